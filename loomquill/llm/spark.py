"""Small helpers shared by the operators: shared storage, keys, schemas."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, set as the checkpoint folder.

    Where that is unset a folder of our own is used on a single machine; on a
    cluster this raises, as no folder of the driver's machine is one that
    executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="loomquill-checkpoint-"))
    return sc.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the cluster's shared folder.

    A checkpoint keeps the size that was estimated for its plan.  Estimates of
    joins are products, so in a loop they grow to numbers of millions of digits;
    the rows are therefore taken over without them, and adaptive execution goes
    by what it measures.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a table written in the cluster's shared folder.

    Columns are packed there, so large results take less room than a checkpoint;
    the files stay until that folder is cleaned.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def need(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; everything else is left out, so no name can clash."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def give_back() -> None:
    """Returns what this process has freed to the machine; an idle worker else keeps the pages of its largest task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the text of nothing."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
