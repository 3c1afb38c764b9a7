"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``, whatever further ones there are and however
they are named: each stage carries a row as one struct and gives it back.  Whoever runs the stages may write each
result and read it again as the next one's ``docs``; `run` does so in the
session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquill.llm import decontaminate, neardup, pieces, quality, secrets
from loomquill.llm.queries import table, tokenizer_path
from loomquill.llm.spark import shared_checkpoint


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go.

    Null texts are scored as empty; repeated rows share one fate; null ids are
    scored and never learnt from; an empty table stays empty.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=True).filter("predicted = 1").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the smallest id; of repeated rows of it, one.

    Null texts are empty ones and alike; null ids stay only where no other id is
    in the class; texts without words are alike only if equal; an empty table
    stays empty.

    The winners' (id, text key) pairs are distinct, and so are the rows that
    meet them once equal rows are counted as one.  Rows are dealt by both, so
    copies of one text under many ids meet in no one task.
    """
    first = neardup.near_duplicates(docs).filter("is_first").select(F.col("doc_id").alias("id"), "text_key").distinct()
    by_id = lambda id: {"number": F.coalesce(id, F.lit(0)), "nameless": id.isNull()}
    keyed = docs.select(F.struct("*").alias("row")).withColumns({"text_key": neardup.text_key("row.text")} | by_id(F.col("row.doc_id").cast("long")))
    both = ["text_key", "number", "nameless"]
    # Equal rows are counted as one in the partitions that the join has made.
    return keyed.join(first.withColumns(by_id(F.col("id"))).select(both), both).dropDuplicates(both).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts hold nothing; rows of one id are judged by their own texts; null
    ids are an id of their own; an empty table or benchmark changes nothing.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    bad = found.select(F.col("doc_id").alias("id"), "text_hash").distinct()
    keyed = docs.select(F.struct("*").alias("row")).withColumn("hash", F.xxhash64(F.col("row.text").cast("string")))
    same = (F.col("hash") == F.col("text_hash")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("id"))
    return keyed.join(bad, same, "left_anti").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; every document stays.  Null texts stay null; an empty table stays empty."""
    clean = secrets.redact(secrets.scan_secrets(docs, keep=True))
    return clean.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, checked by decoding them; `pieces.decode` gives their texts back.

    Null texts are empty ones; repeated rows and null ids pass through; other columns are left out; an empty table stays empty.
    """
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The quality classifier's score, the samples and the segmentation have no SQL form; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results of the filtering ones are cut from their lineage in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_checkpoint(docs)
    return docs
