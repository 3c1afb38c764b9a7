"""What two similar word sets must share, from one row each: rare words, and a sketch that bounds their overlap.

Only these rows and the texts of pairs that pass are dealt out, never all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

#: log2 of the buckets that words are counted in, one byte each; what shares a bucket has one rank, which costs time and loses nothing.
_BITS = 22
_REST = np.uint64((1 << 56) - 1)
_SKETCH = ("s0", "s1", "s2", "s3")


def _hashes(text: Column) -> Column:
    """Hashes of all lower-cased words of a text, repeated ones included."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""), lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    off, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield values[a:b]


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int32)


def ranks(texts: DataFrame, text: str) -> np.ndarray:
    """By bucket: 0 where at most one row has a word of it, else eighths of a doubling of the rows that have one, exactly counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _BITS, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal n
            n += np.bincount(np.concatenate(held), minlength=len(n))

        for batch in batches:
            for h in _lists(batch.column(0)):
                held.append(np.unique(_buckets(h)))
                size += len(held[-1])
                if size > len(n):
                    add()
                    held, size = [], 0
        if held:
            add()
        for part in np.array_split(np.flatnonzero(n), 64):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part])], names=["bucket", "n"])

    counted = texts.select(_hashes(F.col(text))).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rank = F.least(F.lit(255), F.lit(1) + F.floor(F.log2("n") * 8)).cast("short")
    got = counted.filter("n > 1").select("bucket", rank.alias("rank")).toArrow()
    out = np.zeros(1 << _BITS, np.uint8)
    out[got["bucket"].to_numpy()] = got["rank"].to_numpy()
    return out


def signed(texts: DataFrame, id: str, text: str, least: float, *block: str) -> DataFrame:
    """Per row: ``block..., id, key`` (the text's), ``size`` (of its word set), ``skipped``, ``prefix``, ``s0`` to ``s3``.

    ``prefix`` has the first ``size - ceil(least * size) + 1`` words in the order
    of rarity, each as a number, without the first ``skipped`` ones, which no
    other row has.  The sketch has 256 bits, each the parity of the words that
    fall on it.  Rows without words are left out.
    """
    sent = texts.sparkSession.sparkContext.broadcast(ranks(texts, text))
    width = len(block) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            rows, sizes, skipped, prefix, sketches = [], [], [], [], []
            for k, h in enumerate(_lists(batch.column(width))):
                if not len(h):
                    continue
                words = np.sort((rank[_buckets(h)].astype(np.uint64) << np.uint64(56)) | (h & _REST))
                words = words[np.append(True, words[1:] != words[:-1])]
                n = len(words)
                first = words[: n - int(np.ceil(least * n - 1e-9)) + 1]
                alone = int(np.searchsorted(first, _REST, side="right"))
                rows.append(k)
                sizes.append(n)
                skipped.append(alone)
                prefix.append(first[alone:])
                sketches.append(np.packbits((np.bincount(((words >> np.uint64(8)) & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)))
            if not rows:
                continue
            off = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            sketch = np.concatenate(sketches).view(np.int64).reshape(-1, 4)
            made = [pa.array(sizes, pa.int64()), pa.array(skipped, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefix).view(np.int64)))]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in batch.columns[:width]] + made + [pa.array(sketch[:, j].copy()) for j in range(4)], names=out.names)

    rows = texts.select(*block, F.col(id).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("key"), _hashes(F.col(text)).alias("h"))
    numbers = [StructField(x, LongType()) for x in ("size", "skipped")] + [StructField("prefix", ArrayType(LongType()))] + [StructField(x, LongType()) for x in _SKETCH]
    out = StructType([f for f in rows.schema.fields if f.name in (*block, "id")] + [StructField("key", BinaryType())] + numbers)
    return rows.mapInArrow(run, out)


def may_be_similar(rows: DataFrame, least: float, *block: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of `signed` rows whose sets may be over ``least``: all that are, few that are not."""
    one = rows.groupBy(*block, "key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "skipped", "prefix", *_SKETCH)]).filter("id is not null")
    words = one.select(*block, "id", "size", "skipped", *_SKETCH, F.posexplode("prefix").alias("at", "word"))

    def side(x: str) -> DataFrame:
        # Words from this one on: those before it are not in the other text, if this is the first that both have.
        left = (F.col("size") - F.col("skipped") - F.col("at")).cast("int")
        return words.select(*block, "word", F.col("id").alias(f"id_{x}"), F.col("size").cast("int").alias(f"size_{x}"), left.alias(f"left_{x}"), *[F.col(s).alias(f"{s}_{x}") for s in _SKETCH])

    both = F.col("size_a") + F.col("size_b")
    needed = both * F.lit(least / (1 + least)) - F.lit(1e-6)
    differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _SKETCH), F.lit(0))
    near = (F.least("size_a", "size_b") > F.lit(least) * F.greatest("size_a", "size_b")) & (F.least("left_a", "left_b") > needed) & ((both - differ) / 2 > needed)
    return side("a").join(side("b"), [*block, "word"]).filter((F.col("id_a") < F.col("id_b")) & near).select("id_a", "id_b").distinct()


def compared(pairs: DataFrame, texts: DataFrame, id: str, text: str, side: int = 300) -> DataFrame:
    """``id_a, id_b, similarity``: the Jaccard similarity of the pairs' word sets, each word told by 64 bits.

    Pairs of one neighbourhood meet in a cell, and those of a large one in
    blocks of some ``side * side`` pairs, so a text is dealt out once for each
    cell, not for each pair.
    """
    low = pairs.groupBy(F.col("id_b").alias("id_a")).agg(F.min("id_a").alias("hub"))
    near = pairs.join(low, "id_a", "left").withColumn("hub", F.coalesce("hub", "id_a"))
    blocks = near.groupBy("hub").agg(F.ceil(F.sqrt(F.count("*")) / side).alias("blocks"))
    block = lambda x: F.pmod(F.xxhash64(x), "blocks")
    cells = 8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = near.join(blocks, "hub").select("id_a", "id_b", F.pmod(F.xxhash64("hub", block("id_a"), block("id_b")), F.lit(cells)).alias("cell"))
    dealt = placed.select(F.col("cell").alias("of"), F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    said = dealt.join(texts.select(F.col(id).alias("id"), F.col(text).alias("text")), "id").select("of", "id", F.array_distinct(_hashes(F.col("text"))).alias("h"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = dict(zip(right["id"].to_pylist(), (np.unique(h) for c in right["h"].chunks for h in _lists(c))))
        out = []
        for a, b in zip(left["id_a"].to_pylist(), left["id_b"].to_pylist()):
            x, y = words[a], words[b]
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out.append(both / (len(x) + len(y) - both))
        return left.select(["id_a", "id_b"]).append_column("similarity", pa.array(out, pa.float64()))

    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    schema = StructType([StructField(x, kinds[x]) for x in ("id_a", "id_b")] + [StructField("similarity", DoubleType())])
    return placed.groupBy("cell").cogroup(said.groupBy("of")).applyInArrow(run, schema)
