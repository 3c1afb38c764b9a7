"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows (``width`` consecutive words, or all words of a shorter item)
are looked for in documents.  A window is contained only if all its words are,
so one prefix token is necessary and enough: its rarest word, by how often the
words of the benchmark stand in all documents.  Documents' words are joined with
these anchors; a meeting fixes where the window would begin, which bounds it by
position and length; then the words themselves are compared, all of them.

The joined side is the benchmark's distinct windows.  They are broadcast in
blocks of at most ``most`` windows and 64 MB; a benchmark beyond that takes
several passes over the documents.  Document words never leave the row they stand in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import need, shared_checkpoint

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but digits, a-z and characters beyond ASCII.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z (and nothing else) lower-cased.  ``lower`` does just that where all is ASCII, at a fraction of ``translate``'s cost."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, _UP, _LOW))
    return F.array_remove(F.split(lowered, _GAP), "")


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """``item_id, window``: the item's windows as word arrays.  Items without an id or words have none."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w")).filter("item_id is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(width)))).alias("window")).distinct()


#: No broadcast is larger than this in bytes of its words, but for a single row.
_BYTES = 64 << 20


def _blocks(rows: DataFrame, size: Column, most: int) -> int:
    """In how many blocks ``rows`` are broadcast: ``most`` rows and `_BYTES` of ``size`` each."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(1, -(-n // most), -(-total // _BYTES))


def occurrences(docs: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """How often each of ``words`` (``word``, distinct) stands in all documents: ``word, n``."""
    blocks = _blocks(words, F.octet_length("word"), most)
    text = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    parts = [text.join(F.broadcast(words.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)), "word").groupBy("word").agg(F.count("*").alias("n")) for b in range(blocks)]
    return words.join(reduce(DataFrame.unionByName, parts), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(docs: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """Distinct windows with their rarest word: ``window, size, anchor, lead`` (words before the anchor; ties to the first place)."""
    words = windows.select(F.explode("window").alias("word")).distinct()
    rarity = occurrences(docs, words, most)
    distinct = windows.select("window").distinct()
    placed = distinct.select("window", F.posexplode("window").alias("lead", "word"))
    ranked = placed.join(rarity, "word").groupBy("window").agg(F.min(F.struct("n", "lead", "word")).alias("r"))
    return ranked.select("window", F.size("window").alias("size"), F.col("r.word").alias("anchor"), F.col("r.lead").alias("lead"))


def contained(docs: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """Every place of a window in a document: ``doc_id, text_hash, start, size, window`` (words from 0)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    at = rows.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "anchor"))
    blocks = _blocks(anchors, F.octet_length(F.concat_ws("", "window")), most)

    def part(b: int) -> DataFrame:
        block = anchors.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) if blocks > 1 else anchors
        met = at.join(F.broadcast(block), "anchor")
        start = F.col("pos") - F.col("lead")
        met = met.filter((start >= 0) & (start + F.col("size") <= F.size("words")))
        met = met.filter(F.slice("words", start + 1, F.col("size")) == F.col("window"))
        return met.select("doc_id", "text_hash", start.alias("start"), "size", "window")

    return reduce(DataFrame.unionByName, [part(b) for b in range(blocks)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, most: int = 200_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, n_items, item_ids`` (sorted as strings), ``contaminated``.

    Null texts have no words and are clean; repeated rows get one result each,
    all the same; null ids are ids of their own; an empty benchmark hits
    nothing; benchmark rows without id or words take no part, and rows with the
    same id are one item; other columns are left out.
    """
    d = need(docs, doc_id="long", text="string")
    windows = windows_of(need(benchmark, item_id="long", text="string"), width)
    anchors = shared_checkpoint(anchored(d, windows, most))
    hits = shared_checkpoint(contained(d, anchors, most).distinct())
    key = ["doc_id", "text_hash"]
    # Distinct words hit: the length of the union of intervals, swept in order.
    sweep = F.aggregate(F.array_sort("at"), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda acc, x: F.struct(F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n")))
    hit_words = hits.groupBy(*key).agg(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))).alias("at")).select(*key, sweep["n"].cast("long").alias("n_hit"))
    items = hits.select(*key, "window").distinct().join(windows, "window").groupBy(*key).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    rows = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    found = hit_words.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}).join(items.withColumnsRenamed({"doc_id": "d2", "text_hash": "h2"}), F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))).drop("d2", "h2")
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_hash"] == F.col("h")), "left")
    ids = F.coalesce(F.array_sort("ids"), F.expr("cast(array() as array<string>)"))
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
