"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Everything is a Spark SQL expression on the row's own text: no shuffle, no
Python.  Rows without a candidate cost two regular-expression passes.

Base kinds are plain patterns.  The entropy kind takes each candidate string (a
long run of key characters holding letters and digits), picks the character
class it is made of, and slides a window over it.  Counts of the window's
characters are kept up incrementally: one enters, one leaves, and the sum of
c log2 c changes by these two counts alone.  Windows at or over the class's
entropy threshold give a span from the first such window's start to the last
one's end.  Candidates that fit the allow-list, and spans inside a base span,
are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import need

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Character classes, the first that fits counts, and their thresholds in bits for a window of 20.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^", 3.7))
#: Not secrets: UUIDs, things named as examples, runs of the alphabet or of digits, paths and joined lower-case words.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^[a-z0-9]{1,15}([-_/][a-z0-9]{1,15}){2,}$",
)
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """For each element of an array of (gap, size): its start, the sum of all gaps and sizes before it plus its own gap.

    Blocks keep the copying of growing arrays small: an array of n elements
    costs about n * n / 256 instead of n * n / 2 moves.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        return F.struct((start + x["size"]).alias("pos"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + x["size"]).alias("end"))).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK)), F.struct(acc["pos"].alias("pos"), empty.alias("out")), step)
        return F.struct(part["pos"].alias("pos"), F.concat(acc["out"], part["out"]).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), empty.alias("out")), block)["out"]


def matches(text: Column, regex: str) -> Column:
    """All leftmost, non-overlapping matches of ``regex`` with positions: array of (start, end, found), in code points."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    lengths = F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)), found, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("size")))
    places = F.when(F.size(found) > 0, _running(lengths)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    return F.zip_with(places, found, lambda p, x: F.struct(p["start"].alias("start"), p["end"].alias("end"), x.alias("found")))


def _entropy_range(found: Column) -> Column:
    """First and last index (of a window's last character) at which the window over ``found`` reaches its class's threshold."""
    chars = F.filter(F.split(found, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    least = F.lit(CLASSES[-1][2])
    for _, regex, bits in reversed(CLASSES[:-1]):
        least = F.when(found.rlike(regex), F.lit(bits)).otherwise(least)

    def f(c: Column) -> Column:
        return F.element_at(cost, c + 1)

    def step(acc: Column, i: Column) -> Column:
        enters = F.element_at(acc["codes"], i)
        leaves = F.when(i > WINDOW, F.element_at(acc["codes"], F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
        c_in = F.element_at(acc["counts"], enters)
        c_out = F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
        # A character that enters and leaves at once changes nothing.
        total = F.when(enters == leaves, acc["total"]).otherwise(acc["total"] + f(c_in + 1) - f(c_in) + F.when(leaves > 0, f(F.greatest(c_out - 1, F.lit(0))) - f(c_out)).otherwise(0.0))
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j + 1 == enters, 1).otherwise(0) - F.when(j + 1 == leaves, 1).otherwise(0))
        high = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= acc["least"] - 1e-9)
        return F.struct(
            acc["codes"].alias("codes"), counts.alias("counts"), total.alias("total"), acc["least"].alias("least"),
            F.when(high & (acc["first"] == 0), i).otherwise(acc["first"]).alias("first"), F.when(high, i).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), least.alias("least"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(found)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _span(rank: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Adds ``base`` and ``spans``: sorted arrays of (start, rank in `KINDS`, end), code points, end exclusive.

    Returns ``doc_id`` and ``text`` beside them, with ``keep`` also ``row``, a
    struct of all columns whatever their names.  Null text has no spans; texts of
    any length are scanned whole; repeated rows and null ids pass through; an
    empty table gives an empty result.
    """
    kept = ["row"] * keep
    rows = docs.select(F.col("doc_id"), F.col("text"), *[F.struct("*").alias("row")] * keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    t = F.col("__t")
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    has_run = t.rlike(CANDIDATE.replace("{20,}", "{20}"))
    found = rows.withColumns(
        {
            "__assign": F.when(t.rlike(ASSIGN), matches(t, ASSIGN)).otherwise(none),
            "__access": F.when(has_run & F.contains(t, F.lit("AKIA")), matches(t, ACCESS)).otherwise(none),
            "__hex": F.when(has_run, F.when(t.rlike(HEX), matches(t, HEX)).otherwise(none)).otherwise(none),
            "__cand": F.when(has_run, matches(t, CANDIDATE)).otherwise(none),
        }
    )
    assign = F.transform(F.filter("__assign", lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 1)) >= ASSIGN_LEAST), lambda m: _span(0, m["start"], m["end"]))
    access = F.transform(F.filter("__access", lambda m: F.length(m["found"]) >= ACCESS_LEAST), lambda m: _span(1, m["start"], m["end"]))
    hexes = F.transform("__hex", lambda m: _span(2, m["start"], m["end"]))

    def suspicious(m: Column) -> Column:
        allowed = F.lit(False)
        for regex in ALLOW:
            allowed = allowed | m["found"].rlike(regex)
        return m["found"].rlike("[0-9]") & m["found"].rlike("[A-Za-z]") & ~allowed

    ranged = F.transform(F.filter("__cand", suspicious), lambda m: F.struct(m["start"].alias("start"), _entropy_range(m["found"]).alias("r")))
    high = F.transform(F.filter(ranged, lambda x: x["r"]["first"] > 0), lambda x: _span(3, x["start"] + x["r"]["first"] - WINDOW, x["start"] + x["r"]["last"]))
    found = found.withColumns({"base": F.array_sort(F.concat(assign, access, hexes)), "__high": high})
    beyond = F.filter("__high", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    found = found.withColumn("spans", F.array_sort(F.concat("base", beyond)))
    return found.select("doc_id", "text", *kept, "base", "spans")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scanned table."""
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``; rows without spans stay as they are."""
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise("")).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(text)).drop("base", "spans")
