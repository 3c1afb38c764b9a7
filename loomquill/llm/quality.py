"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees in a cycle over the features: each round gives
every feature one small tree on its own bins, fitted to the gradients that are
left, and adds its leaves, shrunk, to that feature's lookup table.  Then the
pairs whose four-quadrant split removes most of what is left get tables of
their own, boosted the same way.  A score is the intercept plus one table entry
for each feature and pair: bin, look up, add.

Features come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import text as T
from .spark import crc_mod, need

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "end_mark", "pipe", "same_as_last", "distinct_words",
    "distinct_triples", "short_words", "line_words", "distinct_lines", "top_word", "long_words", "wide_bytes", "capital_words", "bang",
)


def _classes(*chars: int | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for c in chars:
        out[c if isinstance(c, int) else np.array(c)] = True
    return out


_UPPER, _DIGIT = _classes(range(65, 91)), _classes(range(48, 58))
_PLAIN = _classes(range(48, 58), range(65, 91), range(97, 123), range(128, 256), 32, 9, 10, 13, 46, 44, 39, 45, 33, 63, 58, 59, 124)
_END, _PIPE, _WIDE, _BANG = _classes(46, 63), _classes(124), _classes(range(128, 256)), _classes(33)


def _distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many different values it has, and how often the commonest stands."""
    n = len(off) - 1
    if not len(values):
        return np.zeros(n), np.zeros(n)
    row = np.repeat(np.arange(n), np.diff(off))
    # Rows in the high bits: one sort instead of two; 40 bits of hash are enough for ratios.
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits)
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of = (key[new] >> (np.uint64(64) - bits)).astype(np.int64)
    size = np.diff(np.append(new, len(key)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, size)
    return np.bincount(of, minlength=n).astype(float), top.astype(float)


def features(column: pa.Array) -> np.ndarray:
    """One row of `FEATURES` for each text; ratios of nothing are 0."""
    parts = [_features(column.slice(a, b - a)) for a, b in T.pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(column: pa.Array) -> np.ndarray:
    buf, off = T.as_bytes(column)
    n = len(off) - 1
    starts, ends, of = T.words(buf, off, T.NOT_SPACE)
    size, count = ends - starts, np.diff(of)
    total, nwords = np.maximum(np.diff(off), 1), np.maximum(count, 1)

    def share(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which[buf], dtype=np.int64)])
        return np.diff(sums[off]) / total

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[of]) / nwords

    h = T.word_hashes(buf, starts, ends)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        same[of[:-1][count > 0]] = False
    different, top = _distinct(h, of)
    triples, tof = T.shingles(h, of, 3)
    different3, _ = _distinct(triples, tof)
    not_break = np.ones(256, bool)
    not_break[10] = False
    lstarts, lends, lof = T.words(buf, off, not_break)
    lines, _ = _distinct(T.word_hashes(buf, lstarts, lends), lof)
    nlines = np.maximum(np.diff(lof), 1)
    first = buf[starts] if len(starts) else np.zeros(0, np.uint8)
    return np.column_stack(
        [
            np.log1p(count), per_word(size), share(_UPPER), share(_DIGIT), share(~_PLAIN), share(_END) * total / nwords, share(_PIPE), per_word(same), different / nwords,
            different3 / np.maximum(np.diff(tof), 1), per_word(size <= 3), np.log1p(nwords / nlines), lines / nlines, top / nwords, per_word(size > 16), share(_WIDE), per_word(_UPPER[first]), share(_BANG),
        ]
    ).reshape(n, len(FEATURES))


@dataclass
class AdditiveModel:
    """Intercept, bin edges and lookup tables; a few thousand numbers whatever the data."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).reshape(len(x), len(self.edges))

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Newton leaf values, one for each bin, of a small tree over the bins' gradient and hessian sums."""
    out = np.full(len(g), g.sum() / (h.sum() + 1))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g), np.cumsum(h)
        lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + 1) + rg**2 / (rh + 1), -np.inf)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > cg[-1] ** 2 / (ch[-1] + 1) + 1e-9:
            out[:cut], out[cut:] = _tree(g[:cut], h[:cut], depth - 1, least), _tree(g[cut:], h[cut:], depth - 1, least)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best split of a bin grid into four quadrants: leaf values and gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quads.append((cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + a, ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + b))
    gain = sum(x**2 / (y + 1) for x, y in quads) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    gain = np.where(sum((y >= least).astype(int) for _, y in quads) >= 3, gain, -np.inf)
    if not gain.size or not np.isfinite(gain.max()):
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows, cols, (x, y) in zip((slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(None, j + 1), slice(j + 1, None)) * 2, quads):
        out[rows, cols] = x[i, j] / (y[i, j] + 1)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, depth: int = 2, least: float = 2.0) -> AdditiveModel:
    """Cyclic boosting on features ``x`` and labels ``y`` (0 or 1).  Without rows, or with one class only, the score is the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), depth, least)
            table += step
            logit += step[b[:, j]]
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((-_pair_tree(grid(i, j, g), grid(i, j, h), least)[1], i, j) for i in range(x.shape[1]) for j in range(i)))[:pairs]
    model.pairs = [(i, j) for gain, i, j in gains if gain < 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), least)[0]
            table += step
            logit += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 5) -> AdditiveModel:
    """Fits on labelled rows outside fold 0 (crc32 of the id as text, modulo ``folds``).

    At most ``sample`` labelled ids are used, those of smallest hash: the
    documented bound on what reaches the driver (20,000 rows of 18 numbers).
    Labels that are null, or contradict each other on one id, are left out.
    """
    known = need(labels, doc_id="long", quality="int").filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(crc_mod(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).filter("quality = high")
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = need(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", "y", *FEATURES])

    made = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES))
    # A repeated id counts once, as the least of its rows, so the model is fixed; at most ``sample`` rows reach the driver.
    one = made.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"), F.max("y").alias("y")).select("doc_id", "y", "x.*")
    got = one.toPandas().sort_values("doc_id")
    return fit(got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """Each row's ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    Returns ``doc_id, score, predicted``, with ``keep`` also ``row``, a struct of
    all columns of ``docs`` whatever their names.  Null text is scored as empty;
    texts of any length are scored whole; repeated rows and null ids pass
    through; an empty table gives an empty one.
    """
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct("*").alias("row")] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *([batch.column(2)] if keep else [])],
                names=["doc_id", "score", "predicted", *["row"] * keep],
            )

    fields = [StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return sent.mapInArrow(run, StructType(fields + [f for f in sent.schema.fields if f.name == "row"]))
