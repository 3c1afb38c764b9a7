"""Near-duplicate classes by improved consistent weighted sampling.

A text is the bag of its five-word shingles, weighted TF-IDF: term frequency
times ``1 + spread * ln(1 / share) / ln(1 / least)``, where ``share`` is the share
of all rows the shingle stands in, taken as ``least`` (one row in a hundred) where
it is smaller.  Shingles over ``least`` are counted exactly; there are at most
``1 / least`` times a row's mean number of shingles of them, whatever the corpus,
and a shingle's weight depends on its share alone, so all sizes behave alike.

1. Texts that are equal are one text from here on.
2. Improved consistent weighted sampling draws ``bands * rows`` samples of a
   text; two texts draw the same one with the probability of their weighted
   Jaccard similarity.  ``rows`` samples make a band key.
3. Texts that share a band key are candidates.  Their components, never their
   pairs, are made.
4. A task verifies the exact weighted Jaccard similarity of all pairs of one
   component's texts, or of one block of a large component's.  It returns one row
   a text, which names the text of most neighbours in the text's class.  These
   representatives go to the next round, where those of most neighbours meet all
   others, so links and dealt rows follow a group's size, not its square.
5. Where representatives of a large component stay apart, members may still be
   linked.  Its texts meet again on the shingles of a weighted prefix, the rarest
   first: texts as alike as the threshold share one, and texts that have only a
   common passage do not.  What meets is verified, all pairs of different classes.
6. The components of verified links are the classes.

A pair of similarity 0.8 shares no band with probability (1 - 0.8^3)^16 = 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .spark import need, partitions, shared_checkpoint

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 3
#: How much more a rare shingle weighs than one that stands in all rows, and the share below which all are equally rare.
SPREAD, LEAST = 0.15, 0.01
#: Postings up to this length are paired one by one, longer ones by matrix products.
_SHORT = 16
#: Labels of large components that are broadcast: some 10 MB.
_MOST_LABELS = 100_000


def text_key(column: str = "text"):
    """A text's 128-bit key; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")))


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingle hashes, ascending, and their frequencies."""
    for a, b in T.pieces(column):
        buf, off = T.as_bytes(column.slice(a, b - a))
        buf = T.LOWER[buf]
        starts, ends, of = T.words(buf, off, T.ALNUM)
        made, at = T.shingles(T.word_hashes(buf, starts, ends), of, SHINGLE)
        for k in range(b - a):
            yield np.unique(made[at[k] : at[k + 1]], return_counts=True)


class Weights:
    """IDF by exact shingle: a table of the common ones, of bounded size whatever the corpus; all others weigh ``1 + spread``."""

    _BITS = 18

    def __init__(self, shares: dict[int, float] | None = None, spread: float = SPREAD, least: float = LEAST):
        found = sorted((shares or {}).items())
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.top = np.float32(1 + spread)
        self.idf = np.array([1 + spread * np.log(max(x, least)) / np.log(least) for _, x in found], np.float32)
        self.may_be = np.zeros(1 << self._BITS, bool)
        self.may_be[self._bits(self.hashes)] = True

    def _bits(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self._BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are in the table, and where."""
        maybe = np.flatnonzero(self.may_be[self._bits(h)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        return maybe[hit], at[hit]

    def of(self, h: np.ndarray) -> np.ndarray:
        """The shingles' IDF."""
        out = np.full(len(h), self.top, np.float32)
        spots, at = self.find(h)
        out[spots] = self.idf[at]
        return out

    def log(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return np.log(self.of(h)) + np.log(tf).astype(np.float32)


def common_shingles(docs: DataFrame, least: float = LEAST, most_held: int = 1 << 20) -> dict[int, float]:
    """Shingles that stand in more than ``least`` of all rows, and the exact share of rows.

    First every task counts its own rows and leaves out what stands in no more
    than half of ``least`` of them; what is over ``least`` of all rows stays in
    some task, and all that is left out of it is under half of that.  Then these
    candidates, at most ``2 / least`` times the mean number of a row's shingles,
    are counted in all rows.
    """
    total = docs.count()
    if not total:
        return {}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = rows = 0

        def packed() -> tuple[np.ndarray, np.ndarray]:
            """What has been held, added to what is known."""
            h, n = np.unique(np.concatenate(held), return_counts=True)
            every, at = np.unique(np.concatenate([known, h]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([seen, n]), len(every)).astype(np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            keep = seen > int(least * rows / 2)
            yield pa.RecordBatch.from_arrays([pa.array(known[keep].view(np.int64)), pa.array(seen[keep])], names=["h", "n"])

        for batch in batches:
            for h, _ in bags(batch.column(0)):
                held.append(h)
                size, rows = size + len(h), rows + 1
                if size > most_held:
                    known, seen = packed()
                    held, size = [], 0
                    # Enough rows to leave much out, or so few and long ones that all must go on.
                    if rows * least >= 20 or len(known) > 2 * most_held:
                        yield from close()
                        known, seen, rows = known[:0], seen[:0], 0
        if held:
            known, seen = packed()
        if rows:
            yield from close()

    text = need(docs, text="string")
    likely = text.mapInArrow(parts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > least * total / 2).select("h").collect()
    if not likely:
        return {}
    sought = docs.sparkSession.sparkContext.broadcast(Weights({h: 1.0 for h in np.array([r.h for r in likely], np.int64).view(np.uint64).tolist()}))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sought.value
        n = np.zeros(len(table.hashes), np.int64)
        for batch in batches:
            for h, _ in bags(batch.column(0)):
                n += np.bincount(table.find(h)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["k", "n"])

    counted = text.mapInArrow(exact, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") > least * total).collect()
    out = {int(sought.value.hashes[r.k]): r.n / total for r in counted}
    sought.unpersist()
    return out


def _gamma2() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) distribution, by inverting 1 - (1 + x) exp(-x)."""
    x = np.linspace(0, 30, 600_001)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Draws the samples.  A sample (shingle, level) is told by its hash value ln a, which no other sample of that draw shares but by chance."""

    def __init__(self, draws: int):
        quantiles = _gamma2()
        self.r = quantiles.astype(np.float32)
        self.inverse = (1 / quantiles).astype(np.float32)
        self.log_c = np.log(quantiles).astype(np.float32)
        self.seeds = T.mix(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def draw(self, h: np.ndarray, log_weight: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Samples (texts x draws) of texts whose elements are ``h[off[k]:off[k + 1]]``, none empty."""
        out = np.empty((len(off) - 1, len(self.seeds)), np.uint32)
        low = np.uint64(0xFFFF)
        for i, seed in enumerate(self.seeds):
            u = T.mix(h ^ seed)
            k = (u & low).astype(np.int64)
            beta = ((u >> np.uint64(32)) & low).astype(np.float32) / np.float32(1 << 16)
            level = np.floor(log_weight * self.inverse[k] + beta)
            log_a = self.log_c[((u >> np.uint64(16)) & low).astype(np.int64)] - self.r[k] * (level - beta + np.float32(1))
            out[:, i] = np.minimum.reduceat(log_a, off[:-1]).view(np.uint32)
        return out


def signatures(docs: DataFrame, weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``doc_id, key, shingles`` (how many) and ``band_keys`` (null for texts without words)."""
    names = ["doc_id", "key", "shingles", "band_keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, w = Sampler(bands * rows), weights.value
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                got = list(bags(part.column(2)))
                full = [k for k, (h, _) in enumerate(got) if len(h)]
                keys: list = [None] * len(got)
                if full:
                    h = np.concatenate([got[k][0] for k in full])
                    off = np.concatenate([[0], np.cumsum([len(got[k][0]) for k in full])])
                    drawn = sampler.draw(h, w.log(h, np.concatenate([got[k][1] for k in full])), off).astype(np.uint64)
                    made = np.column_stack([T.row_hash64(b, drawn[:, b * rows : (b + 1) * rows]) for b in range(bands)]).view(np.int64)
                    for k, row in zip(full, made.tolist()):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(h) for h, _ in got], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    rows_in = need(docs, doc_id="long", text="string")
    return rows_in.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key binary, shingles long, band_keys array<bigint>")


def _shared(got: list[tuple[np.ndarray, np.ndarray]], w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The weight that each two texts share (texts x texts), and each text's own."""
    n = len(got)
    of = np.repeat(np.arange(n), [len(h) for h, _ in got])
    every, place, spread = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True, return_counts=True)
    idf, tf = w.of(every).astype(float), np.concatenate([c for _, c in got]).astype(float)
    own = np.bincount(of, tf * idf[place], n)
    order = np.argsort(place, kind="stable")
    order = order[spread[place[order]] > 1]  # a shingle of one text is shared by none
    place, of, tf = place[order], of[order], tf[order]
    # Short postings: pairs at every distance within a posting.
    few = spread[place] <= _SHORT
    e, t, f = place[few], of[few], tf[few]
    out = np.zeros((n, n))
    for d in range(1, _SHORT):
        same = np.flatnonzero(e[d:] == e[:-d]) if d < len(e) else np.zeros(0, np.int64)
        if not len(same):
            break
        out += np.bincount(t[same] * n + t[same + d], np.minimum(f[same], f[same + d]) * idf[e[same]], n * n).reshape(n, n)
    out += out.T.copy()
    # Long ones: those of single occurrences by matrix products, the others one by one.
    e, t, f = place[~few], of[~few], tf[~few]
    if len(e):
        columns, column, size = np.unique(e, return_inverse=True, return_counts=True)
        once = np.bincount(column, f) == size
        for at in range(0, len(columns), 512):
            mine = (column >= at) & (column < at + 512) & once[column]
            dense = np.zeros((n, min(512, len(columns) - at)))
            dense[t[mine], column[mine] - at] = np.sqrt(idf[e[mine]])
            out += dense @ dense.T
        begins = np.concatenate([[0], np.cumsum(size)])
        for k in np.flatnonzero(~once):
            a, b = begins[k], begins[k + 1]
            out[np.ix_(t[a:b], t[a:b])] += np.minimum.outer(f[a:b], f[a:b]) * idf[columns[k]]
    return out, own


def _classes(got: list[tuple[np.ndarray, np.ndarray]], roots: list[bytes], w: Weights, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's class (texts of one root are one) and number of neighbours."""
    shared, own = _shared(got, w)
    near = shared >= (threshold - 1e-9) * (own[:, None] + own[None, :] - shared)
    np.fill_diagonal(near, False)
    _, root = np.unique(np.array(roots, object), return_inverse=True)
    root = root.astype(np.int32)
    label = root.copy()
    while True:
        # The smallest label among neighbours, then the smallest within a root.
        low = np.where(near, label[None, :], np.int32(len(got))).min(axis=1, initial=len(got))
        low = np.minimum(low, label)
        best = np.full(root.max() + 1, len(got), np.int32)
        np.minimum.at(best, root, low)
        if (best[root] == label).all():
            return label, near.sum(axis=1)
        label = best[root]


_CELL = "label binary, a binary, b binary, open boolean, near long, shingles long, text string"


def verified(texts: DataFrame, weights, threshold: float) -> DataFrame:
    """One row for each root in each cell: ``label, a, b, open, near, shingles, text``.

    ``texts``: ``cell, key, root, label, open, shingles, text``.  ``a`` is the
    root and ``b`` the root of the text of most neighbours in its class; where
    they are the same and the label is ``open``, the row also has that text;
    ``near`` is its number of neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        cell = None
        out: list[tuple] = []

        def close() -> None:
            rows = list(held.items())
            label, near = _classes(list(bags(pa.array([x[4] for _, x in rows], pa.large_string()))), [x[0] for _, x in rows], weights.value, threshold) if len(rows) > 1 else (np.zeros(1, int), np.zeros(1, int))
            best: dict[int, int] = {}
            for k in np.lexsort((np.arange(len(rows)), -near)).tolist():
                best.setdefault(int(label[k]), k)
            done = set()
            for k, (_, (root, name, more, _, _)) in enumerate(rows):
                if root not in done:
                    done.add(root)
                    to = rows[best[int(label[k])]][1]
                    out.append((name, root, to[0], more, int(near[best[int(label[k])]]), to[3], to[4] if more and root == to[0] else None))

        def packed() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _CELL.split(", ")])

        for batch in batches:
            for here, key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if here != cell:
                    if held:
                        close()
                    held, cell = {}, here
                held[key] = tuple(rest)
            if len(out) > 2000:
                yield packed()
                out = []
        if held:
            close()
        if out:
            yield packed()

    dealt = texts.select("cell", "key", "root", "label", "open", "shingles", "text").repartition(partitions(texts.sparkSession), "cell")
    return dealt.sortWithinPartitions("cell", "key").mapInArrow(run, _CELL)


def _cell(*parts: str):
    return F.unhex(F.md5(F.concat_ws(":", F.hex("label"), *parts).cast("binary")))


def _blocks(texts: DataFrame, members: int, shingles: int) -> DataFrame:
    """``texts`` with ``blocks``, how many its label's texts are dealt to, and ``block``, its own."""
    sizes = texts.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("shingles") / shingles)).cast("int").alias("blocks"))
    large = shared_checkpoint(sizes.filter("blocks > 1"))
    # Few labels are large, and the largest one's texts then need not meet in a task.
    near = F.broadcast(large) if large.count() <= _MOST_LABELS else large
    placed = texts.drop("blocks").join(near, "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return placed.withColumn("block", F.pmod(F.xxhash64("key", "blocks"), F.col("blocks")).cast("int"))


def prefixes(texts: DataFrame, weights, threshold: float) -> DataFrame:
    """``label, e, key, root``: each text's prefix shingles, the rarest first, after which less than ``threshold`` of its weight is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = []
                for h, tf in bags(part.column(3)):
                    idf = w.of(h)
                    order = np.lexsort((h, -idf))
                    left = np.cumsum((tf * idf).astype(float)[order][::-1])[::-1]
                    found.append(h[order][left >= (threshold - 1e-6) * left[0]] if len(h) else h)
                row = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in found]))
                e = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), e, part.column(1).take(row), part.column(2).take(row)], names=["label", "e", "key", "root"])

    return texts.select("label", "key", "root", "text").mapInArrow(run, "label binary, e long, key binary, root binary")


def text_links(placed: DataFrame, texts, weights, threshold: float, members: int, shingles: int) -> DataFrame:
    """Links ``a, b`` (keys) whose components are the verified classes.

    ``placed``: the candidates' ``key, label, shingles``; ``texts(keys)`` gives
    those with their ``text``.
    """
    level = texts(_blocks(placed, members, shingles).withColumns({"root": F.col("key"), "open": F.col("blocks") > 1}))
    links, before = None, None
    while True:
        made = shared_checkpoint(verified(level.withColumn("cell", _cell("blocks", "block")), weights, threshold))
        found = made.filter("a <> b").select("a", "b")
        links = found if links is None else links.unionByName(found)
        reps = made.filter("a = b and open").select("label", "open", F.col("a").alias("key"), "near", "shingles", "text")
        if before is not None:
            # Texts that stood in several blocks may have ended in several classes, which are one: the least of these goes on.
            ends = components(found)
            ends = reps.join(ends.select(F.col("node").alias("key"), F.col("label").alias("end")), "key", "left").withColumn("end", F.coalesce("end", "key"))
            best = Window.partitionBy("label", "end").orderBy(F.desc("near"), "key")
            reps = shared_checkpoint(ends.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "end"))
        reps = reps.withColumn("root", F.col("key"))
        apart = shared_checkpoint(reps.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"))
        now = apart.agg(F.sum("n")).first()[0]
        if not now:
            return links
        if before is not None and now > 0.5 * before:
            break
        before = now
        # Next come the representatives, in blocks, and to each block those of most neighbours.
        dealt = shared_checkpoint(_blocks(reps.join(apart.select("label"), "label", "left_semi"), members, shingles))
        first = Window.partitionBy("label").orderBy(F.desc("near"), "key")
        pivots = dealt.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= max(1, members // 10)).drop("r")
        level = dealt.unionByName(pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    # Representatives of ``apart`` are no longer alike, but members of their classes may be.
    so_far = components(links)
    still = placed.join(apart.select("label"), "label", "left_semi").join(so_far.select(F.col("node").alias("key"), F.col("label").alias("root")), "key", "left")
    still = shared_checkpoint(texts(still.withColumn("root", F.coalesce("root", "key"))))
    met = shared_checkpoint(prefixes(still, weights, threshold))
    least = met.groupBy("label", "e").agg(F.min("key").alias("a"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("label", "e", "a")
    group = components(met.join(least, ["label", "e"]).select("a", F.col("key").alias("b")))
    again = _blocks(still.drop("label").join(group.withColumnRenamed("node", "key"), "key"), members, shingles)
    cells = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumns({"cell": _cell("blocks", F.least("block", "other"), F.greatest("block", "other")), "open": F.lit(False)})
    return links.unionByName(shared_checkpoint(verified(cells, weights, threshold)).filter("a <> b").select("a", "b"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, members: int = 500, shingles: int = 500_000, most_broadcast: int = 200_000) -> DataFrame:
    """One row a document: ``doc_id, text_key, class_id, is_first``.

    ``class_id`` is the smallest ``doc_id`` of the document's class, whose texts
    are equal or chained by similarities of ``threshold`` or more; ``is_first``
    marks that one document (one row of it, where rows repeat, cannot be told
    apart: all rows of that id and text are marked).  Texts without words are
    like equal texts only.  Null text counts as empty; null ids join classes but
    never name one, unless all ids are null; an empty table gives an empty
    result; other columns are left out.

    A task verifies at most two blocks of about ``members`` texts and
    ``shingles`` shingles.
    """
    spark = docs.sparkSession
    d = need(docs, doc_id="long", text="string")
    weights = spark.sparkContext.broadcast(Weights(common_shingles(d)))
    signed = shared_checkpoint(signatures(d, weights))
    one = shared_checkpoint(signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("shingles").alias("shingles"), F.max("band_keys").alias("band_keys")))
    # Candidates: each text is tied to the smallest of its bucket.
    band = one.filter("band_keys is not null").select("key", F.posexplode("band_keys").alias("band", "value"))
    least = band.groupBy("band", "value").agg(F.min("key").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    group = components(band.join(least, ["band", "value"]).select("a", F.col("key").alias("b")))
    placed = shared_checkpoint(group.withColumnRenamed("node", "key").join(one.select("key", "first_id", "shingles"), "key"))
    rows = d.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def texts(keys: DataFrame) -> DataFrame:
        # Only one document of each text is read, the first, and only texts that have a candidate are dealt out.
        near = F.broadcast(keys) if placed.count() <= most_broadcast else keys
        return rows.withColumnRenamed("key", "own_key").join(near, (F.col("own_key") == near["key"]) & rows["doc_id"].eqNullSafe(near["first_id"])).select(*keys.columns, "text")

    links = text_links(placed, texts, weights, threshold, members, shingles)
    classes = components(links)
    named = one.join(classes.withColumnRenamed("node", "key"), "key", "left").select("key", "first_id", F.coalesce("label", "key").alias("label"))
    names = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("head"))
    of_text = named.join(names, "label").select("key", "first_id", "class_id", (F.col("head.key") == F.col("key")).alias("heads"))
    out = signed.select("doc_id", "key").join(of_text, "key")
    return out.select("doc_id", F.col("key").alias("text_key"), "class_id", (F.col("heads") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("is_first"))
