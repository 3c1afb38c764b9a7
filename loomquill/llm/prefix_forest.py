"""Nearest neighbours by a hash-prefix forest.

A hash string is a sequence of symbols.  A symbol is the axis that a vector is
nearest to after a random rotation, with its sign: of two vectors at an angle of
63 degrees in 64 dimensions some 6 in 100 symbols agree, of two at random angles
1 in 100.  Symbols come in groups, and every two symbols of a group begin a tree's
string, which the others of the group go on, so a few rotations give many trees.
Each tree keeps the strings of a block of rows as one sorted array.  A query
descends in every tree to the rows of its longest matching prefix; then all trees
ascend together, one symbol at a time, until the union of their prefix ranges
holds ``least`` rows.  These are scored exactly.

Inner products become angles: rows get one more coordinate that lifts them to
the length of the block's longest vector, queries get a zero there.

Scale: rows are reduced to distinct vectors, each with its ``k + 1`` smallest
ids (more can never be among the ``k`` nearest), and hashed into blocks of about
``block`` vectors; queries, a stated set, into blocks of ``query_block``.  A
task holds one block of each, whatever the table's size or its commonest vector,
and makes a block's forest once for all queries of the other.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import shared_checkpoint


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


@functools.lru_cache(maxsize=2)
def _rotations(dim: int, n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)]).astype(np.float32)


def _symbols(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Each row's symbol under each rotation: rotations x rows."""
    x = x.astype(np.float32)
    out = np.empty((len(rotations), len(x)), np.uint32)
    for k, rotation in enumerate(rotations):
        turned = x @ rotation
        axis = np.abs(turned).argmax(axis=1)
        out[k] = 2 * axis + (turned[np.arange(len(x)), axis] > 0)
    return out


class Forest:
    """One block's trees: sorted strings and the rows they belong to."""

    def __init__(self, rows: np.ndarray, groups: int, size: int, depth: int, seed: int = 7):
        norms = np.linalg.norm(rows, axis=1)
        self.scale = norms.max()
        lift = np.sqrt(np.maximum(1 - (norms / self.scale) ** 2, 0))
        self.n, dim = len(rows), rows.shape[1] + 1
        self.bits = max(1, int(2 * dim - 1).bit_length())
        self.depth = max(1, min(depth, size, 32 // self.bits))
        self.rotations = _rotations(dim, groups * size, seed)
        # The symbols of each tree's string: a pair of its group, then those that follow the pair's second in a circle.
        self.trees = [tuple(g * size + x for x in [i, j, *[y for y in ((j + 1 + z) % size for z in range(size)) if y not in (i, j)]][: self.depth]) for g in range(groups) for i in range(size) for j in range(i)]
        symbols = _symbols(np.column_stack([rows / self.scale, lift]), self.rotations)
        self.sorted = np.empty((len(self.trees), self.n), np.uint32)
        self.order = np.empty((len(self.trees), self.n), np.int32)
        for t, tree in enumerate(self.trees):
            strings = self._strings(symbols, tree)
            self.order[t] = np.argsort(strings, kind="stable")
            self.sorted[t] = strings[self.order[t]]

    def _strings(self, symbols: np.ndarray, tree: tuple[int, ...]) -> np.ndarray:
        out = symbols[tree[0]].copy()
        for k in tree[1:]:
            out = (out << np.uint32(self.bits)) | symbols[k]
        return out

    def candidates(self, queries: np.ndarray, least: int, chunk: int = 512):
        """For each query, rows of the block: at least ``least`` of them, or all."""
        q = np.column_stack([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros(len(queries))])
        symbols = _symbols(q, self.rotations)
        for a in range(0, len(q), chunk):
            part = symbols[:, a : a + chunk]
            # How long a prefix each row shares with each query in some tree, one more; found for the longer ones in one go.
            shared = np.zeros((part.shape[1], self.n), np.uint8)
            live = np.arange(part.shape[1])
            for level in (min(2, self.depth), 1):
                self._meet(part, live, level, shared)
                live = live[(shared[live] > level).sum(axis=1) < least]
                if not len(live):
                    break
            for row in shared:
                # The longest prefix that enough rows share, or no prefix at all.
                level = next((k for k in range(self.depth, 0, -1) if (row > k).sum() >= least), 0)
                yield np.flatnonzero(row > level) if level else np.arange(self.n)

    def _meet(self, symbols: np.ndarray, live: np.ndarray, level: int, shared: np.ndarray) -> None:
        """Notes in ``shared`` the rows that share a prefix of ``level`` symbols or more, for the queries ``live``."""
        drop = np.uint64(self.bits * (self.depth - level))
        for t, tree in enumerate(self.trees):
            strings = self._strings(symbols[:, live], tree)
            prefix = strings.astype(np.uint64) >> drop
            low = np.searchsorted(self.sorted[t], (prefix << drop).astype(np.uint32))
            high = np.searchsorted(self.sorted[t], (((prefix + np.uint64(1)) << drop) - np.uint64(1)).astype(np.uint32), side="right")
            met = high - low
            total = int(met.sum())
            if total:
                first = np.cumsum(met) - met
                of = np.repeat(np.arange(len(live)), met)
                at = np.arange(total) - first[of] + low[of]
                differs = self.sorted[t][at] ^ strings[of]
                length = np.full(total, level + 1, np.uint8)
                for k in range(level + 1, self.depth + 1):
                    length += differs >> np.uint32(self.bits * (self.depth - k)) == 0
                spot = live[of], self.order[t][at]
                shared[spot] = np.maximum(shared[spot], length)


_FOUND = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(rows: DataFrame, queries: DataFrame, k: int = 20, groups: int = 18, size: int = 10, depth: int = 4, least: int = 1500, block: int = 8192, query_block: int = 16_384) -> DataFrame:
    """The ``k`` nearest of ``rows`` for each query, by largest inner product: ``query_id, rank, vec_id, score``.

    At least ``least`` candidates are scored for a query, over all blocks, or all
    rows.  Both tables have ``vec_id`` and ``embedding``.  Candidates are all rows with
    another id than the query's.  Null, zero or non-finite vectors and null ids
    take no part; vectors of different lengths never meet; repeated rows count
    once; ties go to the smaller id; fewer than ``k`` candidates are all
    returned, best first; other columns are left out.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        return v.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()

    in_order = Window.partitionBy("v").orderBy("vec_id")
    smallest = clean(rows).withColumn("r", F.row_number().over(in_order)).filter(F.col("r") <= k + 1)
    vectors = shared_checkpoint(smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = clean(queries)
    n_rows, n_asked = vectors.count(), asked.count()
    row_blocks, asked_blocks = max(1, -(-n_rows // block)), max(1, -(-n_asked // query_block))
    h = F.xxhash64("v")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("v", "ids", F.size("v").alias("dim"), F.pmod(h, F.lit(row_blocks)).cast("int").alias("rb"), all_of(asked_blocks).alias("qb"))
    right = asked.select("vec_id", "v", h.alias("query_hash"), F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(asked_blocks)).cast("int").alias("qb"), all_of(row_blocks).alias("rb"))

    def cell(row_table: pa.Table, asked_table: pa.Table) -> pa.Table:
        if not row_table.num_rows or not asked_table.num_rows:
            return _FOUND.empty_table()
        x, q = (np.array(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (row_table, asked_table))
        ids, own, hashes = row_table["ids"].to_pylist(), asked_table["vec_id"].to_pylist(), asked_table["query_hash"].to_pylist()
        out: list[tuple] = []
        for j, near in enumerate(Forest(x, groups, size, depth).candidates(q, max(k + 1, -(-least // row_blocks)))):
            score = x[near] @ q[j]
            if len(near) > k + 1:  # all ties of the last one stay
                keep = score >= np.partition(score, -k - 1)[-k - 1]
                near, score = near[keep], score[keep]
            score = np.array([np.dot(x[i], q[j]) for i in near])
            best = sorted((-s, i) for s, r in zip(score.tolist(), near) for i in ids[r] if i != own[j])[:k]
            out += [(own[j], hashes[j], i, -s) for s, i in best]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND) if out else _FOUND.empty_table()

    key = ["dim", "qb", "rb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, query_hash long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
