import numpy as np

import pytest

from loomquill.llm.prefix_forest import Forest, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        best = sorted((-float(np.dot(y, x)), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_small_tables_are_exact_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(float).tolist(), 0) for i in range(15)]
    rows += [(20 + i, [0.5] * 8, 0) for i in range(12)]  # one common vector, ties
    rows += [(50, None, 0), (51, [0.0] * 8, 0), (52, [None] * 8, 0), (53, [float("nan")] * 8, 0), (54, [float("inf")] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (55, [1.0, 2.0], 0), (56, [], 0)]
    want = exact(rows, 5)
    got: dict[int, list] = {}
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    for r in search(df, df, k=5, least=10**9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in got for a, b in zip(got[q], want[q]))
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0


def test_ties_across_blocks_go_to_the_smaller_id(spark):
    """Different vectors of equal inner product with the query, in many blocks."""
    rows = [(i, [1.0] + [float(i == j) for j in range(30)], 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.filter("vec_id = 7"), k=9, least=10**9, block=3).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(k + 1, v, 1.0) for k, v in enumerate([0, 1, 2, 3, 4, 5, 6, 8, 9])]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.filter("vec_id % 20 = 0"), block=1000, query_block=100).toPandas()
    assert len(got) == 150 * 20
    x32 = x.astype(np.float32).astype(float)
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x32 @ x32[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(part.vec_id))
    assert hits / len(got) >= 0.9


def test_few_rows_are_scored_at_high_recall():
    """100,000 vectors of random directions, the hardest case, in the blocks and with the settings of the query."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((100_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = x[:100]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1:21]
    seen, found = 0, [set() for _ in asked]
    for a in range(0, len(x), 8192):
        for j, rows in enumerate(Forest(x[a : a + 8192], 18, 10, 4).candidates(asked, 128)):
            seen += len(rows)
            found[j] |= set((rows + a).tolist())
    assert seen < 0.1 * len(asked) * len(x)
    assert np.mean([len(found[j] & set(near[j].tolist())) / 20 for j in range(len(asked))]) >= 0.9


def test_recall_on_the_drivers_vectors(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.1/embeddings.parquet").exists():
        pytest.skip("the driver's tables are not here")
    from loomquill.llm.queries import op3_neighbours

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v = np.stack(rows.embedding.to_numpy()).astype(float)
    got = op3_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = v @ v[np.flatnonzero(rows.vec_id == q)[0]]
        s[rows.vec_id == q] = -9
        hits += len(set(rows.vec_id[np.argsort(-s)[:20]]) & set(part.vec_id))
    assert len(got) == 20 * (rows.vec_id % 20 == 0).sum() and hits / len(got) >= 0.9
