import zlib

import numpy as np
import pyarrow as pa

from loomquill.llm import quality as Q


def test_model_learns_main_effects_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 4))
    y = (((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = Q.fit(x[:3000], y[:3000], pair_rounds=60)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.93
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    # A score is a sum of looked-up entries and nothing else.
    b = model.bins(x[:1])[0]
    by_hand = model.intercept + sum(t[b[j]] for j, t in enumerate(model.tables)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert np.isclose(by_hand, model.logit(x[:1])[0])


def test_without_rows_or_with_one_class():
    none = Q.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (Q.fit(np.zeros((8, 3)), np.ones(8)).score(np.zeros((1, 3))) > 0.8).all()


def test_features_of_plain_cases():
    names = list(Q.FEATURES)
    x = Q.features(pa.array(["The cat. The cat.", None, "", "é é é", "a | b\na | b", "!!"]))
    get = lambda row, name: x[row, names.index(name)]
    assert np.isclose(get(0, "log_words"), np.log1p(4)) and get(0, "capital_words") == 0.5 and get(0, "distinct_words") == 0.5 and get(0, "same_as_last") == 0
    assert (x[1] == x[2]).all() and get(1, "log_words") == 0
    assert np.isclose(get(3, "same_as_last"), 2 / 3) and get(3, "top_word") == 1
    assert get(4, "distinct_lines") == 0.5 and np.isclose(get(4, "pipe"), 2 / 11) and np.isfinite(x).all()


def test_whole_texts_batches_and_rows(spark):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["the", "house", "stands", "by", "a", "river", "and", "old", "trees."], 60)) for _ in range(300)]
    bad = ["%%% ".join(rng.choice(["zz", "qq", "xx"], 60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(t for pair in zip(good, bad) for t in pair)]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in rows] + [(None, None, 0.2), (0, rows[0][1], 0.3), (9999, "long " * 50000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(4, None), (6, 0), (None, 1)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = Q.score_quality(docs, model, keep=True).collect()
    assert len(got) == len(rows) + 3
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and all(r.predicted == 1 - r.doc_id % 2 for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sorted((str(r.doc_id), r.score, r.predicted) for r in Q.score_quality(docs, model).collect()) == sorted((str(r.doc_id), r.score, r.predicted) for r in got)
    assert Q.score_quality(docs.limit(0), model).count() == 0
    assert Q.train(docs, labels.limit(0)).score(np.zeros((1, len(Q.FEATURES)))).tolist() == [0.5]


def test_the_model_does_not_depend_on_the_rows_order(spark):
    """Labelled ids that repeat with other texts count once, as the least of their rows."""
    rng = np.random.default_rng(5)
    words = ["the", "house", "zz", "%%%", "a", "river.", "QQ"]
    rows = [(i % 90, " ".join(rng.choice(words, 1 + int(rng.integers(60))))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    models = []
    for order in (rows, rows[::-1]):
        model = Q.train(spark.createDataFrame(order, "doc_id long, text string").repartition(3), labels)
        models.append([model.intercept, *(t.tolist() for t in model.tables), model.pairs, *(t.tolist() for t in model.pair_tables)])
    assert models[0] == models[1]
