import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from loomquill.llm.components import components
from loomquill.llm import neardup
from loomquill.llm.neardup import LEAST, SPREAD, Sampler, Weights, common_shingles, near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def similarities(rows):
    """Weighted Jaccard of all pairs of different texts, straight from the definition."""
    bags = {t: bag(t) for _, t in rows}
    df = Counter(s for _, t in rows for s in bags[t])
    n = len(rows)
    idf = {s: 1 + SPREAD * math.log(max(k / n, LEAST)) / math.log(LEAST) for s, k in df.items()}
    out = {}
    for a, b in itertools.combinations(sorted(bags, key=str), 2):
        both = set(bags[a]) | set(bags[b])
        top = sum(max(bags[a][s], bags[b][s]) * idf[s] for s in both)
        out[a, b] = sum(min(bags[a][s], bags[b][s]) * idf[s] for s in both) / top if top else 0.0
    return out


def classes(texts, pairs, least):
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), s in pairs.items():
        if s >= least:
            root[find(a)] = find(b)
    return {t: find(t) for t in texts}


def corpus():
    random.seed(3)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(800)]
    rows = []
    for _ in range(40):
        words = random.choices(vocabulary, k=random.randint(1, 300))
        for copy in range(random.choice([1, 1, 2, 5])):
            w = list(words)
            for _ in range(random.randint(0, max(1, len(w) // 40)) if copy else 0):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append(" ".join(w))
    hub = random.choices(vocabulary, k=200)
    for _ in range(60):  # a large group, each a few words from one text
        w = list(hub)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [rows[0]] * 3 + ["", None, "!!", "?", "one two", "one two", "One, two", "x " * 4000, "x " * 3990]
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, class_id string")
    for members in (1000, 16):  # one block, and many
        got = near_duplicates(df, members=members).collect()
        assert len(got) == len(rows)
        found = {r.doc_id: r.class_id for r in got}
        pairs = similarities(rows)
        sure, at_most = (classes({t for _, t in rows}, pairs, s) for s in (0.800001, 0.799999))
        for (i, a), (j, b) in itertools.combinations(rows, 2):
            if (a or "") == (b or "") or sure[a] == sure[b]:
                assert found[i] == found[j], (a, b)
            if found[i] == found[j]:
                assert (a or "") == (b or "") or at_most[a] == at_most[b], (a, b)
        for c in set(found.values()):
            assert c == min(i for i, x in found.items() if x == c)
        assert sorted(r.doc_id for r in got if r.is_first) == sorted(set(found.values()))


def test_odd_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words here"), (None, "a b c d e f"), (None, "nameless text"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} == {(7, 7), (None, 7), (None, None), (3, 3), (4, 3)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    for few in (200_000, 20, 0):
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def test_samples_follow_large_frequencies():
    w = Weights()
    tf = np.array([1, 4096, 4097, 100_000])
    h = np.arange(4, dtype=np.uint64)
    assert np.allclose(w.log(h, tf) - w.log(h, np.ones(4, int)), np.log(tf))
    # Two phrases' shingles 100,000 times each, and 20,000 shingles of their own in each text: similarity 0.83.
    common = np.arange(1, 3, dtype=np.uint64) << np.uint64(40)
    own = [(np.arange(20_000, dtype=np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) for k in (7, 1_000_007)]
    tf = np.concatenate([np.full(2, 100_000), np.ones(20_000, int)])
    a, b = (Sampler(96).draw(np.concatenate([common, x]), w.log(np.concatenate([common, x]), tf), np.array([0, 20_002]))[0] for x in own)
    assert 0.7 < (a == b).mean() < 0.95


def hub(n, seed, words=60, changes=1):
    """``n`` texts, each ``changes`` words away from one text, which is the first of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    while len(out) < n:
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_links_and_cells_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Copies one word away from one text, mostly not alike among themselves: one class, however many blocks."""
    rows, links = {}, {}
    dealt, linked = neardup.verified, neardup.text_links

    def counted(texts, *args):
        rows[n] = rows.get(n, 0) + texts.count()
        return dealt(texts, *args)

    def kept(*args):
        out = linked(*args)
        links[n] = out.count()
        return out

    monkeypatch.setattr(neardup, "verified", counted)
    monkeypatch.setattr(neardup, "text_links", kept)
    for n in (160, 320, 640):
        df = spark.createDataFrame(list(enumerate(hub(n, 5))), "doc_id long, text string")
        assert {r.class_id for r in near_duplicates(df, members=40).collect()} == {0}
    assert links[640] < 2 * 640 and links[640] <= 2.2 * links[320] <= 2.2 * 2.2 * links[160]
    assert rows[640] < 3 * 640 and rows[640] <= 2.2 * rows[320] <= 2.2 * 2.2 * rows[160]


def test_members_of_classes_whose_representatives_are_apart(spark):
    """Chains of texts, each three words from the last, in many blocks; passages that all share do not hide the links."""
    rng = random.Random(9)
    common = " ".join(f"c{k}" for k in range(60))
    texts = []
    for chain in range(3):
        w = [f"w{chain}x{k}" for k in range(60)]
        for step in range(40):
            texts.append(common + " " + " ".join(w))
            w[(step * 3) % 60 : (step * 3) % 60 + 3] = [f"y{chain}x{step}x{k}" for k in range(3)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = similarities(rows)
    want = classes(set(texts), pairs, 0.8)
    for members in (1000, 15):
        found = {r.doc_id: r.class_id for r in near_duplicates(df, members=members).collect()}
        for (i, a), (j, b) in itertools.combinations(rows, 2):
            assert (found[i] == found[j]) == (want[a] == want[b])


def test_common_shingles_are_counted_exactly(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(0, 40))) for _ in range(700)] + [None, "", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for held in (1 << 22, 50):
        got = common_shingles(df.repartition(5), most_held=held)
        df_of = Counter(s for t in texts for s in bag(t))
        assert sorted(got.values()) == sorted(k / len(texts) for k in df_of.values() if k > LEAST * len(texts))
    assert common_shingles(df.limit(0)) == {}
