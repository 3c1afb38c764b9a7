import random
import re

from loomquill.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in L.PHRASES.items() for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_against_brute_force(spark):
    random.seed(6)
    words = ["cc", "by", "CC-BY", "general", "public", "license", "License,", "all", "rights", "reserved", "RESERVED.", "é", "gnu", "the", "x1", "All", "\n", "—"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 60))) for _ in range(300)] + [None, "", "cc by", "cc  by by cc by", "all rights", "ſall rights reserved", "word " * 30000 + "all rights reserved", "x" * 100000]
    rows = [(i, t, "q") for i, t in enumerate(texts)] + [(1, texts[1], "q"), (None, "cc by", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = L.scan_licenses(df).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(by_id[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_templates(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "x y Released under the MIT License. z": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit", "apache helicopters have a license of version 2": "", "the mit campus": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(100 + k, "plain words here") for k in range(50)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(df).collect()}
    for k, label in enumerate(cases.values()):
        assert got[k][0] == label and (got[k][1] > 0.5) == bool(label)


def plainly(text, idf, anchors, votes, slack):
    """Labels and score by the definition: every template at every shift, its anchors found by hand."""
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text))
    labels, score, base = set(), 0.0, set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        if any(words[k : k + len(p)] == p for k in range(len(words))):
            labels.add(label)
            base.add(label)
            score = 1.0
    for t in L.TEMPLATES:
        own = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(t.text))
        places = sorted(range(len(own)), key=lambda i: (-idf[own[i]], i))[:anchors]
        at = lambda k: words[k] if 0 <= k < len(words) else None  # noqa: B023, E731
        for shift in range(-len(own), len(words)):
            if sum(at(shift + i) == own[i] for i in places) < min(votes, len(own)):
                continue
            keys = [k.split() for k in t.key]
            found = [next((i for i in range(len(own)) if own[i : i + len(k)] == k), 0) for k in keys]
            if all(any(shift + i + d >= 0 and words[shift + i + d : shift + i + d + len(k)] == k for d in range(-slack, slack + 1)) for k, i in zip(keys, found)):
                labels.add(t.label)
                score = max(score, sum(at(shift + i) == w for i, w in enumerate(own)) / len(own))
    return ",".join(sorted(base)), ",".join(sorted(labels)), score


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_labels_and_scores_against_brute_force(spark):
    random.seed(6)
    filler = ["the", "software", "license", "and", "or", "zebra", "copy", "of", "this", "version", "2", "0", "notice", "public"]
    texts = [None, "", "!!", "cc by", "the " * 3000, *(t.text for t in L.TEMPLATES)]
    for t in L.TEMPLATES:
        words = t.text.split()
        for _ in range(4):
            w = list(words)
            for _ in range(random.randint(0, 3)):
                k = random.randrange(len(w) + 1)
                w[k : k + random.randint(0, 2)] = random.choices(filler, k=random.randint(0, 2))
            texts.append(" ".join(random.choices(filler, k=random.randint(0, 40)) + w[random.randint(0, len(w) // 3) :] + random.choices(filler, k=random.randint(0, 9))))
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[7])], "doc_id long, text string")
    index = L.Index(L.PHRASES, L.TEMPLATES)
    frequency, n = L.document_frequency(df, index)
    index.rank(frequency, n, 4)
    idf = {w.decode(): index.idf[k] for w, k in index.id.items()}
    for r in L.scan_licenses(df).collect():
        text = texts[7] if r.doc_id is None else texts[r.doc_id]
        base, labels, score = plainly(text, idf, 4, 2, 2)
        assert (r.base_labels, r.labels) == (base, labels) and abs(r.score - score) < 1e-12, text
    whole = {r.doc_id - 5: r for r in L.scan_licenses(df).collect() if r.doc_id is not None and 5 <= r.doc_id < 5 + len(L.TEMPLATES)}
    assert all(t.label in whole[k].labels.split(",") and whole[k].score == 1.0 for k, t in enumerate(L.TEMPLATES))
