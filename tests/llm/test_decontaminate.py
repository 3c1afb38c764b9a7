import random
import re

import pytest

from loomquill.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, hit, ids = split(text), set(), set()
        for item_id, item in items:
            q = split(item)
            if item_id is None or not q:
                continue
            for k in range(max(1, len(q) - width + 1)):
                win = q[k : k + width]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 7])
def test_against_brute_force(spark, most):
    random.seed(9)
    vocabulary = ["a", "b", "C", "é", "d1", "the", "x-y", "Zz"]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(k, say(random.randint(1, 9))) for k in range(8)] + [(3, say(6)), (None, "a b"), (50, None), (51, "!!"), (52, say(5)), (60, "b c é d1")]
    items += [(70, items[0][1]), items[1]]
    docs = [(k, say(random.randint(0, 40))) for k in range(60)] + [(0, say(5)), (None, "b C é d1 a"), (61, None), (62, ""), (63, "b c é d1 " * 2000)]
    docs += [docs[5], docs[5]]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, width=4, most=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str) == brute(docs, items, 4)
    assert all(r.n_items == len(r.item_ids) for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(d.limit(0), b).count() == 0
    assert [r.contaminated for r in decontaminate(d, b.limit(0)).collect()] == [False]
    assert [r.contaminated for r in decontaminate(d, b).collect()] == [True]
