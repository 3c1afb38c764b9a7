import hashlib
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from loomquill.llm import pieces as P
from loomquill.llm.queries import tokenizer_path


def small():
    p = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁▁", "bb", "▁ab"]
    return P.Lattice(P.Vocabulary(p, [300 + i for i in range(len(p))], [-1.0, -1.5, -2.25, -2.0, -2.5, -0.5, -1.25, -0.75, -3.5, -2.625], list(range(3, 259))))


def every_path(lattice, text):
    """All segmentations of the marked text and their scores."""
    marked = P.MARK + text.replace(" ", P.MARK) if text else ""

    def walk(at):
        if at == len(marked):
            yield 0.0, ()
            return
        for end in range(at + 1, min(len(marked), at + lattice.longest) + 1):
            found = lattice.known.get(marked[at:end])
            if found:
                ids, score = (found[0],), found[1]
            elif end == at + 1:
                ids, score = lattice.spell(marked[at:end]), lattice.unknown
            else:
                continue
            for s, rest in walk(end):
                yield score + s, ids + rest

    return sorted(walk(0), key=lambda x: -x[0])


def test_n_best_against_all_paths():
    lattice = small()
    random.seed(1)
    for k in range(300):
        text = "".join(random.choices("aab b\né", k=k % 9))
        want = every_path(lattice, text)
        lattice.solve(P.cut(text))
        for n in (1, 2, 5):
            packed, scores, back = lattice.encode(P.cut(text), n)
            ids = struct.unpack(f"<{len(packed) // 4}i", packed)
            assert scores == pytest.approx([s for s, _ in want[:n]]), text
            assert (pytest.approx(scores[0]), tuple(ids)) in [(s, i) for s, i in want]
        assert lattice.decode(ids) == text == back


def test_a_star_paths_are_distinct_and_exact():
    lattice = small()
    for link in ("▁abab", "▁▁aba", "bbéab", "a" * 50):
        got = lattice.n_best(link, 6)
        assert len({ids for _, ids in got}) == len(got)
        if len(link) < 20:
            want = []

            def walk(at, score, ids, link=link, want=want):
                if at == len(link):
                    want.append((score, ids))
                for end in range(at + 1, len(link) + 1):
                    for start, more, s in lattice.edges(link, end):
                        if start == at:
                            walk(end, score + s, ids + more)

            walk(0, 0.0, ())
            assert [s for s, _ in got] == pytest.approx(sorted((s for s, _ in want), reverse=True)[:6])


def test_rows(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = ["Hello  world\n\nthe end ", "", None, " x", "日本語 und ñandú 𝔸", "the " * 20000, "z" * 3000, "a▁b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, "a", 1)], "doc_id long, text string, ids int")
    got = P.encode(df, path, with_ids=True).collect()
    assert len(got) == 10
    lattice = P.Lattice(P.Vocabulary.load(path))
    for r in got:
        text = "a" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.round_trip == (P.MARK not in text) and lattice.decode(r.ids) == text.replace(P.MARK, " ")
        assert r.n_pieces == len(r.ids) and r.scores == sorted(r.scores, reverse=True)
    assert P.encode(df.limit(0), path).count() == 0


def test_every_segmentation_has_its_ids():
    lattice = small()
    random.seed(2)
    for k in range(200):
        text = "".join(random.choices("aab b\né", k=k % 10))
        want = every_path(lattice, text)
        lattice.solve(P.cut(text))
        packed, scores, same = lattice.encode_all(P.cut(text), 5)
        paths = [struct.unpack(f"<{len(x) // 4}i", x) for x in packed]
        assert len(set(paths)) == len(paths) == min(5, len(want))
        scored = {ids: s for s, ids in want}
        assert scores == pytest.approx([scored[x] for x in paths]) and scores == pytest.approx([s for s, _ in want[:5]]), text
        assert same == all(lattice.decode_packed(x) == text for x in packed)


def test_operator_gives_all_segmentations_and_decodes_them(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = ["Hello  world\n\nthe end ", "", None, "日本語 und ñandú 𝔸"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = P.encode(df, path, with_ids=True, with_all=True)
    for r in got.collect():
        assert r.all_ids[0] == r.ids and len(r.all_ids) == len(r.scores) == len(set(map(tuple, r.all_ids))) == (4 if texts[r.doc_id] else 1)
        assert r.all_sha256 == [hashlib.sha256(struct.pack(f"<{len(x)}i", *x)).hexdigest() for x in r.all_ids] and r.all_sha256[0] == r.ids_sha256
    each = got.select("doc_id", F.explode("all_ids").alias("ids"))
    back = P.decode(each, path).collect()
    assert len(back) == 10 and all(r.text == (texts[r.doc_id] or "") for r in back)


def test_a_long_text_without_marks(spark):
    """100,000 characters in one link: linear work, all segmentations decode,"""
    import time

    path = tokenizer_path("piece_bpe_32k.model")
    text = "".join(random.Random(4).choices("abcdefghijklmnop日本語é", k=100_000))
    began = time.time()
    got = P.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, with_ids=True).first()
    assert time.time() - began < 60
    assert got.round_trip and len(got.scores) == 4 and got.scores == sorted(got.scores, reverse=True)


def test_an_idle_worker_gives_its_lattices_back(monkeypatch):
    """Other stages run in the same worker; a task that begins in time finds what is remembered."""
    monkeypatch.setattr(P, "_IDLE", 0.5)
    v = P.Vocabulary.load(tokenizer_path("piece_bpe_32k.model"))
    first = P._lattice(v)
    P._done()
    assert P._lattice(v) is first
    time.sleep(1.0)
    assert P._lattices == {v.key: first}  # the second task still runs
    P._done()
    time.sleep(1.5)
    assert not P._lattices
