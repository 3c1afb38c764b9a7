import json
import random

import pytest

from loomquill.llm import token_count as C
from loomquill.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    random.seed(2)
    parts = ["the", " ", "  ", "\n", "\t", "é", "Straße", "'s", "'ll", "12", "$%", "<|endoftext|>", "日本", "　", "\x1c", "\x85", "𝔸", ".", " of", " and", "ciónque"]
    out = ["".join(random.choices(parts, k=random.randint(0, 120))) for _ in range(150)]
    return [*out, "", " ", "a b", "word " * 3000, "x" * 5000, " " * 3000, "a" * 300 + " b" * 2000 + "\n\n" * 500, "<|endoftext|> x <|endoftext|>"]


def test_pieces_join_and_add_up(tokenizer):
    for t in texts():
        pieces = C.stable_pieces(t)
        assert "".join(pieces) == t
        assert sum(len(tokenizer.encode(p, add_special_tokens=False)) for p in pieces) == len(tokenizer.encode(t, add_special_tokens=False))


def test_splicing_equals_whole_encoding(tokenizer):
    calls = []

    def spans(text):
        calls.append(len(text))
        return tokenizer.encode(text, add_special_tokens=False).offsets

    for t in texts():
        for chunk, overlap in ((40, 12), (100, 30), (700, 64)):
            assert C.splice_count(t, spans, chunk, overlap) == len(tokenizer.encode(t, add_special_tokens=False)), (t, chunk)
    assert max(calls) >= 3000  # overlaps widened, where no place is stable
    calls.clear()
    assert C.splice_count("word " * 20000, spans, 5000, 200) == 20001 and max(calls) < 6000


def test_rows(spark, tokenizer):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, None, 1), (0, texts()[0], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = C.count_tokens(df, PATH, limit=50, chunk=400, overlap=64).collect()
    assert len(got) == len(rows)
    want = {(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 50) for i, t, _ in rows}
    assert {tuple(r) for r in got} == want
    assert C.count_tokens(df.limit(0), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    with open(PATH) as usual, open(path) as other:
        file = usual.read()
        assert C.splits_at_spaces(file) and not C.splits_at_spaces(other.read())
    changed = json.loads(file)
    changed["added_tokens"][0]["content"] = "of the"
    assert not C.splits_at_spaces(json.dumps(changed))
    given = ["Hello  World of the x", None, "", "a b " * 400]
    got = C.count_tokens(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), path, chunk=100, overlap=20).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(k, len(own.encode(t or "", add_special_tokens=False))) for k, t in enumerate(given)}
