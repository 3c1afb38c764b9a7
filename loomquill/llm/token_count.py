"""Token counts by overlap resynchronisation.

Two facts about byte-level BPE with the usual word splitting make exact counts
cheap.  No word of the splitter ends in a space or holds one after its first
character, so the place before a single space between two characters that are
not white space always parts two words, whatever stands further away: a
*stable* place.  And BPE never merges across words, so counts on both sides of
a stable place add up.

* Documents up to ``chunk`` characters are cut at every stable place; each
  distinct piece is encoded once by the library and remembered.
* Longer ones are encoded in overlapping chunks with offsets.  Two neighbours
  are spliced at a stable place in the middle of their overlap, where both
  encodings have a boundary and agree on all boundaries up to the last stable
  place of the overlap; where that fails, the overlap is doubled, in the end up
  to the whole document.

White space here is Python's ``\\s``, a superset of the splitter's, so a place
called stable is stable for the library too.  Both facts hold for the usual
splitter only; the tokenizer's file is looked at first (`splits_at_spaces`), and
under any other every text is encoded whole.

The file is read on the driver and sent to the workers as it is.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .spark import need

_ODD = re.compile(r" \s|\s |^ | $")
_STABLE = re.compile(r"(?<=\S) (?=\S)")
#: Remembered pieces of one worker; the memory is emptied when it is full.
_MOST_PIECES = 300_000

_loaded: dict[str, tuple] = {}


def splits_at_spaces(file: str) -> bool:
    """Whether a tokenizer file's words never cross a stable place: byte-level BPE with the usual splitter and nothing that reads over spaces."""
    d = json.loads(file)
    pre, model = d.get("pre_tokenizer") or {}, d.get("model") or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = model.get("type") == "BPE" and not model.get("dropout") and not d.get("normalizer")
    odd = any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in d.get("added_tokens") or [])
    return bool(usual and plain and not odd)


def _load(file: str):
    """The library's tokenizer without truncation and padding, and this worker's memory of piece counts."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[key] = tokenizer, {}
    return _loaded[key]


def stable_pieces(text: str) -> list[str]:
    """``text`` cut at its stable places; the pieces joined give ``text``."""
    if not _ODD.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    cuts = [0, *[m.start() for m in _STABLE.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def splice_count(text: str, spans: Callable[[str], list[tuple[int, int]]], chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from overlapping chunks; ``spans`` encodes a string to its tokens' offsets."""
    n, start, keep_from, total = len(text), 0, 0, 0
    width = overlap
    while True:
        end = min(n, start + chunk + width - overlap)
        left = [(a + start, b + start) for a, b in spans(text[start:end])]
        while True:
            if end == n:
                return total + sum(a >= keep_from for a, _ in left)
            again = max(start + 1, end - width)
            right = [(a + again, b + again) for a, b in spans(text[again : min(n, again + chunk)])]
            place = _splice_place(text, left, right, max(again, keep_from), end)
            if place is not None:
                break
            # No provable place: a wider overlap, from a longer left chunk.
            width *= 2
            end = min(n, start + chunk + width - overlap)
            left = [(a + start, b + start) for a, b in spans(text[start:end])]
        total += sum(keep_from <= a < place for a, _ in left)
        keep_from, start, width = place, again, overlap


def _splice_place(text: str, left: list, right: list, low: int, high: int) -> int | None:
    """A stable place of ``text[low:high]`` at which both token lists part and after which they agree."""
    stable = [m.start() + low for m in _STABLE.finditer(text[low:high])]
    if len(stable) < 2:
        return None
    last = stable[-1]
    # A boundary is where a token begins; offsets may leave out a leading space.
    begins = [a for a, _ in left], [a for a, _ in right]
    for place in sorted(stable[:-1], key=lambda p: abs(p - (low + high) // 2)):
        parts = [x[bisect.bisect_left(x, place) : bisect.bisect_left(x, last)] for x in begins]
        if parts[0] and parts[0] == parts[1] and parts[0][0] <= place + 1:
            return place
    return None


def _counter(file: str, chunk: int, overlap: int) -> Callable[[str], int]:
    tokenizer, known = _load(file)
    if not splits_at_spaces(file):
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False))

    def spans(text: str) -> list[tuple[int, int]]:
        return tokenizer.encode(text, add_special_tokens=False).offsets

    def count(text: str) -> int:
        if len(text) > chunk:
            return splice_count(text, spans, chunk, overlap)
        pieces = Counter(stable_pieces(text))
        if new := [x for x in pieces if x not in known]:
            if len(known) + len(new) > _MOST_PIECES:
                known.clear()
                new = list(pieces)
            for x, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[x] = len(e)
        return sum(known[x] * k for x, k in pieces.items())

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit`` under the tokenizer file at ``path``.

    Null text counts as empty (0 tokens); rows are independent, so repeated
    rows and null ids pass through; an empty table gives an empty result; other
    columns are left out.  Memory is one Arrow batch, one document's pieces and
    a bounded memo.
    """
    with open(path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(file.value, chunk, overlap)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return need(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
