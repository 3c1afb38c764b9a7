"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for every piece of the model that stands
there; a path's score is the sum of its pieces' scores, as the model file gives
them.  (For a BPE model these are ranks, so the best path is the one of best
ranks, not the one its merges would reach.)  A character no piece covers is
spelt in byte pieces at a penalty.

Forward Viterbi gives every node the best score from the start, and a search
from the end takes these as exact heuristics: A* pops nodes in the order of the
best path through them, so the first N paths that reach the start are the N
best.

No piece crosses from other characters into a run of word marks, nor holds a
line feed beside another character, so all paths meet at these places: the
lattice is a chain of small ones.  Each distinct link of the chain is solved
once, many at a time; the best detour off its best path comes from forward and
backward scores.  In a text, only the N - 1 links of smallest detours can differ
between its N best paths; A* runs on these, and their paths are merged.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import threading
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .spark import give_back, need

MARK = "▁"
_LINK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Links longer than this are solved one at a time.
_LONG = 40
_MOST_LINKS = 250_000
_UNKNOWN_PENALTY = 10.0
_P, _SPREAD = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
_MAY_BITS = 20


@dataclass
class Vocabulary:
    """The pieces of a model: plain data, as large as the model, that the driver sends to its workers."""

    pieces: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]
    key: str = ""

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        with open(path, "rb") as f:
            key = hashlib.sha256(f.read()).hexdigest()

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        by_byte = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
        scores = [model.get_score(i) for i in plain]
        # Some files give runs of word marks a score of minus a billion, for "after all others": here one less than the least.
        least = min((s for s in scores if s > -1e8), default=0.0) - 1
        return cls([model.id_to_piece(i) for i in plain], plain, [max(s, least) for s in scores], [by_byte[f"<0x{b:02X}>"] for b in range(256)], key)


class Lattice:
    def __init__(self, v: Vocabulary):
        self.known = {p: (i, s) for p, i, s in zip(v.pieces, v.ids, v.scores)}
        self.text_of = dict(zip(v.ids, v.pieces))
        self.byte_of = {i: b for b, i in enumerate(v.byte_ids)}
        self.byte_ids = v.byte_ids
        self.longest = max(map(len, v.pieces))
        self.unknown = min(v.scores, default=0.0) - _UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in v.pieces):
            raise ValueError("pieces cross word marks or line feeds: texts cannot be cut there")
        hashes = np.array([self._hash(p) for p in v.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(v.ids, np.int32)[order]
        self.hash_scores = np.array(v.scores)[order]
        self.may_be = np.zeros(1 << _MAY_BITS, bool)
        self.may_be[self.hashes * _SPREAD >> np.uint64(64 - _MAY_BITS)] = True
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        #: Of each link: best score, the best detour's loss, the best path's ids as little-endian int32.
        self.solved: dict[str, tuple[float, float, bytes]] = {}
        #: The generation before: what is used again comes back from here, the rest is forgotten with it.
        self.older: dict[str, tuple[float, float, bytes]] = {}
        self.paths: dict[tuple[str, int], list[tuple[float, bytes, bool]]] = {}
        #: By id: the piece, and whether it is one of the byte pieces.
        self.piece_of = np.full(max(v.ids + v.byte_ids) + 1, "", object)
        self.piece_of[v.ids] = v.pieces
        self.is_byte = np.zeros(len(self.piece_of), bool)
        self.is_byte[v.byte_ids] = True
        self.byte_value = np.zeros(len(self.piece_of), np.uint8)
        self.byte_value[v.byte_ids] = np.arange(256)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) % (1 << 64)
        return h

    def spell(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode())

    def edges(self, link: str, end: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """Pieces that end at ``end``: start, ids, score."""
        for start in range(max(0, end - self.longest), end):
            found = self.known.get(link[start:end])
            if found:
                yield start, (found[0],), found[1]
            elif end - start == 1:
                yield start, self.spell(link[start:end]), self.unknown

    def n_best(self, link: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths, best first: score and ids."""
        best = [0.0] + [-np.inf] * len(link)
        into: list[list] = [[]]
        for end in range(1, len(link) + 1):
            into.append(list(self.edges(link, end)))
            best[end] = max(best[start] + score for start, _, score in into[end])
        # A path is a chain of its pieces from the end, so long links copy nothing; of equals the one found last goes first, so ties end paths instead of widening the search.
        heap: list[tuple] = [(-best[-1], 0, len(link), 0.0, None)]
        out, found = [], 0
        while heap and len(out) < n:
            _, _, node, behind, chain = heapq.heappop(heap)
            if node == 0:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                out.append((behind, tuple(ids)))
                continue
            for start, more, score in into[node]:
                found += 1
                heapq.heappush(heap, (-(behind + score + best[start]), -found, start, behind + score, (more, chain)))
        return out

    def solve(self, links: list[str]) -> None:
        """Puts all of ``links`` into ``solved``."""
        if len(self.solved) > _MOST_LINKS:
            self.older, self.solved = self.solved, {}
            self.paths.clear()
        new = []
        for x in links:
            if x not in self.solved:
                if x in self.older:
                    self.solved[x] = self.older[x]
                else:
                    new.append(x)
        by_size: dict[int, list[str]] = {}
        for x in new:
            by_size.setdefault(len(x), []).append(x)
        for size, group in by_size.items():
            if size > _LONG:
                for x in group:
                    two = self.n_best(x, 2)
                    self._keep(x, two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf, two[0][1])
                continue
            for at in range(0, len(group), 4096):
                self._solve_equal(group[at : at + 4096], size)

    def _keep(self, link: str, best: float, loss: float, ids: tuple[int, ...]) -> None:
        self.solved[link] = best, loss, struct.pack(f"<{len(ids)}i", *ids)

    def _solve_equal(self, group: list[str], size: int) -> None:
        """Forward and backward Viterbi over links of ``size`` characters, side by side: arrays are node or start by link."""
        n = len(group)
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        most = min(self.longest, size)
        score = np.full((most + 1, size, n), -np.inf)  # by piece length, start, link
        ids = np.full((most + 1, size, n), -1, np.int32)
        h = np.zeros((size, n), np.uint64)
        for length in range(1, most + 1):
            h = h[: size - length + 1] * _P + codes[length - 1 :]
            to_score, to_ids = score[length, : size - length + 1], ids[length, : size - length + 1]
            if length == 1:
                to_score[:] = self.unknown
            # Most strings are no pieces: a table of bits tells, the search is for the rest.
            maybe = np.nonzero(self.may_be[h * _SPREAD >> np.uint64(64 - _MAY_BITS)])
            sought = h[maybe]
            at = np.minimum(np.searchsorted(self.hashes, sought), len(self.hashes) - 1)
            hit = self.hashes[at] == sought
            where = maybe[0][hit], maybe[1][hit]
            to_score[where], to_ids[where] = self.hash_scores[at[hit]], self.hash_ids[at[hit]]
        ahead = np.full((size + 1, n), -np.inf)
        ahead[0] = 0
        took = np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            for k in range(min(most, end), 0, -1):
                way = ahead[end - k] + score[k, end - k]
                better = way > ahead[end]
                np.copyto(ahead[end], way, where=better)
                np.copyto(took[end], k, where=better)
        behind = np.full((size + 1, n), -np.inf)
        behind[size] = 0
        for start in range(size - 1, -1, -1):
            for k in range(1, min(most, size - start) + 1):
                np.maximum(behind[start], score[k, start] + behind[start + k], out=behind[start])
        every, node = np.arange(n), np.full(n, size)
        path = np.full((n, size), -2, np.int32)
        for k in range(1, most + 1):  # from here on the score of the best path through a piece
            score[k, : size - k + 1] += ahead[: size - k + 1] + behind[k:]
        while len(live := every[node > 0]):
            k = took[node[live], live]
            start = node[live] - k
            path[live, start] = ids[k, start, live]
            score[k, start, live] = -np.inf
            node[live] = start
        loss = (ahead[size] - score.max(axis=(0, 1))).tolist()
        best = ahead[size].tolist()
        spelt = (path == -1).any(axis=1)
        taken = path[path != -2]
        cut_at = np.concatenate([[0], np.cumsum((path != -2).sum(axis=1))]).tolist()
        for k, x in enumerate(group):
            if spelt[k]:
                row = path[k].tolist()
                self._keep(x, best[k], loss[k], tuple(i for at, p in enumerate(row) if p != -2 for i in ((p,) if p >= 0 else self.spell(x[at]))))
            else:
                own = taken[cut_at[k] : cut_at[k + 1]]
                self.solved[x] = best[k], loss[k], own.tobytes()

    def encode(self, links: list[str], n: int) -> tuple[bytes, list[float], str]:
        """Of a text cut into solved links: the best path's ids (little-endian int32), the scores of the ``n`` best paths (or of all), and the text of the best path's ids."""
        packed, scores, _ = self.encode_all(links, n)
        return packed[0], scores, self.decode_packed(packed[0])

    def encode_all(self, links: list[str], n: int) -> tuple[list[bytes], list[float], bool]:
        """Of a text cut into solved links: the ids (little-endian int32) and the scores of its ``n`` best paths (or of all), best first.

        Last, whether the ids of every detour taken decode to the link they stand
        for, so that all paths decode to what the best one does.
        """
        known = self.solved
        if not links:
            return [b""], [0.0], True
        score, loss, best = zip(*[known[x] for x in links])
        total = sum(score)
        merged: list[tuple[float, tuple]] = [(0.0, ())]  # loss, and (link, its ids) where they differ from the best path's
        # Links of the n - 1 smallest detours, each as often as it stands.
        for k in np.argsort(loss, kind="stable")[: n - 1].tolist() if len(loss) < 4 * n else sorted(np.argpartition(loss, n - 1)[: n - 1].tolist()):
            if loss[k] == np.inf:
                continue
            detours = self._detours(links[k], n, best[k])
            merged = heapq.nsmallest(n, merged + [(a + more, taken + ((k, ids, same),)) for a, taken in merged for more, ids, same in detours], key=lambda x: x[0])
        first = b"".join(best)
        begins = {k: sum(map(len, best[:k])) for k in {k for _, taken in merged for k, _, _ in taken}}
        packed = []
        for _, taken in merged:
            # The best path's bytes but for the links where this one differs.
            parts, at = [], 0
            for k, ids, _ in sorted(taken):
                parts += (first[at : begins[k]], ids)
                at = begins[k] + len(best[k])
            packed.append(b"".join([*parts, first[at:]]) if taken else first)
        return packed, [total - x for x, _ in merged], all(same for _, taken in merged for _, _, same in taken)

    def _detours(self, link: str, n: int, own: bytes) -> list[tuple[float, bytes, bool]]:
        """Loss and packed ids of the ``n - 1`` best paths of a link other than ``own``, its best one, and whether these decode to the link."""
        if (link, n) not in self.paths:
            found = [(s, struct.pack(f"<{len(ids)}i", *ids), self._join(ids) == link) for s, ids in self.n_best(link, n)]
            self.paths[link, n] = [(found[0][0] - s, ids, same) for s, ids, same in found if ids != own][: n - 1]
        return self.paths[link, n]

    def decode_packed(self, packed: bytes) -> str:
        """`decode` of little-endian int32 ids."""
        ids = np.frombuffer(packed, "<i4")
        parts = self.piece_of[ids].tolist()
        spelt = np.flatnonzero(self.is_byte[ids])
        if len(spelt):
            # Each run of byte pieces is text of its own, put where the run begins.
            cuts = np.flatnonzero(np.diff(spelt) > 1) + 1
            values = self.byte_value[ids[spelt]].tobytes()
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(spelt)]):
                parts[spelt[a]] = values[a:b].decode("utf-8", "replace")
        return "".join(parts).replace(MARK, " ")[1:]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces joined, byte pieces taken as UTF-8, marks back to spaces, the first one dropped."""
        return self._join(ids).replace(MARK, " ")[1:]

    def _join(self, ids: Iterable[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.text_of[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


#: This worker's lattices with what they remember, by their vocabulary; of one model usually.
_lattices: dict[str, Lattice] = {}


#: Seconds after a worker's last task here before its lattices are given back: other stages run in the same worker.
_IDLE = 2.0
_latest = 0


def _lattice(v: Vocabulary) -> Lattice:
    global _latest
    _latest += 1
    lattice = _lattices.get(v.key)
    if lattice is None:
        _lattices.clear()
        lattice = _lattices[v.key] = Lattice(v)
    return lattice


def _done() -> None:
    """A task has ended; if no other begins for a while, what the worker remembers goes."""
    mine = _latest

    def forget() -> None:
        if mine == _latest:
            _lattices.clear()
            give_back()

    timer = threading.Timer(_IDLE, forget)
    timer.daemon = True
    timer.start()


def _lists(packed: list[bytes]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def cut(text: str) -> list[str]:
    """The links of a text's chain, in order; they join to the marked text.  An empty text has none."""
    return _LINK.findall(MARK + text.replace(" ", MARK)) if text else []


def encode(docs: DataFrame, path: str, n: int = 4, with_ids: bool = False, with_all: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_pieces, scores, ids_sha256, all_sha256, round_trip``, and ``ids`` and ``all_ids`` where asked for.

    ``scores`` and ``all_ids`` are those of the ``n`` best segmentations, best
    first; ``ids`` is the best one; ``ids_sha256`` the digest of its ids as
    little-endian int32, ``all_sha256`` those of all; ``round_trip`` tells that
    decoding the ids of each gives the text back (a text that holds the word mark
    itself does not: the mark comes back as a space).  Null text counts as empty:
    no pieces, one segmentation of score 0.  Repeated rows and null ids pass
    through; an empty table gives an empty result; other columns are left out.
    Memory: one piece of a batch and a bounded memo.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    names = ["doc_id", "n_bytes", "n_pieces", "scores", "ids_sha256", "all_sha256", "round_trip"] + ["ids"] * with_ids + ["all_ids"] * with_all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary.value)
        for batch in batches:
            for a, b in T.pieces(batch.column(1), 3 << 20):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                links = [cut(t) for t in texts]
                lattice.solve(list(set().union(*links)))
                got = [lattice.encode_all(x, n) for x in links]
                digests = [[hashlib.sha256(x).hexdigest() for x in packed] for packed, _, _ in got]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(packed[0]) // 4 for packed, _, _ in got], pa.int64()),
                    pa.array([s for _, s, _ in got], pa.list_(pa.float64())),
                    pa.array([x[0] for x in digests], pa.string()),
                    pa.array(digests, pa.list_(pa.string())),
                    pa.array([same and lattice.decode_packed(packed[0]) == t for (packed, _, same), t in zip(got, texts)], pa.bool_()),
                ]
                if with_ids:
                    columns.append(_lists([packed[0] for packed, _, _ in got]))
                if with_all:
                    off = np.concatenate([[0], np.cumsum([len(packed) for packed, _, _ in got])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(off), _lists([x for packed, _, _ in got for x in packed])))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del lattice
        _done()

    schema = "doc_id long, n_bytes long, n_pieces long, scores array<double>, ids_sha256 string, all_sha256 array<string>, round_trip boolean" + ", ids array<int>" * with_ids + ", all_ids array<array<int>>" * with_all
    return need(docs, doc_id="long", text="string").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id, text``, the text of ``ids``; null ids give null.  Other columns are left out."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else lattice.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
        del lattice
        _done()

    return need(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")
