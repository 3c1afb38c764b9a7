"""Greedy packing of turns into bounded chunks.

The result depends on the running total, so a session is folded in order.  Rows
are dealt by session and sorted (spilling); the fold keeps the open chunk only,
never a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import PackConfig


class _Fold:
    """One session's fold.  ``add`` and ``close`` give (row, chunk) pairs once they are final."""

    def __init__(self, c: PackConfig):
        self.c, self.chunk, self.size, self.before = c, -1, 0, None
        self.open: list[int] = []
        self.closed_turn = None

    def _close(self, small_joins: bool) -> list[tuple[int, int]]:
        """Ends the open chunk; a small one may join the chunk before it."""
        if not self.open:
            return []
        if small_joins and self.size < self.c.least and self.before is not None and self.before + self.size <= self.c.hard:
            self.before += self.size
        else:
            self.chunk += 1
            self.before = self.size
        out = [(row, self.chunk) for row in self.open]
        self.open, self.size = [], 0
        return out

    def add(self, row: int, turn: int, tokens: int, turn_tokens: int, first: bool) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        if turn_tokens > self.c.hard:
            # Too large for any chunk: what is open ends, and the turn is cut between entries.
            if first:
                out = self._close(self.closed_turn is None)
            elif self.open and self.size + tokens > self.c.hard:
                out = self._close(False)
            self.closed_turn = turn
        elif first:
            if self.closed_turn is not None or (self.open and self.size + turn_tokens > self.c.target):
                out = self._close(False)
            self.closed_turn = None
        self.open.append(row)
        self.size += tokens
        return out

    def end(self) -> list[tuple[int, int]]:
        return self._close(self.closed_turn is None)


def pack(entries: DataFrame, session: str, order: str, config: PackConfig = PackConfig()) -> DataFrame:
    """Adds ``chunk_id`` (from 0 in each session) to entries with ``turn_id`` and ``tokens``.

    A turn joins the open chunk unless that would pass the target.  A turn over
    the hard limit ends the open chunk and is cut between its entries (an entry
    over the limit stays alone).  A last chunk under the least size, or one left
    so by an oversized turn, joins the chunk before it if the hard limit allows.
    """
    whole = F.sum("tokens").over(Window.partitionBy(session, "turn_id"))
    first = F.row_number().over(Window.partitionBy(session, "turn_id").orderBy(order)) == 1
    fields = entries.withColumns({"__turn_tokens": whole, "__first": first})
    sorted_rows = fields.repartition(session).sortWithinPartitions(session, order)
    names = entries.columns
    at = {c: k for k, c in enumerate(sorted_rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: _Fold | None = None
        here: object = _NOTHING
        held: dict[int, tuple[pa.RecordBatch, int]] = {}
        number = 0

        def flush(done: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            """Rows leave in runs of the same batch."""
            k = 0
            while k < len(done):
                batch, start = held.pop(done[k][0])
                end = k + 1
                while end < len(done) and held[done[end][0]][0] is batch:
                    held.pop(done[end][0])
                    end += 1
                part = batch.slice(start, end - k)
                yield pa.RecordBatch.from_arrays([*[part.column(at[c]) for c in names], pa.array([c for _, c in done[k:end]], pa.int64())], names=[*names, "chunk_id"])
                k = end

        for batch in batches:
            columns = [batch.column(at[c]).to_pylist() for c in (session, "turn_id", "tokens", "__turn_tokens", "__first")]
            for k, (s, turn, tokens, turn_tokens, is_first) in enumerate(zip(*columns)):
                if fold is None or s != here:
                    if fold is not None:
                        yield from flush(fold.end())
                    fold, here = _Fold(config), s
                held[number] = batch, k
                yield from flush(fold.add(number, turn, tokens or 0, turn_tokens or 0, is_first))
                number += 1
        if fold is not None:
            yield from flush(fold.end())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return sorted_rows.mapInArrow(run, f"{schema}, chunk_id long")


_NOTHING = object()


def chunk_stats(packed: DataFrame, session: str, timestamp: str | None = None) -> DataFrame:
    """Per chunk: ``turns, entries, tokens_est`` and, with a timestamp column, ``first_ts, last_ts``."""
    turns = packed.groupBy(session, "chunk_id", "turn_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), *([F.min(timestamp).alias("lo"), F.max(timestamp).alias("hi")] if timestamp else []))
    more = [F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts")] if timestamp else []
    return turns.groupBy(session, "chunk_id").agg(F.count("*").alias("turns"), F.sum("n").alias("entries"), F.sum("t").alias("tokens_est"), *more)


def out_of_bounds(stats: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Adds ``too_small`` and ``too_large``."""
    return stats.withColumns({"too_small": F.col("tokens_est") < config.least, "too_large": F.col("tokens_est") > config.hard})
