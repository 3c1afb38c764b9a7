"""Turns: numbering entries by the user messages that open them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_turns(entries: DataFrame, session: str = "file", order: str = "line_num", paired: bool = False) -> DataFrame:
    """Adds ``turn_id``, from 1 for a session's first user entry (0: entries before it).

    With ``paired``, a user entry that holds only tool results belongs to the
    turn before, so that calls and results stay together (needs ``parts``).  A
    session's window is a sorted scan that spills; it holds one row at a time.
    """
    opens = F.col("type") == "user"
    if paired:
        opens = opens & F.exists("parts", lambda p: p["type"] != "tool_result")
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("turn_id", F.sum(F.when(opens, 1).otherwise(0)).over(so_far))


def turn_ordinals(packed: DataFrame, session: str = "file") -> DataFrame:
    """Adds ``turn_no``: the turn's number within its chunk, from 1."""
    return packed.withColumn("turn_no", F.dense_rank().over(Window.partitionBy(session, "chunk_id").orderBy("turn_id")))


def recent(entries: DataFrame, n: int = 500, session: str | None = "file", order: str = "line_num") -> DataFrame:
    """Entries among the last ``n`` lines: ``order`` greater than the session's largest minus ``n``."""
    last = entries.groupBy(*([session] if session else [])).agg(F.max(order).alias("__last"))
    both = entries.join(last, session) if session else entries.crossJoin(F.broadcast(last))
    return both.filter(F.col(order) > F.col("__last") - n).drop("__last")


def positions(entries: DataFrame, session: str = "file", order: str = "line_num") -> DataFrame:
    """Adds ``position``, an entry's place in its session from 1: line order, which is the chronological one."""
    return entries.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))


def every_n_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """Adds ``trigger_no``: which block of ``n`` turns a turn belongs to."""
    return turns.withColumn("trigger_no", F.floor((F.col("turn_id") - 1) / n).cast("long"))
