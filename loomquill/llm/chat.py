"""Chat formatting from an event log.

An event is ``(conv_id, seq, kind, role, text, ref)``:

* ``message`` opens a message, known by its ``seq``;
* ``delta`` appends its text to message ``ref`` (null: the last opened one);
* ``edit`` replaces the text of message ``ref`` (null: the last opened one);
* ``regenerate`` replaces the text of message ``ref`` (null: the last opened
  one) and drops the messages opened between that one and the event.

Unknown kinds count as ``message``.  Events of one conversation with equal
``seq`` are taken in the order of kind, role and text, so results do not depend
on the rows' order; equal messages stay separate turns.

Template, one segment a turn: ``<s>[INST] role [/INST] text</s>`` and a line
feed.  Control strings inside roles and texts get a backslash after their first
character and backslashes are doubled, which `unescape` takes back exactly.

Scale: rows are dealt once, by conversation; all windows and the fold follow
from that.  Every message folds on its own and segments stay separate rows, so a
conversation with a third of all rows is never one value.  What needs the order
inside a conversation is a sort that spills and running values over its rows:
linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import need

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_SEGMENT = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """Backslashes doubled, then every control string broken by a backslash after its first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<(?=s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))", r"$1\\")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of an event log; ``turn`` is the opening event's ``seq``.

    Null text is empty, null role is empty, null ``conv_id`` is a conversation
    of its own, null ``seq`` sorts first.  Events whose target does not exist
    are dropped.
    """
    e = need(events, conv_id="long", seq="long", kind="string", role="string", text="string", ref="long")
    e = e.withColumns({"text": F.coalesce("text", F.lit("")), "role": F.coalesce("role", F.lit("")), "kind": F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")})
    rank, opens = F.when(F.col("kind") == "message", 0).otherwise(1), F.col("kind") == "message"
    in_order = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), rank, "kind", "role", "text")
    e = e.withColumn("at", F.row_number().over(in_order))
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("last_at", F.last(F.when(opens, F.col("at")), ignorenulls=True).over(so_far))
    # A target given by ref is found by its seq; the first message of that seq counts.
    named = Window.partitionBy("conv_id", "name")
    e = e.withColumn("name", F.when(opens, F.col("seq")).otherwise(F.col("ref"))).withColumn("ref_at", F.min(F.when(opens, F.col("at"))).over(named))
    by_ref = F.when(F.col("ref_at") < F.col("at"), F.col("ref_at"))
    e = e.withColumn("target", F.when(opens, F.col("at")).when(F.col("ref").isNull(), F.col("last_at")).otherwise(by_ref)).filter("target is not null")
    # What a regeneration that is still to come drops: running minima from the end, one pass whatever the length.
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("target"))).over(from_end))
    # Each message: what follows its last replacement is appended to it; what that replaced is not collected.
    e = e.withColumn("from_at", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(Window.partitionBy("conv_id", "target")))
    head = F.max(F.when(opens, F.struct("seq", "role", "cut")))
    parts = F.sort_array(F.collect_list(F.when(F.col("at") >= F.col("from_at"), F.struct("at", "text"))))
    folded = e.groupBy("conv_id", F.col("target").alias("at")).agg(head.alias("head"), parts.alias("parts")).filter("head.cut is null or head.cut >= at")
    return folded.select("conv_id", "at", F.col("head.seq").alias("turn"), F.col("head.role").alias("role"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Adds ``segment``, the turn as the template gives it, and the loss mask inside it (code points, end exclusive; null for none)."""
    head = F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST] "))
    body = escape(F.col("text"))
    trained = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "at", "turn", F.concat(head, body, F.lit("</s>\n")).alias("segment"), F.when(trained, F.length(head)).alias("loss_start"), F.when(trained, F.length(head) + F.length(body)).alias("loss_end")
    )


def format_chat(events: DataFrame) -> DataFrame:
    """The log folded and rendered: one segment a turn, to be joined in the order of ``at`` within ``conv_id``."""
    return render(fold_events(events))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of conversations as read from their formatted output alone: one row a conversation.

    Rows are dealt by conversation, sorted (spilling) and read once; only
    running digests are held, whatever a conversation's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, segment, low, high in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = _SEGMENT.fullmatch(segment)
                state[1] += 1
                state[2].update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                if low is not None:
                    loss = unescape(segment[low:high])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(segment)
            if len(done) > 5000:
                yield _digest_rows(done)
                done = []
        close()
        if done:
            yield _digest_rows(done)

    dealt = segments.select("conv_id", "segment", "loss_start", "loss_end", "at").repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("at"))
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=list(names))
