"""Chunk documents and result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .turns import turn_ordinals


def render_turns(packed: DataFrame, session: str = "file") -> DataFrame:
    """``session, chunk_id, turn_no, text``: each turn's Markdown.  Needs ``type, timestamp, parts, turn_id, line_num``."""
    shown = F.array_join(
        F.transform("parts", lambda p: F.when(p["type"] == "thinking", F.concat(F.lit("[thinking]\n"), p["text"])).when(p["type"] == "tool_result", F.concat(F.lit("[Tool Result]\n"), p["text"])).otherwise(p["text"])), "\n\n"
    )
    who = F.when(F.col("type") == "user", F.lit("### User:\n")).otherwise(F.lit("### Assistant:\n"))
    blocks = turn_ordinals(packed, session).select(session, "chunk_id", "turn_no", "line_num", "timestamp", F.concat(who, shown).alias("block"))
    turns = blocks.groupBy(session, "chunk_id", "turn_no").agg(F.min_by("timestamp", "line_num").alias("ts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    return turns.select(session, "chunk_id", "turn_no", F.concat(F.lit("## [Turn "), F.col("turn_no"), F.lit("] "), "ts", F.lit("\n\n"), "body", F.lit("\n\n---\n")).alias("text"))


def render_headers(stats: DataFrame, session: str = "file") -> DataFrame:
    """``session, chunk_id, text``: each chunk's heading.  Ordinals are index over last index.  Needs chunk stats with timestamps."""
    last = F.max("chunk_id").over(Window.partitionBy(session))
    text = F.concat(
        F.lit("# Conversation History Export - Chunk "), F.col("chunk_id"), F.lit("/"), last, F.lit("\n\n> Time range: "), F.coalesce("first_ts", F.lit("")), F.lit(" ~ "), F.coalesce("last_ts", F.lit("")),
        F.lit("\n> Estimated tokens: ~"), F.format_number("tokens_est", 0), F.lit("\n> Conversation turns: "), F.col("turns"), F.lit("\n\n---\n"),
    )
    return stats.select(session, "chunk_id", text.alias("text"))


def write_chunks(packed: DataFrame, stats: DataFrame, path: str, session: str = "file", prefix: str = "chunk") -> None:
    """Writes ``path/session=.../chunk=<prefix>-N/*.txt``: one text file a chunk, header first, turns in order.

    Turns stay rows: a chunk, bounded by the hard limit, is the most one file holds.
    """
    parts = render_headers(stats, session).select(session, "chunk_id", F.lit(0).alias("turn_no"), "text").unionByName(render_turns(packed, session).select(session, "chunk_id", F.col("turn_no").cast("int").alias("turn_no"), "text"))
    named = parts.select(F.xxhash64(session).alias("session"), F.concat(F.lit(f"{prefix}-"), F.col("chunk_id")).alias("chunk"), "turn_no", "text")
    ordered = named.repartition("session", "chunk").sortWithinPartitions("session", "chunk", "turn_no").select("session", "chunk", F.col("text").alias("value"))
    ordered.write.mode("overwrite").option("lineSep", "\n").partitionBy("session", "chunk").text(path)


def result_record(status: str, mode: str, counters: DataFrame, stats: DataFrame, cursors: DataFrame, session: str = "file", prefix: str = "chunk", warnings: list[str] | None = None) -> DataFrame:
    """One row, ``json``: status, mode, counters, warnings, chunks and the new cursors (as many as there are files and chunks)."""
    chunk = F.struct(F.concat(F.col(session), F.lit(f"/{prefix}-"), "chunk_id", F.lit(".md")).alias("file"), "tokens_est", "turns")
    chunks = stats.agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    sync = cursors.agg(F.array_sort(F.collect_list(F.struct("file", F.col("line_number").alias("last_line_number"), F.col("uuid").alias("last_uuid"), F.col("timestamp").alias("last_timestamp")))).alias("sync_state"))
    row = counters.join(F.broadcast(chunks)).join(F.broadcast(sync))
    return row.select(F.to_json(F.struct(F.lit(status).alias("status"), F.lit(mode).alias("mode"), "total_entries", "processed_entries", "filtered_entries", F.array(*[F.lit(w) for w in warnings or []]).cast("array<string>").alias("warnings"), "chunks", "sync_state")).alias("json"))
