"""Counts and estimates over entries, parts, chunks and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import estimate_tokens, retained
from ..functions.config import DROPPED_TYPES, KEPT_TYPES, PackConfig


def type_distribution(entries: DataFrame, column: str = "type") -> DataFrame:
    """Rows by value, commonest first."""
    return entries.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def block_distribution(with_parts: DataFrame) -> DataFrame:
    """Parts by entry type and block type."""
    return with_parts.select("type", F.explode("parts").alias("p")).groupBy("type", F.col("p.type").alias("block")).agg(F.count("*").alias("n"))


def tool_distribution(with_parts: DataFrame) -> DataFrame:
    """Tool calls by tool, commonest first."""
    name = F.regexp_extract("p.text", r"^\[Tool: ([^\]]*)\]", 1)
    return with_parts.select(F.explode("parts").alias("p")).filter("p.type = 'tool_use'").groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def part_tokens(with_parts: DataFrame) -> DataFrame:
    """Adds ``tokens``: the sum of its parts' estimates, each rounded down by itself."""
    return with_parts.withColumn("tokens", F.aggregate(F.transform("parts", lambda p: estimate_tokens(p["text"])), F.lit(0).cast("long"), lambda a, x: a + x))


def dropped_types(entries: DataFrame) -> DataFrame:
    """Entries that are not kept, by type: ``type, reason, n``; types without a known reason are ``unknown``."""
    reason = F.lit("unknown")
    for name, why in DROPPED_TYPES.items():
        reason = F.when(F.col("type") == name, why).otherwise(reason)
    return entries.filter(~F.coalesce(F.col("type").isin(*KEPT_TYPES), F.lit(False))).groupBy("type", reason.alias("reason")).agg(F.count("*").alias("n"))


def token_totals(rows: DataFrame, kind: str, tokens: str) -> DataFrame:
    """``kind, tokens, retained, n`` with a total row (kind null)."""
    sums = F.sum("t").alias("tokens"), F.sum("r").alias("retained"), F.count("*").alias("n")
    return rows.select(F.col(kind).alias("kind"), F.col(tokens).alias("t"), retained(F.col(kind), F.col(tokens)).alias("r")).rollup("kind").agg(*sums)


def turn_stats(numbered: DataFrame, session: str = "file") -> DataFrame:
    """Entries and estimated tokens of each turn."""
    return numbered.groupBy(session, "turn_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def counters(decoded: DataFrame) -> DataFrame:
    """One row: lines decoded, processed, kept after filtering, malformed."""
    kind = F.get_json_object("json", "$.type")
    return decoded.agg(
        F.count_if(F.col("line").rlike(r"\S")).alias("total_entries"), F.count_if(F.col("json").isNotNull()).alias("processed_entries"), F.count_if(kind.isin(*KEPT_TYPES)).alias("filtered_entries"), F.count_if("malformed").alias("malformed_lines")
    )


def expected_chunks(total_tokens: DataFrame, column: str = "retained", config: PackConfig = PackConfig()) -> DataFrame:
    return total_tokens.withColumn("expected_chunks", F.ceil(F.col(column) / config.target))


def bound_violations(stats: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """One row: chunks, those under the least size, those over the hard limit."""
    return stats.agg(F.count("*").alias("chunks"), F.count_if(F.col("tokens_est") < config.least).alias("too_small"), F.count_if(F.col("tokens_est") > config.hard).alias("too_large"))


def history_totals(history: DataFrame) -> DataFrame:
    """One row of running totals over export history."""
    return history.agg(
        F.count("*").alias("exports"), F.count_if(F.col("type") == "full").alias("full"), F.count_if(F.col("type") == "incremental").alias("incremental"),
        F.coalesce(F.sum("entries_processed"), F.lit(0)).alias("entries"), F.coalesce(F.sum("knowledge_items_extracted"), F.lit(0)).alias("knowledge_items"),
    )


def fallback_level(totals: tuple[int, int, int, int], budget: int) -> int:
    """The first level whose estimated tokens fit: all, without thinking and results, text only, recent lines; 4 if none does."""
    return next((k for k, t in enumerate(totals) if t <= budget), 4)
