"""Column functions: token estimates, slices, JSON access and line parsing, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import CONSUMERS, RETENTION, SAFETY_FACTOR


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens: one a character from U+4E00 to U+9FFF, a quarter for any other, rounded down.  Null has none."""
    t = F.coalesce(text, F.lit(""))
    wide = F.length(F.regexp_replace(t, "[^一-鿿]", ""))
    return F.floor(wide + (F.length(t) - wide) / 4).cast("long")


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_text(json: Column, path: str, default: str = "") -> Column:
    """The value at ``path`` as text, or ``default`` where there is none."""
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def retained(kind: Column, tokens: Column) -> Column:
    """Tokens left after truncation, by the kind's retention rate (a planning estimate; unknown kinds keep all)."""
    rate = F.lit(1.0)
    for name, share in RETENTION.items():
        rate = F.when(kind == name, F.lit(share)).otherwise(rate)
    return tokens * rate


def real_tokens(tokens: Column) -> Column:
    """Expected real tokens of an estimate."""
    return tokens * F.lit(SAFETY_FACTOR)


def context_share(tokens: Column, overhead: int = 38_000, window: int = 1_000_000) -> Column:
    """The share of a model's context that a chunk and the prompt around it take."""
    return (real_tokens(tokens) + F.lit(overhead)) / F.lit(window)


def cost(tokens_in: Column, tokens_out: Column, per_million_in: float = 3.0, per_million_out: float = 15.0) -> Column:
    """Price of a model call."""
    return (tokens_in * F.lit(per_million_in) + tokens_out * F.lit(per_million_out)) / F.lit(1_000_000)


def entry_status(heading: Column) -> Column:
    """Status of a ``### [S] Title`` heading; unmarked ones are drafts.  Null for lines that are no heading."""
    return F.when(heading.rlike("^### "), F.coalesce(F.nullif(F.regexp_extract(heading, r"^### (?:\[([DVX])\] )?", 1), F.lit("")), F.lit("D")))


def entry_title(heading: Column) -> Column:
    return F.when(heading.rlike("^### "), F.regexp_extract(heading, r"^### (?:\[[DVX]\] )?(.*)$", 1))


def item_time(line: Column) -> Column:
    """Timestamp of a ``- [YYYY-MM-DD HH:MM] text`` list item, or null."""
    return F.try_to_timestamp(F.regexp_extract(line, r"^- \[(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\] ", 1), F.lit("yyyy-MM-dd HH:mm"))


def status_rank(status: Column) -> Column:
    """0 for verified, 1 for draft, 2 for deprecated or anything else."""
    return F.when(status == "V", 0).when(status == "D", 1).otherwise(2)


def consumer(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, who in CONSUMERS.items():
        out = F.when(category == name, F.lit(who)).otherwise(out)
    return out


def word_set(text: Column) -> Column:
    """Distinct lower-cased words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")))
