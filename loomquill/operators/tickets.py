"""Tickets: which may be taken up next, and their transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontier(tickets: DataFrame) -> DataFrame:
    """Open tickets whose blockers are all resolved.  A blocker without a ticket is unresolved."""
    open_ones = tickets.filter("status = 'open'")
    waits = open_ones.select("number", F.explode("blocked_by").alias("blocker"))
    resolved = tickets.filter("status = 'resolved'").select(F.col("number").alias("blocker"))
    stuck = waits.join(resolved, "blocker", "left_anti").select("number").distinct()
    return open_ones.join(stuck, "number", "left_anti")


def next_ticket(tickets: DataFrame) -> DataFrame:
    """The frontier's lowest number."""
    return frontier(tickets).orderBy("number").limit(1)


def set_status(tickets: DataFrame, number: int, status: str) -> DataFrame:
    """A claim (``claimed``) or resolution (``resolved``)."""
    return tickets.withColumn("status", F.when(F.col("number") == number, F.lit(status)).otherwise(F.col("status")))


def role_labels(roles: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Adds the tracker's ``label`` of each ``role``; unknown roles have none."""
    label = F.lit(None).cast("string")
    for role, name in labels.items():
        label = F.when(F.col("role") == role, F.lit(name)).otherwise(label)
    return roles.withColumn("label", label)
