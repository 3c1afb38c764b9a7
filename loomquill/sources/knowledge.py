"""Knowledge bases and tickets: Markdown and Parquet readers, versioned snapshot writer."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import entry_status, entry_title, strip
from ..functions.config import CATEGORIES

SCHEMA = "category string, section string, status string, title string, body string, created_at timestamp, updated_at timestamp"


def parse_markdown(files: DataFrame) -> DataFrame:
    """Entries of Markdown files (``category, text``): ``category, section, status, title, body``.

    ``## `` opens a section, ``### [S] Title`` an entry, whose body runs to the
    next heading of either kind.
    """
    lines = files.select("category", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("at", "line"))
    so_far = Window.partitionBy("category").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").rlike("^## "), strip(F.substring("line", 4, 1 << 20))), ignorenulls=True).over(so_far)
    number = F.sum(F.when(F.col("line").rlike("^###? "), 1).otherwise(0)).over(so_far)
    marked = lines.select("category", "at", "line", section.alias("section"), number.alias("n"))
    heading = F.max(F.when(F.col("line").rlike("^### "), F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").rlike("^##"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    got = marked.groupBy("category", "n").agg(F.max("section").alias("section"), heading.alias("heading"), body.alias("body")).filter("heading is not null")
    return got.select("category", "section", entry_status(F.col("heading")).alias("status"), strip(entry_title(F.col("heading"))).alias("title"), strip(F.col("body")).alias("body"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """All ``<category>.md`` files of a directory, parsed."""
    files = spark.read.text(f"{path}/*.md", wholetext=True)
    named = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("category"), F.col("value").alias("text"))
    return parse_markdown(named.filter(F.col("category").isin(*CATEGORIES)))


def to_markdown(kb: DataFrame) -> DataFrame:
    """``category, text``: one Markdown document a category, sections and entries in the order of their names."""
    entry = F.concat(F.lit("### ["), "status", F.lit("] "), "title", F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    sections = kb.groupBy("category", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", entry.alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    head = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("## "), "section", F.lit("\n\n"))).otherwise("")
    joined = sections.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.concat(head, "text").alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    return joined


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The current snapshot under ``root``, or an empty knowledge base."""
    pointer = Path(root) / "CURRENT"
    if not pointer.exists():
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{root}/{pointer.read_text().strip()}")


def write_snapshot(kb: DataFrame, root: str) -> str:
    """Writes a whole new version partitioned by category, then moves the pointer; readers never see half of it."""
    version = f"v-{uuid.uuid4().hex}"
    kb.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition("category").write.partitionBy("category").parquet(f"{root}/{version}")
    fresh = Path(root) / f".CURRENT-{version}"
    fresh.write_text(version)
    fresh.replace(Path(root) / "CURRENT")
    return version


def drop_old_snapshots(root: str) -> int:
    """Deletes versions the pointer does not name; returns how many."""
    current = (Path(root) / "CURRENT").read_text().strip() if (Path(root) / "CURRENT").exists() else ""
    old = [p for p in Path(root).glob("v-*") if p.is_dir() and p.name != current]
    for p in old:
        shutil.rmtree(p)
    return len(old)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Ticket files ``NN-name.md``: ``number, status, type, blocked_by``; a ticket without a status is open."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*)$", 1)
    blockers = F.transform(F.filter(F.split(field("Blocked by"), r"[^0-9]+"), lambda x: x != ""), lambda x: x.cast("int"))
    status = F.lower(strip(field("Status")))
    return files.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)-", 1).try_cast("int").alias("number"), F.when(status == "", "open").otherwise(status).alias("status"), F.nullif(F.lower(strip(field("Type"))), F.lit("")).alias("type"), blockers.alias("blocked_by")
    ).filter("number is not null")


def load_json(path: str) -> dict | None:
    """A small JSON file on the driver; null where it is missing or broken."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None
