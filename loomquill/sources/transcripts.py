"""Transcript files: discovery, line scans with cursors, and decoded entries."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import json_text, strip

LINES = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_num", T.LongType()), T.StructField("line", T.StringType())])


def path_candidates(path: str, existing: list[str] | None = None) -> list[str]:
    """Directory names a project path may be stored under, without repeats, likeliest first.

    Separators become dashes and colons go; then the same in lower case and with
    a trailing separator; then those of ``existing`` whose path contains, or is
    contained in, the project's.
    """
    flat = path.replace("\\", "/")
    found = [flat.replace("/", "-").replace(":", "")]
    found.append(found[0].lower())
    if not flat.endswith("/"):
        found.append(found[0] + "-")
    plain = flat.lower().replace(":", "")
    # Containment of whole path parts: a directory for ``/root`` says nothing of every project below it by a part's beginning.
    inside = lambda a, b: f"/{a.strip('/')}/" in f"/{b.strip('/')}/"
    found += [name for name in existing or [] if (restored := name.replace("-", "/").lower()).strip("/") and (inside(restored, plain) or inside(plain, restored))]
    return list(dict.fromkeys(found))


def discover(project: str, root: str, latest_only: bool = False) -> list[str]:
    """Transcript files of a project under ``root``, newest first; empty if there are none."""
    base = Path(root)
    if not base.is_dir():
        return []
    for name in path_candidates(os.path.abspath(project), sorted(os.listdir(base))):
        files = sorted((base / name).glob("*.jsonl"), key=lambda f: (-f.stat().st_mtime, f.name)) if (base / name).is_dir() else []
        if files:
            return [str(f) for f in files[: 1 if latest_only else None]]
    return []


def file_facts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, size_bytes, last_modified, line_count`` of each file."""
    lines = read_lines(spark, paths)
    facts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("last_modified"))
    counted = lines.groupBy("file").agg(F.count("*").alias("line_count"))
    return facts.join(counted, "file", "left").select("file", "size_bytes", "last_modified", F.coalesce("line_count", F.lit(0)).alias("line_count"))


def snapshot(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What each file holds now: ``file, size_bytes, last_modified, line_count, line_number, uuid, timestamp, malformed_end``.

    ``line_number`` is how many lines an export of this snapshot consumes.  A last
    line without a line end that is no JSON object is still being written
    (``malformed_end``) and is left for the next time.  ``uuid`` and ``timestamp``
    are those of the last line consumed.  One row a file; Spark leaves out files of
    no bytes.
    """
    whole = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("last_modified"), "value"
    )
    lines = F.when(F.length("value") > 0, F.split(F.regexp_replace("value", r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r", -1)).otherwise(F.expr("cast(array() as array<string>)"))
    cut = whole.withColumns({"lines": lines, "ended": F.col("value").rlike(r"[\r\n]$") | (F.col("value") == "")})
    last = strip(F.element_at("lines", -1))
    open_end = ~F.col("ended") & (last != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json(last)).startswith("OBJECT"), F.lit(False))
    marked = cut.withColumn("malformed_end", F.coalesce(open_end, F.lit(False)))
    number = F.size("lines") - F.col("malformed_end").cast("int")
    at = F.when(number > 0, F.element_at("lines", F.greatest(number, F.lit(1))))
    return marked.select(
        "file", "size_bytes", "last_modified", F.size("lines").cast("long").alias("line_count"), number.cast("long").alias("line_number"),
        F.coalesce(F.get_json_object(at, "$.uuid"), F.lit("")).alias("uuid"), F.coalesce(F.get_json_object(at, "$.timestamp"), F.lit("")).alias("timestamp"), "malformed_end",
    )


def latest_file(facts: DataFrame) -> DataFrame:
    """The file modified last (ties to the greater name)."""
    return facts.agg(F.max_by("file", F.struct("last_modified", "file")).alias("file"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line_num, line``: physical lines numbered from 0 in each file, blank ones too.

    A session file is one task's row; its lines become rows at once.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    body = F.regexp_replace("value", r"(\r\n|\n|\r)$", "")
    lines = whole.filter(F.length("value") > 0).select("file", F.posexplode(F.split(body, r"\r\n|\n|\r", -1)).alias("line_num", "line"))
    return lines.select("file", F.col("line_num").cast("long").alias("line_num"), "line")


def slice_lines(lines: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Lines of ``[start, end)``."""
    out = lines.filter(F.col("line_num") >= start)
    return out if end is None else out.filter(F.col("line_num") < end)


def after_cursors(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """Lines at or after each file's cursor (lines consumed); files without one in full."""
    at = cursors.select("file", F.col("line_number").alias("__cursor"))
    return lines.join(at, "file", "left").filter(F.col("line_num") >= F.coalesce("__cursor", F.lit(0))).drop("__cursor")


def decode(lines: DataFrame) -> DataFrame:
    """Adds ``json`` (null for lines that are blank or no JSON object) and ``malformed``."""
    text = strip(F.col("line"))
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    good = F.coalesce(is_object, F.lit(False))
    return lines.withColumns({"json": F.when(good, text), "malformed": (text != "") & ~good})


def entries(decoded: DataFrame) -> DataFrame:
    """``file, line_num, type, timestamp, uuid, content, is_array`` of decoded lines of all types; absent fields are empty."""
    json = F.col("json")
    shape = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), "$.message.content", "variant"))
    return decoded.filter(json.isNotNull()).select(
        "file", "line_num", F.get_json_object(json, "$.type").alias("type"), json_text(json, "$.timestamp").alias("timestamp"), json_text(json, "$.uuid").alias("uuid"),
        json_text(json, "$.message.content").alias("content"), F.coalesce(shape.startswith("ARRAY"), F.lit(False)).alias("is_array"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved conversation files ``conversation-YYYYMMDD-NNN.md``: ``file, day, number, text``."""
    files = spark.read.option("pathGlobFilter", "conversation-*.md").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    pattern = r"^conversation-(\d{8})-(\d+)\.md$"
    return files.select(name.alias("file"), F.try_to_date(F.regexp_extract(name, pattern, 1), "yyyyMMdd").alias("day"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("number"), F.col("value").alias("text")).filter(F.col("number").isNotNull())


def from_memory(rows: DataFrame) -> DataFrame:
    """A session held by the caller, as entries: needs ``type`` and ``content``; lines are numbered in the order of ``line_num``."""
    have = set(rows.columns)
    put = {"file": F.lit("memory"), "timestamp": F.lit(""), "uuid": F.lit(""), "is_array": F.lit(False)}
    return rows.withColumns({k: v for k, v in put.items() if k not in have}).select("file", F.col("line_num").cast("long").alias("line_num"), "type", "timestamp", "uuid", "content", "is_array")
