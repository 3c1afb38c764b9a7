"""Full and incremental exports, status and cleanup over a store directory.

The store holds ``chunks/``, ``cursors/`` (versions behind a pointer),
``history/`` (appended) and ``log/``; its root is a folder that the driver and
all executors share.

An export begins with a snapshot: how many lines each file has and what the last
one says.  Lines beyond it are not read, and exactly the snapshot becomes the
cursors, after the chunks are written.  So what is appended meanwhile is left for
the next run, and a run that dies in between repeats work and loses none.

What may go wrong, and what is done:

* a file is missing: `MissingTranscript`;  * no file given: `NoTranscripts`;
* an empty file: nothing of it, a warning, status ``empty`` if all are;
* lines that are no JSON objects: left out and counted, a warning, status ``partial``;
* a cut file: exported in full again, with a warning that a full export is due;
* the state is missing or broken: as on a first run, with a warning if broken;
* too little disk space: `NoSpace`, before anything is written;
* a chunk cannot be written: tried again once, then `WriteFailed`; earlier chunks stay;
* entries are lost on the way to the chunks: `NotConserved`, and no cursor moves;
* no project directory matches: `NoProject`, which lists the directories there are;
* Python is too old: `ExportError`.
"""

from __future__ import annotations

import os
import re
import shutil
import sys
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import CATEGORIES, RECENT_LINES, PackConfig
from ..operators import extract, knowledge, pack, render, stats, turns
from ..sources import knowledge as bases
from ..sources import transcripts

CURSORS = "file string, line_number long, uuid string, timestamp string, size_bytes long, line_count long, last_modified timestamp"
#: Rendered turns in, drafts out.
Extractor = Callable[[pd.DataFrame], list[dict]]
HISTORY = "type string, timestamp timestamp, duration_seconds double, chunks_analyzed long, entries_processed long, knowledge_items_extracted long, tokens_estimated long"


class ExportError(Exception):
    """An export that cannot go on."""


class NoTranscripts(ExportError):
    """No file was given."""


class MissingTranscript(ExportError):
    """A file is not there."""


class NoProject(ExportError):
    """No directory matches the project; ``candidates`` are those there are."""

    def __init__(self, project: str, candidates: list[str]):
        super().__init__(f"no transcripts for {project}; name the files yourself, or one of: {', '.join(candidates) or 'none'}")
        self.candidates = candidates


class NoSpace(ExportError):
    """The store's disk has too little room."""


class WriteFailed(ExportError):
    """Chunks could not be written, twice."""


class NotConserved(ExportError):
    """The chunks do not hold the entries that were kept."""


@dataclass
class Export:
    """What an export made: chunks, their stats, counters, the cursors to commit, warnings and the result record."""

    mode: str
    packed: DataFrame
    stats: DataFrame
    counters: DataFrame
    cursors: DataFrame
    result: DataFrame
    warnings: list[str]
    conserving: bool = True


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def cursors(self) -> DataFrame:
        """Committed cursors; none on a first run, and none, with a warning, where the state is broken.

        Only a state that is missing or cannot be understood counts as broken: any
        other failure to read it is raised, as a commit without the other files'
        cursors would drop them.
        """
        none = self.spark.createDataFrame([], CURSORS)
        pointer = self.root / "cursors" / "CURRENT"
        if not pointer.exists():
            return none
        version = pointer.read_text(encoding="utf-8", errors="replace").strip()
        if not re.fullmatch(r"v-[0-9a-f]{32}", version) or not (self.root / "cursors" / version).is_dir():
            warnings.warn(f"the state under {self.root} is broken: this counts as a first run", stacklevel=2)
            return none
        return self.spark.read.schema(CURSORS).parquet(str(self.root / "cursors" / version))

    def commit(self, cursors: DataFrame) -> None:
        """Makes ``cursors`` (files that they do not name keep theirs) the current version."""
        old = self.cursors().join(cursors.select("file"), "file", "left_anti")
        version = f"v-{uuid.uuid4().hex}"
        names = [c.split()[0] for c in CURSORS.split(", ")]
        old.select(names).unionByName(cursors.select(names)).coalesce(1).write.parquet(str(self.root / "cursors" / version))
        fresh = self.root / "cursors" / f".{version}"
        fresh.write_text(version)
        fresh.replace(self.root / "cursors" / "CURRENT")

    def history(self) -> DataFrame:
        path = self.root / "history"
        return self.spark.read.schema(HISTORY).parquet(str(path)) if path.exists() else self.spark.createDataFrame([], HISTORY)

    def record(self, rows: DataFrame, result: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(str(self.root / "history"))
        result.coalesce(1).write.mode("append").text(str(self.root / "log"))


def file_status(lines: DataFrame, cursors: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per file: ``file, line_count, line_number, state``: new, unchanged, grown, truncated or changed.

    ``counts``: the files' ``line_count`` where it is known; else lines are counted.

    ``changed``: the cursor's last line no longer has its uuid and timestamp.
    """
    if counts is None:
        counts = lines.groupBy("file").agg(F.count("*").alias("line_count"))
    c = cursors.select("file", "line_number", F.col("uuid").alias("c_uuid"), F.col("timestamp").alias("c_timestamp"))
    at = lines.join(c, "file").filter(F.col("line_num") == F.col("line_number") - 1)
    json = F.col("line")
    seen = at.select("file", (F.coalesce(F.get_json_object(json, "$.uuid"), F.lit("")) == F.col("c_uuid")).alias("same_uuid"), (F.coalesce(F.get_json_object(json, "$.timestamp"), F.lit("")) == F.col("c_timestamp")).alias("same_time"))
    both = counts.join(c, "file", "left").join(seen, "file", "left")
    state = (
        F.when(F.col("line_number").isNull(), "new")
        .when(F.col("line_count") < F.col("line_number"), "truncated")
        .when(~(F.coalesce("same_uuid", F.lit(True)) & F.coalesce("same_time", F.lit(True))), "changed")
        .when(F.col("line_count") == F.col("line_number"), "unchanged")
        .otherwise("grown")
    )
    return both.select("file", "line_count", F.coalesce("line_number", F.lit(0)).cast("long").alias("line_number"), state.alias("state"))


def build(spark: SparkSession, paths: list[str], mode: str = "full", cursors: DataFrame | None = None, config: PackConfig = PackConfig(), paired: bool = False, budget: int | None = None) -> Export:
    """The plan of an export, lazily but for the snapshot: lines, entries, parts, turns, chunks.

    Incremental: unchanged files give nothing, grown ones what follows their
    cursor, all others everything.  A ``budget`` of estimated tokens picks the
    first fallback level that fits it, from totals computed beforehand.
    """
    if not paths:
        raise NoTranscripts("no transcript files")
    try:
        held = transcripts.snapshot(spark, paths)
        taken = spark.createDataFrame(held.collect(), held.schema)  # a row for each of ``paths``
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            raise MissingTranscript(f"not there: {e.getMessageParameters().get('path', paths)}") from e
        raise
    new = taken.select([c.split()[0] for c in CURSORS.split(", ")])
    until = F.broadcast(taken.select("file", F.col("line_number").alias("__end")))
    lines = transcripts.read_lines(spark, paths).join(until, "file").filter(F.col("line_num") < F.col("__end")).drop("__end")
    seen = [unquote(urlparse(r.file).path) for r in taken.filter("line_count > 0").select("file").collect()]
    empty = [p for p in paths if not re.search(r"[*?\[{]", p) and not any(f == _plain(p) or f.startswith(_plain(p) + "/") for f in seen)]
    notes = [f"{p}: no conversation history" for p in empty]
    if mode == "incremental" and cursors is not None:
        state = file_status(lines, cursors, taken.select("file", F.col("line_number").alias("line_count"))).collect()  # a row a file
        for r in sorted(state, key=lambda r: r.file):
            if r.state in ("truncated", "changed"):
                notes.append(f"{r.file}: {r.state} since the last export, taken whole again; a full export is recommended")
        # Only files that have something new are read on; what follows a cursor is taken of those that grew.
        start = spark.createDataFrame([(r.file, r.line_number if r.state == "grown" else 0) for r in state if r.state != "unchanged"], "file string, line_number long")
        lines = transcripts.after_cursors(lines.filter(F.col("file").isin([r.file for r in state if r.state != "unchanged"])), F.broadcast(start))
    tasks = spark.sparkContext.defaultParallelism
    if len(paths) < tasks:  # a file is one task's, and few files would leave the others idle
        lines = lines.repartition(tasks)
    decoded = transcripts.decode(lines)
    kept = extract.content_parts(extract.keep_conversation(transcripts.entries(decoded)))
    if budget is not None:
        kept = _fit(kept, budget)
    sized = stats.part_tokens(kept)
    numbered = turns.number_turns(sized, paired=paired)
    packed = pack.pack(numbered.select("file", "line_num", "type", "timestamp", "uuid", "parts", "turn_id", "tokens"), "file", "line_num", config)
    chunk_stats = pack.chunk_stats(packed, "file", "timestamp")
    counters = stats.counters(decoded)
    counted = spark.createDataFrame(counters.collect(), counters.schema)  # one row, counted once
    bad = counted.first().malformed_lines
    if bad:
        notes.append(f"{bad} malformed lines left out")
    status = "partial" if bad else "success" if seen else "empty"
    prefix = "chunk" if mode == "full" else "chunk-inc"
    return Export(mode, packed, chunk_stats, counted, new, render.result_record(status, mode, counted, chunk_stats, new, prefix=prefix, warnings=notes), notes, budget is None)


def _plain(path: str) -> str:
    """A path without scheme, as the driver's machine names it where it has none."""
    parts = urlparse(path)
    return unquote(parts.path).rstrip("/") if parts.scheme else os.path.abspath(path)


def locate(project: str, root: str, override: list[str] | None = None) -> list[str]:
    """The project's transcript files, newest first, or those named by ``override``."""
    if override:
        return override
    found = transcripts.discover(project, root)
    if not found:
        raise NoProject(project, sorted(os.listdir(root)) if os.path.isdir(root) else [])
    return found


def check_space(root: Path, need: int) -> None:
    """Raises `NoSpace` if the disk of ``root`` (or of the first folder above it that there is) has fewer than ``need`` bytes."""
    at = root
    while not at.exists():
        at = at.parent
    free = shutil.disk_usage(at).free
    if free < need:
        raise NoSpace(f"{at} has {free} bytes free and {need} are needed: free some up")


def check_python(version: tuple = tuple(sys.version_info), least: tuple = (3, 8)) -> None:
    if tuple(version[:2]) < least:
        raise ExportError(f"Python {least[0]}.{least[1]} or later is needed")


def validate(made: Export) -> None:
    """Raises `NotConserved` unless the chunks hold each kept entry once.  Fallback levels leave entries out on purpose."""
    if made.conserving:
        in_chunks, kept = made.stats.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0], made.counters.first().filtered_entries
        if in_chunks != kept:
            raise NotConserved(f"{kept} entries were kept and the chunks hold {in_chunks}")


def _fit(kept: DataFrame, budget: int) -> DataFrame:
    """Entries cut to the first fallback level that fits ``budget``."""
    levels = [extract.drop_parts(kept, k) for k in range(3)]
    levels.append(turns.recent(levels[2], RECENT_LINES))
    totals = tuple((stats.part_tokens(x).agg(F.sum("tokens")).first()[0] or 0) for x in levels)
    level = stats.fallback_level(totals, budget)
    if level > 3:
        raise ExportError(f"even the last {RECENT_LINES} lines of text are {totals[3]} tokens; the budget is {budget}")
    return levels[level]


def run(store: Store, paths: list[str], mode: str = "full", retries: int = 1, extractor: Extractor | None = None, **options) -> Export:
    """Builds, writes chunks (again once on failure), then moves the cursors and records history.

    Chunks are written beside the earlier ones and take their place when whole.
    With an ``extractor`` the history also counts the knowledge items it finds.
    """
    check_python()
    began = time.time()
    made = build(store.spark, paths, mode, store.cursors() if mode == "incremental" else None, **options)
    made.packed.persist()  # read for the chunks' stats, their turns and the checks
    try:
        return _finish(store, made, mode, retries, extractor, began)
    finally:
        made.packed.unpersist()


def _finish(store: Store, made: Export, mode: str, retries: int, extractor: Extractor | None, began: float) -> Export:
    check_space(store.root, 2 * (made.cursors.agg(F.sum("size_bytes")).first()[0] or 0))
    validate(made)
    target = store.root / "chunks" / ("chunk" if mode == "full" else f"chunk-inc-{uuid.uuid4().hex[:8]}")
    fresh = store.root / "chunks" / f".new-{uuid.uuid4().hex[:8]}"
    for attempt in range(retries + 1):
        try:
            render.write_chunks(made.packed, made.stats, str(fresh), prefix="chunk" if mode == "full" else "chunk-inc")
            break
        except Exception as e:
            shutil.rmtree(fresh, ignore_errors=True)
            if attempt == retries:
                raise WriteFailed(f"chunks could not be written to {fresh}") from e
    shutil.rmtree(target, ignore_errors=True)
    fresh.rename(target)
    items = extract_knowledge(render.render_turns(made.packed), extractor).count() if extractor else 0
    total = made.stats.agg(F.count("*"), F.coalesce(F.sum("tokens_est"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    row = [(mode, pd.Timestamp.now("UTC").to_pydatetime(), time.time() - began, total[0], total[2], items, total[1])]
    result = made.result
    store.commit(made.cursors)
    store.record(store.spark.createDataFrame(row, HISTORY), result)
    for note in made.warnings:
        warnings.warn(note, stacklevel=2)
    return made


def full(store: Store, paths: list[str], **options) -> Export:
    return run(store, paths, "full", **options)


def incremental(store: Store, paths: list[str], **options) -> Export:
    return run(store, paths, "incremental", **options)


def status(store: Store, paths: list[str]) -> DataFrame:
    """What an incremental export would find, without doing it."""
    return file_status(transcripts.read_lines(store.spark, paths), store.cursors())


def cleanup(store: Store) -> int:
    """Deletes written chunks, and nothing outside their directory; returns how many files went."""
    chunks = store.root / "chunks"
    files = [f for f in chunks.rglob("*.txt")] if chunks.is_dir() else []
    shutil.rmtree(chunks, ignore_errors=True)
    return len(files)


def headings_extractor(turn_rows: pd.DataFrame) -> list[dict]:
    """The deterministic default: lines ``<category>: <title> - <body>`` of texts become drafts."""
    out = []
    for text in turn_rows["text"]:
        for line in (text or "").splitlines():
            category, colon, rest = line.partition(": ")
            title, dash, body = rest.partition(" - ")
            if colon and dash and category.strip("#-* ").lower() in CATEGORIES:
                out.append({"category": category.strip("#-* ").lower(), "section": "", "title": title.strip(), "body": body.strip()})
    return out


def extract_knowledge(rendered: DataFrame, extractor: Extractor = headings_extractor) -> DataFrame:
    """Draft entries from rendered turns, a batch of rows at a time: the extension point for other extractors."""

    def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = extractor(batch)
            yield pd.DataFrame(found, columns=["category", "section", "title", "body"], dtype=object)

    return rendered.select("text").mapInPandas(run_batches, "category string, section string, title string, body string")


def union_extractions(*drafts: DataFrame) -> DataFrame:
    """The drafts of several chunks or exports as one table for one merge; what several of them found counts once."""
    names = ["category", "section", "title", "body"]
    out = drafts[0].select(names)
    for more in drafts[1:]:
        out = out.unionByName(more.select(names))
    return out.dropDuplicates(names)


def extract_incremental(rendered: DataFrame, kb: DataFrame, extractor: Extractor = headings_extractor) -> tuple[DataFrame, DataFrame]:
    """Drafts of new turns, for a knowledge base that may hold them already: what is to be merged, and what changes in place.

    Drafts that a live entry says word for word are left out.  Drafts of the
    category ``state`` whose title a live draft there has already are changes of
    that entry.
    """
    found = union_extractions(extract_knowledge(rendered, extractor)).withColumn("title_key", knowledge.title_key(F.col("title")))
    live = kb.filter("status <> 'X'")
    fresh = found.join(live.select("category", "title", "body"), ["category", "title", "body"], "left_anti")
    held = live.filter("category = 'state' and status = 'D'").select("category", knowledge.title_key(F.col("title")).alias("title_key")).distinct()
    names = ["category", "section", "title", "body"]
    return fresh.join(held, ["category", "title_key"], "left_anti").select(names), fresh.join(held, ["category", "title_key"], "left_semi").select(names)


def update_in_place(kb: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Live drafts take the body of the change of their category and title (of several, the greatest); all else stays."""
    new = changes.groupBy("category", knowledge.title_key(F.col("title")).alias("title_key")).agg(F.max("body").alias("__body"))
    met = kb.withColumn("title_key", knowledge.title_key(F.col("title"))).join(new, ["category", "title_key"], "left")
    hit = F.col("__body").isNotNull() & (F.col("status") == "D") & ~F.col("__body").eqNullSafe(F.col("body"))
    done = met.withColumns({"__new_body": F.when(hit, F.col("__body")).otherwise(F.col("body")), "__at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return done.withColumns({"body": F.col("__new_body"), "updated_at": F.col("__at")}).select(*kb.columns)


def sync(spark: SparkSession, root: str, drafts: DataFrame, now: Column, scope: str = "all", changes: DataFrame | None = None) -> DataFrame:
    """Merges ``drafts`` (and ``changes`` in place) of the scope's categories into the snapshot under ``root``.

    Categories outside the scope stay as they are.  Returns the sync's summary by
    category.  Columns ``fact_key`` and ``fact_value`` are taken where drafts have
    them.
    """
    facts = {"fact_key": F.lit(None).cast("string"), "fact_value": F.lit(None).cast("string")}
    whole = bases.read_snapshot(spark, root)
    mine, others = knowledge.in_scope(whole, scope), whole.join(knowledge.in_scope(whole, scope).select("category").distinct(), "category", "left_anti")
    if changes is not None:
        mine = update_in_place(mine, knowledge.in_scope(changes, scope), now)
    new = knowledge.in_scope(drafts, scope).withColumns({k: v for k, v in facts.items() if k not in drafts.columns} | {"status": F.lit("D"), "created_at": now, "updated_at": now})
    old = mine.withColumns(facts)
    summary = knowledge.sync_summary(knowledge.classify(old, new))
    told = spark.createDataFrame(summary.collect(), summary.schema)  # a row for each category, as it was before the merge
    merged = knowledge.merge(old, new.select(*old.columns), now)
    bases.write_snapshot(merged.drop("fact_key", "fact_value").unionByName(others.select(*mine.columns)), root)
    return told


def sync_kb(spark: SparkSession, root: str, drafts: DataFrame, now: Column) -> DataFrame:
    return sync(spark, root, drafts, now, "kb")


def sync_growth(spark: SparkSession, root: str, drafts: DataFrame, now: Column) -> DataFrame:
    return sync(spark, root, drafts, now, "growth")


def sync_alignment(spark: SparkSession, root: str, drafts: DataFrame, now: Column) -> DataFrame:
    return sync(spark, root, drafts, now, "alignment")
