"""Transcripts as a stream: a Python data source that sees appended lines.

Spark's own file stream never reads a file again, so appended lines would be
lost.  Offsets here are ``{file: bytes consumed}``; a batch reads whole lines
between two offsets, each file in a partition of its own.

    spark.dataSource.register(TranscriptTail)
    spark.readStream.format("transcript_tail").option("path", directory).load()
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start_byte long, line string"


@dataclass
class FileSlice(InputPartition):
    file: str
    start: int
    end: int


class TranscriptTail(DataSource):
    """Options: ``path``, a directory all readers share; ``glob``, file names (default ``*.jsonl``)."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options["path"], self.options.get("glob", "*.jsonl"))


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Each file's bytes up to its last line feed; a file cut short starts again."""
        return {f: end for f in sorted(glob.glob(os.path.join(self.path, self.pattern))) if (end := _whole_lines(f))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file, to in end.items():
            at = start.get(file, 0)
            if to != at:
                out.append(FileSlice(file, at if at < to else 0, to))
        return out

    def read(self, partition: FileSlice) -> Iterator[tuple]:
        with open(partition.file, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


def _whole_lines(file: str, block: int = 1 << 16) -> int:
    """How many bytes of a file are lines that have ended, read from its end."""
    with open(file, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - block)
            f.seek(start)
            found = f.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0
