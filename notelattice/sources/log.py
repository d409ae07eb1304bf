"""A growing log file as a stream of its whole lines.

`format("notelattice.log")` follows the newest file of a name below a folder. An offset is a file, its inode
and a byte position behind a newline, whatever the file holds: a batch is the bytes between two offsets. A
file that was truncated or replaced is read from its start. Of more than `maxBytes` since the last batch only
the end is forwarded, from the first whole line on. Empty lines and what is not yet a line stay out.
"""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from notelattice.functions.ship import ship

log = logging.getLogger(__name__)
SCHEMA = "path string, at bigint, line string"
MAX_BYTES = 256 * 1024
NAME = "sync.log"


def newest(path: str, name: str = NAME) -> tuple[str, os.stat_result] | None:
    """The file itself, or the latest regular file called `name` in the folder or a folder of it; of
    equal times the last in name order. Links are not followed."""
    found = []
    try:
        info = os.lstat(path)
        if stat.S_ISREG(info.st_mode):
            return path, info
        for at in (path, *(e.path for e in os.scandir(path) if e.is_dir(follow_symlinks=False))):
            try:
                info = os.lstat(os.path.join(at, name))
            except OSError:
                continue
            if stat.S_ISREG(info.st_mode):
                found.append((info.st_mtime_ns, os.path.join(at, name), info))
    except OSError:
        return None
    return max(found, key=lambda x: x[:2])[1:] if found else None


def last_line_end(path: str, size: int, step: int = 1 << 16) -> int:
    """The position behind the last newline before `size`, 0 if there is none."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            start = max(0, at - step)
            f.seek(start)
            i = f.read(at - start).rfind(b"\n")
            if i >= 0:
                return start + i + 1
            at = start
    return 0


@dataclass
class Span(InputPartition):
    path: str
    inode: int
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.name = low["path"].removeprefix("file:"), low.get("name", NAME)
        self.cap, self.begin = int(low.get("maxbytes", MAX_BYTES)), low.get("from", "end")

    def _now(self) -> dict:
        at = newest(self.path, self.name)
        try:
            return {"path": at[0], "inode": at[1].st_ino, "at": last_line_end(at[0], at[1].st_size)} if at else {"path": "", "inode": 0, "at": 0}
        except OSError:  # it went meanwhile
            return {"path": "", "inode": 0, "at": 0}

    def initialOffset(self) -> dict:
        """Behind the last whole line there is; with from=start, before the first."""
        return self._now() if self.begin == "end" else {"path": "", "inode": 0, "at": 0}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not end["path"]:
            return []
        same = (start["path"], start["inode"]) == (end["path"], end["inode"]) and start["at"] <= end["at"]
        first = start["at"] if same else 0
        return [Span(end["path"], end["inode"], first, end["at"])] if first < end["at"] else []

    def read(self, partition: Span) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as f:
                if os.fstat(f.fileno()).st_ino != partition.inode:
                    log.warning("%s was replaced before it was read", partition.path)
                    return
                at = partition.start
                if partition.end - at > self.cap:
                    at = partition.end - self.cap
                    log.warning("%s grew by more than %d bytes; %d are skipped", partition.path, self.cap, at - partition.start)
                    f.seek(at - 1)
                    if f.read(1) != b"\n":  # within a line: its rest goes too
                        at += len(f.readline())
                f.seek(at)
                for raw in f.read(partition.end - at).split(b"\n")[:-1]:
                    line = raw.decode("utf-8", "replace").removesuffix("\r")
                    if line:
                        yield partition.path, at, line
                    at += len(raw) + 1
        except FileNotFoundError:
            log.warning("%s went before it was read", partition.path)

    def commit(self, end: dict) -> None:
        pass


class LogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notelattice.log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, at (the byte that it begins at) and line of the whole lines that come to a log."""
    ship(spark)
    spark.dataSource.register(LogDataSource)
    reader = spark.readStream.format("notelattice.log")
    for k, v in options.items():
        reader = reader.option(k.removesuffix("_"), v)
    return reader.load(path)
