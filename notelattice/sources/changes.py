"""A folder of notes listed by Spark, and its changes as a stream of numbered versions.

Folders are expanded level by level: each level is a job whose tasks list the folders they hold and pass
entries on as they come, so that the driver holds no paths. A listing is a table; a poll joins it with the one
before, and what differs becomes a version: a folder with the new listing and the events, which appears
by one rename. A reader's offset is how far it has come in the versions, whatever their size, and a restart
goes on from there with the same events.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.functions.paths import is_indexable
from notelattice.functions.ship import ship
from notelattice.operators.store import Folder

ENTRIES = "type string, path string, mtime_ms bigint, size bigint"
EVENTS = "kind string, path string, mtime_ms bigint, size bigint, version bigint"
#: Entries of a batch that a task passes on.
BATCH = 2000
#: Listings that stay; events stay until forget().
KEPT = 2


def entries_of(root: str, folder: str, tolerant: bool) -> Iterator[tuple[str, str, int, int]]:
    """Visible entries of one folder, links left out; those that go meanwhile are left out too."""
    try:
        found = os.scandir(os.path.join(root, folder))
    except (FileNotFoundError, NotADirectoryError):
        return
    except PermissionError:
        if tolerant:
            return
        raise
    with found:
        for e in found:
            if e.name.startswith(".") or e.is_symlink():
                continue
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                info = e.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            if e.is_dir(follow_symlinks=False):
                yield "folder", path, info.st_mtime_ns // 1_000_000, 0
            elif e.is_file(follow_symlinks=False):
                yield "file", path, info.st_mtime_ns // 1_000_000, info.st_size


def list_entries(spark: SparkSession, root: str, at: str, tolerant: bool = False) -> DataFrame:
    """type, path, mtime_ms, size of all entries below root, written to the folder `at` level by level. A
    root that is not there is an error."""
    ship(spark)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in entries_of(root, folder, tolerant):
                    out.append(row)
                    if len(out) >= BATCH:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        # folders next to each other in a listing may be large alike: they are dealt out
        level.repartition("path").mapInArrow(run, ENTRIES).write.parquet(f"{at}/{len(levels)}")
        levels.append(spark.read.schema(ENTRIES).parquet(f"{at}/{len(levels)}"))
        level = levels[-1].where("type = 'folder'").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["type", "path", "mtime_ms", "size"])


@dataclass
class Changes(Folder):
    """The versions of a vault's notes, below `root` (any store that Spark reads)."""

    vault: str = ""
    tolerant: bool = False

    def version(self) -> int:
        """The last version, 0 before the first poll."""
        return max((int(n[1:]) for n in self._names("v")), default=0)

    def listing(self, version: int) -> DataFrame:
        """path, mtime_ms, size of the notes of a version; none of version 0."""
        schema = "path string, mtime_ms bigint, size bigint"
        return self.spark.read.schema(schema).parquet(f"{self.root}/v{version:012d}/listing") if version else self.spark.createDataFrame([], schema)

    def poll(self) -> int | None:
        """Lists the notes; what differs from the last version becomes the next one, whose number is
        returned. None if nothing does. One poll at a time."""
        last, work = self.version(), f".work-{uuid.uuid4().hex}"
        try:
            found = list_entries(self.spark, self.vault, f"{self.root}/{work}/levels", self.tolerant)
            notes = found.where((F.col("type") == "file") & is_indexable(F.col("path"))).select("path", "mtime_ms", "size")
            old = self.listing(last).select("path", F.col("mtime_ms").alias("old_ms"), F.col("size").alias("old_size"))
            met = notes.join(old, "path", "full_outer")
            kind = F.when(F.col("size").isNull(), "remove").when(F.col("old_size").isNull() | (F.col("mtime_ms") != F.col("old_ms")) | (F.col("size") != F.col("old_size")), "upsert")
            events = met.select(kind.alias("kind"), "path", "mtime_ms", "size", F.lit(last + 1).cast("long").alias("version")).where("kind IS NOT NULL")
            events.write.parquet(f"{self.root}/{work}/next/events")
            if self.spark.read.schema(EVENTS).parquet(f"{self.root}/{work}/next/events").isEmpty():
                return None
            notes.write.parquet(f"{self.root}/{work}/next/listing")
            jvm, fs = self._fs()
            make = jvm.org.apache.hadoop.fs.Path
            if not fs.rename(make(self.root, f"{work}/next"), make(self.root, f"v{last + 1:012d}")):
                raise OSError(f"version {last + 1} is there already: two polls?")
            for n in self._names("v")[:-KEPT]:
                self._remove(f"{n}/listing")
            return last + 1
        finally:
            self._remove(work)

    def events(self, after: int = 0) -> DataFrame:
        """The events of the versions after one, as a table."""
        found = [n for n in self._names("v") if int(n[1:]) > after]
        return self.spark.read.schema(EVENTS).parquet(*(f"{self.root}/{n}/events" for n in found)) if found else self.spark.createDataFrame([], EVENTS)

    def stream(self) -> DataFrame:
        """kind, path, mtime_ms, size, version of the changes, version after version."""
        jvm, fs = self._fs()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(self.root))
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.root}/v*/events")

    def forget(self, before: int) -> None:
        """Removes the events of versions before one, which every reader has passed."""
        self._remove(*(n for n in self._names("v")[:-KEPT] if int(n[1:]) < before))
