"""A folder of notes as a Spark data source: format("notelattice.vault").

The reader walks the folder on the driver, without following symlinks, leaves hidden names out, and
hands runs of paths to the tasks, which open each file without following links and read it whole.
Options: entries (notes or all), content (false: names, times and sizes only, no file is opened),
prefix, maxBytes (none unless given; a larger file keeps its size and has no content), tolerant (true:
folders that may not be read are left out). The root must be a folder that all executors see.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from notelattice.functions.ship import ship

from .guard import Gone, read_regular

SCHEMA = "vault string, type string, path string, mtime_ms bigint, size bigint, content binary, sha256 string, skip_reason string"
RUN = 500
CONTENT = pa.schema([("path", pa.string()), ("mtime_ms", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("sha256", pa.string())])


def walk(root: str, notes_only: bool, prefix: str = "", tolerant: bool = False) -> Iterator[tuple[str, str]]:
    """(type, path) in pre-order. With notes_only: Markdown files, node_modules left out. A folder
    that may not be read is an error, or left out if tolerant."""

    def go(rel: str) -> Iterator[tuple[str, str]]:
        try:
            rows = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError):  # went away meanwhile
            return
        except PermissionError:
            if tolerant:
                return
            raise
        for e in rows:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.name.startswith(".") or e.is_symlink() or (notes_only and e.name == "node_modules"):
                continue
            if e.is_dir(follow_symlinks=False):
                if not notes_only and path.startswith(prefix):
                    yield "folder", path
                if path.startswith(prefix) or prefix.startswith(path + "/"):
                    yield from go(path)
            elif e.is_file(follow_symlinks=False) and path.startswith(prefix) and (not notes_only or path.lower().endswith((".md", ".markdown", ".mdx"))):
                yield "file", path

    yield from go("")


def read_file(root: str, path: str, limit: int | None = None) -> tuple[int, int, bytes | None, str | None, str | None]:
    """mtime_ms, size, content, sha256, skip_reason of a file. It is 'gone' only where no regular
    file is; a failure to read is an error, never a missing note."""
    try:
        info, data = read_regular(root, path, limit)
    except Gone:
        return 0, 0, None, None, "gone"
    at = info.st_mtime_ns // 1_000_000
    if data is None:
        return at, info.st_size, None, None, "too_large"
    return at, len(data), data, hashlib.sha256(data).hexdigest(), None


class _Run(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.vault = options["path"], options.get("vault", os.path.basename(options["path"].rstrip("/")))
        self.notes_only = options.get("entries", "notes") == "notes"
        self.prefix, self.limit = options.get("prefix", ""), int(options["maxBytes"]) if "maxbytes" in {k.lower() for k in options} else None
        self.content, self.tolerant = options.get("content", "true") != "false", options.get("tolerant", "false") == "true"

    def pushFilters(self, filters):
        """A path prefix prunes the walk; Spark checks it again all the same."""
        for f in filters:
            if type(f).__name__ == "StringStartsWith" and f.attribute == ("path",):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f

    def partitions(self):
        rows = list(walk(self.root, self.notes_only, self.prefix, self.tolerant))
        return [_Run(rows[i : i + RUN]) for i in range(0, len(rows), RUN)] or [_Run([])]

    def read(self, partition):
        for kind, path in partition.rows:
            if kind == "folder":
                yield (self.vault, kind, path, None, None, None, None, None)
                continue
            if not self.content:
                try:
                    info = os.lstat(os.path.join(self.root, path))
                except FileNotFoundError:
                    continue
                yield (self.vault, kind, path, info.st_mtime_ns // 1_000_000, info.st_size, None, None, None)
                continue
            at, size, data, digest, why = read_file(self.root, path, self.limit)
            if why != "gone":
                yield (self.vault, kind, path, at, size, data, digest, why)


class _Changes(DataSourceStreamReader):
    """Events between two walks: upsert for a new or changed note, remove for one that went. The
    offset is the whole snapshot, so that a restart goes on from there."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.skip_old = options.get("skipOld", "false") == "true"

    def initialOffset(self) -> dict:
        return {"seen": self._snapshot() if self.skip_old else {}}

    def _snapshot(self) -> dict:
        out = {}
        for _, path in walk(self.root, True):
            try:
                info = os.lstat(os.path.join(self.root, path))
            except FileNotFoundError:
                continue
            out[path] = f"{info.st_mtime_ns // 1_000_000}/{info.st_size}"
        return out

    def latestOffset(self) -> dict:
        return {"seen": self._snapshot()}

    def partitions(self, start: dict, end: dict):
        old, new = start["seen"], end["seen"]
        rows = [("upsert", p) for p, v in new.items() if old.get(p) != v] + [("remove", p) for p in old if p not in new]
        return [_Run(rows[i : i + RUN]) for i in range(0, len(rows), RUN)] or [_Run([])]

    def read(self, partition):
        for kind, path in partition.rows:
            if kind == "remove":
                yield (kind, path, None, None, None)
                continue
            at, _, data, digest, why = read_file(self.root, path)
            yield ("remove", path, None, None, None) if why == "gone" else (kind, path, at, data, digest)


class VaultDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notelattice.vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class VaultChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notelattice.changes"

    def schema(self) -> str:
        return "kind string, path string, mtime_ms bigint, content binary, sha256 string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(VaultDataSource)
    spark.dataSource.register(VaultChangeSource)


def read_vault(spark: SparkSession, root: str, vault: str, entries: str = "notes", **options) -> DataFrame:
    """Files of a vault, and with entries="all" files of every type and folders."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("notelattice.vault").option("vault", vault).option("entries", entries)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(root)


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, mtime_ms, size, content, sha256 of the files at `paths`, read by the tasks that hold
    the paths; those that are gone are left out."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at, size, data, digest, why = read_file(root, path)
                if not why:
                    yield pa.RecordBatch.from_pydict({"path": [path], "mtime_ms": [at], "size": [size], "content": [data], "sha256": [digest]}, schema=CONTENT)

    return paths.select("path").mapInArrow(run, "path string, mtime_ms bigint, size bigint, content binary, sha256 string")
