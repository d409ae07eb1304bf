"""The chunk store: filters, aggregates, upserts, and versioned Parquet tables."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.errors import DimensionMismatch, PipelineTooNew, VaultError
from notelattice.functions.paths import has_hidden_segment, order_key, under
from notelattice.functions.ship import ship

PIPELINE_VERSION = 1


def where_path_and_tag(chunks: DataFrame, prefix: str | None = None, tag: str | None = None) -> DataFrame:
    """Literal path prefix (pushed to Parquet) and tag membership."""
    if prefix:
        chunks = chunks.where(F.startswith("path", F.lit(prefix)))
    return chunks.where(F.array_contains("tags", tag)) if tag is not None else chunks


def document_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("path").alias("documents"), F.count("*").alias("chunks"))


def tag_counts(chunks: DataFrame, prefix: str | None = None) -> DataFrame:
    """tag, count of different paths; null tag lists have none."""
    rows = where_path_and_tag(chunks, prefix).select("path", F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.countDistinct("path").alias("count"))


def top_tags(chunks: DataFrame, limit: int = 100, prefix: str | None = None) -> DataFrame:
    """The most frequent tags, with the number of all tags before the limit."""
    counts = tag_counts(chunks, prefix)
    total = counts.agg(F.count("*").alias("total"))
    # one row, so the broadcast is bounded
    return counts.orderBy(F.desc("count"), "tag").limit(limit).join(F.broadcast(total), F.lit(True))


def fingerprints(chunks: DataFrame) -> DataFrame:
    """path, mtime_ms and sha256 of its latest row."""
    return chunks.groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"), F.max_by("sha256", F.struct("mtime_ms", "chunk_index")).alias("sha256"))


def fingerprint(chunks: DataFrame, path: str) -> DataFrame:
    return fingerprints(chunks.where(F.col("path") == path))


def has_rows(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """paths with `present`."""
    known = chunks.select("path").distinct().withColumn("present", F.lit(True))
    return paths.join(known, "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def indexed_paths(chunks: DataFrame, prefix: str | None = None) -> DataFrame:
    return where_path_and_tag(chunks, prefix).select("path").distinct().orderBy("path")


def upsert(chunks: DataFrame, changed: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Chunks after replacing all rows of the changed paths; a path without new rows is dropped."""
    return chunks.join(changed.select("path").distinct(), "path", "left_anti").unionByName(new_rows)


def drop_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("path").distinct(), "path", "left_anti")


def delete_under(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(~under(F.col("path"), path))


def guarded_drops(requested: DataFrame, indexable: DataFrame) -> DataFrame:
    """Requested drops, but for paths that hold an indexable note by now."""
    return requested.select("path").distinct().join(indexable.select("path"), "path", "left_anti")


def drop_hidden(chunks: DataFrame, path: str) -> DataFrame:
    """Drops a path's rows if it has a hidden segment, and only then."""
    return chunks.where(~((F.col("path") == path) & has_hidden_segment(F.col("path"))))


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path and action of a scan: new, changed, touched (other time, same hash) or unchanged."""
    old = stored.select("path", F.col("mtime_ms").alias("old_mtime"), F.col("sha256").alias("old_sha"))
    action = (
        F.when(F.col("old_sha").isNull(), "new")
        .when(F.col("mtime_ms") == F.col("old_mtime"), "unchanged")
        .when(F.col("sha256") == F.col("old_sha"), "touched")
        .otherwise("changed")
    )
    return current.join(old, "path", "left").select("path", action.alias("action"))


def swept(indexed: DataFrame, indexable: DataFrame) -> DataFrame:
    """Indexed paths whose note is gone."""
    return indexed.select("path").distinct().join(indexable.select("path"), "path", "left_anti")


def fresh(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows that are not older than what is stored, or say the same."""
    old = stored.select("path", F.col("mtime_ms").alias("old_mtime"), F.col("sha256").alias("old_sha"))
    keep = F.col("old_sha").isNull() | (F.col("mtime_ms") >= F.col("old_mtime")) | (F.col("sha256") == F.col("old_sha"))
    return incoming.join(old, "path", "left").where(keep).drop("old_mtime", "old_sha")


def status(vaults: DataFrame, supervisor: DataFrame, indexer: DataFrame) -> DataFrame:
    """Vaults with both states; a missing one is starting."""
    out = vaults.join(supervisor, "slug", "left").join(indexer, "slug", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("starting")) for c in ("sync_state", "index_state")})


def in_path_order(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.orderBy(order_key(F.col("path")), *more)


#: Rows of a piece of a table.
PIECE_ROWS = 1_000_000


@dataclass
class Folder:
    """A folder of any store that Spark reads, with small files that appear whole."""

    spark: SparkSession
    root: str

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith(start)) if fs.exists(path) else []

    def _read_text(self, name: str) -> str:
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(self.root, name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> None:
        """A file that was not there before; it appears whole."""
        jvm, fs = self._fs()
        make = jvm.org.apache.hadoop.fs.Path
        tmp = make(self.root, f".{name}.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(tmp, make(self.root, name)):
            raise VaultError(f"{name} is there already: two writers?")

    def _remove(self, *names: str) -> None:
        jvm, fs = self._fs()
        for name in names:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self.root, name), True)

    def current(self) -> dict | None:
        names = self._names("pointer-")
        return json.loads(self._read_text(names[-1])) if names else None


@dataclass
class Snapshots(Folder):
    """Folders of whole versions, each told of by a numbered pointer file; the last two stay."""

    def new(self) -> str:
        return f"v{uuid.uuid4().hex}"

    def publish(self, told: dict) -> dict:
        """Makes a version current that lies in the folder told["at"]."""
        names = self._names("pointer-")
        self._publish(f"pointer-{int(names[-1][8:-5]) + 1 if names else 1:012d}.json", json.dumps(told))
        last = self._names("pointer-")[-2:]
        held = {json.loads(self._read_text(n))["at"] for n in last}
        self._remove(*(n for n in self._names("pointer-") if n not in last), *(f for f in self._names("v") if f not in held))
        return told

    def remove(self, name: str) -> None:
        self._remove(name)


@dataclass
class VersionedTable(Folder):
    """A Parquet table in pieces by ranges of the path. A version is a pointer file that lists the pieces
    with their least and greatest path and their rows; pointers are numbered, made by a rename to a name that
    is new, and the highest counts, so that a reader always finds a whole version. A prefix is read from
    the pieces that may hold it. An upsert writes the pieces that it touches, cut anew where they have
    grown, and keeps the others. One writer at a time. Paths are Hadoop paths, so any store that Spark
    reads will do."""

    order: tuple[str, ...] = ("path",)

    def remove(self) -> None:
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.root), True)

    def read(self, dim: int | None = None, prefix: str | None = None) -> DataFrame | None:
        """The current version, or None; a wrong vector size is an error. With a prefix, the pieces that
        may hold such paths."""
        at = self.current()
        if at is None:
            return None
        if dim is not None and at.get("dim") not in (None, dim):
            raise DimensionMismatch(at["dim"], dim)
        start = (prefix or "").encode()
        return self._rows(at, [p for p in at["pieces"] if p["high"].encode() >= start and p["low"].encode()[: len(start)] <= start])

    def _rows(self, at: dict, pieces: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(at["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p['at']}" for p in pieces)) if pieces else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, dim: int | None = None) -> None:
        """A version of df's rows alone."""
        self._write(df, F.lit(0), df.count(), dim, [])

    def _write(self, df: DataFrame, number: Column, rows: int, dim: int | None, kept: list[dict]) -> None:
        """A version of the kept pieces and of df's rows, which lie in ranges of their own: those of a
        `number` stay together, so that no new piece reaches over a kept one."""
        at = self.current() or {"version": 0}
        folder = f"v{at['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        dealt = df.withColumn("piece_no", number.cast("int")).repartitionByRange(max(1, -(-rows // PIECE_ROWS)), "piece_no", "path")
        dealt = dealt.withColumn("part_no", F.spark_partition_id()).sortWithinPartitions("piece_no", "part_no", *self.order)
        dealt.write.partitionBy("piece_no", "part_no").parquet(f"{self.root}/{folder}")
        there = self.spark.read.schema(T.StructType([T.StructField("path", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "part_no"))])).parquet(f"{self.root}/{folder}")
        ends = there.groupBy("piece_no", "part_no").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count("*").alias("rows")).collect()  # a row for each piece
        made = [{"at": f"{folder}/piece_no={r['piece_no']}/part_no={r['part_no']}", "low": r["low"], "high": r["high"], "rows": r["rows"]} for r in ends]
        pieces = sorted([*kept, *made], key=lambda p: p["low"].encode())
        new = {"version": at["version"] + 1, "dim": dim if dim is not None else at.get("dim"), "schema": df.schema.jsonValue(), "pieces": pieces}
        self._publish(f"pointer-{new['version']:012d}.json", json.dumps(new))
        # the version before stays for readers that hold it
        old = self._names("pointer-")[:-2]
        held = {p["at"].split("/")[0] for n in self._names("pointer-")[-2:] for p in json.loads(self._read_text(n))["pieces"]}
        self._remove(*old, *(f for f in self._names("v") if f not in held | {folder}))

    def upsert(self, changed: DataFrame, new_rows: DataFrame, dim: int | None = None) -> None:
        at = self.current()
        if at is None or not at["pieces"]:
            return self.write(new_rows, dim)
        self.read(dim)
        pieces, lows = at["pieces"], [p["low"].encode() for p in at["pieces"]]
        ship(self.spark)

        @F.arrow_udf("int")
        def number(paths: pa.Array) -> pa.Array:
            """The piece whose range a path lies in or behind."""
            return pa.array([max(0, bisect_right(lows, p.encode()) - 1) for p in paths.to_pylist()], pa.int32())

        hit = changed.select("path").unionByName(new_rows.select("path")).distinct().select(number("path").alias("n")).distinct()
        touched = {r["n"] for r in hit.collect()}  # at most a number for each piece
        if touched:
            old = [pieces[i] for i in sorted(touched)]
            rows = upsert(self._rows(at, old), changed, new_rows)
            self._write(rows, number("path"), sum(p["rows"] for p in old) + new_rows.count(), dim, [p for i, p in enumerate(pieces) if i not in touched])

    def reconcile(self, version: int = PIPELINE_VERSION) -> str:
        """Of the pipeline version: equal keeps, older or none resets, newer is an error."""
        found = [int(n.removeprefix("pipeline-")) for n in self._names("pipeline-")]
        if found and max(found) > version:
            raise PipelineTooNew(max(found), version)
        if version in found:
            return "kept"
        self._remove(*self._names("pointer-"), *self._names("pipeline-"), *self._names("v"))
        self._publish(f"pipeline-{version}", "")
        return "reset"
