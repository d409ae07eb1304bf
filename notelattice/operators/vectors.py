"""An inverted-file index over chunk vectors.

Centroids come from k-means on a bounded sample; every row then goes into the list of its nearest
centroid, a folder of the table, with its residual in one byte a dimension beside the whole vector. A
search reads only the folders of the lists nearest to the query, ranks their rows by the short codes, and
scores the best again by their vectors. How many lists are read is set by measurement when the index is
made: the fewest that reach the target recall against a scan of all rows for a bounded set of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from notelattice.functions.scores import squared_distance
from notelattice.functions.ship import ship
from notelattice.functions.slices import SLICE_BYTES

from .search import DIGITS
from .store import Snapshots

#: An index is worth it from so many rows on.
LEAST_ROWS = 256
#: Bytes of the sample that k-means gets, its rounds, rows of the sample for each centroid, and lists at most.
SAMPLE_BYTES, ROUNDS, ROWS_A_LIST, MOST_LISTS = 64 << 20, 12, 32, 4096
#: Rows that one task handles, and queries that meet them there, at most: their number, and the bytes of their vectors.
#: All rows are sent once for each block of queries and all queries once for each block of rows, so that blocks are large.
BLOCK_ROWS, BLOCK_QUERIES = 131_072, 32_768
ROW_BYTES, QUERY_BYTES = 64 << 20, 16 << 20
#: Blocks that lists are dealt to while these have so many rows at least: work for that many tasks.
SPREAD, LEAST_BLOCK = 16, 8192
#: Rows of a block in indexes that don't say.
UNTOLD_ROWS = 50_000
#: The recall that the number of probed lists is set for, and the queries it is measured with.
TARGET, MEASURED = 0.95, 64
#: Rows ranked by codes that are scored again, a multiple of what is asked for.
AGAIN = 8


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced points; an empty one moves to the farthest point."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near, far = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        empty = np.flatnonzero(n == 0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if len(empty):
            centres[empty] = points[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres.astype(np.float32)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest centre and the squared distance, block by block."""
    near, far = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, (1 << 22) // len(centres))
    half = (centres.astype(np.float64) ** 2).sum(1) / 2
    for at in range(0, len(points), step):
        part = points[at : at + step].astype(np.float64)
        score = half - part @ centres.T.astype(np.float64)
        own = score.argmin(1)
        near[at : at + step] = own
        far[at : at + step] = 2 * score[np.arange(len(own)), own] + (part**2).sum(1)
    return near, far


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64, copy=False)


def least_hashed(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The `most` rows of least `h`, a 64-bit hash, of n rows: the same sample whenever the rows are the
    same. Each task would send that many to the one that sorts them, so that a bound goes before, under which
    somewhat more lie; where hashes are so uneven that fewer do, there is none."""
    share = (1.25 * most + 1000) / n
    if share < 1:
        low = rows.where(F.col("h") < int(share * 2.0**64) - 2**63)
        if low.count() >= most:
            rows = low
    return rows.orderBy("h").limit(most)


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _most(rows: int, size: int, dim: int) -> int:
    """Vectors of a block."""
    return max(1, min(rows, size // (8 * max(dim, 1))))


@dataclass
class VectorIndex:
    """The index in a folder: a table of lists for each version, and pointer files with centroids, list
    sizes and the number of lists to probe. The version before stays for its readers."""

    spark: SparkSession
    root: str

    @property
    def files(self) -> Snapshots:
        return Snapshots(self.spark, self.root)

    def current(self) -> dict | None:
        return self.files.current()

    # ---- making

    def build(self, chunks: DataFrame, target: float = TARGET, mark: str = "") -> dict:
        """Indexes every row of chunks (id, path, vector) with a vector; `mark` says of what state. All
        vectors are of one length."""
        ship(self.spark)
        rows = chunks.where(F.col("vector").isNotNull()).select("id", "path", "vector")
        n, dim = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        name = self.files.new()
        at = f"{self.root}/{name}"
        if not n:
            return self.files.publish({"rows": 0, "dim": 0, "at": name, "centres": [], "sizes": {}, "probes": 0, "recall": 1.0, "scale": 1.0, "mark": mark})
        most = max(1, SAMPLE_BYTES // (8 * dim))
        picked = least_hashed(rows.select("vector", F.xxhash64("id").alias("h")), n, most).select("vector").toArrow()
        points = matrix(picked.column("vector").combine_chunks())
        lists = int(min(MOST_LISTS, max(1, np.sqrt(n)), max(1, len(points) // ROWS_A_LIST)))
        centres = kmeans(points, lists)
        near, _ = nearest(points, centres)
        scale = float(max(np.abs(points - centres[near]).max() / 127, 1e-12))
        placed = self._placed(rows, centres, scale)
        placed.write.parquet(f"{at}/placed")
        placed = self.spark.read.schema(placed.schema).parquet(f"{at}/placed")
        sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row for each list
        block = _most(BLOCK_ROWS, ROW_BYTES, dim)
        parts = self.spark.createDataFrame([(int(k), _blocks(v, block)) for k, v in sizes.items()], "list int, parts int")
        dealt = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        dealt.repartition("list", "part").sortWithinPartitions("list", "part", "id").write.partitionBy("list").parquet(f"{at}/lists")
        self.files.remove(f"{name}/placed")
        told = {"rows": n, "dim": dim, "at": name, "block": block, "centres": centres.tolist(), "sizes": {str(k): v for k, v in sizes.items()}, "scale": scale, "mark": mark, "probes": lists, "recall": 1.0}
        return self.files.publish(told | self._measured(told, rows, target))

    def _placed(self, rows: DataFrame, centres: np.ndarray, scale: float) -> DataFrame:
        """rows with their list and the code of their residual."""
        shared = self.spark.sparkContext.broadcast(centres)
        schema = T.StructType([*rows.select("id", "path").schema, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("code", T.ArrayType(T.ByteType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                points = matrix(batch.column(2))
                near, _ = nearest(points, centres)
                code = np.clip(np.rint((points - centres[near]) / scale), -127, 127).astype(np.int8)
                ends = np.arange(0, points.size + 1, points.shape[1], dtype=np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(points), pa.array(near.astype(np.int32)), lists(code)], schema.fieldNames())

        return rows.mapInArrow(run, schema)

    def _measured(self, told: dict, rows: DataFrame, target: float) -> dict:
        """The fewest lists, doubling from one, whose rows hold `target` of the true neighbours of a
        bounded set of rows, which are searched for halfway towards another row."""
        k, lists = 60, len(told["centres"])
        few = rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit("measured"))).limit(MEASURED + 1).collect()
        asked = [(i, [0.75 * x + 0.25 * y for x, y in zip(a["vector"], b["vector"], strict=True)]) for i, (a, b) in enumerate(zip(few, few[1:], strict=False))]
        if not asked or lists == 1:
            return {"probes": 1, "recall": 1.0}
        queries = self.spark.createDataFrame(asked, "query_id long, query array<double>")
        truth = exact_hits(rows, queries, k).select("query_id", "id")
        home = self.spark.read.parquet(f"{self.root}/{told['at']}/lists").select("id", "list")
        where = truth.join(home, "id").groupBy("query_id", "list").agg(F.count("*").alias("n")).collect()  # at most MEASURED * k rows
        order = np.argsort(nearest_order(np.array([q for _, q in asked]), np.array(told["centres"])), axis=1)
        total, probes = sum(r["n"] for r in where), 1
        while True:
            found = sum(r["n"] for r in where if order[r["query_id"], r["list"]] < probes)
            if found >= target * total or probes >= lists:
                return {"probes": min(probes, lists), "recall": found / total}
            probes *= 2

    # ---- searching

    def lists(self, told: dict) -> DataFrame:
        schema = "id string, path string, vector array<double>, code array<tinyint>, part int, list int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{told['at']}/lists")

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """id, path, distance, rank of the k nearest rows found: only the probed lists' files are
        read, and of their rows all but the best by code are scored no further."""
        told = self.current()
        if not told or not told["rows"]:
            return self.spark.createDataFrame([], "id string, path string, distance double, rank int")
        centres, q = np.array(told["centres"]), np.array(query, np.float64)
        own = [int(x) for x in nearest_order(q[None, :], centres)[0][: probes or told["probes"]]]
        away = self.spark.createDataFrame([(x, (q - centres[x]).tolist()) for x in own], "list int, away array<double>")
        rows = self.lists(told).where(F.col("list").isin(own))
        rough = F.aggregate(F.zip_with("code", "away", lambda c, a: (a - c * F.lit(told["scale"])) * (a - c * F.lit(told["scale"]))), F.lit(0.0), lambda s, x: s + x)
        # a row for each probed list; then at most AGAIN * k rows
        best = rows.join(F.broadcast(away), "list").select("list", "id", rough.alias("rough")).orderBy("rough", "id").limit(AGAIN * k).select("list", "id")
        again = rows.select("list", "id", "path", "vector").join(F.broadcast(best), ["list", "id"], "left_semi")
        near = again.select("id", "path", F.round(squared_distance(F.col("vector"), F.lit(q.tolist()).cast("array<double>")), DIGITS).alias("distance"))
        top = near.orderBy("distance", "id").limit(k)
        return top.withColumn("rank", F.row_number().over(W.orderBy("distance", "id")))

    def search_all(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, id, path, distance, position of the k nearest rows found for each of a table of
        queries (query_id, query). Lists are dealt to blocks of bounded size. A query goes once to each block
        that has some of its lists, with their numbers, and meets the rows of these; a block passes on
        k rows a query, however many lists are in it."""
        ship(self.spark)
        told = self.current()
        hits = _hits(queries)
        if not told or not told["rows"]:
            return self.spark.createDataFrame([], T.StructType([*hits, T.StructField("position", T.IntegerType())]))
        home = dealt_lists({int(x): n for x, n in told["sizes"].items()}, told.get("block", UNTOLD_ROWS))
        holds = np.zeros((max(b for _, _, b in home) + 1, len(told["centres"])), bool)  # which lists a block has rows of
        for number, _, block in home:
            holds[block, number] = True
        shared, probes = self.spark.sparkContext.broadcast((np.array(told["centres"]), holds)), probes or told["probes"]
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, holds = shared.value
            step = max(1, SLICE_BYTES // (8 * (len(holds) * centres.shape[1] + len(centres))))
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.slice(start, step)
                    own = np.zeros((len(part), len(centres)), bool)
                    np.put_along_axis(own, nearest_order(matrix(part.column(1)), centres)[:, :probes], True, axis=1)
                    for block, here in enumerate(holds):
                        mine = own & here
                        at = np.flatnonzero(mine.any(axis=1))
                        if not len(at):
                            continue
                        who, lists = np.nonzero(mine[at])
                        ends = np.searchsorted(who, np.arange(len(at) + 1)).astype(np.int32)
                        columns = [*(part.column(i).take(pa.array(at)) for i in range(2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.astype(np.int32))), pa.array(np.full(len(at), block, np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", "query", "lists", "block"])

        fields = [T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("block", T.IntegerType())]
        crowds = _blocks(asked.count(), _most(BLOCK_QUERIES, QUERY_BYTES, told["dim"]))
        mine = asked.mapInArrow(sent, T.StructType([*asked.schema, *fields])).withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.lit(crowds)).cast("int"))
        plan = F.broadcast(self.spark.createDataFrame(home, "list int, part int, block int"))  # a row for each list, or part of a long one
        rows = self.lists(told).join(plan, ["list", "part"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))

        key = ("block", "crowd")
        return _first(_met(mine.select(*key, "query_id", "query", "lists"), rows.select(*key, "id", "path", "vector", "list"), key, k, hits), k)


def dealt_lists(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(list, part, block) of all lists: one of more than `most` rows is in parts, and neighbours share a block
    up to `most` rows, or up to a share of all rows that leaves work for SPREAD tasks."""
    full = min(most, max(LEAST_BLOCK, -(-sum(sizes.values()) // SPREAD)))
    out, block, held = [], 0, 0
    for number, n in sorted(sizes.items()):
        parts = _blocks(n, most)
        for part in range(parts):
            own = -(-n // parts)
            if held and held + own > full:
                block, held = block + 1, 0
            out.append((number, part, block))
            held += own
    return out


def _met(queries: DataFrame, rows: DataFrame, key: tuple[str, ...], k: int, hits: T.StructType) -> DataFrame:
    """The k nearest rows of each query in every block: of equal distances those of least id. Where queries
    have `lists`, of the rows whose `list` is among them."""

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(rows):
            by_id = pc.sort_indices(rows, sort_keys=[("id", "ascending")])
            q, v = matrix(queries.column("query").combine_chunks()), matrix(rows.column("vector").combine_chunks())
            held = rows.column("list").to_numpy()[by_id.to_numpy()] if "list" in rows.column_names else None
            v, rows = v[by_id.to_numpy()], rows.select(["id", "path"]).take(by_id)  # vectors are not copied once more
            half = np.einsum("ij,ij->i", v, v) / 2
            asked = _Asked(queries, held) if held is not None else None
            if asked:
                q, queries = q[asked.order], queries.select(["query_id"]).take(pa.array(asked.order))
            step = max(1, (1 << 22) // len(v))
            for at in range(0, len(q), step):
                open_ = asked.open(at, step) if asked else None  # for each query which lists it may see
                near = np.flatnonzero(open_.any(axis=0)[asked.place]) if asked else None
                if near is not None and not len(near):  # a block may have no row of a part of a list
                    continue
                if near is None or 2 * len(near) > len(v):  # else few lists are left, and only their rows are scored
                    near = slice(None)
                score = half[near] - q[at : at + step] @ v[near].T
                close = ~open_[:, asked.place[near]] if asked else None  # rows that a query doesn't see
                if asked:
                    score[close] = np.inf
                most = min(k, score.shape[1])
                own = np.argpartition(score, most - 1, axis=1)[:, :most]
                last = np.take_along_axis(score, own, 1).max(axis=1, keepdims=True)
                for i in np.flatnonzero((score <= last + 1e-9).sum(axis=1) > most):  # ties at the end
                    if close is not None and len(score[i]) - close[i].sum() <= most:  # all that it sees are there
                        continue
                    own[i] = np.argsort(np.round(score[i], DIGITS), kind="stable")[:most]
                who, flat = np.repeat(np.arange(at, at + len(score)), most), own.ravel()
                if close is not None:
                    seen = ~np.take_along_axis(close, own, 1).ravel()
                    who, flat = who[seen], flat[seen]
                if not isinstance(near, slice):
                    flat = near[flat]
                distance = np.round(((v[flat] - q[who]) ** 2).sum(1), DIGITS)
                taken = rows.take(pa.array(flat))
                out.append(pa.table([queries.column("query_id").take(pa.array(who)), taken.column("id"), taken.column("path"), pa.array(distance)], names=hits.fieldNames()))
        return pa.concat_tables(out) if out else pa.table([queries.column("query_id").slice(0, 0), *(pa.array([], kind) for kind in (pa.string(), pa.string(), pa.float64()))], names=hits.fieldNames())

    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, hits)


class _Asked:
    """Which lists of a block its queries see. Queries with the same first list are neighbours in `order`;
    place: for each row the column of its list."""

    def __init__(self, queries: pa.Table, held: np.ndarray):
        numbers, self.place = np.unique(held, return_inverse=True)
        column = queries.column("lists").combine_chunks()
        lists, ends = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy())))
        self.order = np.argsort(lists[ends[:-1]], kind="stable")
        at = np.minimum(np.searchsorted(numbers, lists), len(numbers) - 1)
        self.lists, self.there, self.ends, self.n = at, numbers[at] == lists, ends, len(numbers)

    def open(self, at: int, step: int) -> np.ndarray:
        own = self.order[at : at + step]
        out = np.zeros((len(own), self.n), bool)
        for i, x in enumerate(own):
            part = slice(self.ends[x], self.ends[x + 1])
            out[i, self.lists[part][self.there[part]]] = True
        return out


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _hits(queries: DataFrame) -> T.StructType:
    return T.StructType([queries.schema["query_id"], *(T.StructField(c, T.StringType()) for c in ("id", "path")), T.StructField("distance", T.DoubleType())])


def all_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, path, distance, position of the k nearest chunks to each of a stated set of queries
    (query_id, query), without an index: rows and queries meet in blocks of bounded size, each of which
    passes on k rows a query. The set may grow with the table; nothing is broadcast."""
    ship(chunks.sparkSession)
    asked, dim = queries.agg(F.count("*"), F.max(F.size("query"))).first()
    parts, crowds = _blocks(chunks.count(), _most(BLOCK_ROWS, ROW_BYTES, dim or 0)), _blocks(asked, _most(BLOCK_QUERIES, QUERY_BYTES, dim or 0))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = chunks.where(F.col("vector").isNotNull()).select("id", "path", F.col("vector").cast("array<double>").alias("vector"), deal("id", parts).alias("part"), every(crowds).alias("crowd"))
    mine = queries.select("query_id", F.col("query").cast("array<double>").alias("query"), deal("query_id", crowds).alias("crowd"), every(parts).alias("part"))
    return _first(_met(mine, rows, ("part", "crowd"), k, _hits(queries)), k)


def nearest_order(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each point all centres, the nearest first."""
    return np.argsort((centres**2).sum(1) / 2 - points @ centres.T, axis=1, kind="stable")


def exact_hits(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries: it is broadcast, and each task keeps its own
    k best of each query."""
    few = [(r["query_id"], list(r["query"])) for r in queries.collect()]
    kind = queries.schema["query_id"]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.array([q for _, q in few], np.float64), [i for i, _ in few]))
    schema = T.StructType([kind, T.StructField("id", T.StringType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = shared.value
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            v = matrix(batch.column(1))
            half = (v**2).sum(1) / 2
            for at in range(len(q)):
                own = np.argpartition(half - v @ q[at], min(k, len(v)) - 1)[:k] if len(v) > k else np.arange(len(v))
                distance = np.round(((v[own] - q[at]) ** 2).sum(1), DIGITS)
                yield pa.RecordBatch.from_arrays([pa.array([names[at]] * len(own)), batch.column(0).take(pa.array(own)), pa.array(distance)], schema.fieldNames())

    found = rows.select("id", "vector").mapInArrow(run, schema)
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
