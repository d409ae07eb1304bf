"""A text index dealt by token, with the greatest impact of every block.

Chunks are numbered into ranges by their length, so that neighbours score alike, and by a hash within a
length. The postings of a token lie together, by range; of tokens that many chunks have, a second
table keeps the greatest impact of each range. A search bounds every range from above by these, scores the
ranges of the highest bounds, and then only those whose bound reaches the score of the k-th hit so far.
What is skipped cannot be among the first k, so that the hits are those of a search of everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search
from .store import Snapshots

#: Chunks of a range, and lengths that ranges are cut at, at most.
RANGE_ROWS, LENGTHS = 256, 1024
#: A token in more chunks than this has its blocks kept; of others all postings are read.
HEAVY = 2048
#: Postings of a bucket of tokens, and of a file.
BUCKET_ROWS, FILE_ROWS = 20_000_000, 1_000_000
#: Ranges that are scored first, and ranges that a filter lists by number.
FIRST, LISTED = 32, 2000
#: Sums of floats depend on their order by less than this.
SLACK = 1e-6

POSTINGS = "token string, range int, id string, path string, impact double, bucket int"


@dataclass
class ImpactIndex:
    """The index in a folder: versions of postings and blocks, and a pointer file with the counts."""

    spark: SparkSession
    root: str

    @property
    def files(self) -> Snapshots:
        return Snapshots(self.spark, self.root)

    def current(self) -> dict | None:
        return self.files.current()

    # ---- making

    def build(self, postings: DataFrame, stats: DataFrame, mark: str = "") -> dict:
        """Indexes postings (id, path, token, tf, doc_len), a kept table that is read three times; stats is
        one row with n and avgdl of all chunks, those without words included."""
        n, avgdl = stats.select("n", "avgdl").first()
        return self._made(self.files.new(), postings, postings.select("id", "doc_len").distinct(), postings.count(), n, avgdl, mark)

    def build_from(self, chunks: DataFrame, mark: str = "") -> dict:
        """Indexes chunks (id, path, embed_text). Their texts are read once: what they are counted to is
        written to the index's folder, and lengths, statistics and postings are read from there."""
        name = self.files.new()
        bags = search.bags(chunks)
        bags.write.parquet(f"{self.root}/{name}/bags")
        bags = self.spark.read.schema(bags.schema).parquet(f"{self.root}/{name}/bags")
        n, avgdl, total = bags.agg(F.count("*"), F.avg("doc_len"), F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()
        key = ("id", "path", "doc_len")
        rows = bags.select(*key, F.explode("bag").alias("p")).select(*key, "p.token", "p.tf")
        if not bags.groupBy(*key).count().where("count > 1").isEmpty():  # copies of a chunk are one, with all their words
            rows = rows.groupBy(*key, "token").agg(F.sum("tf").alias("tf"))
        told = self._made(name, rows, bags.where("doc_len > 0").select("id", "doc_len"), total, n, avgdl, mark)
        self.files.remove(f"{name}/bags")
        return told

    def _made(self, name: str, postings: DataFrame, lengths: DataFrame, total: int, n: int, avgdl: float | None, mark: str) -> dict:
        at = f"{self.root}/{name}"
        steps = min(LENGTHS, max(1, n // RANGE_ROWS))
        cuts = lengths.agg(F.percentile_approx("doc_len", [i / steps for i in range(1, steps)] or [1.0], 10_000)).first()[0] or []
        cuts = sorted(set(cuts)) if steps > 1 else []
        fine = max(1, -(-n // (RANGE_ROWS * (len(cuts) + 1))))
        if cuts:  # the number of cuts below a length, by a binary search
            postings = Bucketizer(splits=[-math.inf, *(c + 0.5 for c in cuts), math.inf], inputCol="doc_len", outputCol="coarse").transform(postings)
        else:
            postings = postings.withColumn("coarse", F.lit(0))
        place = (F.col("coarse") * fine + F.pmod(F.xxhash64("id"), F.lit(fine))).cast("int")
        rows = postings.select("token", place.alias("range"), "id", "path", search.impact(F.col("tf"), F.col("doc_len"), F.lit(avgdl)).alias("impact"))
        buckets, ranges = max(1, -(-total // BUCKET_ROWS)), (len(cuts) + 1) * fine
        bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket")
        # a frequent token fills many files, each with the ranges of one part of them
        parts = max(1, -(-total // (buckets * FILE_ROWS)))
        dealt = rows.withColumn("bucket", bucket).withColumn("slice", F.expr(f"cast(range * {parts} div {ranges} as int)"))
        # each has a task of its own: by hash, several would meet in one
        dealt = dealt.repartitionById(buckets * parts, F.col("bucket") * parts + F.col("slice")).drop("slice").sortWithinPartitions("bucket", "token", "range")
        dealt.write.option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{at}/postings")
        told = {"at": name, "n": n, "avgdl": avgdl, "buckets": buckets, "ranges": ranges, "mark": mark}
        kept = self._postings(told)
        words = kept.groupBy("bucket", "token").agg(F.count("*").alias("df"))
        words.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{at}/words")
        heavy = self._words(told).where(F.col("df") > HEAVY).select(F.col("token").alias("t"))
        blocks = kept.join(heavy, F.col("token") == F.col("t"), "left_semi").groupBy("bucket", "token", "range").agg(F.max("impact").alias("top"))
        blocks.repartition("bucket").sortWithinPartitions("bucket", "token", "range").write.partitionBy("bucket").parquet(f"{at}/blocks")
        return self.files.publish(told)

    def _postings(self, told: dict) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.root}/{told['at']}/postings")

    def _words(self, told: dict) -> DataFrame:
        return self.spark.read.schema("token string, df long, bucket int").parquet(f"{self.root}/{told['at']}/words")

    def _blocks(self, told: dict) -> DataFrame:
        return self.spark.read.schema("token string, range int, top double, bucket int").parquet(f"{self.root}/{told['at']}/blocks")

    def _of(self, rows: DataFrame, told: dict, words: list[str]) -> DataFrame:
        """Rows of some words: their buckets are folders, the words go to the files' statistics."""
        own = self.spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(told["buckets"])).cast("int").alias("b")).distinct()
        return rows.where(F.col("bucket").isin([r["b"] for r in own.collect()]) & F.col("token").isin(words))

    # ---- searching

    def search(self, words: list[str], k: int) -> DataFrame:
        """id, path, bm25, rank of the k best chunks."""
        return search.text_arm(self.scored(words, k)[0], k)

    def scored(self, words: list[str], k: int) -> tuple[DataFrame, dict]:
        """(id, path, bm25 of chunks that hold the k best ones, and how many ranges were read of all)."""
        told = self.current()
        words = list(dict.fromkeys(words))
        none = self.spark.createDataFrame([], "id string, path string, bm25 double")
        if not told or not words or not told["n"]:
            return none, {"ranges": 0, "read": 0}
        known = {r["token"]: r["df"] for r in self._of(self._words(told), told, words).collect()}  # a row for each word
        if not known:
            return none, {"ranges": told["ranges"], "read": 0}
        weight = {w: search.idf_of(told["n"], df) for w, df in known.items()}
        rows = self._of(self._postings(told), told, list(known)).withColumn("part", _weighed(F.col("token"), weight) * F.col("impact"))
        heavy = [w for w, df in known.items() if df > HEAVY]
        light = [w for w in known if w not in heavy]
        tops = []
        if heavy:
            kept = self._of(self._blocks(told), told, heavy)
            tops.append(kept.select("range", "token", (_weighed(F.col("token"), weight) * F.col("top")).alias("top")))
        if light:  # at most HEAVY postings a word
            tops.append(rows.where(F.col("token").isin(light)).groupBy("range", "token").agg(F.max("part").alias("top")))
        bounds = (tops[0].unionByName(tops[1]) if len(tops) > 1 else tops[0]).groupBy("range").agg(F.sum("top").alias("bound"))
        first = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(FIRST).collect()]
        best = self._sums(rows.where(F.col("range").isin(first))).orderBy(F.desc("bm25")).limit(k).collect()
        least = best[-1]["bm25"] - SLACK if len(best) == k else 0.0
        open_ = bounds.where(F.col("bound") >= least).select("range")
        few = [r["range"] for r in open_.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            return self._sums(rows.where(F.col("range").isin(few))), {"ranges": told["ranges"], "read": len(set(few) | set(first))}
        return self._sums(rows.join(open_, "range", "left_semi")), {"ranges": told["ranges"], "read": open_.count()}

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("id", "path").agg(F.round(F.sum("part"), search.DIGITS).alias("bm25"))


def _weighed(token: Column, weight: dict[str, float]) -> Column:
    out = F.when(F.lit(False), 0.0)
    for w, x in weight.items():
        out = out.when(token == w, F.lit(x))
    return out
