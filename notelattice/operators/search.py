"""Search: postings and BM25, exact vector arm, rank fusion, diversity by path, threshold, limit."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelattice.errors import InvalidInput
from notelattice.functions.scores import RRF_K, rrf_term, squared_distance, text_score, vector_score
from notelattice.functions.stem import stem_bags, stem_counts, stems

from .store import where_path_and_tag

MODES = ("hybrid", "vector", "fts")
K1, B = 1.2, 0.75
MIN_CANDIDATES, OVERFETCH = 60, 3
#: Decimals to which scores are rounded before they rank: sums of floats depend on their order.
DIGITS = 9
#: Words that the text index leaves out.
STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


@dataclass(frozen=True)
class SearchOptions:
    """Bounds and defaults of a search request."""

    mode: str = "hybrid"
    limit: int = 20
    mmr_lambda: float = 0.5
    max_per_path: int = 3
    threshold: float = 0.0
    path_prefix: str | None = None
    tag: str | None = None

    def checked(self, query: str) -> SearchOptions:
        if not 1 <= len(query) <= 4096:
            raise InvalidInput("a query has 1 to 4096 characters")
        if self.mode not in MODES or not 1 <= self.limit <= 100 or not 1 <= self.max_per_path <= 100:
            raise InvalidInput("mode, limit or max_per_path is out of bounds")
        if not 0 <= self.threshold <= 1 or not 0 <= self.mmr_lambda <= 1:
            raise InvalidInput("threshold and lambda lie in [0, 1]")
        return self


def runs_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def words_of(text: Column) -> Column:
    """The runs without stop words."""
    return F.filter(runs_of(text), lambda w: ~w.isin(*STOP_WORDS))


def tokens(text: Column) -> Column:
    """The words of a text, stemmed."""
    return stems(words_of(text))


def postings(chunks: DataFrame) -> DataFrame:
    """id, path, token, tf, doc_len: the text index, kept as a table."""
    rows = chunks.select("id", "path", tokens(F.col("embed_text")).alias("t")).withColumn("doc_len", F.size("t"))
    # a plain explode drops empty lists before it, for which Spark would stem every text a second time
    return rows.select("id", "path", "doc_len", F.explode_outer("t").alias("token")).where("token IS NOT NULL").groupBy("id", "path", "doc_len", "token").agg(F.count("*").alias("tf"))


def bags(chunks: DataFrame) -> DataFrame:
    """id, path, doc_len, bag: each chunk with its tokens and their tf, in one pass over the texts. Chunks
    without words stay."""
    rows = chunks.select("id", "path", stem_bags(runs_of(F.col("embed_text")), STOP_WORDS).alias("b"))
    return rows.select("id", "path", "b.doc_len", "b.bag")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """n and avgdl, one row; a chunk without words counts."""
    lengths = chunks.select(F.size(words_of(F.col("embed_text"))).alias("doc_len"))  # a stem for each word
    return lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """The weight of a word."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_of(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def impact(tf: Column, doc_len: Column, avgdl: Column) -> Column:
    """What a word adds to the score of a chunk, before the word's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avgdl))


def bm25(index: DataFrame, stats: DataFrame, words: list[str]) -> DataFrame:
    """id, path, bm25 of chunks with any of the words. Document counts are over the index given."""
    hits = index.where(F.col("token").isin(*dict.fromkeys(words)))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    # a row for each word of the query, and one row: bounded
    met = hits.join(F.broadcast(df), "token").join(F.broadcast(stats), F.lit(True))
    part = idf(F.col("n"), F.col("df")) * impact(F.col("tf"), F.col("doc_len"), F.col("avgdl"))
    return met.groupBy("id", "path").agg(F.round(F.sum(part), DIGITS).alias("bm25"))


def scanned(chunks: DataFrame, words: list[str]) -> DataFrame:
    """id, path, bm25 as above, of texts that have no index, in one pass over them: a chunk becomes the
    counts of the query's words, chunks with none of them become one row of sums in each task, and
    statistics and scores both read the exchange of what is left."""
    words = list(dict.fromkeys(words))
    rows = chunks.select("id", "path", stem_counts(words_of(F.col("embed_text")), words).alias("c"))
    rows = rows.select("id", "path", F.col("c")[0].alias("doc_len"), *(F.col("c")[i + 1].alias(f"tf{i}") for i in range(len(words))))
    names = [f"tf{i}" for i in range(len(words))]
    hit = F.greatest(F.lit(0), F.lit(0), *names) > 0
    keys = ("id", "path", "doc_len", *names)
    kept = [F.when(hit, F.col(c)).alias(f"h_{c}") for c in keys]
    sums = (F.count("*").alias("rows"), F.sum("doc_len").alias("length"), F.max(hit.cast("int")).alias("hit"))
    slim = rows.select("doc_len", *names, *kept).groupBy(*(f"h_{c}" for c in keys)).agg(*sums)
    # both readers of the exchange use all three sums, else it is not the same one and texts are read twice
    df = [F.coalesce(F.sum(F.when(F.col(f"h_{c}") > 0, F.col("rows"))), F.lit(0)).alias(f"df_{c}") for c in names]
    stats = slim.agg(F.sum("rows").alias("n"), (F.sum("length") / F.sum("rows")).alias("avgdl"), F.sum("hit").alias("hits"), *df)
    met = slim.where("hit = 1 AND rows > 0 AND length >= 0").join(F.broadcast(stats), F.lit(True)).where("hits > 0")  # one row
    parts = [F.when(F.col(f"h_{c}") > 0, idf(F.col("n"), F.col(f"df_{c}")) * impact(F.col(f"h_{c}"), F.col("h_doc_len"), F.col("avgdl"))).otherwise(0.0) for c in names]
    score = sum(parts, F.lit(0.0))
    return met.select(F.col("h_id").alias("id"), F.col("h_path").alias("path"), F.round(score, DIGITS).alias("bm25"))


def vector_arm(chunks: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """id, path, distance, rank of the k nearest chunks to the one vector of `query`."""
    near = chunks.join(F.broadcast(query), F.lit(True)).select("id", "path", F.round(squared_distance(F.col("vector"), F.col("query")), DIGITS).alias("distance"))
    top = near.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("distance").asc_nulls_last(), "id")))


def text_arm(scored: DataFrame, k: int) -> DataFrame:
    """id, path, bm25, rank of the k best chunks."""
    top = scored.orderBy(F.desc("bm25"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("bm25"), "id")))


def fuse(*arms: DataFrame) -> DataFrame:
    """id, path, score by reciprocal ranks, relative to first place in every arm."""
    rows = arms[0].select("id", "path", "rank")
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select("id", "path", "rank"))
    top = len(arms) / (RRF_K + 1)
    return rows.groupBy("id", "path").agg(F.round(F.least(F.lit(1.0), F.sum(rrf_term(F.col("rank"))) / F.lit(top)), DIGITS).alias("score")).where("score > 0")


def pool(hits: DataFrame, top_k: int) -> DataFrame:
    """hits in order of score, numbered from 0, the first top_k."""
    top = hits.orderBy(F.desc("score"), "id").limit(top_k)
    return top.withColumn("i", F.row_number().over(W.orderBy(F.desc("score"), "id")) - 1)


def diversify(hits: DataFrame, mmr_lambda: float = 0.5, max_per_path: int = 3) -> DataFrame:
    """Greedy choice with a penalty for paths chosen before, in closed form: within a path the order
    is fixed, and all but its first hit carry the same penalty. Adds r, mmr and position from 1."""
    within = W.partitionBy("path").orderBy(F.desc(F.col("score") * mmr_lambda), "i")
    kept = hits.withColumn("r", F.row_number().over(within)).where(F.col("r") <= max_per_path)
    keyed = kept.withColumn("mmr", F.round(F.col("score") * mmr_lambda - F.when(F.col("r") > 1, 1 - mmr_lambda).otherwise(0.0), DIGITS))
    return keyed.withColumn("position", F.row_number().over(W.orderBy(F.desc("mmr"), "i")))


def above(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.where(F.col("score") >= threshold) if threshold > 0 else hits


def candidates(options: SearchOptions) -> int:
    """What each arm is asked for."""
    return max(MIN_CANDIDATES, OVERFETCH * options.limit)


def search(
    chunks: DataFrame, query: DataFrame, words: list[str], options: SearchOptions, index: DataFrame | None = None, near: DataFrame | None = None, scored: DataFrame | None = None
) -> DataFrame:
    """id, path, score, position of the hits of a search. `query` is one row with the vector; `index`
    is the kept postings of the chunks, which then have their doc_len: no text is read. Counts for
    BM25 are of what is searched, after the path and tag filters. `near` and `scored` are the arms as
    a vector index and an impact index gave them."""
    chunks = where_path_and_tag(chunks, options.path_prefix, options.tag)
    k = candidates(options)
    arms = []
    if options.mode != "fts":
        arms.append(vector_arm(chunks, query, k) if near is None else near)
    if options.mode != "vector":
        if scored is not None:
            pass
        elif index is None:
            scored = scanned(chunks, words)
        else:
            stats = chunks.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
            index = where_path_and_tag(index, options.path_prefix)
            if options.tag is not None:
                index = index.join(chunks.select("id"), "id", "left_semi")
            scored = bm25(index, stats, words)
        arms.append(text_arm(scored, k))
    if options.mode == "hybrid":
        hits = fuse(*arms)
    elif options.mode == "vector":
        hits = arms[0].select("id", "path", F.round(vector_score(F.col("distance")), DIGITS).alias("score"))
    else:
        hits = arms[0].select("id", "path", F.round(text_score(F.col("bm25"), F.col("rank")), DIGITS).alias("score"))
    chosen = above(diversify(pool(hits, k), options.mmr_lambda, options.max_per_path), options.threshold)
    return chosen.orderBy("position").limit(options.limit).select("id", "path", "score", F.row_number().over(W.orderBy("position")).alias("position"))


def evaluate(expected: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """recall_at_1, recall_at_k and mrr of (query_id, expected_path) against (query_id, path, position)."""
    best = hits.groupBy("query_id", "path").agg(F.min("position").alias("rank"))
    met = expected.join(best.withColumnRenamed("path", "expected_path"), ["query_id", "expected_path"], "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return met.agg(share(F.col("rank") <= 1).alias("recall_at_1"), share(F.col("rank") <= k).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def seed_queries(spark, path: str) -> DataFrame:
    """query_id, query, expected_path, mode and note of a JSON array of golden queries. A row without
    query or expected path, or with an unknown mode, is an error."""
    schema = "query string, expectedPath string, mode string, note string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    bad = rows.where(F.col("query").isNull() | F.col("expectedPath").isNull() | ~F.coalesce("mode", F.lit("hybrid")).isin(*MODES))
    if not bad.isEmpty():
        raise InvalidInput("a seed query is incomplete or has an unknown mode")
    return rows.select(F.xxhash64("query", "expectedPath").alias("query_id"), "query", F.col("expectedPath").alias("expected_path"), F.coalesce("mode", F.lit("hybrid")).alias("mode"), "note")
