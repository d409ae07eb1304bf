"""Registered queries of the engine's own operators, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.functions import frontmatter, paths, scores, text
from notelattice.functions.stem import stem
from notelattice.operators import chunking, embed, grep, health, impacts, links, listing, search, store, vectors
from notelattice.streaming import events
from notelattice.vault import index_folder

from . import inputs
from .inputs import with_tables
from .stem_sql import stem_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A query's words as the index holds them.
WORDS = [stem(w) for w in ("with", "thorin", "idiots", "heit", "que", "eringing", "orantion")]
WORD_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- search

STOPS = "[" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + "]"
TOKENS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains(" + STOPS.replace("{", "{{") + ", w))"
VECTOR = "list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * (1 + 0.001::DOUBLE * (c.doc_id // n)))"


def vector_cte(where: str = "") -> str:
    return f"""{with_tables('chunks')}, en AS (SELECT count(*) AS n FROM embeddings), cv AS (SELECT c.*, {VECTOR} AS vector FROM chunks c, en JOIN embeddings e ON e.vec_id = c.doc_id % n{where}),
q AS (SELECT embedding AS query FROM embeddings WHERE vec_id = 1),
near AS (SELECT id, path, round(list_sum(list_transform(list_zip(vector, query), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 9) AS distance FROM cv, q),
vec AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 60)"""


VECTOR_CTE = vector_cte()


def post_cte(chunks: str) -> str:
    """tok: chunks and their words; stats; post: the postings."""
    return f"""tok AS (SELECT id, path, {TOKENS.format('embed_text')} AS t FROM {chunks}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), raw AS (SELECT id, path, CAST(len(t) AS INT) AS doc_len, unnest(t) AS word FROM tok), {stem_ctes('(SELECT DISTINCT word FROM raw)')},
post AS (SELECT id, path, doc_len, stem AS token, count(*) AS tf FROM raw JOIN stems USING (word) GROUP BY ALL)"""


TEXT_CTE = f"""{post_cte('cv')},
hit AS (SELECT * FROM post WHERE list_contains({WORD_SQL}, token)), df AS (SELECT token, count(*) AS df FROM hit GROUP BY token),
bm AS (SELECT id, path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 9) AS bm25 FROM hit JOIN df USING (token), stats GROUP BY id, path),
fts AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM bm QUALIFY rank <= 60)"""
ARMS = f"""{TEXT_CTE}, arms AS (SELECT id, path, rank FROM vec UNION ALL SELECT id, path, rank FROM fts),
fused AS (SELECT id, path, round(least(1.0, sum(1.0::DOUBLE / (60 + rank)) / (2.0::DOUBLE / 61)), 9) AS score FROM arms GROUP BY id, path)"""
FUSED = f"{VECTOR_CTE}, {ARMS}"
MMR = """pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS i FROM {hits} QUALIFY i < 60),
mm AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score * 0.5::DOUBLE DESC, i) AS r FROM pool QUALIFY r <= 3),
mk AS (SELECT *, round(score * 0.5::DOUBLE - CASE WHEN r > 1 THEN 0.5::DOUBLE ELSE 0 END, 9) AS mmr FROM mm),
sel AS (SELECT *, row_number() OVER (ORDER BY mmr DESC, i) AS position FROM mk)"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = inputs.chunks(spark, sf_dir, vectors=True)
    return search.vector_arm(c, inputs.query_vector(spark, sf_dir), 60), search.text_arm(search.scanned(c, WORDS), 60)


def _search(mode: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = inputs.chunks(spark, sf_dir, vectors=mode != "fts")
        return search.search(c, inputs.query_vector(spark, sf_dir), WORDS, search.SearchOptions(mode=mode, **options))

    return run


TAKE = "SELECT id, path, score, position FROM (SELECT id, path, score, row_number() OVER (ORDER BY position) AS position FROM sel {where}) WHERE position <= 20"
VEC_HITS = "hits AS (SELECT id, path, round(1 / (1 + distance), 9) AS score FROM vec)"
FTS_HITS = "hits AS (SELECT id, path, round(s / (1 + s), 9) AS score FROM (SELECT id, path, CASE WHEN bm25 > 0 THEN bm25 ELSE 1.0::DOUBLE / (60 + rank) END AS s FROM fts))"
query("R5_hybrid_search", f"{FUSED}, {MMR.format(hits='fused')} {TAKE.format(where='')}")(_search("hybrid"))
query("R3_vector_search", f"{VECTOR_CTE}, {VEC_HITS}, {MMR.format(hits='hits')} {TAKE.format(where='')}")(_search("vector"))
query("R4_text_search", f"{VECTOR_CTE}, {TEXT_CTE}, {FTS_HITS}, {MMR.format(hits='hits')} {TAKE.format(where='')}")(_search("fts"))
query("F5_threshold", f"{FUSED}, {MMR.format(hits='fused')} {TAKE.format(where='WHERE score >= 0.45')}")(_search("hybrid", threshold=0.45))
SRC1_EN = " WHERE starts_with(path, 'src1') AND list_contains(tags, 'en')"
query("F3_filtered_search", f"{vector_cte(SRC1_EN)}, {ARMS}, {MMR.format(hits='fused')} {TAKE.format(where='')}")(_search("hybrid", path_prefix="src1", tag="en"))


@query("T1_vector_arm", f"{VECTOR_CTE} SELECT id, path, distance, rank FROM vec")
def vector_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir)[0]


@query("T2_text_arm", f"{VECTOR_CTE}, {TEXT_CTE} SELECT id, path, bm25, rank FROM fts")
def text_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir)[1]


@query("A10_rank_fusion", f"{FUSED} SELECT id, path, score FROM fused")
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(*_arms(spark, sf_dir))


@query("W2_diversify", f"{FUSED}, {MMR.format(hits='fused')} SELECT id, path, score, CAST(i AS INT) AS i, CAST(r AS INT) AS r, mmr, CAST(position AS INT) AS position FROM sel")
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.diversify(search.pool(search.fuse(*_arms(spark, sf_dir)), 60))


@query("T5_vector_scores", f"{VECTOR_CTE} SELECT id, path, round(1 / (1 + distance), 9) AS score FROM vec WHERE rank <= 20")
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = _arms(spark, sf_dir)[0].where("rank <= 20")
    return arm.select("id", "path", F.round(scores.vector_score(F.col("distance")), 9).alias("score"))


@query("A5_postings", f"{with_tables('chunks')}, {post_cte('chunks')} SELECT id, path, doc_len, token, tf FROM post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(inputs.chunks(spark, sf_dir))


@query("A12_recall_mrr", f"""{VECTOR_CTE}, d AS (SELECT doc_id, path FROM chunks WHERE doc_id % 100 = 0),
qs AS (SELECT c.doc_id AS query_id, c.path AS expected_path, list_transform(list_zip({VECTOR}, {VECTOR.replace('e.', 'o.')}), lambda p: p[1] * 0.7::DOUBLE + p[2] * 0.3::DOUBLE) AS query FROM d c, en JOIN embeddings e ON e.vec_id = c.doc_id % n JOIN embeddings o ON o.vec_id = (c.doc_id + 7) % n),
dist AS (SELECT query_id, id, path, round(list_sum(list_transform(list_zip(vector, qs.query), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM cv, qs),
hits AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM dist QUALIFY position <= 60),
best AS (SELECT query_id, path, min(position) AS rank FROM hits GROUP BY ALL)
SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mrr
FROM qs e LEFT JOIN best b ON b.query_id = e.query_id AND b.path = e.expected_path""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = inputs.query_set(spark, sf_dir)
    hits = vectors.all_hits(inputs.chunks(spark, sf_dir, vectors=True), wanted.select("query_id", "query"), 60)
    return search.evaluate(wanted.select("query_id", "expected_path"), hits)


@query("K3_impact_index", f"{with_tables('chunks')}, cv AS (SELECT * FROM chunks), {TEXT_CTE} SELECT id, path, bm25, rank FROM fts")
def impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of an index made of all chunks, which skips what cannot be among them."""
    c = inputs.chunks(spark, sf_dir)
    index = impacts.ImpactIndex(spark, index_folder(spark))
    index.build_from(c)
    return index.search(WORDS, 60)


@query("K3_vector_index")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row whose id is divisible by 100 as a query against an index of all rows: hits, the
    nearest and the farthest distance, the lists that were probed, and for a bounded number of queries the
    share of the true 60 nearest rows that was found."""
    c = inputs.chunks(spark, sf_dir, vectors=True)
    index = vectors.VectorIndex(spark, index_folder(spark))
    told = index.build(c)
    asked = inputs.query_set(spark, sf_dir).select("query_id", "query")
    hits = index.search_all(asked, 60)
    measured = asked.orderBy(F.xxhash64("query_id")).limit(256)
    truth = vectors.exact_hits(c.select("id", "vector"), measured, 60).groupBy("query_id").agg(F.max("distance").alias("least"), F.count("*").alias("wanted"))
    # rows as near as the farthest true one count: there are ties
    met = hits.join(truth, "query_id", "left").groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"),
        F.round(F.sum((F.col("distance") <= F.col("least") + 1e-6).cast("int")) / F.max("wanted"), 6).alias("recall"),
    )
    return met.select("*", F.lit(told["probes"]).alias("probed"), F.lit(len(told["centres"])).alias("lists"))


def _shift_step(i: int) -> str:
    """The next state of a 32-bit xorshift."""
    a, b = "xor(x, (x << 13) & 4294967295)", "xor(a, a >> 17)"
    return f"s{i} AS (SELECT p_partkey, list_append(v, x / 2147483647.0::DOUBLE - 1) AS v, x FROM (SELECT p_partkey, v, xor(b, (b << 5) & 4294967295) AS x FROM (SELECT *, {b} AS b FROM (SELECT *, {a} AS a FROM s{i - 1}))))"


@query("E2_hash_vectors", f"""WITH s0 AS (SELECT p_partkey, CAST([] AS DOUBLE[]) AS v, CASE h WHEN 0 THEN 1 ELSE h END AS x FROM (SELECT p_partkey,
 list_reduce(list_prepend(5381::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(substr(p_name, i, 1)) AS BIGINT))), lambda h, u: (h * 33 + u) & 4294967295) AS h FROM part)),
{', '.join(_shift_step(i) for i in range(1, 6))} SELECT p_partkey, list_transform(v, lambda e: CAST(CAST(e / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT) AS DOUBLE)) AS vector FROM s5""")
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("embed_text"))
    return embed.with_vectors(rows, embed.HashEmbedder(5)).select("p_partkey", F.transform("vector", lambda x: x.cast("double")).alias("vector"))


# ---------------------------------------------------------------- store


def _chunk_query(name: str, sql: str) -> Callable:
    return query(name, with_tables("chunks") + sql)


@_chunk_query("A1_document_count", "SELECT count(DISTINCT path) AS documents, count(*) AS chunks FROM chunks")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.document_count(inputs.chunks(spark, sf_dir))


@_chunk_query("A3_tag_counts", "SELECT tag, count(DISTINCT path) AS count FROM (SELECT path, unnest(tags) AS tag FROM chunks) GROUP BY tag")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tag_counts(inputs.chunks(spark, sf_dir))


@_chunk_query("A4_top_tags", ", c AS (SELECT tag, count(DISTINCT path) AS count FROM (SELECT path, unnest(tags) AS tag FROM chunks WHERE starts_with(path, 'src1')) GROUP BY tag) SELECT tag, count, (SELECT count(*) FROM c) AS total FROM c ORDER BY count DESC, tag LIMIT 5")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_tags(inputs.chunks(spark, sf_dir), 5, "src1")


@_chunk_query("A6_fingerprints", "SELECT path, max(mtime_ms) AS mtime_ms, arg_max(sha256, mtime_ms) AS sha256 FROM chunks GROUP BY path")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fingerprints(inputs.chunks(spark, sf_dir))


@_chunk_query("A7_fingerprint", "SELECT path, max(mtime_ms) AS mtime_ms, arg_max(sha256, mtime_ms) AS sha256 FROM chunks WHERE path = 'src1/en/1.md' GROUP BY path")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fingerprint(inputs.chunks(spark, sf_dir), "src1/en/1.md")


@_chunk_query("A8_has_rows", ", p AS (SELECT 'src' || (doc_id % 30) || '/en/' || (doc_id % 9) || '.md' AS path FROM documents GROUP BY ALL) SELECT p.path, p.path IN (SELECT path FROM chunks) AS present FROM p")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    wanted = inputs.table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), (n % 30).cast("string"), F.lit("/en/"), (n % 9).cast("string"), F.lit(".md")).alias("path")).distinct()
    return store.has_rows(inputs.chunks(spark, sf_dir), wanted)


@_chunk_query("A9_indexed_paths", "SELECT DISTINCT path FROM chunks WHERE starts_with(path, 'src1')")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.indexed_paths(inputs.chunks(spark, sf_dir), "src1")


@_chunk_query("F1_path_prefix", "SELECT id FROM chunks WHERE starts_with(path, 'src1/')")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.where_path_and_tag(inputs.chunks(spark, sf_dir), "src1/").select("id")


@_chunk_query("F2_tag_filter", "SELECT id FROM chunks WHERE list_contains(tags, 'n3')")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.where_path_and_tag(inputs.chunks(spark, sf_dir), tag="n3").select("id")


@_chunk_query("F4_path_equals", "SELECT id FROM chunks WHERE path = 'src3/fr/2.md'")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.chunks(spark, sf_dir).where(F.col("path") == "src3/fr/2.md").select("id")


NEW = "new AS (SELECT path, CAST(chunk_index + 1 AS INT) AS chunk_index, sha256 || 'x' AS sha256 FROM chunks WHERE path IN (SELECT path FROM changed) AND doc_id % 2 = 0)"


def _upsert_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = inputs.chunks(spark, sf_dir)
    changed = c.where(F.endswith("path", F.lit("/3.md"))).select("path").distinct()
    new = c.join(changed, "path", "left_semi").where("doc_id % 2 = 0").select("path", (F.col("chunk_index") + 1).alias("chunk_index"), F.concat("sha256", F.lit("x")).alias("sha256"))
    return c.select("path", "chunk_index", "sha256"), changed, new


@_chunk_query("K1_upsert", f", changed AS (SELECT DISTINCT path FROM chunks WHERE ends_with(path, '/3.md')), {NEW} SELECT path, chunk_index, sha256 FROM chunks WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT * FROM new")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_upsert_parts(spark, sf_dir))


@_chunk_query("K2_drop", "SELECT path, chunk_index, sha256 FROM chunks WHERE NOT ends_with(path, '/3.md')")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, changed, _ = _upsert_parts(spark, sf_dir)
    return store.drop_paths(old, changed)


@_chunk_query("K9_delete_folder", "SELECT id FROM chunks WHERE NOT (path = 'src1' OR starts_with(path, 'src1/'))")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_under(inputs.chunks(spark, sf_dir), "src1").select("id")


@_chunk_query("K14_guarded_drop", "SELECT DISTINCT path FROM chunks WHERE path NOT IN (SELECT path FROM chunks WHERE doc_id % 3 = 0)")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.chunks(spark, sf_dir)
    return store.guarded_drops(c, c.where("doc_id % 3 = 0").select("path"))


@_chunk_query("K15_drop_hidden", ", h AS (SELECT id, CASE WHEN doc_id % 3 = 0 THEN '.trash/' ELSE '' END || path AS path FROM chunks) SELECT id, path FROM h WHERE path <> '.trash/src1/en/1.md'")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.concat(F.when(F.col("doc_id") % 3 == 0, ".trash/").otherwise(""), "path")
    rows = inputs.chunks(spark, sf_dir).select("id", hidden.alias("path"))
    return store.drop_hidden(store.drop_hidden(rows, ".trash/src1/en/1.md"), "src1/en/1.md")  # the second path is not hidden


STORED = "stored AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN mtime_ms - 5 ELSE mtime_ms END AS mtime_ms, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE sha256 END AS sha256 FROM files WHERE doc_id % 4 <> 1)"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.files(spark, sf_dir).where("doc_id % 4 <> 1")
    return rows.select("path", F.when(F.col("doc_id") % 3 == 0, F.col("mtime_ms") - 5).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))


@query("J1_scan_actions", f"{with_tables('files')}, {STORED} SELECT f.path, CASE WHEN s.sha256 IS NULL THEN 'new' WHEN f.mtime_ms = s.mtime_ms THEN 'unchanged' WHEN f.sha256 = s.sha256 THEN 'touched' ELSE 'changed' END AS action FROM files f LEFT JOIN stored s USING (path)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.classify(inputs.files(spark, sf_dir).select("path", "mtime_ms", "sha256"), _stored(spark, sf_dir))


@query("J2_sweep", f"{with_tables('files')}, {STORED} SELECT path FROM files WHERE path NOT IN (SELECT path FROM stored)")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.swept(inputs.files(spark, sf_dir), _stored(spark, sf_dir))


@query("M5_fresh_writes", f"{with_tables('files')}, {STORED}, inc AS (SELECT path, mtime_ms - 3 AS mtime_ms, sha256 FROM files) SELECT i.path, i.mtime_ms FROM inc i LEFT JOIN stored s USING (path) WHERE s.sha256 IS NULL OR i.mtime_ms >= s.mtime_ms OR i.sha256 = s.sha256")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = inputs.files(spark, sf_dir).select("path", (F.col("mtime_ms") - 3).alias("mtime_ms"), "sha256")
    return store.fresh(inc, _stored(spark, sf_dir)).select("path", "mtime_ms")


@query("J8_status", "SELECT n_name AS slug, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'running' END, 'starting') AS sync_state, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'ready' END, 'starting') AS index_state FROM nation")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = inputs.table(spark, sf_dir, "nation").withColumnRenamed("n_name", "slug")
    sync = n.where("n_nationkey % 3 = 0").select("slug", F.lit("running").alias("sync_state"))
    index = n.where("n_nationkey % 2 = 0").select("slug", F.lit("ready").alias("index_state"))
    return store.status(n.select("slug"), sync, index)


# ---------------------------------------------------------------- listing

LISTED = "ROW_NUMBER() OVER (ORDER BY string_split(path, '/'))"
ENTRIES = """entries AS (SELECT vault, 'file' AS type, path, size, sha256 FROM files UNION ALL
 SELECT DISTINCT vault, 'folder', split_part(path, '/', 1), NULL::BIGINT, NULL FROM files UNION ALL
 SELECT DISTINCT vault, 'folder', split_part(path, '/', 1) || '/' || split_part(path, '/', 2), NULL::BIGINT, NULL FROM files)"""


@query("S5_entries", f"{with_tables('files')}, {ENTRIES} SELECT * FROM entries")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.entries(inputs.files(spark, sf_dir))


@query("F6_one_level", f"{with_tables('files')}, {ENTRIES} SELECT type, path FROM entries WHERE starts_with(path, 'src1') AND strpos(path, '/') = 0")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.listed(listing.entries(inputs.files(spark, sf_dir)), "src1", recursive=False).select("type", "path")


CURSOR = "c3JjMS9lbi8xMDEubWQ="  # src1/en/101.md


@query("T6_page", f"""{with_tables('files')}, {ENTRIES}, rest AS (SELECT type, path FROM entries WHERE string_split(path, '/') > ['src1', 'en', '101.md']),
top AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS k FROM rest QUALIFY k <= 26)
SELECT type, path, CASE WHEN (SELECT count(*) FROM top) > 25 THEN (SELECT to_base64(encode(path)) FROM top WHERE k = 25) END AS next_cursor FROM top WHERE k <= 25""")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(listing.entries(inputs.files(spark, sf_dir)).select("type", "path"), CURSOR, 25)


@query("S10_resources", f"{with_tables('files')}, top AS (SELECT path, {LISTED} AS k FROM files QUALIFY k <= 101) SELECT path, CASE WHEN (SELECT count(*) FROM top) > 100 THEN (SELECT to_base64(encode(path)) FROM top WHERE k = 100) END AS next_cursor FROM top WHERE k <= 100")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.resources(inputs.files(spark, sf_dir).select("path"))


@query("P15_scope", f"{with_tables('files')} SELECT substr(path, 6) AS path, size FROM files WHERE starts_with(path, 'src1/')")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.scoped(inputs.files(spark, sf_dir), "src1").select("path", "size")


@query("S6_read_file", f"{with_tables('files')} SELECT path, mtime_ms, size, sha256, 'text/markdown' AS content_type FROM files WHERE path = 'src1/en/1.md'")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).where(F.col("path") == "src1/en/1.md").select("path", "mtime_ms", "size", "sha256", paths.mime(F.col("path")).alias("content_type"))


# ---------------------------------------------------------------- paths

ODD = "odd AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'a//b/./' || doc_id || '.md' WHEN 1 THEN '/abs/' || doc_id WHEN 2 THEN 'C:x' || doc_id WHEN 3 THEN 'a/../b' || doc_id WHEN 4 THEN 'a/.git/' || doc_id || '.MD' WHEN 5 THEN '' WHEN 6 THEN 'node_modules/' || doc_id || '.md' WHEN 7 THEN 'x/y.' || lang ELSE 'pic/' || doc_id || '.PNG' END AS path FROM documents)"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit("a//b/./"), n, F.lit(".md")), F.concat(F.lit("/abs/"), n), F.concat(F.lit("C:x"), n), F.concat(F.lit("a/../b"), n), F.concat(F.lit("a/.git/"), n, F.lit(".MD")), F.lit(""), F.concat(F.lit("node_modules/"), n, F.lit(".md")), F.concat(F.lit("x/y."), "lang"), F.concat(F.lit("pic/"), n, F.lit(".PNG"))]
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 9 + 1).cast("int")).alias("path"))


@query("P11_content_type", f"WITH {ODD} SELECT doc_id, CASE WHEN lower(path) LIKE '%.md' THEN 'text/markdown' WHEN path LIKE '%.PNG' THEN 'image/png' ELSE 'application/octet-stream' END AS content_type, lower(path) LIKE '%.md' AS markdown FROM odd")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd(spark, sf_dir).select("doc_id", paths.mime(F.col("path")).alias("content_type"), paths.is_markdown(F.col("path")).alias("markdown"))


@query("P14_canonical_path", f"WITH {ODD} SELECT doc_id, CASE WHEN starts_with(path, '/') THEN '/' ELSE '' END || array_to_string(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')), '/') AS path FROM odd")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd(spark, sf_dir).select("doc_id", paths.canonical(F.col("path")).alias("path"))


@query("F10_safe_path", f"""WITH {ODD}, r AS (SELECT doc_id, path, CASE WHEN path = '' THEN 'empty' WHEN strlen(path) > 1024 THEN 'too_long' WHEN starts_with(path, '/') THEN 'absolute' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive'
 WHEN list_contains(string_split(path, '/'), '..') THEN 'parent' WHEN regexp_matches(path, '(^|/)\\.') THEN 'hidden' END AS problem FROM odd)
SELECT doc_id, problem, problem IS NULL AND lower(path) LIKE '%.md' AND NOT list_contains(string_split(path, '/'), 'node_modules') AS indexable FROM r""")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _odd(spark, sf_dir).select("doc_id", paths.path_problem(p).alias("problem"), paths.is_indexable(p).alias("indexable"))


@query("X13_path_parts", f"{with_tables('files')} SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, split_part(path, '/', 3) AS name, len(string_split(path, '/')) AS depth FROM files")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return inputs.files(spark, sf_dir).select("path", paths.folder_of(p).alias("folder"), paths.basename(p).alias("name"), F.size(paths.segments(p)).cast("bigint").alias("depth"))


@query("X10_relative_path", f"""{with_tables('files')} SELECT path, CASE WHEN starts_with(path, 'src1/en/') THEN substr(path, 9) WHEN starts_with(path, 'src1/') THEN '../' || substr(path, 6) ELSE '../../' || path END AS relative FROM files""")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", paths.relative_form(F.lit("src1/en"), F.col("path")).alias("relative"))


@query("X11_join_path", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id WHEN 1 THEN source || '/' || lang || '/b' WHEN 2 THEN NULL ELSE '' END AS joined FROM documents")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    forms = F.array(F.concat(F.lit("../"), F.col("doc_id").cast("string")), F.lit("./x/..//b"), F.lit("../../../b"), F.lit("../.."))
    rel = F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", paths.join_normalized(F.concat("source", F.lit("/"), "lang"), rel).alias("joined"))


@query("F16_inside", f"{with_tables('files')} SELECT path, path = 'src1/en' OR starts_with(path, 'src1/en/') AS inside FROM files")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", paths.under(F.col("path"), "src1/en").alias("inside"))


@query("K11_copy_paths", f"{with_tables('files')} SELECT path AS old, 'copy/of' || substr(path, 5) AS new FROM files WHERE starts_with(path, 'src1/')")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.move_map(inputs.files(spark, sf_dir), "src1", "copy/of")


# ---------------------------------------------------------------- text


@query("X6_slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")!"))).alias("slug"))


@query("X2_split_lines", f"{with_tables('files')} SELECT path, len(string_split(content, chr(10))) AS lines, string_split(content, chr(10))[1] AS first FROM files")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.split_lines(F.col("content"))
    return inputs.files(spark, sf_dir).select("path", F.size(lines).cast("bigint").alias("lines"), F.element_at(lines, 1).alias("first"))


@query("X3_clip_line", f"{with_tables('files')} SELECT path, substr(content, 1, 1000) AS clipped FROM files")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", text.clip_line(F.col("content")).alias("clipped"))


@query("X4_window_line", f"{with_tables('files')}, m AS (SELECT path, content, strpos(content, ' of ') AS c FROM files), s AS (SELECT *, greatest(1, least(c - 50, length(content) - 99)) AS start_col FROM m WHERE c > 0) SELECT path, CAST(start_col AS INT) AS start_col, substr(content, start_col, 100) AS shown FROM s")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.files(spark, sf_dir).withColumn("c", F.instr("content", " of ")).where("c > 0")
    return rows.select("path", text.window_start(F.col("content"), F.col("c"), 100).alias("start_col"), text.window_line(F.col("content"), F.col("c"), 100).alias("shown"))


@query("X14_occurrences", f"{with_tables('files')} SELECT path, CAST((length(content) - length(replace(content, 'er', ''))) / 2 AS INT) AS n FROM files")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", text.occurrences(F.col("content"), F.lit("er")).alias("n"))


@query("K7_patch", f"""{with_tables('files')}, p AS (SELECT path, replace(content, ' of ', ' OF ') AS t, strpos(content, ' of ') AS a FROM files), q AS (SELECT *, CAST((length(t) - length(replace(t, ' and ', ''))) / 5 AS INT) AS n FROM p)
SELECT path, CASE WHEN a > 0 AND n = 1 THEN replace(t, ' and ', ' & ') END AS text, CASE WHEN a = 0 OR n = 0 THEN 'patch_no_match' WHEN n > 1 THEN 'patch_ambiguous' END AS error, CASE WHEN a = 0 THEN 0 WHEN n <> 1 THEN 1 ELSE 2 END AS at FROM q""")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = lambda old, new, every: F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(every).alias("all"))
    done = text.apply_edits(F.col("content"), F.array(edit(" of ", " OF ", True), edit(" and ", " & ", False)))
    return inputs.files(spark, sf_dir).select("path", done.alias("d")).select("path", "d.*")


@query("K6_append", f"{with_tables('files')} SELECT path, sha256(content || chr(10) || 'end') AS sha256 FROM files")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", F.sha2(F.concat("content", F.lit("\nend")), 256).alias("sha256"))


@query("K5_frontmatter", "SELECT doc_id, '---' || chr(10) || 'lang: \"' || lang || '\"' || chr(10) || 'n: ' || n_chars || chr(10) || '---' || chr(10) || chr(10) || text AS note FROM documents")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    fields = F.create_map(F.lit("lang"), F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("n"), F.col("n_chars").cast("string"))
    return d.select("doc_id", text.note_with_frontmatter(fields, F.col("text")).alias("note"))


@query("X9_encode_link", "SELECT p_partkey, replace(replace(replace(p_name || ' (50%)', '%', '%25'), ' ', '%20'), '(', '%28') AS most, p_name || ' (50%)' AS back FROM part")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" (50%)"))
    done = text.encode_link(name)
    return inputs.table(spark, sf_dir, "part").select("p_partkey", F.replace(done, F.lit("%29"), F.lit(")")).alias("most"), text.decode_link(done).alias("back"))


@query("X21_iso_time", f"{with_tables('files')} SELECT path, strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM files")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", text.iso_of_millis(F.col("mtime_ms")).alias("iso"))


@query("X15_utf8", f"{with_tables('files')} SELECT path, CASE WHEN doc_id % 2 = 0 THEN content END AS strict, content || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(65533) || 'A' END AS lenient FROM files")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("content", "UTF-8")).otherwise(F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FF41"))))
    return inputs.files(spark, sf_dir).select("path", text.strict_utf8(raw).alias("strict"), text.lenient_utf8(raw).alias("lenient"))


@query("P6_embed_text", f"{with_tables('chunks')} SELECT id, sha256(embed_text) AS sha256 FROM chunks")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.chunks(spark, sf_dir).select("id", F.sha2("embed_text", 256).alias("sha256"))


@query("P12_sha256", f"{with_tables('files')} SELECT path, sha256 FROM files")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).select("path", "sha256")


@query("P8_tags", f"{with_tables('files', 'notes')} SELECT path, ['tag/' || (doc_id % 4)] AS tags FROM notes")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.notes(spark, sf_dir).select("path", chunking.tags_without_code(F.col("content")).alias("tags"))


FRONT = """front AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '{"lang": ' || lang WHEN 1 THEN '[1, "en"]' WHEN 2 THEN NULL WHEN 3 THEN '"' || lang || '"' ELSE
 '{"lang": "' || lang || '", "n": ' || n_chars || ', "in": ["' || source || '", "all"], "a b": {"c": ' || (doc_id % 5) || CASE WHEN doc_id % 2 = 0 THEN '.5' ELSE '' END || '}}' END AS frontmatter FROM documents),
j AS (SELECT *, CASE WHEN json_type(TRY_CAST(frontmatter AS JSON)) = 'OBJECT' THEN CAST(frontmatter AS JSON) ELSE CAST('{}' AS JSON) END AS f FROM front)"""


def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = inputs.table(spark, sf_dir, "documents"), F.col("doc_id")
    whole = F.concat(
        F.lit('{"lang": "'), "lang", F.lit('", "n": '), F.col("n_chars").cast("string"), F.lit(', "in": ["'), "source", F.lit('", "all"], "a b": {"c": '), (n % 5).cast("string"),
        F.when(n % 2 == 0, ".5").otherwise(""), F.lit("}}"),
    )
    odd = F.when(n % 7 == 0, F.concat(F.lit('{"lang": '), "lang")).when(n % 7 == 1, '[1, "en"]').when(n % 7 == 2, F.lit(None)).when(n % 7 == 3, F.concat(F.lit('"'), "lang", F.lit('"')))
    return d.select("doc_id", F.when(n % 7 < 4, odd).otherwise(whole).alias("frontmatter"))


@query("P18_frontmatter", f"""WITH {FRONT} SELECT doc_id, f ->> '$.lang' AS lang, CAST(f ->> '$.n' AS BIGINT) AS n, CAST(f -> '$.in' AS VARCHAR[]) AS sources, CAST(f -> '$."a b"' ->> '$.c' AS DOUBLE) AS c, json_type(f -> '$.n') IS NOT NULL AS counted FROM j""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frontmatter.fields(F.col("frontmatter"))
    get = lambda names, kind: frontmatter.field(f, names, kind)
    return _front(spark, sf_dir).select(
        "doc_id", get("lang", "string").alias("lang"), get("n", "bigint").alias("n"), get("in", "array<string>").alias("sources"), get(("a b", "c"), "double").alias("c"), frontmatter.has(f, "n").alias("counted")
    )


@query("X23_frontmatter_filter", f"WITH {FRONT} SELECT doc_id, frontmatter FROM j WHERE list_contains(CAST(f -> '$.in' AS VARCHAR[]), 'src1') AND f ->> '$.lang' = 'en'")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.where_field(frontmatter.where_field(_front(spark, sf_dir), "in", "src1"), "lang", "en")


@query("P7_wiki_links", f"{with_tables('files', 'notes')} SELECT path, list_concat(list_concat([CAST((doc_id * 13) % 120 AS VARCHAR), split_part(path, '/', 1) || '/en/' || ((doc_id + 20) % 200)], [((doc_id * 17) % 90) || '\\']), ['in/deep', 'in/code']) AS links FROM notes")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.notes(spark, sf_dir).select("path", links.wiki_links(F.col("content")).alias("links"))


# ---------------------------------------------------------------- grep

GREP = """lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
ctx AS (SELECT *, lag(substr(line, 1, 1000)) OVER w AS b, lead(substr(line, 1, 1000)) OVER w AS a FROM lines WINDOW w AS (PARTITION BY path ORDER BY n)),
m AS (SELECT *, {col} AS col FROM ctx)"""
GREP_OUT = "SELECT path, CAST(n AS INT) AS n, CAST(col AS INT) AS col, CAST(greatest(1, least(col - 500, length(line) - 999)) AS INT) AS start_col, substr(line, greatest(1, least(col - 500, length(line) - 999)), 1000) AS line, {b} AS before, {a} AS after FROM m WHERE col > 0 ORDER BY string_split(path, '/'), n LIMIT {limit}"


@query("F8_grep_literal", f"{with_tables('files')}, {GREP.format(col=chr(39).join(['strpos(line, ', 'idiot', ')']))} {GREP_OUT.format(b='list_filter([b], lambda x: x IS NOT NULL)', a='list_filter([a], lambda x: x IS NOT NULL)', limit=101)}")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.matches(inputs.files(spark, sf_dir), grep.GrepOptions("idiot", context=1))


@query("F8_grep_regex", f"""{with_tables('files')}, {GREP.format(col="CASE WHEN regexp_matches(line, 'th[aeiou]+n[dt]\\b', 'i') THEN length(regexp_extract(line, '^(.*?)th[aeiou]+n[dt]\\b', 1, 'is')) + 1 ELSE 0 END")} {GREP_OUT.format(b='[]::VARCHAR[]', a='[]::VARCHAR[]', limit=51)}""")
def f8r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.matches(inputs.files(spark, sf_dir), grep.GrepOptions(r"th[aeiou]+n[dt]\b", regex=True, ignore_case=True, limit=50))


BUDGET = """cost AS (SELECT path, content, size, CASE WHEN size <= 8000 THEN size ELSE 0 END AS c FROM files),
run AS (SELECT *, CAST(coalesce(sum(c) OVER (ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM cost),
stop AS (SELECT min(string_split(path, '/')) AS stop FROM run WHERE ahead + least(size, 8001) > 500000),
seen AS (SELECT run.*, stop IS NULL OR string_split(path, '/') < stop AS reached FROM run, stop)"""


@query("W6_byte_budget", f"{with_tables('files')}, {BUDGET} SELECT path, ahead, reached FROM seen")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.in_budget(inputs.files(spark, sf_dir), 8000, 500_000).select("path", "ahead", "reached")


@query("A11_grep_summary", f"""{with_tables('files')}, {BUDGET}, hits AS (SELECT count(*) AS h FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM seen WHERE reached AND size <= 8000) WHERE strpos(line, 'trash') > 0)
SELECT count(*) FILTER (WHERE reached AND size <= 8000) AS files_scanned, count(*) FILTER (WHERE reached AND size > 8000) AS files_skipped, any_value(h) > 40 OR NOT bool_and(reached) AS truncated, CASE WHEN any_value(h) > 40 THEN 'limit' WHEN NOT bool_and(reached) THEN 'bytes' END AS reason FROM seen, hits""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep(inputs.files(spark, sf_dir), grep.GrepOptions("trash", limit=40, max_file=8000, budget=500_000))[1]


# ---------------------------------------------------------------- links

RESOLVED = """keys AS (SELECT path, unnest([lower(path), lower(split_part(path, '/', 2) || '/' || split_part(path, '/', 3)), lower(split_part(path, '/', 3))]) AS key FROM files),
cand AS (SELECT source, link_no, 1 AS step, 0 AS form, regexp_replace(source, '/[^/]*$', '') || '/' || replace(linkpath, '\\.', '.') AS want FROM links WHERE kind = 'inline'
 UNION ALL SELECT source, link_no, 1, 1, regexp_replace(source, '/[^/]*$', '') || '/' || replace(linkpath, '\\.', '.') || '.md' FROM links WHERE kind = 'inline'
 UNION ALL SELECT source, link_no, step, form, replace(linkpath, '\\.', '.') || CASE form WHEN 1 THEN '.md' ELSE '' END FROM links, (VALUES (2, 0), (2, 1), (3, 0), (3, 1)) v(step, form)),
met AS (SELECT c.*, k.path AS target FROM cand c JOIN keys k ON k.key = lower(c.want) WHERE c.step = 3 OR lower(k.path) = lower(c.want)),
best AS (SELECT *, row_number() OVER (PARTITION BY source, link_no ORDER BY step, CASE WHEN step = 3 THEN 0 ELSE form END, CASE WHEN step = 3 THEN NOT ends_with(target, want) ELSE target <> want END,
 CASE WHEN step = 3 AND regexp_replace(target, '/[^/]*$', '') <> regexp_replace(source, '/[^/]*$', '') THEN 1 ELSE 0 END, CASE WHEN step = 3 THEN len(string_split(target, '/')) ELSE 0 END, string_split(target, '/')) AS nth FROM met),
resolved AS (SELECT source, link_no, target, step FROM best WHERE nth = 1)"""


@query("L2_file_keys", f"{with_tables('files')} SELECT path, unnest([lower(path), lower(split_part(path, '/', 2) || '/' || split_part(path, '/', 3)), lower(split_part(path, '/', 3))]) AS key FROM files")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.file_keys(inputs.files(spark, sf_dir))


@query("L3_resolve_links", f"{with_tables('files', 'links')}, {RESOLVED} SELECT source, link_no, target, step FROM resolved")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.resolve(inputs.links(spark, sf_dir), inputs.files(spark, sf_dir))


@query("L9_backlinks", f"{with_tables('files', 'links')}, {RESOLVED} SELECT target, count(DISTINCT source) AS notes, count(*) AS links FROM resolved GROUP BY target")
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks(links.resolve(inputs.links(spark, sf_dir), inputs.files(spark, sf_dir)))


@query("L1_find_links", f"{with_tables('files', 'links')} SELECT source, link_no, kind, linkpath FROM links")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.links_of(inputs.notes(spark, sf_dir)).select("source", "link_no", "kind", "linkpath")


@query("L4_plan_move")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inputs.files(spark, sf_dir)
    return links.plan_move(files.select("path"), inputs.notes(spark, sf_dir), "src1", "moved/one")


@query("L6_rewrite_notes")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = inputs.notes(spark, sf_dir)
    return links.rewrite(notes, links.plan_move(inputs.files(spark, sf_dir).select("path"), notes, "src1", "moved/one"))


@query("P1_chunk_notes")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = inputs.notes(spark, sf_dir)
    return chunking.chunk_notes(notes.select("path", "content", F.lit(0).cast("bigint").alias("mtime_ms"), F.sha2("content", 256).alias("sha256")))


@query("S8_page_markdown", r"""WITH p AS (SELECT source || '/' || doc_id // 400 || '.pdf' AS path, row_number() OVER (PARTITION BY source, doc_id // 400 ORDER BY doc_id) AS page, CASE WHEN doc_id % 5 = 0 THEN '' ELSE
 regexp_replace(regexp_replace(text || chr(10) || chr(10) || 'end of ' || doc_id, '^\s+', ''), '\n{3,}', chr(10) || chr(10), 'g') END AS t FROM documents)
SELECT path, count(*) AS pages, bool_or(t <> '') AS has_text, coalesce(string_agg(CASE WHEN page = 1 THEN t ELSE '<!-- page ' || page || ' -->' || chr(10) || chr(10) || t END, chr(10) || chr(10) ORDER BY page) FILTER (WHERE t <> ''), '') AS markdown FROM p GROUP BY path""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    d = inputs.table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), F.expr("doc_id div 400"), F.lit(".pdf")))
    page = F.row_number().over(W.partitionBy("path").orderBy("doc_id"))
    body = F.when(F.col("doc_id") % 5 == 0, "  \n").otherwise(F.concat(F.lit(" "), "text", F.lit("\n\n\n\nend of "), F.col("doc_id").cast("string"), F.lit("\n")))
    return chunking.pages_to_markdown(d.select("path", page.alias("page"), body.alias("text")))


# ---------------------------------------------------------------- events


@query("M2_debounce", f"{with_tables('file_events')}, g AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM file_events) SELECT path, kind, ts + INTERVAL 3600000 MILLISECONDS AS fired_at FROM g WHERE gap IS NULL OR gap >= 3600000000")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.debounced(inputs.file_events(spark, sf_dir), 3_600_000)


@query("M6_latest_event", f"{with_tables('file_events')} SELECT path, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS ts FROM file_events GROUP BY path")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest(inputs.file_events(spark, sf_dir))


@query("M9_silences", f"{with_tables('file_events')}, g AS (SELECT path AS vault, ts AS since, lead(ts) OVER (PARTITION BY path ORDER BY ts) AS until FROM file_events) SELECT * FROM g WHERE epoch_us(until) - epoch_us(since) > 43200000000")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.silences(inputs.file_events(spark, sf_dir).withColumnRenamed("path", "vault"), 43_200)


@query("M15_watchdog_state", f"{with_tables('file_events')} SELECT path AS vault, CASE WHEN count(ts) = 0 THEN 'resolving' WHEN count(ts) = 1 THEN 'tailing' ELSE 'armed' END AS state, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) > 86400000000 AS stalled FROM file_events GROUP BY path")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.watchdog_state(inputs.file_events(spark, sf_dir).withColumnRenamed("path", "vault"), "2024-01-31 00:00:00", 86_400)


@query("A15_rolling_counts", f"{with_tables('file_events')} SELECT event_id, count(*) OVER (PARTITION BY path ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM file_events")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rolling_counts(inputs.file_events(spark, sf_dir), "path", 86_400).select("event_id", "recent")


# ---------------------------------------------------------------- health and outcomes

STATUSES = """st AS (SELECT 'u' || user_id AS slug, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'failed' ELSE 'running' END AS state, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY user_id)"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug")).agg(F.when(last == "error", "failed").otherwise("running").alias("state"), F.count_if(F.col("event_type") == "error").alias("failures"))


@query("F14_unhealthy", f"WITH {STATUSES} SELECT slug, state, failures, CASE WHEN state = 'failed' THEN 'failed' ELSE 'failed_attempts' END AS reason FROM st WHERE state = 'failed' OR failures >= 3")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.unhealthy(_statuses(spark, sf_dir), 3)


@query("F14_all_running", f"WITH {STATUSES} SELECT coalesce(bool_and(state = 'running'), true) AS ready FROM st")
def f14r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.all_running(_statuses(spark, sf_dir))


@query("F15_scoped_status", f"WITH {STATUSES} SELECT slug, state, failures FROM st WHERE slug = 'u7'")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.narrowed(_statuses(spark, sf_dir), "u7")


@query("A13_outcomes", "SELECT l_orderkey % 500 AS op, bool_and(l_quantity > 2) AND bool_or(l_linestatus = 'O') AS indexed FROM lineitem GROUP BY op")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("op"), (F.col("l_quantity") > 2).alias("ok"), (F.col("l_linestatus") == "O").alias("indexed"))
    return health.outcomes(rows, "op")


@query("U3_lock_keys", f"{with_tables('files')} SELECT path, list_sort(list_distinct([split_part(path, '/', 2), split_part(path, '/', 1), split_part(path, '/', 2), path])) AS keys FROM files")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    return inputs.files(spark, sf_dir).select("path", health.lock_keys(F.array(part(2), part(1), part(2), "path")).alias("keys"))


@query("U4_file_sets", f"{with_tables('files')}, a AS (SELECT CASE WHEN starts_with(path, 'src1/') THEN 'moved/' || path ELSE path END AS path FROM files WHERE doc_id % 11 <> 0) (SELECT path, 'gone' AS change FROM (SELECT path FROM files EXCEPT ALL SELECT path FROM a)) UNION ALL (SELECT path, 'come' FROM (SELECT path FROM a EXCEPT ALL SELECT path FROM files))")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = inputs.files(spark, sf_dir)
    after = before.where("doc_id % 11 <> 0").select(F.when(F.startswith("path", F.lit("src1/")), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"))
    return health.file_set_change(before, after)


@query("M10_crash_ceiling", f"""{with_tables('file_events')}, k AS (SELECT event_id, path, ts, CASE event_id % 5 WHEN 0 THEN 'recovered' WHEN 1 THEN 'line' ELSE 'crash' END AS kind FROM file_events),
l AS (SELECT *, count(*) FILTER (WHERE kind = 'recovered') OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM k),
c AS (SELECT event_id, count(*) FILTER (WHERE kind = 'crash') OVER (PARTITION BY path, life ORDER BY epoch_us(ts) RANGE BETWEEN 864000000000 PRECEDING AND CURRENT ROW) AS recent FROM l) SELECT event_id, recent, recent > 2 AS over FROM c""")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    log = inputs.file_events(spark, sf_dir).withColumn("kind", F.when(n == 0, "recovered").when(n == 1, "line").otherwise("crash"))
    return health.over_ceiling(log, "path", 864_000, 2).select("event_id", "recent", "over")
