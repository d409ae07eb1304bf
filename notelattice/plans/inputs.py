"""The engine's tables, derived from the test tables; each has a DuckDB twin of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.operators.chunking import embed_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit("main").alias("vault"),
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        (F.lit(1700000000000) + F.col("doc_id") * 1000).alias("mtime_ms"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One chunk for each document; seven notes for each source and language."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.lit(".md"))
    out = d.select(
        path.alias("path"),
        F.col("doc_id").cast("int").alias("chunk_index"),
        F.concat(path, F.lit("#"), F.col("doc_id").cast("string")).alias("id"),
        F.array("source", "lang").alias("heading_path"),
        "text",
        F.array("lang", F.concat(F.lit("n"), (F.col("doc_id") % 5).cast("string")), "lang").alias("tags"),
        F.array(F.concat(F.lit("d"), (F.col("doc_id") * 7 % 100).cast("string"))).alias("links"),
        (F.lit(1700000000000) + F.col("doc_id") * 1000).alias("mtime_ms"),
        F.sha2("text", 256).alias("sha256"),
        "doc_id",
    ).withColumn("embed_text", embed_text(F.col("path"), F.col("heading_path"), F.col("text")))
    if not vectors:
        return out
    return out.join(vectors_of(out.select("doc_id"), spark, sf_dir), "doc_id")


def vectors_of(ids: DataFrame, spark: SparkSession, sf_dir: str, ahead: int = 0) -> DataFrame:
    """doc_id, vector of every document: the embeddings in turn, a little longer in each turn."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), "embedding")
    n = e.agg(F.count("*").alias("n"))  # one row
    placed = ids.join(F.broadcast(n), F.lit(True)).withColumns({"slot": (F.col("doc_id") + ahead) % F.col("n"), "turn": F.expr("doc_id div n")})
    longer = F.transform("embedding", lambda x: x.cast("double") * (1 + F.lit(0.001) * F.col("turn")))
    return placed.join(e, "slot").select("doc_id", longer.alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 1").select(F.col("embedding").alias("query"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, expected_path: a query for each document whose id is divisible by 100, its
    vector with a part of another one's mixed in."""
    d = chunks(spark, sf_dir).where("doc_id % 100 = 0").select("doc_id", F.col("path").alias("expected_path"))
    own, other = vectors_of(d.select("doc_id"), spark, sf_dir), vectors_of(d.select("doc_id"), spark, sf_dir, 7).withColumnRenamed("vector", "other")
    query = F.zip_with("vector", "other", lambda x, y: x * F.lit(0.7) + y * F.lit(0.3))
    return d.join(own, "doc_id").join(other, "doc_id").select(F.col("doc_id").alias("query_id"), query.alias("query"), "expected_path")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with frontmatter, a heading, a tag, five links (one in a cell of a table, one with an escape),
    a list with an item in an item, code of three sorts that holds tags and links, and the whole text of
    a document."""
    d = files(spark, sf_dir)
    n = F.col("doc_id")
    content = F.concat(
        F.lit("---\ntitle: Note "), n.cast("string"), F.lit("\n---\n# Head\n\n #tag/"), (n % 4).cast("string"), F.lit(" [["), ((n * 13) % 120).cast("string"), F.lit("|name]] [x]("), ((n * 5) % 60).cast("string"),
        F.lit(".md) [["), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/en/"), ((n + 20) % 200).cast("string"), F.lit("]]\n\n| [["), ((n * 17) % 90).cast("string"), F.lit("\\|cell]] | [e]("), ((n * 3) % 70).cast("string"),
        F.lit("\\.md) |\n\n* one\n* two\n  1. inner\n\ntext `#code/span`\n\n     #code/deep [[in/deep]]\n\n```\n #code/tag [[in/code]]\n```\n\n"), "content",
    )
    return d.select("doc_id", "path", content.alias("content"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of notes(), as a table: link_no 0, 2 and 3 are wiki links, 1 and 4 are inline ones."""
    d = files(spark, sf_dir)
    n = F.col("doc_id")
    rows = F.array(
        F.struct(F.lit(0).alias("link_no"), F.lit("wiki").alias("kind"), ((n * 13) % 120).cast("string").alias("linkpath")),
        F.struct(F.lit(1).alias("link_no"), F.lit("inline").alias("kind"), F.concat(((n * 5) % 60).cast("string"), F.lit(".md")).alias("linkpath")),
        F.struct(F.lit(2).alias("link_no"), F.lit("wiki").alias("kind"), F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/en/"), ((n + 20) % 200).cast("string")).alias("linkpath")),
        F.struct(F.lit(3).alias("link_no"), F.lit("wiki").alias("kind"), ((n * 17) % 90).cast("string").alias("linkpath")),
        F.struct(F.lit(4).alias("link_no"), F.lit("inline").alias("kind"), F.concat(((n * 3) % 70).cast("string"), F.lit("\\.md")).alias("linkpath")),
    )
    return d.select(F.col("path").alias("source"), F.explode(rows).alias("l")).select("source", "l.*")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("upsert")
    return e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), "ts", kind.alias("kind"))


#: DuckDB twins.
SQL = {
    "files": """files AS (SELECT 'main' AS vault, doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, 1700000000000 + doc_id * 1000 AS mtime_ms,
 CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, text AS content FROM documents)""",
    "chunks": """chunks0 AS (SELECT source || '/' || lang || '/' || (doc_id % 7) || '.md' AS path, CAST(doc_id AS INT) AS chunk_index, [source, lang] AS heading_path, text,
 [lang, 'n' || (doc_id % 5), lang] AS tags, ['d' || (doc_id * 7 % 100)] AS links, 1700000000000 + doc_id * 1000 AS mtime_ms, sha256(text) AS sha256, doc_id FROM documents),
chunks AS (SELECT *, path || '#' || chunk_index AS id, path || chr(10) || heading_path[1] || ' > ' || heading_path[2] || chr(10) || chr(10) || text AS embed_text FROM chunks0)""",
    "links": """links AS (SELECT path AS source, 0 AS link_no, 'wiki' AS kind, CAST((doc_id * 13) % 120 AS VARCHAR) AS linkpath FROM files
 UNION ALL SELECT path, 1, 'inline', ((doc_id * 5) % 60) || '.md' FROM files
 UNION ALL SELECT path, 2, 'wiki', split_part(path, '/', 1) || '/en/' || ((doc_id + 20) % 200) FROM files
 UNION ALL SELECT path, 3, 'wiki', CAST((doc_id * 17) % 90 AS VARCHAR) FROM files
 UNION ALL SELECT path, 4, 'inline', ((doc_id * 3) % 70) || '\\.md' FROM files)""",
    "notes": """notes AS (SELECT doc_id, path, '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || '---' || chr(10) || '# Head' || chr(10) || chr(10) || ' #tag/' || (doc_id % 4) || ' [[' || ((doc_id * 13) % 120) || '|name]] [x](' || ((doc_id * 5) % 60)
 || '.md) [[' || split_part(path, '/', 1) || '/en/' || ((doc_id + 20) % 200) || ']]' || chr(10) || chr(10) || '| [[' || ((doc_id * 17) % 90) || '\\|cell]] | [e](' || ((doc_id * 3) % 70) || '\\.md) |' || chr(10) || chr(10) || '* one' || chr(10) || '* two' || chr(10) || '  1. inner'
 || chr(10) || chr(10) || 'text `#code/span`' || chr(10) || chr(10) || '     #code/deep [[in/deep]]' || chr(10) || chr(10) || '```' || chr(10) || ' #code/tag [[in/code]]' || chr(10) || '```' || chr(10) || chr(10) || content AS content FROM files)""",
    "file_events": """file_events AS (SELECT event_id, 'u' || user_id || '.md' AS path, ts, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS kind FROM events)""",
}


def with_tables(*names: str) -> str:
    """WITH clause of the twins, in order."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
