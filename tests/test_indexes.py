"""The vector index and the impact index against searches of everything."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelattice.functions import stem
from notelattice.operators import impacts, search, vectors
from notelattice.plans import inputs, queries


@pytest.fixture(scope="module")
def points():
    """Clusters, one of which holds a third of all, and many equal vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    own = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 40, 6000))
    out = centres[own] + rng.normal(size=(6000, 16)) * 0.3
    out[:300] = out[0]
    return out


@pytest.fixture(scope="module")
def chunks(spark, points):
    rows = [(f"c{i}", f"f{i % 50}.md", [float(x) for x in v], i) for i, v in enumerate(points)] + [("none", "f.md", None, -1)]
    return spark.createDataFrame(rows, "id string, path string, vector array<float>, n int").repartition(4)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    out = vectors.VectorIndex(spark, str(tmp_path_factory.mktemp("vectors") / "ix"))
    out.build(chunks)
    return out


def true_ids(points, query, k):
    distance = ((points.astype(np.float32).astype(float) - query) ** 2).sum(1)
    return [f"c{i}" for i in np.argsort(distance, kind="stable")[:k]], np.sort(distance)[:k]


def test_every_row_is_in_one_list(index, points):
    told = index.current()
    rows = index.lists(told).select("id", "list").collect()
    assert sorted(r["id"] for r in rows) == sorted(f"c{i}" for i in range(len(points)))
    assert told["rows"] == len(points) == sum(told["sizes"].values()) and len(told["centres"]) > 20
    assert told["recall"] >= 0.95 and told["probes"] < len(told["centres"])


def test_recall_and_exact_scores(spark, index, points):
    asked = list(range(0, 6000, 100))
    queries = spark.createDataFrame([(i, [float(x) for x in points[i] * 0.9 + 0.05]) for i in asked], "query_id long, query array<double>")
    found = {}
    for r in index.search_all(queries, 20).collect():
        found.setdefault(r["query_id"], []).append((r["position"], r["id"], r["distance"]))
    good = 0
    for i in asked:
        _, want = true_ids(points, points[i] * 0.9 + 0.05, 20)
        got = [d for *_, d in sorted(found[i])]
        assert [p for p, *_ in sorted(found[i])] == list(range(1, 21)) and got == sorted(got)
        good += sum(d <= want[-1] + 1e-6 for d in got)
    assert good / (20 * len(asked)) >= 0.9
    everything = index.search_all(queries.limit(3), 20, probes=10**6).collect()
    for r in everything:
        _, want = true_ids(points, points[r["query_id"]] * 0.9 + 0.05, 20)
        assert abs(r["distance"] - want[r["position"] - 1]) < 1e-6


def test_one_query_reads_only_its_lists(spark, index, points):
    good = 0
    for i in (5, 1200, 4321):
        query = (points[i] * 0.95).tolist()
        out = index.search(query, 10)
        _, want = true_ids(points, np.array(query), 10)
        rows = out.collect()
        assert [r["rank"] for r in rows] == list(range(1, 11))
        good += sum(abs(r["distance"] - w) < 1e-6 for r, w in zip(rows, want, strict=True))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [list" in plan or "PartitionFilters: [isnotnull(list" in plan
    scan = index.lists(index.current()).where(F.col("list").isin([0, 3]))
    scan.count()
    node = scan._jdf.queryExecution().sparkPlan()
    files = [leaf.selectedPartitions().totalNumberOfFiles() for leaf in (node.collectLeaves().apply(i) for i in range(node.collectLeaves().size()))]
    assert files == [2] < [len(index.lists(index.current()).inputFiles())]
    assert good >= 27


def test_all_rows_in_blocks(spark, chunks, points, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 900)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    asked = list(range(0, 6000, 300))
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in asked], "query_id long, query array<double>")
    got = {}
    for r in vectors.all_hits(chunks, queries, 12).collect():
        got.setdefault(r["query_id"], []).append((r["position"], r["distance"], r["id"]))
    kept = points.astype(np.float32).astype(float)
    for i in asked:  # the first query has 300 equal vectors: those of least id count
        want = sorted((round(float(d), 9), f"c{j}") for j, d in enumerate(((kept - points[i]) ** 2).sum(1)))[:12]
        mine = sorted(got[i])
        assert [p for p, *_ in mine] == list(range(1, 13)) and [x for *_, x in mine] == [x for _, x in want]
        assert np.allclose([d for _, d, _ in mine], [d for d, _ in want], atol=1e-8)


def test_rows_are_not_sent_for_every_thousand_queries(spark):
    """Blocks are bounded by bytes: 4,000 queries of 64 numbers meet the rows in one crowd, and longer vectors in more."""
    rows = spark.range(300).selectExpr("cast(id as string) id", "'p' path", "array_repeat(cast(id as double), 64) vector")
    queries = spark.range(4000).selectExpr("id query_id", "array_repeat(cast(id as double), 64) query")
    out = vectors.all_hits(rows, queries, 2)
    assert "sequence(0, 0," in out._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 3," not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["query_id"], r["position"]): r["id"] for r in out.collect()}
    assert len(got) == 8000 and got[7, 1] == "7" and got[7, 2] == "6" and got[3999, 1] == "299"
    assert vectors._most(vectors.BLOCK_ROWS, vectors.ROW_BYTES, 1536) * 1536 * 8 <= 64 << 20


def test_small_and_empty(spark, tmp_path):
    schema = "id string, path string, vector array<float>"
    empty = vectors.VectorIndex(spark, str(tmp_path / "empty"))
    empty.build(spark.createDataFrame([], schema))
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query array<double>")
    assert empty.search([1.0, 0.0], 5).count() == 0 and empty.search_all(queries, 5).count() == 0
    two = vectors.VectorIndex(spark, str(tmp_path / "two"))
    rows = spark.createDataFrame([("a", "p", [1.0, 0.0]), ("b", "p", [0.0, 1.0])], schema)
    two.build(rows, mark="1")
    assert [r["id"] for r in two.search([1.0, 0.1], 5).orderBy("rank").collect()] == ["a", "b"]
    assert [(r["query_id"], r["id"]) for r in two.search_all(queries, 1).collect()] == [("q", "a")]
    two.build(rows.where("id = 'b'"), mark="2")
    two.build(rows.where("id = 'b'"), mark="3")
    assert two.current()["mark"] == "3" and len(two.files._names("v")) == 2


def test_sample_is_bounded_before_it_is_sorted(spark):
    """The sort of the sample gets little more than the sample, which is that of a sort of all rows."""
    rows = spark.range(0, 60_000, 1, 8).select("id", F.xxhash64("id").alias("h"))
    out = vectors.least_hashed(rows, 60_000, 2000)
    assert [r["id"] for r in out.collect()] == [r["id"] for r in rows.orderBy("h").limit(2000).collect()]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (" in plan and 2000 <= rows.where("h < " + plan.split(" < ")[1].split(")")[0].rstrip("L")).count() < 5000
    same = rows.withColumn("h", F.lit(5).cast("long"))  # no bound parts these
    assert vectors.least_hashed(same, 60_000, 2000).count() == 2000


@pytest.fixture(scope="module")
def texts(spark):
    """Some words are in most chunks, some in few; lengths differ widely."""
    rng = np.random.default_rng(9)
    words = [f"w{int(x)}" for x in range(400)]
    weight = 1 / np.arange(1, 401)
    weight /= weight.sum()
    rows = []
    for i in range(4000):
        n = int(rng.integers(1, 12)) ** 2
        rows.append((f"c{i}", f"f{i % 70}.md", " ".join(rng.choice(words, n, p=weight))))
    rows += [("empty", "e.md", ""), ("null", "e.md", None)]
    return spark.createDataFrame(rows, "id string, path string, embed_text string").repartition(4)


def test_impacts_give_the_hits_of_a_full_search(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(impacts, "RANGE_ROWS", 32)
    monkeypatch.setattr(impacts, "HEAVY", 200)
    monkeypatch.setattr(impacts, "BUCKET_ROWS", 20_000)
    monkeypatch.setattr(impacts, "FILE_ROWS", 5_000)
    index = impacts.ImpactIndex(spark, str(tmp_path / "ix"))
    kept, stats = search.postings(texts).cache(), search.corpus_stats(texts)
    index.build(kept, stats)
    skipped = 0
    for words, k in ((["w0"], 10), (["w1", "w399"], 60), (["w3", "w5", "w17"], 20), (["w390"], 60), (["w0", "w1", "w2", "w200"], 5)):
        want = [tuple(r) for r in search.text_arm(search.bm25(kept, stats, words), k).collect()]
        got, read = index.scored(words, k)
        assert [tuple(r) for r in search.text_arm(got, k).collect()] == want
        assert [tuple(r) for r in index.search(words, k).collect()] == want
        assert 0 < read["read"] <= read["ranges"]
        skipped += read["read"] < read["ranges"] // 2
    assert skipped >= 3
    assert index.search(["nowhere"], 5).count() == 0 and index.search([], 5).count() == 0
    monkeypatch.setattr(impacts, "LISTED", 3)  # more ranges than a filter lists
    want = [tuple(r) for r in search.text_arm(search.bm25(kept, stats, ["w2", "w9"]), 60).collect()]
    assert [tuple(r) for r in index.search(["w2", "w9"], 60).collect()] == want
    plan = index.scored(["w390"], 5)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert "In(token" in plan or "EqualTo(token" in plan


def test_impacts_of_nothing(spark, texts, tmp_path):
    index = impacts.ImpactIndex(spark, str(tmp_path / "ix"))
    assert index.search(["w1"], 5).count() == 0
    index.build(search.postings(texts.limit(0)), search.corpus_stats(texts.limit(0)))
    assert index.search(["w1"], 5).count() == 0


def test_impact_query_reads_texts_once(spark, sf_dir, monkeypatch):
    """Texts are tokenised and stemmed once, however many steps the index is made in."""
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        met.add(1)
        return text

    made = inputs.chunks(spark, sf_dir).select("id", "path", "embed_text").cache()
    monkeypatch.setattr(inputs, "chunks", lambda *_: made.withColumn("embed_text", seen.asNondeterministic()("embed_text")))
    assert queries.QUERIES["K3_impact_index"](spark, sf_dir).count() == 60
    assert met.value == made.count()


def test_impacts_of_chunks(spark, texts, tmp_path, monkeypatch):
    """Made of chunks, copies of some among them, the index is that of their postings."""
    monkeypatch.setattr(impacts, "RANGE_ROWS", 32)
    monkeypatch.setattr(impacts, "BUCKET_ROWS", 20_000)
    monkeypatch.setattr(impacts, "FILE_ROWS", 5_000)
    copies = texts.where("id LIKE 'c1%'").unionByName(texts.where("id = 'c17'"))
    for i, chunks in enumerate((texts, texts.unionByName(copies), texts.limit(0), texts.where("id = 'null'"))):
        one, two = (impacts.ImpactIndex(spark, str(tmp_path / f"{k}{i}")) for k in "ab")
        told = one.build_from(chunks)
        want = two.build(search.postings(chunks).cache(), search.corpus_stats(chunks))
        assert (told["n"], told["avgdl"]) == (want["n"], want["avgdl"])
        rows = [sorted(tuple(r) for r in x._postings(t).select("token", "id", "path", F.round("impact", 12)).collect()) for x, t in ((one, told), (two, want))]
        assert rows[0] == rows[1]
        for words in (["w0"], ["w1", "w399"], ["w3", "w5", "w17"]):
            assert one.search(words, 20).collect() == two.search(words, 20).collect()
        assert not (tmp_path / f"a{i}" / told["at"] / "bags").exists()


def test_bags():
    """Null lists, null words, words left out, and a slice of an array."""
    lists = pa.array([["x"], ["running", "runs", "the", None, "cats"], None, [], ["the"], ["cat", "run", "cat"]])
    for at in range(len(lists) + 1):
        got = stem.bagged(lists.slice(at), frozenset(["the"])).to_pylist()
        for text, bag in zip(lists.to_pylist()[at:], got, strict=True):
            want = Counter(stem.stem(w) for w in text or [] if w not in (None, "the"))
            assert bag["doc_len"] == want.total() and {p["token"]: p["tf"] for p in bag["bag"]} == want and len(bag["bag"]) == len(want)


def asked_of(spark, points):
    ids = list(range(0, 6000, 150))
    return ids, spark.createDataFrame([(i, (points[i] * 0.9 + 0.05).tolist()) for i in ids], "query_id long, query array<double>")


def test_a_query_is_sent_once_to_a_block(spark, index, points, monkeypatch):
    """Not once for each list that it probes: neither queries nor hits grow with the number of lists."""
    met, first, kept = vectors._met, vectors._first, {}
    monkeypatch.setattr(vectors, "_met", lambda queries, *a: met(kept.setdefault("queries", queries), *a))
    monkeypatch.setattr(vectors, "_first", lambda found, k: first(kept.setdefault("found", found), k))
    ids, queries = asked_of(spark, points)
    assert index.search_all(queries, 20, probes=10**6).count() == 20 * len(ids)
    assert kept["queries"].count() == len(ids) and kept["found"].count() == 20 * len(ids)


@pytest.mark.parametrize("probes", [1, 3, 30, 10**6])
def test_blocks_hold_the_probed_lists_alone(spark, chunks, points, tmp_path, monkeypatch, probes):
    """Many blocks, lists in parts, several crowds: the rows of the probed lists, as a plain reading has them."""
    for name, value in (("BLOCK_ROWS", 80), ("LEAST_BLOCK", 40), ("BLOCK_QUERIES", 9)):
        monkeypatch.setattr(vectors, name, value)
    index = vectors.VectorIndex(spark, str(tmp_path / "ix"))
    told = index.build(chunks)
    home = vectors.dealt_lists({int(x): n for x, n in told["sizes"].items()}, told["block"])
    assert len({b for *_, b in home}) > 10 and len(home) > len(told["sizes"])
    rows = index.lists(told).select("id", "list", "vector").collect()
    ids, queries = asked_of(spark, points)
    got = {}
    for r in index.search_all(queries, 20, probes=probes).collect():
        got.setdefault(r["query_id"], []).append((r["position"], r["id"], r["distance"]))
    lists, v = np.array([r["list"] for r in rows]), np.array([r["vector"] for r in rows])
    for i in ids:
        q = points[i] * 0.9 + 0.05
        own = np.flatnonzero(np.isin(lists, vectors.nearest_order(q[None, :], np.array(told["centres"]))[0][:probes]))
        want = sorted((round(float(((v[x] - q) ** 2).sum()), 8), rows[x]["id"]) for x in own)[:20]
        mine = sorted(got.get(i, []))
        assert [(x, p) for p, x, _ in mine] == [(x, p) for p, (_, x) in enumerate(want, 1)]
        assert np.allclose([d for *_, d in mine], [d for d, _ in want], atol=1e-7)
