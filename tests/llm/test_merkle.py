"""The Merkle manifest against trees built plainly, with sources that span many partitions."""

import hashlib
import random
import zlib

import duckdb
import pytest

from notelattice.llm import merkle
from notelattice.llm.common import table
from notelattice.llm.oracles import ORACLES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])

    def siblings(i):
        for level in levels[:-1]:
            at = i // 3 * 3
            yield level[at:i], level[i + 1 : at + 3]
            i //= 3

    return levels[-1][0], siblings


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r, leaf(r, r[4])) for r in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in sources}
    trees = {s: tree([h for _, h in own[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources]) if sources else ("", None)
    out = []
    for k, s in enumerate(sources):
        for i, (r, h) in enumerate(own[s]):
            path = [*trees[s][1](i), *above(k)]
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            x = leaf(r, text)
            for left, right in path:
                x = digest(*left, x, *right)
            out.append((r[0], h, trees[s][0], root, digest(*(y for left, right in path for y in left + right)), x, x == root))
    return out


def same(docs, **options):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in merkle.merkle_manifest(docs, **options).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    return got


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query(spark, sf_dir):
    out = merkle.merkle_manifest(table(spark, sf_dir, "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(ORACLES["op13_merkle_manifest"]).fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(str, want)) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("step", [1, 2])
def test_sources_over_many_partitions(spark, apart, step):
    rng = random.Random(step)
    texts = [None, "", "a\nb", "x\n" * 5, "ü", "no break"]
    rows = [(rng.choice([None, 1, 2, i, i, i]), rng.choice([None, "", "a", "hot", "hot", "hot", "ü"]), None if i % 3 else "é", i % 4 or None, rng.choice(texts)) for i in range(500)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(3).selectExpr("*", "1 AS k", "'x' AS g", "doc_id AS leaf", "0 AS part")
    got = same(docs, step=step)
    assert {r[6] for r in got} == {True, False}


def test_one_source_and_many(spark, apart):
    for n in (1, 2, 3, 4, 9, 10, 28, 82):
        same(spark.createDataFrame([(i, "s", None, None, "t\n") for i in range(n)], SCHEMA), step=1)
    same(spark.createDataFrame([(7, f"s{i}", None, None, "t") for i in range(40)], SCHEMA), step=1)


def test_empty_and_all_null(spark):
    none = spark.createDataFrame([(None,) * 5] * 5, SCHEMA)
    same(none)
    assert merkle.merkle_manifest(none.limit(0)).count() == 0


def test_subtrees_cover_a_run_once():
    for n in range(1, 60):
        nodes = [digest(str(i)).encode() for i in range(n)]
        for lo in range(0, n, 4):
            for hi in range(lo + 1, n + 1, 5):
                levels, tops = merkle.subtrees(nodes[lo:hi], lo, n)
                covered = sorted(i for level, j, _ in tops for i in range(j * 3**level, min((j + 1) * 3**level, n)))
                assert covered == list(range(lo, hi))
                assert all(levels[level][1][j - levels[level][0]] == h for level, j, h in tops)
