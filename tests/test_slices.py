"""Python operators work on Arrow batches in slices (functions/slices.py): the plans say so, and batches of many
slices give what single rows give."""

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from notelattice.functions.stem import stem, stem_counts
from notelattice.operators import chunking, links, search

ITER = f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}"
TEXT = "# Head\n\n #tag [[a%d|x]] [y](b%d.md) `[[code]]`\n\n" + "some words that fill é " * 60


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def notes(spark, n: int = 4000):
    rows = spark.range(n).selectExpr("concat('n/', id, '.md') path", "id")
    text = F.when(F.col("id") % 50 != 0, F.concat(F.lit("# Head\n\n #tag [[a"), F.col("id").cast("string"), F.lit("|x]] [y](b"), F.col("id").cast("string"), F.lit(TEXT.split("b%d")[1])))
    return rows.select("path", text.alias("content"), F.col("id").alias("mtime_ms"), F.lit("s").alias("sha256")).coalesce(1)


def iterates(df) -> bool:
    """All Python of the plan takes batches one after the other."""
    nodes = [line for line in plan(df).splitlines() if "ArrowEvalPython" in line]
    return bool(nodes) and all(ITER in line for line in nodes)


def test_counts(spark):
    df = spark.range(6000).selectExpr("array_repeat(concat('runs', id % 3), cast(id % 97 as int)) || array('running') w").coalesce(1)
    out = df.select("w", stem_counts(F.col("w"), ["run", "runs1"]).alias("c"))
    assert iterates(out)
    got = out.collect()
    assert len(got) == 6000 and all(r["c"] == [len(r["w"]), 1, sum(stem(x) == "runs1" for x in r["w"])] for r in got)
    chunks = spark.createDataFrame([("a", "p", "running")], "id string, path string, embed_text string")
    assert iterates(search.scanned(chunks, ["run"]))


def test_chunks(spark):
    for every in (False, True):
        out = chunking.chunk_notes(notes(spark), every)
        assert "MapInArrow" in plan(out)
        got = [r.asDict() for r in out.collect()]
        want = []
        for r in notes(spark).collect():
            made = [{**c, "mtime_ms": r["mtime_ms"], "sha256": "s", "id": f"{r['path']}#{c['chunk_index']}"} for c in chunking.chunk_note(r["path"], r["content"] or "")]
            want += made or [{**dict.fromkeys(got[0]), "path": r["path"]}] * every
        assert got == want


def test_links_and_tags(spark):
    out = links.links_of(notes(spark))
    assert iterates(out)
    want = [(r["path"], i, x["kind"], x["linkpath"], x["raw_start"], x["raw_end"], x["angle"]) for r in notes(spark).collect() for i, x in enumerate(links.find_links(r["content"] or ""))]
    assert [tuple(r) for r in out.select("source", "link_no", "kind", "linkpath", "raw_start", "raw_end", "angle").collect()] == want and len(want) == 2 * 3920
    tags = notes(spark).select("content", chunking.tags_without_code(F.col("content")).alias("t"))
    assert iterates(tags)
    assert all(r["t"] == (["tag"] if r["content"] else []) for r in tags.collect())


def test_moves(spark):
    """Forms are read again, and notes are rewritten, in slices too."""
    pages = spark.createDataFrame([(f"m/{i}.md", f"[x]({i + 1}.md) [[{i}]] " + "words " * 400) for i in range(2000)], "path string, content string").coalesce(1)
    plan_ = links.plan_move(pages.select("path"), pages, "m/7.md", "k/7.md")
    assert iterates(plan_)
    got = {(r["source"], r["link_no"]): r["new_linkpath"] for r in plan_.collect()}
    assert got == {("m/6.md", 0): "../k/7.md", ("m/7.md", 0): "../m/8.md"}
    new = links.rewrite(pages, plan_)
    assert iterates(new)
    assert {r["path"]: r["content"][:16] for r in new.collect()} == {"m/6.md": "[x](../k/7.md) [", "k/7.md": "[x](../m/8.md) ["}
