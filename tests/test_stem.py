"""The stemmer on words of the published vocabulary and in its Arrow form."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelattice.functions.slices import SLICE_BYTES, sliced
from notelattice.functions.stem import IRREGULAR, stem, stem_counts, stemmed, stems
from notelattice.operators import search

#: Word and stem, as published for the English rules.
PUBLISHED = (
    "consigned consign, consignment consign, consistency consist, consistently consist, consolations consol, consolatory consolatori, consolingly consol, conspicuously conspicu, "
    "conspiracy conspiraci, conspirators conspir, constables constabl, constancy constanc, knackeries knackeri, knavish knavish, kneeling kneel, knightly knight, knitted knit, knives knive, "
    "generously generous, hopping hop, hoping hope, running run, flies fli, dies die, cries cri, gas gas, gaps gap, kiwis kiwi, happy happi, by by, say say, relational relat, conditional condit, "
    "rational ration, skies sky, luxuriated luxuri, agreed agre, feed feed, controlling control, rolling roll, falling fall, probate probat, rate rate, cease ceas, bedded bed, shed shed, "
    "beautifully beauti, hopefulness hope, callousness callous, electricity electr, formalize formal, communism communism, community communiti, arsenal arsenal, succeeding succeed, "
    "inning inning, adjustment adjust, adoption adopt, replacement replac, yielding yield, ugly ugli"
)


@pytest.mark.parametrize("pair", PUBLISHED.split(", "))
def test_published(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_arrow_form(spark):
    rows = [(1, ["running", "runs", "été", "running"]), (2, []), (3, None), (4, ["a", "xy", "7s"])]
    df = spark.createDataFrame(rows, "i int, w array<string>").repartition(2)
    got = {r["i"]: r["s"] for r in df.select("i", stems(F.col("w")).alias("s")).collect()}
    assert got == {1: ["run", "run", "été", "run"], 2: [], 3: None, 4: ["a", "xy", "7s"]}
    sliced = df.where("i <> 1").select("i", stems(F.col("w")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in sliced} == {2: [], 3: None, 4: ["a", "xy", "7s"]}


def test_counts_of_stems(spark):
    rows = [(1, ["running", "runs", "dying", "running"]), (2, []), (3, ["die", "rung"]), (4, [])]
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1)
    got = {r["i"]: r["c"] for r in df.select("i", stem_counts(F.col("w"), ["run", "die", "nowhere"]).alias("c")).collect()}
    assert got == {1: [4, 3, 1, 0], 2: [0, 0, 0, 0], 3: [2, 0, 1, 0], 4: [0, 0, 0, 0]}
    assert all(stem(w)[0] == w[0] for w in [*IRREGULAR, "yes", "ying", "ed", "sing"])


def test_words_meet_by_stem(spark):
    rows = [("a", "a.md", "Connections and connected connectors"), ("b", "b.md", "the of and"), ("c", "c.md", "a river"), ("d", "d.md", None), ("d2", "d.md", "connect connect rivers")]
    chunks = spark.createDataFrame(rows, "id string, path string, embed_text string")
    words = [stem(w) for w in ("connecting", "rivers", "connects")]
    kept = search.bm25(search.postings(chunks), search.corpus_stats(chunks), words)
    scan = search.scanned(chunks, words)
    want = {(r["id"], r["bm25"]) for r in kept.collect()}
    assert want == {(r["id"], r["bm25"]) for r in scan.collect()} and {x for x, _ in want} == {"a", "c", "d2"}
    assert search.scanned(chunks, []).count() == 0


def test_one_pass(spark):
    """Texts are tokenised once: statistics and scores read one exchange, and no token is a row."""
    chunks = spark.range(2000).selectExpr("cast(id as string) id", "'p' path", "concat('word', id % 7, ' with text') embed_text")
    scored = search.text_arm(search.scanned(chunks, ["word3", "text"]), 10)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("ArrowEvalPython") == 1 and "Generate" not in final and "ReusedExchange" in plan


def test_slices():
    """A batch is worked on in bounded slices, whatever their offsets and nulls; all rows come back in order."""
    lists = pa.array([None if i % 50 == 0 else [f"running{i}", "runs"] * (i % 40) for i in range(20_000)], pa.list_(pa.string()))
    seen = []

    def work(part):
        seen.append(part.nbytes)
        return stemmed(part)

    got = pa.concat_arrays(list(sliced(work, iter([lists.slice(3), lists.slice(0, 0)]))))
    assert max(seen) <= SLICE_BYTES < lists.nbytes / 4
    assert got.to_pylist() == [None if w is None else [stem(x) for x in w] for w in lists.slice(3).to_pylist()]


def test_large_batches(spark):
    df = spark.range(6000).selectExpr("id", "IF(id % 11 = 0, NULL, array_repeat(concat('words', id % 13), cast(id % 97 as int))) w").coalesce(1)
    got = df.select("w", stems(F.col("w")).alias("s")).collect()
    assert len(got) == 6000 and all(r["s"] == (None if r["w"] is None else [stem(x) for x in r["w"]]) for r in got)


def test_lengths_need_no_stems(spark):
    chunks = spark.createDataFrame([("Connections, and the rivers",), (None,), ("of",)], "embed_text string")
    stats = search.corpus_stats(chunks)
    assert (stats.first()["n"], round(stats.first()["avgdl"], 9)) == (3, round(2 / 3, 9))
    assert "EvalPython" not in stats._jdf.queryExecution().executedPlan().toString()


def test_postings_stem_once(spark):
    """An explode of what Python made runs it once; chunks without words have no postings."""
    chunks = spark.createDataFrame([("a", "a.md", "Rivers river"), ("b", "b.md", "the of"), ("c", "c.md", None), ("d", "d.md", "")], "id string, path string, embed_text string")
    kept = search.postings(chunks)
    assert [tuple(r) for r in kept.select("id", "path", "doc_len", "token", "tf").collect()] == [("a", "a.md", 2, "river", 2)]
    assert kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 1
