"""Quality rules, mixing and sharding against brute force, with odd rows."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notelattice.llm import hilbert, mixing, quality_rules
from notelattice.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None), (2, "", "b", "en"), (3, " \t\n\x0b\x0c\r ", "b", None), (4, "one two three four five six seven eight nine ten eleven", "a", "en"),
    (5, "x y z a b " * 6, "a", "en"), (5, "x y z a b " * 6, "a", "en"), (6, "line # one\nline # one\n\nother\r\n", "ü", "de"), (7, "é 漢字 \U0001f600 a", "c", "fr"),
    (None, "no id here but a few words to be counted as any other text is", "c", "en"), (8, "w" + " w" * 9, "a", "en"), (9, " ".join(f"t{i}" for i in range(30000)), "c", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, i, "mine", 0.5) for i, t, s, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string, size double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 1, 0), (4, 1, 0), (None, 1, 0), (5, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")


def counts(text):
    t = text or ""
    words = WORD.findall(t)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(wins)
    cover = {p for i, x in enumerate(wins) if often[x] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n)


def same_counts(rows, docs):
    got = Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows)
    assert got == Counter((d["doc_id"], *counts(d["text"])) for d in docs)


def test_base_counts(spark, sf_dir, odd, labels):
    docs = table(spark, sf_dir, "documents")
    rows = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels")).collect()
    same_counts(rows, docs.collect())
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD) for r in rows)
    same_counts(quality_rules.quality_rules(odd, labels).collect(), odd.collect())
    assert quality_rules.quality_rules(odd.limit(0), labels).count() == 0
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns and {r["kept"] for r in kept.collect()} == {"mine"}


def test_ratios(spark, sf_dir):
    """The model against a count in Python of the same hashes."""
    xxhash = pytest.importorskip("xxhash")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for d in docs.collect():
        for w in WORD.findall(d["text"]):
            b = (xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
            raw[b % 64] += 1
            target[b % 64] += d["doc_id"] in good
    import math

    share, alpha = sum(target.values()) / sum(raw.values()), quality_rules.ALPHA
    want = [math.log((target[b] + alpha) / (raw[b] * share + alpha)) for b in range(64)]
    assert quality_rules.fit(docs, quality_rules.trusted_ids(labels), 64, 1) == pytest.approx(want)
    assert quality_rules.fit(docs, quality_rules.trusted_ids(labels.limit(0)), 64) == [0.0] * 64


def test_held_out_junk(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_rules.quality_rules(docs, labels).collect() if r["doc_id"] in marks and not r["base_failed"]]
    assert sum(r["kept"] == bool(marks[r["doc_id"]]) for r in rows) > 0.95 * len(rows)


def fill(sizes, weights, total):
    out, live = {}, set(sizes)
    while True:
        level = (total - sum(out.values())) / sum(weights[s] for s in live)
        over = [s for s in live if level * weights[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weights[s] for s in live}
        for s in over:
            out[s] = 2 * sizes[s]
            live.discard(s)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mix(spark, sf_dir, odd, which):
    docs = odd if which == "odd" else table(spark, sf_dir, "documents")
    rows = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in docs.collect())
    sizes, most, taken = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_mixed_rows(spark, odd):
    got = Counter(map(tuple, mixing.mixed_rows(odd).collect()))
    taken = Counter()
    for r in mixing.mix(odd).collect():
        taken[r["doc_id"]] += r["copies"]
    back = Counter()
    for row, n in got.items():
        back[row[0]] += n
    assert back == +taken and mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_weights_matter(spark):
    """Five of six texts of equal size are taken: of the clean half more than of the marked-up one."""
    rows = [(i, ("word " * 20 if i % 2 else "w# " * 20), "s" + str(i % 3)) for i in range(3000)]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 's1' and taken > 0").collect()
    clean = sum(r["doc_id"] % 2 for r in taken)
    assert clean > 1.1 * (len(taken) - clean)


def test_shards_prune(spark):
    """A shard holds few of the values of each dimension."""
    rows = [(i, "word " * (1 << i % 11), f"s{i % 16:02d}", f"l{i % 13 % 4}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    met = hilbert.shard(docs).select("doc_id", "shard").join(docs, "doc_id")
    per = met.groupBy("shard").agg(F.count_distinct("source").alias("a"), F.count_distinct("lang").alias("b")).collect()
    assert sum(r["a"] for r in per) <= 80 and sum(r["b"] for r in per) <= 24  # of 128 and 32 without an order


def test_curve():
    at = {i: c for c, i in enumerate(hilbert.curve(3, 3))}
    assert sorted(at) == list(range(512))
    step = [sum(abs(at[i] // 8**k % 8 - at[i + 1] // 8**k % 8) for k in range(3)) for i in range(511)]
    assert set(step) == {1}


@pytest.mark.parametrize("which", ["table", "odd"])
def test_shards(spark, sf_dir, odd, which, tmp_path):
    docs = odd if which == "odd" else table(spark, sf_dir, "documents")
    rows = hilbert.shard(docs).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d["doc_id"], len(raw(d["text"])) + 1, zlib.crc32(raw(d["text"]))) for d in docs.collect())
    per = Counter(r["shard"] for r in rows)
    assert set(per) <= set(range(8)) and max(per.values()) - min(per[s] for s in range(8)) <= 1
    for s in per:
        mine = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(per[s]))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in rows)
    assert hilbert.shard(docs.limit(0)).count() == 0
    hilbert.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
