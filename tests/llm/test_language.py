"""Language identification: held-out accuracy, counts and scores against plain ones, odd texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelattice.llm import language
from notelattice.llm.common import table


def plain_grams(text):
    """Buckets of a text's n-grams, one by one."""
    chars = [c if c.isalpha() else " " for c in language.PAD + language.lowered(text) + language.PAD]
    real = [c.isalpha() for c in chars]
    out = Counter()
    for i in range(len(chars) - language.REACH):
        for order in language.ORDERS:
            if real[i] or order > 1 and real[i + 1]:
                h = 0
                for c in chars[i : i + order]:
                    h = (h * 0x01000193 + ord(c)) % 2**32
                out[(h * 0x9E3779B1 + order * 0x05EBCA6B) % 2**32 >> 32 - language.BUCKET_BITS] += 1
    return out


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = language.identify_language(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 100
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_counts_and_scores_plainly(spark, monkeypatch):
    texts = [("en", "The cat, the 2 cats"), ("de", "Die Katzen - größer"), ("en", "A dog!"), (None, "rien"), ("de", None), ("xx", "")]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in zip(ids, texts, strict=True)], "doc_id long, text string, lang string")
    want = {}
    for x, t in texts:
        if x and t:
            want.setdefault(x, Counter()).update(plain_grams(t))
    got = {}
    for r in language.gram_counts(docs).collect():
        got.setdefault(r["lang"], Counter())[r["bucket"]] = r["n"]
    assert got == want
    langs, matrix = language.fit(docs)
    assert langs == ["de", "en"]
    unit = {x: [round((math.log(n + 1) - math.log(sum(c.values()) + language.BUCKETS)) * 65536) for n in (c.get(b, 0) for b in range(language.BUCKETS))] for x, c in want.items()}
    assert all(np.array_equal(matrix[k], unit[x]) for k, x in enumerate(langs))
    some = ["the cats", "Katzen", "", "12 --", None, "die katze und the dog " * 50]
    for window in (7, 1000, 10**6):
        monkeypatch.setattr(language, "WINDOW", window)
        names, scores = language.predict([t or "" for t in some], langs, matrix)
        for t, name, score in zip(some, names, scores, strict=True):
            total = {x: sum(unit[x][b] * n for b, n in plain_grams(t or "").items()) / 65536 for x in langs}
            best = max(langs, key=lambda x: total[x])
            if any(c.isalpha() for c in t or ""):
                assert name == best and score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()))
            else:
                assert (name, score) == ("und", 0.0)


def test_odd_tables(spark):
    rows = [(1, "x" * 500_000 + " ünd " * 90_000, "a"), (2, "İİ \U00020000", "b"), (None, "no id", "b"), (3, "same text", "a"), (4, "same text", "b"), (4, "same text", "b"), (5, None, "a"), (6, "1 2 3", None), (7, "same text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "held_out": F.lit("x"), "bucket": F.lit(0), "n": F.lit(0)})
    got = language.identify_language(docs.repartition(3)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["lang_pred"] == by[6]["lang_pred"] == "und" and by[None]["held_out"]
    assert len({(by[i]["lang_pred"], by[i]["score"]) for i in (3, 4, 7)}) == 1
    assert language.identify_language(docs.limit(0)).count() == 0
    unknown = language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
