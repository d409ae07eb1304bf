"""The pipeline stage by stage, the classifiers on held-out rows, and the registry."""

import math
import zlib
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from notelattice.llm import factorisation, pii, toxicity
from notelattice.llm.common import table
from tests.llm.test_native import WORD, counts
from tests.llm.test_text import brute_links

SF = "/root/testdata/sf0.01"


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    held = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        held.append(docs := spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in held[:-1])
    raw = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    good = {r["doc_id"]: r for r in held[0].collect()}
    marks = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    passed = {i for i, r in raw.items() if not counts(r["text"])[5]}
    assert set(good) <= passed and all(good[i] == raw[i] for i in good)
    assert sum((i in good) == bool(marks[i]) for i in passed & set(marks)) >= 0.95 * len(passed & set(marks))
    _, group = brute_links(good.values())
    one = held[1].collect()
    assert sorted(r["doc_id"] for r in one) == sorted(set(group.values()))
    clean = {r["doc_id"]: r for r in held[2].collect()}
    assert set(clean) == {r["doc_id"] for r in one}
    for r in one:
        spans = pii.all_spans([r["text"]], pii.field())[0][1]
        text = clean[r["doc_id"]]["text"]
        assert (text == r["text"]) == (not spans) and len(text) == clean[r["doc_id"]]["n_chars"] and not pii.base_spans(text)
    mixed = Counter(r["doc_id"] for r in held[3].collect())
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    size = {i: len(WORD.findall(r["text"])) for i, r in clean.items()}
    share = sum(size[i] * n for i, n in mixed.items()) / sum(size.values())
    assert share == pytest.approx(1.5, abs=0.1)
    last = held[4].collect()
    assert Counter(r["doc_id"] for r in last) == mixed and all(r["parity"] and r["round_trip"] for r in last)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "ids"} <= set(out.columns) and out.count()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, "x", "y"), (2, "", 0, "x", "y"), (3, "a\nb " * 40000, 5, "x", "y"), (3, "a\nb " * 40000, 5, "x", "y"), (None, "é 漢 \U0001f600 ###", -1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string, held_out string")


@pytest.mark.parametrize("score,label,folds,out", [(factorisation.score_quality, "quality", 5, 0), (toxicity.score_toxicity, "toxic", 4, 2)])
def test_classifiers(spark, odd, score, label, folds, out):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    marks = {r["doc_id"]: r[label] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.85 * len(held)
    odd_rows = score(odd, labels).collect()
    assert len(odd_rows) == 5 and len({r["score"] for r in odd_rows if r["doc_id"] == 3}) == 1
    # held-out labels change nothing
    flipped = labels.withColumn(label, 1 - labels[label]).where(f"crc32(cast(cast(doc_id as string) as binary)) % {folds} = {out}")
    kept = labels.where(f"crc32(cast(cast(doc_id as string) as binary)) % {folds} <> {out}")
    again = {r["doc_id"]: r["score"] for r in score(docs, kept.unionByName(flipped)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in rows)
    alone = score(odd, labels.where(f"{label} = 1")).collect()
    assert len({r["score"] for r in alone}) == 1 and score(odd.limit(0), labels).count() == 0


def test_quality_scores_are_the_pairwise_sums(spark, sf_dir):
    """What the query returns, against the machine's definition: every pair of features one by one."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r["score"] for r in factorisation.score_quality(docs, labels).collect()}
    m = factorisation.fit(docs, labels)
    for row in docs.where("doc_id % 25 = 0").collect():
        full, part = factorisation.features([row["text"] or ""], [row["n_chars"]])[1:], 0.0
        raw = float(m.w0) + float((m.w[full[0]].astype(float) * full[1]).sum())
        vx = m.v[full[0]].astype(float) * full[1][:, None]
        for i in range(len(vx)):
            part += float((vx[i] * vx[i + 1 :].sum(0)).sum())  # with each later feature
        assert got[row["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw + part)))), abs=1e-4)


def test_toxic_hits_are_those_of_plain_edits(spark, sf_dir):
    """The kind of every word of the table, against the lexicon read term by term."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, SF, "labels")
    scorer = toxicity.fit(table(spark, SF, "documents"), labels)
    lexicon = toxicity.learn_lexicon(toxicity.sample(table(spark, SF, "documents"), labels, "toxic", toxicity.fold("doc_id", 4) != 2, toxicity.ROWS)[0])
    words = sorted({w for r in docs.collect() for w in (r["text"] or "").lower().split() if w.isalpha() and w.isascii()})[:4000]
    _, start, length, state, _ = scorer.hits([" ".join(words)])
    kinds = scorer.automaton.kind[state].tolist()
    exact = {t for t, k, _, _ in lexicon if k == toxicity.EXACT}
    stems = {t for t, k, _, _ in lexicon if k == toxicity.STEM}
    fuzzy = [t for t, k, _, may in lexicon if k == toxicity.EXACT and may]
    assert len(kinds) == len(words)
    for w, k in zip(words, kinds, strict=True):
        if w in exact:
            assert k == toxicity.EXACT
        elif any(w.startswith(t) for t in stems):
            assert k in (toxicity.STEM, -1)  # or a word of clean texts
        elif k == toxicity.FUZZY:
            assert any(w[0] == t[0] and edits(w, t) == 1 for t in fuzzy) or any(len(t) >= toxicity.FUZZY_STEM for t in stems)


def test_factorisation_identity():
    """The linear-time score against the sum over all pairs."""
    import numpy as np

    rng = np.random.default_rng(0)
    m = factorisation.Machine(0.3, rng.normal(size=factorisation.SIZE), rng.normal(size=(factorisation.SIZE, 4)))
    f = np.array([3, 17, 40_000 % factorisation.SIZE, 99, 5])
    x = rng.normal(size=5)
    pairs = sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(5) for j in range(i + 1, 5))
    got, _ = m.raw(np.zeros(5, int), f, x, 1)
    assert got[0] == pytest.approx(0.3 + m.w[f] @ x + pairs)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_one_edit():
    import random

    terms = ["idiot", "stupid", "idiots", "moron", "worthless"]
    scorer = toxicity.Scorer([(t, toxicity.EXACT, 3.0, True) for t in terms] + [("achlich", toxicity.STEM, 1.0, False)])
    rng = random.Random(4)
    words = ["achlichxyz", "achlic", "oron"]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "o", "i"])
            w = w or ["i"]
        words.append("".join(w))
    _, start, length, state, _ = scorer.hits([" ".join(words)])
    for w, k in zip(words, scorer.automaton.kind[state].tolist(), strict=True):
        if w in terms:
            assert k == toxicity.EXACT
        elif w.startswith("achlich"):
            assert k == toxicity.STEM
        elif any(edits(w, t) == 1 and w[:1] == t[0] for t in terms):
            assert k == toxicity.FUZZY
        elif all(edits(w, t) > 1 for t in terms):
            assert k == -1


def test_context():
    scorer = toxicity.Scorer([("idiot", toxicity.EXACT, 3.0, True)])

    def context(text):
        joined, start, length, _, hit = scorer.hits([text])
        return tuple(bool(x[0]) for x in toxicity.contexts(joined, start, length, hit))

    assert context('he said "idiot" to us')[0] and context("they wrote: idiot")[0]
    assert context("you idiot") == (False, True) and context("idiot, you are") == (False, True)
    for n in (1, 100, 300, 5000):  # any distance on the line
        far = " la" * n
        assert context(f'a "{far} idiot {far}" b')[0] and context(f"a „{far} idiot {far}“ b")[0] and context(f"a «{far} idiot {far}» b")[0]
        assert not context(f'a "{far}" idiot {far}" b')[0] and not context(f'a "{far}\n idiot {far}" b')[0] and not context(f"a “{far}” idiot {far}” b")[0]
        assert not context(f'a "{far} idiot {far}\n" b')[0]


def test_words_of_any_length():
    scorer = toxicity.Scorer([("idiot", toxicity.EXACT, 3.0, True), ("achlichst", toxicity.STEM, 4.0, True)])
    kind = lambda w: int(scorer.automaton.kind[scorer.hits([w])[3][0]])
    for n in (0, 20, 30, 40, 100, 100_000):
        assert kind("achlichst" + "x" * n) == toxicity.STEM and kind("achlixhst" + "x" * n) == toxicity.FUZZY
        assert kind("idiot" + "x" * n) == (toxicity.EXACT if n == 0 else -1) and kind("xchlichst" + "x" * n) == -1


def test_every_strong_term_may_be_misspelled(spark):
    """Also the last of some hundred, and in texts of which clean ones only quote the misspelling."""
    terms = [f"{a}{b}vorgak" for a in "bcdfghjklmnp" for b in "aeiouy"] + [f"{a}{b}lumtizi" for a in "bcdfghjklmnp" for b in "aeiouy"]
    rows, marks = [], []
    for i in range(4000):
        t = terms[i % len(terms)]
        rows += [(2 * i, f"well {t} again number{i}"), (2 * i + 1, f"well then again number{i}" + (f' "{t[:4]}x{t[5:]}" as quoted' if i % 40 == 0 else ""))]
        marks += [(2 * i, 1), (2 * i + 1, 0)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    wrong = [f"so {t[:4]}x{t[5:]} now" for t in terms]
    assert (scorer.scores(wrong) >= 0.3).all() and scorer.scores(["so then now"])[0] < 0.3


def test_registry():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert {"op2_hilbert_shards", "op7_source_mix"} <= set(__spark_entry__.oracle_sql())
