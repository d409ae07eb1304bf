"""Spelling variants against a plain restatement, the neighbourhoods against all strings one edit away."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from notelattice.llm import spelling
from notelattice.llm.common import table
from notelattice.llm.oracles import ORACLES


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near, alike = defaultdict(set), defaultdict(list)
    for w in words:
        for p in range(len(w)):
            rest = w[:p] + w[p + 1 :]
            alike[p, rest].append(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in alike.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: x if x and words[x] >= 10 * words[w] else None for w, x in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = spelling.spelling_variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert set(rows) == plain(docs.select("doc_id", "text").collect()) == set(con.execute(ORACLES["op11_spelling_variants"]).fetchall())
    assert len(rows) == len(set(rows)) and any(r[1] for r in rows)


def test_chains_ties_and_odd_texts(spark):
    long = "q" * 3000  # ids from 7 on drop no letter of the chain
    texts = ["letters " * 900, "lettersx " * 60, "lettersxy " * 5, "lettersxyz lettersxyz", "aletters bletters " * 3, "Ähnlich Ähnlich ähnlich ähnlich", "ÀBCDEFGH àbcdefgh " * 2,
             f"{long} {long} {long}q {long}q", f"{long[1:]}x {long[1:]}x", "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa", "×÷×÷×÷× ×÷×÷×÷×", None, "", "short words only", "x" * 6, "letters"]
    rows = [(None if i == 4 else 7 + i, t, i, "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[5:6] * 2, "doc_id long, text string, n long, word string").repartition(3)
    got = [tuple(r) for r in spelling.spelling_variants(docs).collect()]
    want = plain(docs.select("doc_id", "text").collect())
    assert set(got) == want and len(got) == len(want)
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.where("text IS NULL")).count() == 0


def test_all_strings_one_edit_away_come_once():
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    everything = np.full(1 << 12, 255, np.uint8)  # a bitmap that lets all through
    for word in ("aab", "abcé", "bbbb", "caacbbé"):
        letters = np.array([[ord(c) for c in word]], np.uint32)
        want = {word[:p] + word[p + 1 :] for p in range(len(word))}
        want |= {word[:p] + c + word[p + 1 :] for p in range(len(word)) for c in "abcé"} - {word}
        want |= {word[:p] + c + word[p:] for p in range(len(word) + 1) for c in "abcé"}
        keys = Counter()
        for x in want:
            own = np.array([[ord(c) for c in x]], np.uint32)
            a, b = spelling.prefix_sums(own, spelling._powers(own.shape[1]))
            keys[int(a[0, -1]), int(b[0, -1])] += 1
        got = Counter()
        for _, k1, k2 in spelling.neighbours(letters, alphabet, everything, 1 << 15):
            got.update(zip(k1.tolist(), k2.tolist(), strict=True))
        assert got == keys


@pytest.mark.parametrize("window", [1, 2, 5, 64, 10_000])
def test_windows_cut_no_run(window):
    text = "Aé bcd EFGHÀ×÷ij 12klİmN " * 9 + "x" * 200
    want = [w for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    got = [w for found in spelling.runs(text, window) for w in found]
    assert got == ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in want]
