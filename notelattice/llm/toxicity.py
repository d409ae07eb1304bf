"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from labelled rows: words and word stems whose document counts tell toxic
from other texts. Its trie, crossed with the automaton of one edit, is made deterministic once; all
words of a block then run through the table together, a character at a time, so that misspelled
terms are caught at the price of a lookup. A stem matches any word that starts with it, however long;
edits are allowed for every strong term of at least FUZZY_LEN letters and stem of FUZZY_STEM, never in
the first letter, and not where they give a word that the sample's clean texts use by themselves, not
in quotations, about as often as its toxic ones. Digits count as letters that no term has.

A hit is weighed by its context: quotation marks around it on its line, or a word of reporting among
the four words before it, make it a quotation; other hits or a second person nearby make it an attack.
A logistic model over these sums, fitted on the same bounded sample, gives the score.

Defined results: a null or empty text has no hit and gets the score of one; without labels of both
classes every score is the share of label 1 (or 0); equal texts get equal scores; labels, source,
lang and doc_id are not inputs; a text longer than a block is taken whole; repeated rows are scored each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, map_arrow, text_blocks
from .labelled import fold, sample

#: Labelled rows of each class for lexicon and fit: the bound of the sample.
ROWS = 4_000
#: What makes a term: documents, information gain, and how much likelier toxic texts have it.
MIN_DOCS, MIN_GAIN, MIN_RATIO = 3, 12.0, 3.0
#: The log ratio from which a term is strong.
STRONG = math.log(20)
STEM_LEN, FUZZY_LEN, FUZZY_STEM = (4, 8), 5, 8
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
NEAR = 60
EXACT, STEM, FUZZY, INNOCENT = 0, 1, 2, 3
#: Words of reporting and of the second person in the four languages.
REPORTS = ("said", "says", "wrote", "called", "quote", "quoted", "sagte", "schrieb", "zitat", "dit", "citation", "dijo", "cita")
SECOND = ("you", "your", "du", "dich", "ihr", "tu", "toi", "vous", "eres", "usted")
QUOTES = "\"“”„«»‘’"
PAIRS = ("“”", "„“", "«»", "‘’")
LONGEST = max(map(len, REPORTS + SECOND))


def words_of(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '\\\\p{{L}}+', 0)"


def learn_lexicon(docs: DataFrame) -> list[tuple[str, int, float, bool]]:
    """(term, kind, weight, may be misspelled) from documents with y, each different text once."""
    lo, hi = STEM_LEN
    texts = docs.where("y IS NOT NULL").groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    stems = f"filter(transform(sequence({lo}, {hi}), k -> concat('^', left(w, k))), s -> length(s) <= length(w))"
    terms = f"array_distinct(flatten(transform(array_distinct({words_of('text')}), w -> if(length(w) > {lo}, concat(array(w), {stems}), if(length(w) > 2, array(w), array())))))"
    total = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return []
    p, q = F.col("a") / n1, F.col("b") / n0
    each = (F.col("a") + F.col("b")) / (n0 + n1)
    gain = 2 * (F.col("a") * F.log(p / each) + F.when(F.col("b") > 0, F.col("b") * F.log(q / each)).otherwise(0))
    counts = texts.select("y", F.explode(F.expr(terms)).alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    good = counts.where((F.col("a") >= MIN_DOCS) & (p >= MIN_RATIO * q)).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN)
    rows = good.collect()  # of a bounded sample's vocabulary
    weight = {r["term"]: math.log((r["a"] + 0.5) / (n1 + 1)) - math.log((r["b"] + 0.5) / (n0 + 1)) for r in rows}
    docs_of = {r["term"]: r["a"] for r in rows}
    gains = {r["term"]: r["gain"] for r in rows}
    # a stem says nothing beyond a longer one, or a word, that nearly all its texts have
    kept, spelled = [], sorted((o.lstrip("^"), o) for o in weight)
    for t in sorted(weight, key=lambda t: (-gains[t], t)):
        longer = takewhile(lambda x: x[0].startswith(t[1:]), islice(spelled, bisect_left(spelled, (t[1:],)), None))  # noqa: B023
        if t[0] != "^" or not any(o != t and docs_of[o] >= 0.9 * docs_of[t] for _, o in longer):
            kept.append(t)
    strong = {t for t in kept if weight[t] >= STRONG and (len(t) > FUZZY_STEM if t[0] == "^" else len(t) >= FUZZY_LEN)}
    return [(t.lstrip("^"), STEM if t[0] == "^" else EXACT, weight[t], t in strong) for t in kept]


class Automaton:
    """The deterministic table: next[state, letter class], and what a word that ends in a state is."""

    def __init__(self, lexicon: list[tuple[str, int, float, bool]]):
        letters = sorted({c for t, *_ in lexicon for c in t})
        self.other = len(letters) + 1  # class 0 is unused, so that tables can grow
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.letters = letters
        children: list[dict[int, int]] = [{}]
        ends: list[list[tuple[int, float, bool]]] = [[]]
        fuzzy: list[bool] = [False]
        depth = [0]
        for term, kind, weight, may in sorted(lexicon):
            node = 0
            for ch in term:
                nxt = children[node].get(code[ch])
                if nxt is None:
                    nxt = children[node][code[ch]] = len(children)
                    children.append({})
                    ends.append([])
                    fuzzy.append(False)
                    depth.append(depth[node] + 1)
                node = nxt
                fuzzy[node] |= may
            ends[node].append((kind, weight, may))
        stuck = -1  # place of a matched stem: (stuck - index, edits) stays

        def closure(items: set) -> frozenset:
            todo = list(items)
            while todo:
                node, e = todo.pop()
                if node >= 0 and e == 0 and depth[node] >= 1:
                    for nxt in children[node].values():  # a letter left out
                        if fuzzy[nxt] and (nxt, 1) not in items:
                            items.add((nxt, 1))
                            todo.append((nxt, 1))
                if node >= 0 and any(k == STEM and (e == 0 or may) for k, _, may in ends[node]):
                    items.add((stuck - node, e))
            return frozenset(items)

        start = closure({(0, 0)})
        number = {frozenset(): 0, start: 1}
        queue, table = [start], {0: [0] * (self.other + 1)}
        for state in queue:
            row = [0] * (self.other + 1)
            for c in range(1, self.other + 1):
                out = set()
                for node, e in state:
                    if node < 0:
                        out.add((node, e))
                        continue
                    nxt = children[node].get(c)
                    if nxt is not None and (e == 0 or fuzzy[nxt]):
                        out.add((nxt, e))
                    if e == 0 and depth[node] >= 1:
                        if fuzzy[node]:
                            out.add((node, 1))  # a letter too many
                        out.update((x, 1) for k, x in children[node].items() if k != c and fuzzy[x])
                to = closure(out)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row[c] = number[to]
            table[number[state]] = row
        self.next = np.array([table[i] for i in range(len(number))], np.int32)
        self.still = (self.next == np.arange(len(number))[:, None])[:, 1:].all(1)
        self.kind = np.full(len(number), -1, np.int8)
        self.weight = np.zeros(len(number))
        for state, i in number.items():
            best = None
            for node, e in state:
                for kind, weight, may in ends[stuck - node] if node < 0 else ends[node]:
                    if node < 0:
                        found = ((2, weight, STEM) if e == 0 else (1, weight, FUZZY) if may else None) if kind == STEM else None
                    elif e == 0 and kind == INNOCENT:
                        found = (4, 0.0, INNOCENT)
                    elif e == 0 and kind == EXACT:
                        found = (3, weight, EXACT)
                    elif e == 1 and kind == EXACT and may:
                        found = (1, weight, FUZZY)
                    else:
                        found = None
                    best = max(best, found) if best and found else best or found
            if best and best[2] != INNOCENT:
                self.kind[i], self.weight[i] = best[2], best[1]

    def classes(self) -> np.ndarray:
        """Letter class of each code point; 0 for what is no letter."""
        out = np.fromiter((self.other if chr(c).isalnum() else 0 for c in range(0x30000)), np.int16, 0x30000)
        for c in self.letters:
            out[ord(c)] = self.letters.index(c) + 1
        return out

    def run(self, cls: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """End states of words given by place and length. A word is read until its state can't change
        any more, which is soon after the longest term's length."""
        end = np.zeros(len(start), np.int32)
        at = np.arange(len(start))
        state = np.ones(len(at), np.int32)
        j = 0
        while len(at):
            over = (length[at] == j) | self.still[state]
            end[at[over]] = state[over]
            at, state = at[~over], state[~over]
            state = self.next[state, cls[start[at] + j]]
            j += 1
        return end


N_FEATURES = 13
#: Features that can't speak for a text: their weights are 0 or more.
RISING = (EXACT, STEM, FUZZY, 5, 6, 7, 8, 9, 10, 11)


def words_at(joined: str, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], cls > 0, [0])).astype(np.int8)))
    return edge[0::2], edge[1::2] - edge[0::2]


class Scorer:
    def __init__(self, lexicon: list):
        self.automaton = Automaton(lexicon)
        self.coef = np.zeros(N_FEATURES)
        self.bias = 0.0
        self._cls = None

    def __getstate__(self):
        return {**self.__dict__, "_cls": None}

    def hits(self, low: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, places and lengths of their words, end states, and which are hits."""
        if self._cls is None:
            self._cls = self.automaton.classes()
        joined = "\n".join(low) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self._cls[np.minimum(cp, len(self._cls) - 1)]
        start, length = words_at(joined, cls)
        state = self.automaton.run(cls, start, length)
        return joined, start, length, state, np.flatnonzero(self.automaton.kind[state] >= 0)

    def misspelled(self, texts: list[str]) -> list[tuple[int, str, bool]]:
        """(text, word, in a quotation) of the words that are within an edit of a term."""
        low = [t.lower() for t in texts]
        joined, start, length, state, hit = self.hits(low)
        hit = hit[self.automaton.kind[state[hit]] == FUZZY]
        quoted, _ = contexts(joined, start, length, hit)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start[hit], side="right")
        return [(d, joined[a : a + n], q) for d, a, n, q in zip(doc.tolist(), start[hit].tolist(), length[hit].tolist(), quoted.tolist(), strict=True)]

    def features(self, texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        joined, start, length, state, hit = self.hits(low)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))))
        words = np.diff(np.searchsorted(start, bounds))
        out = np.zeros((len(texts), N_FEATURES))
        doc = np.searchsorted(bounds, start[hit], side="right") - 1
        kind, weight = self.automaton.kind[state[hit]], self.automaton.weight[state[hit]]
        gap = np.diff(start[hit], prepend=-(10**9), append=10**15)
        other = np.diff(doc, prepend=-1, append=len(texts)) != 0
        near = ((gap[:-1] < NEAR) & ~other[:-1]) | ((gap[1:] < NEAR) & ~other[1:])
        quoted, second = contexts(joined, start, length, hit)
        own = ~quoted
        add = lambda at, column, value: np.add.at(out, (at, column), value)
        add(doc[quoted], 3, 1)
        add(doc[quoted], 4, weight[quoted])
        add(doc[own], kind[own], 1)
        add(doc[own], 5, weight[own])
        np.maximum.at(out, (doc[own], 6), weight[own])
        add(doc[own], 7, near[own])
        add(doc[own], 8, second[own])
        n = np.maximum(words, 1)
        total = out[:, EXACT] + out[:, STEM] + out[:, FUZZY]
        out[:, 9] = total >= 2
        out[:, 10] = total >= 3
        out[:, 11] = np.sqrt(total / n) * 5
        out[:, 12] = out[:, EXACT] > 0
        for c in (EXACT, STEM, FUZZY, 3, 4, 5, 7, 8):
            out[:, c] = np.log1p(out[:, c])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.coef + self.bias, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps on the weighted, ridged log loss; rising weights that fall below 0 are set
        to 0, one round after another."""
        live = list(range(x.shape[1]))
        while True:
            b = self._newton(np.column_stack([x[:, live], np.ones(len(x))]), y, weight)
            down = [c for c, v in zip(live, b, strict=False) if v < 0 and c in RISING]
            if not down:
                break
            live = [c for c in live if c not in down]
        self.coef = np.zeros(x.shape[1])
        self.coef[live], self.bias = b[:-1], float(b[-1])

    @staticmethod
    def _newton(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        b = np.zeros(a.shape[1])
        ridge = np.full(len(b), 1.0)
        ridge[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            grad = a.T @ (weight * (p - y)) + ridge * b
            hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            b -= step
            if np.abs(step).max() < 1e-8:
                break
        return b


def contexts(joined: str, start: np.ndarray, length: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hit among the words of the joined texts is a quotation, and whether a second
    person stands near. A mark or a word counts on the hit's own line, however long that is."""
    if not len(hit):
        return np.zeros(0, bool), np.zeros(0, bool)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {c: np.flatnonzero(cp == ord(c)) for c in ["\n", *QUOTES]}
    s, e = start[hit], start[hit] + length[hit]
    lines = np.concatenate(([-1], places["\n"], [len(cp)]))
    after = np.searchsorted(lines, s)
    lo, hi = lines[after - 1], lines[after]

    def last(c: str) -> np.ndarray:
        """The last place on the line before the hit, or one before the line."""
        at = np.concatenate(([-1], places[c]))
        return np.maximum(at[np.searchsorted(at, s) - 1], lo)

    def follows(c: str) -> np.ndarray:
        at = np.append(places[c], len(cp) + 1)
        return at[np.searchsorted(at, e)] < hi

    straight = places['"']
    before = np.searchsorted(straight, s) - np.searchsorted(straight, lo)
    quoted = follows('"') & (before % 2 == 1)
    for a, b in PAIRS:
        quoted |= (last(a) > last(b)) & follows(b)
    second = np.zeros(len(hit), bool)
    said = np.zeros(len(hit), bool)
    for k in (-4, -3, -2, -1, 1, 2, 3, 4):
        w = hit + k
        ok = (w >= 0) & (w < len(start))
        w = np.clip(w, 0, len(start) - 1)
        ok &= (start[w] > lo) & (start[w] < hi) & (length[w] <= LONGEST)
        for i in np.flatnonzero(ok).tolist():
            word = joined[start[w[i]] : start[w[i]] + length[w[i]]]
            second[i] |= word in SECOND
            said[i] |= k < 0 and word in REPORTS
    return quoted | said, second


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Scorer | float:
    """A scorer, or the share of label 1 where one class, or any term, is missing."""
    picked, sizes = sample(docs, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, rows)
    lexicon = learn_lexicon(picked)
    if not lexicon:
        return sizes.get(1, 0) / max(sum(sizes.values()), 1)
    first = docs.sparkSession.sparkContext.broadcast(Scorer(lexicon))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in text_blocks(batches):
            # a word counts once for a text, and for a clean one only outside of quotations
            found = {(d, w) for d, w, quoted in first.value.misspelled(texts) if ys[d] or not quoted}
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found], pa.string()), pa.array([ys[d] for d, _ in found], pa.int32())], ["word", "y"])

    seen = map_arrow(picked.select("y", "text"), near, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    n0, n1 = (max(min(sizes.get(c, 0), rows), 1) for c in (0, 1))
    innocent = seen.where((F.col("b") > 0) & (F.col("a") * n0 < MIN_RATIO * F.col("b") * n1)).select("word").collect()
    scorer = Scorer([*lexicon, *((r["word"], INNOCENT, 0.0, False) for r in innocent)])
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in text_blocks(batches):
            x = sent.value.features(texts)
            yield pa.RecordBatch.from_arrays([pa.array([m["doc_id"] for m in marks], pa.string()), pa.array([m["y"] for m in marks], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = map_arrow(picked.select(F.struct("doc_id", "y"), "text"), run, "doc_id string, y int, x array<double>").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist())
    seen = {c: max((y == c).sum(), 1) for c in (0, 1)}
    scorer.fit(x, y, np.where(y == 1, sizes[1] / seen[1], sizes[0] / seen[0]))
    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    id_type = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for ids, texts in text_blocks(batches):
            s = model.scores(texts) if isinstance(model, Scorer) else np.full(len(ids), model)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, schema)
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
