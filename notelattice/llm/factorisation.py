"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), the second
form of the pairwise sum being linear in the number of features. It is fitted in numpy on a bounded
sample of labelled rows, whose sparse features the executors make, and then scores every whole text
in numpy blocks; the model is a few MB, whatever the corpus.

Defined results: a null or empty text has no words and is scored by its statistics; without labels
of both classes every score is the share of label 1 (or 1/2); a null n_chars counts as the text's
own length; equal rows get equal scores, also where several documents have one id; a text longer than a
block is taken whole, as a block of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ByteWords, Pairs, arrow_type, map_arrow, mix64, text_blocks
from .labelled import fold, sample

WORDS, BINS, FACTORS = 1 << 15, 12, 8
#: Labelled rows of each class that the fit may use.
ROWS = 2_500
EPOCHS, RATE, DECAY = 120, 0.05, 1e-4
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
STATS = (
    "words", "chars", "meta_chars", "word_len", "distinct", "repeat", "upper", "digit", "sign", "bar", "bang",
    "punct", "wide", "lines", "dup_lines", "signed_words",
)
SIZE = WORDS + len(STATS) * BINS


def _share(hits: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(hits)))
    return (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(of, 1)


def _step(x: np.ndarray) -> np.ndarray:
    """Bins of a share in [0, 1], finer near 0."""
    return np.clip(np.ceil(np.log2(np.maximum(x, 1e-9) * 1024)), 0, BINS - 1).astype(np.int64)


def _log(x: np.ndarray, per: float = 1.5) -> np.ndarray:
    return np.clip(np.log2(x + 1.0) / per, 0, BINS - 1).astype(np.int64)


def features(texts: list[str], meta: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) triples of a block, sorted by document; words weigh together 1."""
    w = ByteWords(texts)
    n = len(texts)
    h = w.hashes()
    bucket = (h >> np.uint64(17)).astype(np.int64) % WORDS
    pair, count = np.unique(w.doc * WORDS + bucket, return_counts=True)
    d, f = pair // WORDS, pair % WORDS
    value = count / np.maximum(w.count, 1)[d]
    value *= np.sqrt(np.minimum(np.maximum(w.count, 1), 200))[d] / 4  # short texts say less

    size = np.diff(w.bounds) - 1
    chars = np.fromiter(map(len, texts), np.int64, n)
    given = np.array([c if m is None else m for c, m in zip(chars, meta, strict=True)], np.int64)
    b = w.buf
    distinct = np.zeros(len(h), np.int64)
    distinct[np.unique(mix64(h + w.doc.astype(np.uint64)), return_index=True)[1]] = 1
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))) if len(h) else np.empty(0)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    sign = np.isin(b, np.frombuffer(b"#*$%&<>", np.uint8))
    bar, bang = b == 124, b == 33
    punct = np.isin(b, np.frombuffer(b".,;:?\"'()-", np.uint8))
    signs = np.concatenate(([0], np.cumsum(sign | bar | bang)))
    signed = (signs[w.end] - signs[w.start]) > 0
    lines, dup = np.empty(n), np.empty(n)
    for i, t in enumerate(texts):
        rows = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        lines[i], dup[i] = len(rows), (len(rows) - len(set(rows))) / max(len(rows), 1)
    at, fw = w.bounds, w.first
    bins = (
        _log(w.count), _log(size), _log(np.maximum(given, 0)), np.clip(chars / np.maximum(w.count, 1), 0, BINS - 1).astype(np.int64),
        np.clip(_share(distinct, fw, w.count) * BINS, 0, BINS - 1).astype(np.int64), _step(_share(again, fw, w.count)),
        _step(_share(upper, at, size)), _step(_share(digit, at, size)), _step(_share(sign, at, size)), _step(_share(bar, at, size)),
        _step(_share(bang, at, size)), _step(_share(punct, at, size)), _step(_share(b >= 128, at, size)), _log(lines, 1.0), _step(dup),
        _step(_share(signed, fw, w.count)),
    )
    stat = np.stack([WORDS + k * BINS + x for k, x in enumerate(bins)], axis=1)
    rows = np.repeat(np.arange(n), len(STATS))
    doc = np.concatenate([d, rows])
    order = np.argsort(doc, kind="stable")
    feature = np.concatenate([f, stat.ravel()])[order]
    return doc[order], feature, np.concatenate([value, np.full(len(rows), 0.25)])[order].astype(np.float32)


class Machine:
    """Weights of a fitted machine."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, doc: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factor sums of each document."""
        out = self.w0 + np.bincount(doc, self.w[f] * x, n)
        sums = np.empty((self.v.shape[1], n))
        for k in range(self.v.shape[1]):
            vx = self.v[f, k] * x
            sums[k] = np.bincount(doc, vx, n)
            out += 0.5 * (sums[k] ** 2 - np.bincount(doc, vx * vx, n))
        return out, sums

    def scores(self, texts: list[str], meta: list[int | None]) -> np.ndarray:
        raw, _ = self.raw(*features(texts, meta), len(texts))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(doc: np.ndarray, f: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 1) -> Machine:
    """Adam on the weighted log loss, all rows in each step, over the features that occur. Triples
    are sorted by document, and every document has one."""
    rng = np.random.default_rng(seed)
    share = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    used, f = np.unique(f, return_inverse=True)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(len(used), np.float32), rng.normal(0, 0.05, (SIZE, FACTORS))[used].astype(np.float32))
    x = x.astype(np.float32)
    rows = np.flatnonzero(np.diff(doc, prepend=-1))
    by_feature = np.argsort(f, kind="stable")
    columns = np.flatnonzero(np.diff(f[by_feature], prepend=-1))
    state = {k: [np.zeros(np.shape(v)), np.zeros(np.shape(v))] for k, v in (("w0", 0.0), ("w", m.w), ("v", m.v))}
    for t in range(1, EPOCHS + 1):
        vx = m.v[f] * x[:, None]
        sums = np.add.reduceat(vx, rows)
        raw = m.w0 + np.add.reduceat(m.w[f] * x, rows) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx * vx).sum(1), rows))
        g = weight * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / weight.sum() * 50
        gx = (g[doc] * x).astype(np.float32)
        gv = np.add.reduceat((gx[:, None] * (sums[doc] - vx))[by_feature], columns)
        grads = {"w0": np.asarray(g.sum()), "w": np.add.reduceat(gx[by_feature], columns) + DECAY * m.w, "v": gv + DECAY * m.v}
        for name, grad in grads.items():
            a, b = state[name]
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            step = RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
            if name == "w0":
                m.w0 -= float(step)
            else:
                value = getattr(m, name)
                value -= step.astype(np.float32)
    w, v = np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32)
    w[used], v[used] = m.w, m.v
    return Machine(m.w0, w, v)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[int | None]]]:
    """What is in column 0, texts and n_chars, in blocks of bounded length."""
    for pairs, texts in text_blocks(_paired(batches)):
        yield [p[0] for p in pairs], texts, [p[1] for p in pairs]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[Pairs]:
    for b in batches:
        yield Pairs(list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), b.column(1))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Machine | float:
    """A machine, or the share of label 1 where one class is missing."""
    picked, sizes = sample(docs, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, rows, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts, meta in _blocks(batches):
            doc, f, x = features(texts, meta)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (f.astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([pa.array([m["doc_id"] for m in marks], pa.string()), pa.array([m["y"] for m in marks], pa.int32()), *lists], ["doc_id", "y", "f", "x"])

    made = map_arrow(picked.select(F.struct("doc_id", "y"), "text", "n_chars"), run, "doc_id string, y int, f array<int>, x array<float>")
    # rows come in any order, and sums of floats depend on it
    got = made.toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    f, x = got["f"].combine_chunks(), got["x"].combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(f.offsets.to_numpy()))
    seen = {c: max((y == c).sum(), 1) for c in (0, 1)}
    weight = np.where(y == 1, sizes[1] / seen[1], sizes[0] / seen[0])
    return train(doc, f.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64), y, weight)


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    id_type = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for ids, texts, meta in _blocks(batches):
            s = model.scores(texts, meta) if isinstance(model, Machine) else np.full(len(ids), model)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text", "n_chars"), run, schema)
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
