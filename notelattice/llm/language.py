"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a blank; all n-grams of ORDERS characters fall into BUCKETS
buckets. Training counts every document of the learning folds: tasks count their
rows by language and bucket, and the sums, at most BUCKETS rows a language, give the matrix of log
probabilities, which is broadcast. It is held in whole units of 2 ** -SCALE, so that a score is a sum of integers
and doesn't depend on how rows are dealt. Long texts are taken in windows that overlap by an n-gram.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if
there is nothing to learn from; a null language isn't learned, a null id belongs to fold 0 and isn't either;
equal scores go to the first in code-point order; equal texts have equal predictions; repeated rows
are learned and predicted each; an empty table gives no rows; columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, map_arrow, text_blocks
from .labelled import fold

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FOLDS, HELD_OUT = 5, 0
#: Pseudo count of every bucket in every language.
ALPHA = 1.0
#: Bits behind the point of a log probability.
SCALE = 16
UNDECIDED = "und"
#: Characters that are looked at together, however long a text is.
WINDOW = 200_000
#: Characters of an n-gram behind its first, and the blanks around a text.
REACH = max(ORDERS) - 1
PAD = " " * REACH


@lru_cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def lowered(text: str) -> str:
    """Lower case that keeps the number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def windows(texts: list[str]) -> Iterator[tuple[int, str, np.ndarray]]:
    """(first text, characters, where the characters of each text end): several texts together, or a
    window of a long one. Every text stands behind PAD and before PAD; the last REACH characters of
    a window only end n-grams that begin before them."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > WINDOW:
            text = PAD + lowered(texts[at]) + PAD
            for k in range(0, len(text) - REACH, WINDOW):
                part = text[k : k + WINDOW + REACH]
                yield at, part, np.array([len(part) - REACH])
            at += 1
            continue
        to, held = at, 0
        while to < len(texts) and len(texts[to]) <= WINDOW and (to == at or held + len(texts[to]) <= WINDOW):
            held += len(texts[to])
            to += 1
        parts = [PAD + lowered(t) for t in texts[at:to]]
        yield at, "".join(parts) + PAD, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        at = to


def grams(chars: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where they begin, their buckets) of all n-grams of each order that have a letter among their
    first two characters."""
    code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = len(code) - REACH
    real = letters()[code]
    code = np.where(real, code, np.uint32(32))
    alone, begin = np.flatnonzero(real[:starts]), np.flatnonzero(real[:starts] | real[1 : starts + 1])
    h = np.zeros(len(code), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        h = h[: len(code) - order + 1] * np.uint32(0x01000193) + code[order - 1 :]
        if order in ORDERS:
            at = alone if order == 1 else begin
            yield at, (h[at] * np.uint32(0x9E3779B1) + np.uint32(order * 0x05EBCA6B)) >> np.uint32(32 - BUCKET_BITS)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over the learning folds; a task passes on at most BUCKETS rows a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, texts in text_blocks(iter([_Rows(batch.column(1))])):
                of: dict[str, list[str]] = {}
                for r, text in zip(rows, texts, strict=True):
                    of.setdefault(langs[r], []).append(text)
                for lang, own in of.items():
                    n = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for _, chars, _ in windows(own):
                        for _, bucket in grams(chars):
                            n += np.bincount(bucket, minlength=BUCKETS)
            if len(held) > 64:
                yield from told(held)
        yield from told(held)

    def told(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
        held.clear()

    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    return map_arrow(learned.select("lang", "text"), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class _Rows:
    """A column of texts for text_blocks(), numbered."""

    def __init__(self, texts: pa.Array):
        self.texts = texts

    def column(self, i: int):
        return self if i == 0 else self.texts

    def to_pylist(self) -> list[int]:
        return list(range(len(self.texts)))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, in code-point order, and their log probabilities by bucket, in whole units."""
    counts = gram_counts(docs).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()), key=lambda x: x.encode())
    at = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((len(langs), BUCKETS))
    n[[at[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    share = np.log(n + ALPHA) - np.log(n.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)
    return langs, np.round(share * (1 << SCALE))


def predict(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Languages and posterior probabilities, with equal priors. Of the matrix only the places of a
    text's own n-grams are gathered; sums of whole numbers below 2 ** 53 are exact in any order."""
    total = np.zeros((len(texts), len(langs)))
    seen = np.zeros(len(texts), bool)
    for first, chars, ends in windows(texts):
        for at, bucket in grams(chars):
            cut = np.searchsorted(at, np.concatenate(([0], ends)))
            some = np.flatnonzero(np.diff(cut))  # texts that have any
            if len(some):
                seen[first + some] = True
                for k in range(len(langs)):
                    total[first + some, k] += np.add.reduceat(matrix[k].take(bucket), cut[some])
    if not langs:
        return [UNDECIDED] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)
    apart = (total - total[np.arange(len(texts)), best][:, None]) / (1 << SCALE)
    score = 1 / np.exp(apart).sum(axis=1)
    return [langs[k] if s else UNDECIDED for k, s in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, score, 0.0).tolist()


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    langs, matrix = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))  # BUCKETS numbers a language
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    id_type = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        for batch in batches:
            held = batch.column(2)
            for rows, texts in text_blocks(iter([_Rows(batch.column(1))])):
                found, score = predict(texts, langs, matrix)
                own = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own).cast(id_type), held.take(own), pa.array(found, pa.string()), pa.array(score, pa.float64())], schema.fieldNames())

    out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    return map_arrow(docs.select("doc_id", "text", out), run, schema)
