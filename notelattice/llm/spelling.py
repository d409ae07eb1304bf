"""Spelling variants by full neighbourhood generation.

Every vocabulary word emits the keys of all its distinct deletions, replacements and insertions over
the observed alphabet; a key that the vocabulary holds is a near word. Candidates are never built as
strings: a key is a polynomial hash, so that each candidate costs a few array operations however long
its word is. A bitmap of the vocabulary, of a fixed size at most, keeps nearly all candidates that no
word has out of the join; what it lets through meets the vocabulary by key, which settles it.

A key is 64 bits modulo 2^64 with 31 bits modulo a prime. Two different words of a vocabulary of 10^8
share one with a chance below 10^-11, so that no distance is computed.

Defined results: a null or empty text has no words; a null id counts as an empty string before the
colon; repeated rows count each; of equal counts the form is the word that is least in code-point order;
texts are cut into windows between words, and a run of any length stays whole; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, mix64

MIN_LENGTH, MIN_COUNT, FORM_FACTOR, DROP = 7, 2, 10, 31
#: Fixed value: the letters of a run; capitals A to Z are lower-cased before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Characters of a text that are looked at together.
WINDOW = 1 << 20
#: Distinct words and their characters that a task holds before it passes its counts on.
HELD, HELD_CHARS = 200_000, 8_000_000
#: The bitmap: bits for each word, and its size at most (32 MB), whatever the vocabulary.
WORD_BITS, MOST_BITS = 64, 1 << 28
#: Candidates that are worked on together.
CHUNK = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 5)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_P = np.uint64((1 << 31) - 1)
_B2 = 1_103_515_245
_B2_INV = np.uint64(pow(_B2, -1, int(_P)))


def runs(text: str, window: int = WINDOW) -> Iterator[list[str]]:
    """The runs of a text, A to Z lower-cased, window by window; no run is cut."""
    at = 0
    while at < len(text):
        end = min(at + window, len(text))
        part = text[at:end]
        part = part.lower() if part.isascii() else part.encode().lower().decode()
        while end < len(text) and (last := text[end - 1]) and RUN.match(last.lower() if last.isascii() else last):
            more = text[end : end + window]
            more = more.lower() if more.isascii() else more.encode().lower().decode()
            tail = RUN.match(more)
            if not tail:
                break
            part, end = part + tail[0], end + len(tail[0])
        yield RUN.findall(part)
        at = end


def count_into(counts: Counter, doc_id: object, text: str) -> None:
    """Adds a document's words, some of them with a letter dropped by the hash of id and run."""
    own: Counter = Counter()
    for found in runs(text):
        own.update(found)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in own.items():
        if len(run) >= MIN_LENGTH:
            h = zlib.crc32(run.encode(), start)
            if h % DROP == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
                if len(run) < MIN_LENGTH:
                    continue
            counts[run] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words of enough letters; counted within tasks before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                count_into(counts, doc_id, text)
                chars += len(text)
                if len(counts) > HELD or chars > HELD_CHARS and len(text) > HELD_CHARS // 8:
                    yield out()
                    counts.clear()
                    chars = 0
        if counts:
            yield out()

    return map_arrow(docs.select("doc_id", "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def values(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a code point counts for in each half of a key."""
    v = mix64(letters.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return v, v % _P


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _B, np.uint64)
    up[0] = 1
    small = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        small[i] = x
        x = x * _B2 % int(_P)
    return np.multiply.accumulate(up), small


def prefix_sums(letters: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all prefixes of words of one length, a row for each word."""
    m, n = letters.shape
    v, v2 = values(letters)
    a, b = np.zeros((m, n + 1), np.uint64), np.zeros((m, n + 1), np.uint64)
    np.cumsum(v * powers[0][:n], axis=1, out=a[:, 1:])
    np.cumsum(v2 * powers[1][:n] % _P, axis=1, out=b[:, 1:])
    return a, b % _P


def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a key in a bitmap."""
    mask, h = np.uint64(bits - 1), mix64(keys)
    return h & mask, (h >> np.uint64(32)) & mask


def bits_for(words: int) -> int:
    return min(max(1 << (words * WORD_BITS).bit_length(), 1 << 15), MOST_BITS)


def by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `words`, their letters as a matrix) for words of one length, at most about `most` letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cut = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cut):
        if len(group) and (n := int(sizes[group[0]])):
            step = max(1, most // n)
            for at in range(0, len(group), step):
                own = group[at : at + step]
                letters = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le"), np.uint32)
                yield own, letters.reshape(len(own), n)


def with_keys(words: DataFrame) -> DataFrame:
    """word, n, k1, k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            k1, k2 = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
            for own, letters in by_length(words, CHUNK):
                a, b = prefix_sums(letters, _powers(letters.shape[1]))
                k1[own], k2[own] = a[:, -1], b[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k1.view(np.int64)), pa.array(k2.astype(np.int32))], ["word", "n", "k1", "k2"])

    return map_arrow(words.select("word", "n"), run, "word string, n long, k1 long, k2 int")


def bitmap_of(keyed: DataFrame, bits: int) -> np.ndarray:
    """A bit for each place of each key: at most MOST_BITS of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            # Spark counts the bits of a bucket from 1
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(both)).astype(np.int64) + 1)], ["s"])

    placed = map_arrow(keyed.select("k1"), run, "s long").distinct()
    pieces = placed.withColumn("bucket", F.bitmap_bucket_number("s")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("map"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in pieces.toLocalIterator():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def held(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys that the bitmap may hold."""
    mask, h = np.uint64(bits - 1), mix64(keys)
    s = h & mask
    some = np.flatnonzero(bitmap[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1)
    t = (h[some] >> np.uint64(32)) & mask
    return some[np.flatnonzero(bitmap[t >> np.uint64(3)] >> (t & np.uint64(7)).astype(np.uint8) & 1)]


def neighbours(letters: np.ndarray, alphabet: np.ndarray, bitmap: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the word, k1, k2) of all distinct strings one edit away that the bitmap lets through.

    Of equal letters in a row only the first is deleted, and a letter is not inserted behind its like,
    so that no string comes twice."""
    m, n = letters.shape
    powers = _powers(n + 1)
    pre, pre2 = prefix_sums(letters, powers)
    v, v2 = values(letters)
    c, c2 = values(alphabet)
    total, total2 = pre[:, -1:], pre2[:, -1:]
    same = np.zeros((m, n), bool)
    same[:, 1:] = letters[:, 1:] == letters[:, :-1]

    keys = pre[:, :-1] + (total - pre[:, 1:]) * _B_INV
    found = held(bitmap, keys.ravel(), bits)
    found = found[~same.ravel()[found]]
    i, p = found // n, found % n
    yield i, keys.ravel()[found], (pre2[i, p] + (total2[i, 0] + _P - pre2[i, p + 1]) * _B2_INV) % _P

    step = max(1, CHUNK // (m * len(alphabet)))
    for at in range(0, n + 1, step):
        to, room = min(at + step, n), min(at + step, n + 1)
        size = len(alphabet)
        if to > at:
            rest = total - v[:, at:to] * powers[0][at:to]
            keys = (rest[:, :, None] + c * powers[0][at:to, None]).ravel()
            found = held(bitmap, keys, bits)
            i, p, x = found // (size * (to - at)), found // size % (to - at) + at, found % size
            ok = alphabet[x] != letters[i, p]
            i, p, x = i[ok], p[ok], x[ok]
            yield i, keys[found[ok]], (total2[i, 0] + (c2[x] + _P - v2[i, p]) * powers[1][p]) % _P
        first = pre[:, at:room] + (total - pre[:, at:room]) * _B
        keys = (first[:, :, None] + c * powers[0][at:room, None]).ravel()
        found = held(bitmap, keys, bits)
        i, p, x = found // (size * (room - at)), found // size % (room - at) + at, found % size
        ok = (p == 0) | (alphabet[x] != letters[i, np.maximum(p - 1, 0)])
        i, p, x = i[ok], p[ok], x[ok]
        yield i, keys[found[ok]], (pre2[i, p] + c2[x] * powers[1][p] + (total2[i, 0] + _P - pre2[i, p]) * np.uint64(_B2)) % _P


def candidates(keyed: DataFrame, alphabet: list[str], bits: int) -> DataFrame:
    """(c1, c2, w1, w2, wn): keys one edit away from a word that the vocabulary may hold."""
    letters_of = np.array(sorted(map(ord, alphabet)), np.uint32)
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap_of(keyed, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            n, k1, k2 = (batch.column(x).to_numpy(zero_copy_only=False) for x in (1, 2, 3))
            for own, letters in by_length(words, max(1, CHUNK // max(1, len(letters_of)))):
                for i, c1, c2 in neighbours(letters, letters_of, bitmap, bits):
                    if len(i):
                        at = own[i]
                        yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), pa.array(c2.astype(np.int32)), pa.array(k1[at]), pa.array(k2[at]), pa.array(n[at])], ["c1", "c2", "w1", "w2", "wn"])

    # a few hundred thousand candidates come from a thousand words: they are dealt out evenly
    return map_arrow(keyed.repartition("k1"), run, "c1 long, c2 int, w1 long, w2 int, wn long")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word: its near word of largest count, if that is
    FORM_FACTOR times its own, and the end of the chain of forms."""
    words = word_counts(docs).where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LENGTH))
    keyed = materialize(with_keys(words), "vocabulary")
    letters = keyed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = [r["c"] for r in letters.collect()]  # at most 26 and 64 letters
    size, most = keyed.agg(F.count("*"), F.max("n")).first()
    near = candidates(keyed, alphabet, bits_for(size))
    met = near.join(keyed.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "word", "n"), ["c1", "c2"])
    form = F.when(F.col("n") >= FORM_FACTOR * F.col("wn"), F.struct((-F.col("n")).alias("minus"), "word"))
    told = met.groupBy("w1", "w2").agg(F.count("*").alias("n_near"), F.min(form).alias("form"))
    named = keyed.join(told, F.expr("k1 = w1 AND k2 = w2"), "left")
    rows = materialize(
        named.select("word", F.col("form.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("form.minus")).alias("form_n")), "variants"
    )
    # a step multiplies the count by FORM_FACTOR at least, so that chains are short: each round doubles what is followed
    steps = max(1, int(math.log((most or 1) / MIN_COUNT + 1, FORM_FACTOR)) + 1)
    links = rows.where("form IS NOT NULL").select("word", "form")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("mid"), F.col("form").alias("onto"))
        links = materialize(links.join(onward, F.col("form") == F.col("mid"), "left").select("word", F.coalesce("onto", "form").alias("form")), "chains")
    ends = links.select(F.col("word").alias("w"), F.col("form").alias("root"))
    out = rows.join(ends, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
