"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

DataFrame and SQL functions only. One pass over all documents counts hashed word n-grams in a
fixed number of buckets, for the raw corpus and for the trusted texts among them; the bucket table
(fixed size) becomes the model. A second pass scores each document by the mean log ratio of its
n-grams and compares that with a fixed threshold; a few base rules come first. n-grams are single
words and, with order 2, pairs too.

Defined results: a null or empty text has no word and fails the base rules; a table without trusted
texts has all ratios 0, so only the base rules decide; repeated rows are judged one by one, equal
texts alike; a ratio equal to the threshold passes; texts of any length are taken whole; an empty table
gives no rows, in keep_good() too; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

BUCKETS = 1 << 16
#: Order of the n-grams, and the mean log ratio from which a document is kept.
NGRAM, THRESHOLD = 2, -0.08
#: Pseudo counts for each bucket, added to what the target has and to what the raw corpus lets
#: expect there: a bucket that few n-grams fall in says little, so that clean texts of rare words
#: outside of the trusted sample are not taken for junk.
ALPHA = 20.0
#: Trusted texts are fitted on at most so many labelled rows, those of least hash.
TRUSTED_ROWS = 20_000
#: Base rules: words at least, and percent of words in repeated windows at most.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
GRAMS = {1: "s.h.ones", 2: "concat(s.h.ones, s.h.twos)"}


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of at most `rows` documents labelled good; bounded, so it may be broadcast."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("trusted_id")).distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(rows)


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once under a name: the lambda of a one-element array."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_grams(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, txt, word_chars, ones (word hashes) and twos (a hash of each word with its successor,
    of the last word alone), plus `keep`. The words themselves never leave the expression."""
    words = rf"array_remove(split(txt, '[{WS}]+'), '')".replace("\\", "\\\\")
    twos = let("h", "transform(w, x -> xxhash64(x))", "struct(h as ones, zip_with(h, slice(h, 2, size(h)), (x, y) -> xxhash64(x, y)) as twos)")
    body = f"struct(cast(char_length(array_join(w, '')) as long) as word_chars, {twos} as h)"
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("txt"), *keep).withColumn("s", F.expr(let("w", words, body)))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, n: int = NGRAM, alpha: float = ALPHA) -> list[float]:
    """The log ratio of each bucket. Counts cover every document; what reaches the driver is one
    row for each bucket, whatever the corpus."""
    # a hint, not a guess: trusted_ids() bounds this side
    mine = docs.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("d_id"), "text")
    marked = mine.join(F.broadcast(trusted), F.col("d_id") == F.col("trusted_id"), "left")
    grams = with_grams(marked, F.col("trusted_id").isNotNull().alias("good")).select("good", F.explode(F.expr(GRAMS[n])).alias("gram"))
    rows = grams.groupBy(F.expr(f"pmod(gram, {buckets})").alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    share = sum(target) / sum(raw)
    return [math.log((t + alpha) / (c * share + alpha)) for t, c in zip(target, raw, strict=True)]


def repeated_words() -> str:
    """Words that lie in a 5-word window found twice or more in the text, from b, the pairs.

    A window is hashed from the pairs it is made of. A repeated window repeats two runs of four
    words, so that texts without those, nearly all, pay for one distinct count only; the others
    sort (hash, place) pairs. Runs over the end of the text have hashes of their own.
    """
    pair = "(x, y) -> xxhash64(x, y)"
    same = "(k > 0 and p[k - 1].h = s.h) or (k < size(p) - 1 and p[k + 1].h = s.h)"
    hit = let("p", "array_sort(transform(win, (h, i) -> struct(h as h, i as i)))", f"array_sort(transform(filter(p, (s, k) -> {same}), s -> s.i))")
    cover = let("a", hit, f"aggregate(transform(a, (x, k) -> if(k = size(a) - 1, {WINDOW}, least({WINDOW}, a[k + 1] - x))), 0L, (acc, x) -> acc + x)")
    wins = let("win", f"zip_with(q, slice(b, 4, size(b)), {pair})", f"if(size(win) = size(array_distinct(win)), 0L, {cover})")
    runs = let("q", f"zip_with(b, slice(b, 3, size(b)), {pair})", f"if(size(q) - size(array_distinct(q)) < 2, 0L, {wins})")
    return let("b", "s.h.twos", runs)


def judge(docs: DataFrame, ratios: list[float], threshold: float, n: int, *keep: Column) -> DataFrame:
    """One row for each document: the base counts, base_failed, llr and kept, plus `keep`."""
    # one literal, folded to an array once; not a literal call for each bucket. Six digits are kept,
    # so that the plan stays small
    counted = with_grams(docs, *keep).withColumn("weights", F.from_json(F.lit(json.dumps([round(r, 6) for r in ratios])), "array<double>"))
    lines = let("a", r"split(txt, '\\n', -1)", rf"if(size(a) = size(array_distinct(a)), 0, {let('f', rf'filter(a, l -> l rlike {chr(39)}[^{WS}]{chr(39)})', 'size(f) - size(array_distinct(f))')})".replace("\\", "\\\\"))
    scored = counted.select(
        "doc_id",
        F.size("s.h.ones").cast("long").alias("n_words"),
        F.col("s.word_chars").alias("word_chars"),
        F.expr("cast(regexp_count(txt, '[#*$%&|<>]') as long)").alias("n_symbols"),
        F.expr(f"cast({lines} as long)").alias("n_dup_lines"),
        F.expr(repeated_words()).alias("n_repeat_words"),
        F.expr(f"if(size({GRAMS[n]}) = 0, 0D, aggregate({GRAMS[n]}, 0D, (acc, g) -> acc + weights[pmod(g, {len(ratios)})]) / size({GRAMS[n]}))").alias("llr"),
        *[F.col(c) for c in counted.columns if c.startswith("__")],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and llr of every document."""
    n = options.get("n", NGRAM)
    ratios = fit(docs, trusted_ids(labels), options.get("buckets", BUCKETS), n)
    return judge(docs, ratios, options.get("threshold", THRESHOLD), n).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    ratios = fit(docs, trusted_ids(labels))
    judged = judge(docs, ratios, THRESHOLD, NGRAM, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    return judged.where("kept").select("__row.*")
