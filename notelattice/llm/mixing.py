"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Each source gets a target share of tokens. A document's key is u ** (1 / w), u from a hash of its id and
text and w its quality weight; within a source the documents come in falling order of key (that is, of
rising -ln(u) / w), and a running sum of sizes cuts them at the budget. Whole epochs come first: a
target of 1.7 times its source takes every document once and then the head of the order for 0.7.

The running sum is in two steps, so that no source, however hot, is sorted in one task: sums by
(source, slice of the key) first, which is a table of at most SLICES rows for a source, then rows
within a slice. Defined results: a null text has size 0 and is taken 0 words; the null source is a
source of its own, ordered last; equal ids are told apart by text, full duplicates may swap places;
words are counted over whole texts of any length; an empty table gives no rows; columns other than
doc_id, text and source are not read by the sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WS, materialize

SLICES = 4096
WEIGHTS = (3, 1, 2)
SHARE_PCT, CAP = 150, 2


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, size (words), key order `k` (smaller first), its slice, and `keep`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.expr(rf"size(array_remove(split(coalesce(text, ''), '[{WS}]+'), ''))".replace("\\", "\\\\")).cast("long")
    # the share of words among words and markup signs, not under a quarter
    marks = F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))), 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    return (
        docs.select("doc_id", "source", words.alias("size"), marks.alias("marks"), u.alias("u"), F.xxhash64(text).alias("text_hash"), *keep)
        .withColumn("w", F.greatest(F.lit(0.25), F.col("size") / (F.col("size") + F.col("marks") + F.lit(1e-9))))
        .withColumn("k", -F.log("u") / F.col("w"))
        .withColumn("slice", F.floor(F.lit(SLICES) * F.col("k") / (1 + F.col("k"))).cast("int"))
        .drop("u", "marks", "w")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size) rows: one row for each source.

    Water filling in closed form. Sorted by cap over weight, the first sources are full; the level
    of the rest is what is left over their weights, and the first source that it doesn't overfill
    ends the full ones. All quantities but the last quotient are whole numbers.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    weighed = ranked.withColumn("weight", F.expr(f"CASE (rank - 1) % {len(WEIGHTS)} {cases} END").cast("long"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(after))
        # twice the left-over amount, so that it is a whole number
        .withColumn("left2", 2 * F.lit(SHARE_PCT) * F.col("total") / 100 - 2 * CAP * F.col("full"))
        .withColumn("fits", F.col("left2") * F.col("weight") <= 2 * CAP * F.col("source_size") * F.col("rest"))
    )
    first = levels.withColumn("place", F.row_number().over(order)).withColumn("ends", F.min(F.when(F.col("fits"), F.col("place"))).over(everything))
    at_end = F.col("place") == F.col("ends")
    settled = first.withColumn("l2", F.max(F.when(at_end, F.col("left2"))).over(everything)).withColumn("r", F.max(F.when(at_end, F.col("rest"))).over(everything))
    target = F.when(F.col("place") < F.col("ends"), (CAP * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * F.col("l2") / (2 * F.col("r"))
    )
    return settled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document, plus `keep`.

    A document at the edge of a budget is taken if that brings its source nearer to its target.
    """
    small = materialize(sized(docs), "mix")
    base = sized(docs, *keep) if keep else small
    goals = targets(small)
    sums = small.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.withColumn("offset", F.coalesce(before, F.lit(0))).drop("slice_size")
    plan = offsets.alias("o").join(goals.alias("g"), F.expr("o.source <=> g.source")).select(
        F.col("o.source").alias("p_source"), F.col("o.slice").alias("p_slice"), "offset", "source_size", "target"
    )
    placed = base.join(plan, F.expr("source <=> p_source AND slice = p_slice"))
    run = W.partitionBy("p_source", "p_slice").orderBy("k", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.expr("if(source_size = 0, 0L, cast(floor(target / source_size) as long))")
    return (
        placed.withColumn("ahead", F.col("offset") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("copies", F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("ahead") + F.col("size") <= 2 * F.col("part")), 1).otherwise(0))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("p_source", "p_slice", "offset", "epochs", "part", "ahead", "k", "slice", "text_hash")
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix, all columns of docs: a document taken twice is there twice."""
    mixed = mix(docs, F.struct(*[docs[c] for c in docs.columns]).alias("__row")).where("copies > 0")
    return mixed.select(F.explode(F.expr("array_repeat(__row, cast(copies as int))")).alias("r")).select("r.*")
