"""Bounded samples of labelled rows for fitting a classifier, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, *columns: str) -> tuple[DataFrame, dict[int, int]]:
    """doc_id (as a string), text, `columns` and the label `y` of at most `rows` ids of each class,
    those of least hash among the labelled rows where `train` holds; and the size of each class
    before the bound.

    An id labelled twice counts once, as 1 if any row says so; a null label is none. Of an id that
    has several documents one is taken, the one whose text has the least hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train)
    known = known.groupBy(F.col("doc_id").cast("string").alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(rows) for y in (0, 1)]
    # at most 2 * rows ids: a proven bound
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    mine = docs.select(F.col("doc_id").cast("string").alias("d_id"), F.struct(F.xxhash64("text").alias("h"), "text", *columns).alias("d"))
    one = mine.join(ids, F.col("d_id") == F.col("l_id")).groupBy("l_id", "y").agg(F.min("d").alias("d"))
    return one.select(F.col("l_id").alias("doc_id"), "d.text", *(f"d.{c}" for c in columns), "y"), sizes
