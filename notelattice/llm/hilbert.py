"""Sharding along a Hilbert curve, DataFrame and SQL functions only.

Metadata dimensions (rank of source, rank of language, size) are quantised to BITS each; their cell's index on the
curve orders the documents, and the order is cut into runs, so that a shard covers few values of
each dimension and readers can prune shards by any of them. The law is `rows`: counts of the shards
differ by one at most.

The global rank is made without a global sort: counts by (cell, slice) first, where a slice is a
fixed range of the hash of id and text that orders a cell, then running sums over that bounded table, then a
row number within each slice. A hot cell is thus spread over SLICES tasks.

Defined results: a null text has 0 bytes, size 1 and the CRC of nothing; null source, language or
id count as empty strings; equal ids are ordered by CRC and size, full duplicates may swap places;
an empty table gives no rows; columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

BITS, DIMS, SHARDS = 4, 3, 8
SLICES = 1024


def curve_index(coords: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve (Skilling's transpose form)."""
    x, n = list(coords), len(coords)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def curve(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """Curve indices of all cells, the first coordinate most significant."""
    side = 1 << bits
    cells = range(side**dims)
    return [curve_index(tuple(c // side ** (dims - 1 - d) % side for d in range(dims)), bits) for c in cells]


#: SQL of the quantised size, which DuckDB runs too.
SIZE_Q = "greatest(0, least(15, length(bin(size)) - 4))"


def ranked(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the place of `column` among its values in order, in 2 ** BITS steps: values that
    are neighbours in the alphabet are neighbours on the curve. The rows are not joined with the
    values, of which some are hot: only the first value of each step reaches the driver."""
    values = rows.groupBy(F.col(column).alias("value")).agg(F.lit(1).alias("one"))
    place = values.select("value", (F.row_number().over(W.orderBy("value")) - 1).alias("at"), F.sum("one").over(W.partitionBy()).alias("of"))
    steps = place.groupBy(F.expr(f"cast(at * {1 << BITS} div of as int)").alias("step")).agg(F.min("value").alias("first"))
    found = F.when(F.lit(False), 0)
    for r in steps.orderBy(F.desc("step")).collect():  # at most 2 ** BITS rows
        found = found.when(F.col(column) >= r["first"], r["step"])
    return rows.withColumn(out, found.otherwise(0))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    index = "[" + ", ".join(map(str, curve())) + "]"
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = materialize(docs.select("doc_id", name("source"), name("lang"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    return (
        ranked(ranked(rows, "source", "source_q"), "lang", "lang_q")
        .withColumn("cell", F.expr(f"cast(source_q * 256 + lang_q * 16 + {SIZE_Q} as int)"))
        .withColumn("hilbert", F.element_at(F.from_json(F.lit(index), "array<int>"), F.col("cell") + 1))
        .withColumn("tie", F.expr("cast(conv(substr(md5(concat_ws(':', coalesce(cast(doc_id as string), ''), text_crc32)), 1, 12), 16, 10) as long)"))
        .withColumn("slice", F.expr(f"cast(tie div {(1 << 48) // SLICES} as int)"))
        .select("doc_id", "size", "text_crc32", "hilbert", "tie", "slice")
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and hilbert."""
    rows = materialize(keyed(docs), "hilbert")
    counts = rows.groupBy("hilbert", "slice").agg(F.count("*").alias("n"))
    cells = counts.groupBy("hilbert").agg(F.sum("n").alias("cell_n"))
    # at most 2 ** (BITS * DIMS) rows, whatever the corpus
    run = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("hilbert").alias("c_hilbert"), F.coalesce(F.sum("cell_n").over(run), F.lit(0)).alias("cell_at"), F.sum("cell_n").over(W.partitionBy()).alias("total"))
    inner = W.partitionBy("hilbert").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    plan = counts.withColumn("slice_at", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(cells, F.expr("hilbert = c_hilbert"))
    plan = plan.select(F.col("hilbert").alias("p_hilbert"), F.col("slice").alias("p_slice"), (F.col("cell_at") + F.col("slice_at")).alias("at"), "total")
    place = F.row_number().over(W.partitionBy("hilbert", "slice").orderBy("tie", "doc_id", "text_crc32", "size"))
    ranked = rows.join(plan, F.expr("hilbert = p_hilbert AND slice = p_slice")).withColumn("rank", F.col("at") + place - 1)
    cut = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents with their shard numbers, a folder for each shard, rows in slot order.
    Documents are met by id, CRC and size; of full duplicates each row gets one place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    same = W.partitionBy("doc_id", "text_crc32", "size")
    marks = shard(docs, shards).withColumn("nth", F.row_number().over(same.orderBy("shard", "slot"))).select("doc_id", "text_crc32", "size", "nth", "shard", "slot")
    mine = docs.withColumns({"text_crc32": F.crc32(text.cast("binary")), "size": (F.octet_length(text) + 1).cast("long")})
    mine = mine.withColumn("nth", F.row_number().over(same.orderBy(F.lit(0))))
    joined = mine.alias("d").join(marks.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.text_crc32 = m.text_crc32 AND d.size = m.size AND d.nth = m.nth"))
    out = joined.select(*[F.col(f"d.{c}") for c in docs.columns], "m.shard", "m.slot")
    out.repartitionByRange(shards * 8, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
