"""Listings: one level or a whole subtree, keyset pages in path order, note catalogues, scopes."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelattice.errors import InvalidInput
from notelattice.functions.paths import cursor_of, is_markdown, order_key, segments

PAGE, MAX_PAGE = 100, 1000


def entries(files: DataFrame) -> DataFrame:
    """Files and the folders above them: vault, type, path, size, sha256 (null for folders)."""
    parts = segments(F.col("path"))
    folders = files.where(F.instr("path", "/") > 0).select(
        "vault", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")
    )
    rows = folders.distinct().select("vault", F.lit("folder").alias("type"), "path", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("sha256"))
    return rows.unionByName(files.select("vault", F.lit("file").alias("type"), "path", F.col("size").cast("bigint").alias("size"), "sha256"))


def listed(rows: DataFrame, prefix: str = "", recursive: bool = True, kind: str | None = None) -> DataFrame:
    """Entries that start with the prefix, all or those one level below its folder."""
    out = rows.where(F.startswith("path", F.lit(prefix)))
    base = prefix[: prefix.rfind("/") + 1]
    if not recursive:
        out = out.where(F.instr(F.substr("path", F.lit(len(base) + 1)), "/") == 0)
    return out.where(F.col("type") == kind) if kind else out


def page(rows: DataFrame, cursor: str | None = None, limit: int = PAGE) -> DataFrame:
    """The next rows after a cursor in path order, each with next_cursor: null on the last page.

    One row is read ahead to know whether a page follows; nothing is counted or skipped.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise InvalidInput(f"a page has 1 to {MAX_PAGE} rows")
    key = order_key(F.col("path"))
    if cursor:
        try:
            after = base64.b64decode(cursor, validate=True).decode()
        except ValueError as e:
            raise InvalidInput("bad cursor") from e
        rows = rows.where(key > F.split(F.lit(after), "/"))
    # one top-k; what follows sees its limit + 1 rows at most
    ahead = rows.orderBy(key).limit(limit + 1).withColumn("nth", F.row_number().over(W.orderBy(key)))
    every = W.partitionBy()
    last = F.max(F.when(F.col("nth") == limit, F.col("path"))).over(every)
    more = F.when(F.max("nth").over(every) > limit, cursor_of(last))
    return ahead.withColumn("next_cursor", more).where(F.col("nth") <= limit).drop("nth")


def resources(files: DataFrame, cursor: str | None = None, limit: int = PAGE) -> DataFrame:
    """The note catalogue: the page is cut first, then filtered to Markdown, so that it may be short."""
    return page(files, cursor, limit).where(is_markdown(F.col("path")))


def scoped(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows under a virtual root, their paths relative to it."""
    inside = rows.where(F.startswith("path", F.lit(prefix + "/")))
    return inside.withColumn("path", F.substr("path", F.lit(len(prefix) + 2)))


def unscoped(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.withColumn("path", F.concat(F.lit(prefix + "/"), F.col("path")))
