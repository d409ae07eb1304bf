"""Exact-text search: lines, matches with context, budgets and counters."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notelattice.errors import InvalidInput
from notelattice.functions.paths import order_key
from notelattice.functions.text import clip_line, escape_literal, split_lines, window_line, window_start
from notelattice.serving import FairSemaphore

MAX_FILE, BUDGET = 1 << 20, 64 << 20
#: Paths that the path order is cut at.
CUTS = 127


@dataclass(frozen=True)
class GrepOptions:
    pattern: str
    regex: bool = False
    ignore_case: bool = False
    context: int = 0
    limit: int = 100
    max_file: int = MAX_FILE
    budget: int = BUDGET

    def checked(self) -> GrepOptions:
        if not 1 <= len(self.pattern) <= 1024 or not 1 <= self.limit <= 1000 or not 0 <= self.context <= 5:
            raise InvalidInput("pattern, limit or context is out of bounds")
        return self

    def java(self) -> str:
        """The Java pattern: Unicode case folding, '.' that stops at the line ends of the pattern
        language, '$' at the very end only."""
        if not self.regex:
            body = escape_literal(self.pattern)
        else:
            body = _javascript(self.pattern)
        return f"(?d{'iu' if self.ignore_case else ''})" + body


#: Fixed value: what \\s is in the pattern language, as the inside of a class.
SPACES = "\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def _javascript(pattern: str) -> str:
    """A pattern of the request language as Java has it: '.', '$' and \\s spelled out, code point and
    script escapes renamed, signs that only Java reads in classes escaped."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            point = re.match(r"\\u\{([0-9A-Fa-f]+)\}", pattern[i:])
            script = re.match(r"\\([pP])\{(?:Script|sc|Script_Extensions|scx)=(\w+)\}", pattern[i:])
            if point:
                out.append(f"\\x{{{point[1]}}}")
                i += point.end()
                continue
            if script:
                out.append(f"\\{script[1]}{{Is{script[2]}}}")
                i += script.end()
                continue
            if n == "s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif n == "S":
                out.append(f"[^{SPACES}]")
            elif n == "0" and not pattern[i + 2 : i + 3].isdigit():
                out.append("\\x00")
            elif n in "GAZzQEhHVRX":
                raise InvalidInput(f"bad pattern: no escape \\{n}")
            else:
                out.append("\\x0b" if n == "v" else pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            if pattern.startswith("[^]", i):
                out.append("[\\x{0}-\\x{10ffff}]")
                i, inside = i + 3, False
                continue
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i, inside = i + 2, False
                continue
            out.append(c)
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif inside:
            out.append("\\" + c if c in "[&" else c)
        elif c == ".":
            out.append("[^\\n\\r\\u2028\\u2029]")
        elif c == "$":
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def compiled(spark: SparkSession, options: GrepOptions) -> None:
    """The pattern as the engine that runs it takes it, or InvalidInput."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(options.java())
    except (IllegalArgumentException, Py4JJavaError) as e:  # whichever way the session passes it on
        raise InvalidInput(f"bad pattern: {str(e).splitlines()[0]}") from e


def _part(files: DataFrame) -> Column:
    """The number of the part of the path order that a path lies in. The order is cut at a bounded
    sample of the paths, those of least hash: a folder with most of the files is many parts."""
    picked = files.select("path").orderBy(F.xxhash64("path"), "path").limit(CUTS).collect()
    cuts = sorted({tuple(r["path"].split("/")) for r in picked if r["path"] is not None}, key=lambda p: [s.encode() for s in p])
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.array(*map(F.lit, c)) for c in cuts)), lambda c: c <= order_key(F.col("path"))))


def in_budget(files: DataFrame, max_file: int = MAX_FILE, budget: int = BUDGET) -> DataFrame:
    """path, size, `ahead`, the bytes read before the file, and `reached`: false from the first file
    on that would go over the budget. Over-size files are not read and cost nothing; they need room
    for the look that finds them over-size.

    Only paths and sizes are shuffled. The running sum is per part of the path order first, so that no
    task orders all files or those of one folder.
    """
    cost = F.when(F.col("size") <= max_file, F.col("size")).otherwise(F.lit(0)).cast("long")
    rows = files.select("path", "size", _part(files).alias("part"), cost.alias("cost"))
    sums = rows.groupBy("part").agg(F.sum("cost").alias("part_cost"))
    # CUTS + 1 rows at most
    before = sums.select(F.col("part").alias("p2"), F.coalesce(F.sum("part_cost").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = W.partitionBy("part").orderBy(order_key(F.col("path"))).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(before), F.col("part") == F.col("p2")).withColumn("ahead", F.col("base") + F.coalesce(F.sum("cost").over(run), F.lit(0))).select("path", "size", "ahead")
    met = placed.join(F.broadcast(_stop(placed, max_file, budget)), F.lit(True))  # one row
    return met.withColumn("reached", _reached()).drop("stop")


def _stop(placed: DataFrame, max_file: int, budget: int) -> DataFrame:
    """One row: the first file that is over the budget, or null."""
    look = F.least(F.col("size"), F.lit(max_file + 1))
    return placed.where(F.col("ahead") + look > budget).agg(F.min(order_key(F.col("path"))).alias("stop"))


def _reached() -> Column:
    return F.col("stop").isNull() | (order_key(F.col("path")) < F.col("stop"))


def reached(files: DataFrame, max_file: int = MAX_FILE, budget: int = BUDGET) -> DataFrame:
    """files with `reached`; they stay where they are, as only the place of the cut is sent to them."""
    cut = in_budget(files.select("path", "size"), max_file, budget).where("NOT reached").agg(F.min(order_key(F.col("path"))).alias("stop"))
    return files.join(F.broadcast(cut), F.lit(True)).withColumn("reached", _reached()).drop("stop")


def readable(files: DataFrame, max_file: int = MAX_FILE) -> Column:
    return (F.col("size") <= max_file) & (F.instr("content", "\0") == 0)


def lines_of(files: DataFrame) -> DataFrame:
    """path, n (from 1) and line of every file."""
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("k", "line")).select("path", (F.col("k") + 1).alias("n"), "line")


def first_column(line: Column, options: GrepOptions) -> Column:
    """1-based code point column of the first match, 0 for none."""
    if not options.regex and not options.ignore_case:
        return F.instr(line, options.pattern)
    pattern = F.lit(options.java())
    at = F.regexp_instr(line, pattern)
    # regexp_instr counts UTF-16 units; the code points before are the length of what precedes
    head = F.regexp_extract(line, "(?s)^(.*?)(?:" + options.java() + ")", 1)
    return F.when(at > 0, F.length(head) + 1).otherwise(F.lit(0))


def matches(files: DataFrame, options: GrepOptions) -> DataFrame:
    """path, n, col, start_col, line (a window around the match), before and after of each matching
    line, in path and line order, at most options.limit + 1 rows: one more proves a cut."""
    rows = lines_of(files)
    if options.context:
        w = W.partitionBy("path").orderBy("n")
        clipped = clip_line(F.col("line"))
        rows = rows.withColumns(
            {
                "before": F.collect_list(clipped).over(w.rowsBetween(-options.context, -1)),
                "after": F.collect_list(clipped).over(w.rowsBetween(1, options.context)),
            }
        )
    else:
        rows = rows.withColumns({"before": F.array().cast("array<string>"), "after": F.array().cast("array<string>")})
    hit = rows.withColumn("col", first_column(F.col("line"), options)).where("col > 0")
    shown = hit.select("path", "n", "col", window_start(F.col("line"), F.col("col")).alias("start_col"), window_line(F.col("line"), F.col("col")).alias("line"), "before", "after")
    return shown.orderBy(order_key(F.col("path")), "n").limit(options.limit + 1)


def grep(files: DataFrame, options: GrepOptions) -> tuple[DataFrame, DataFrame]:
    """(matches, summary). summary: files_scanned, files_skipped, truncated and reason."""
    options = options.checked()
    compiled(files.sparkSession, options)
    seen = reached(files, options.max_file, options.budget)
    scan = seen.where("reached").where(readable(files, options.max_file))
    found = matches(scan, options)
    counts = seen.agg(
        F.count_if(F.col("reached") & readable(files, options.max_file)).alias("files_scanned"),
        F.count_if(F.col("reached") & ~readable(files, options.max_file)).alias("files_skipped"),
        F.coalesce(F.bool_or(~F.col("reached")), F.lit(False)).alias("out_of_bytes"),
    )
    total = found.agg(F.count("*").alias("rows"))
    summary = counts.join(F.broadcast(total), F.lit(True)).select(
        "files_scanned",
        "files_skipped",
        ((F.col("rows") > options.limit) | F.col("out_of_bytes")).alias("truncated"),
        F.when(F.col("rows") > options.limit, "limit").when(F.col("out_of_bytes"), "bytes").alias("reason"),
    )
    return found.limit(options.limit), summary


PARTS = 8


def run(files: DataFrame, options: GrepOptions, seconds: float, slots: FairSemaphore) -> dict:
    """matches (dicts, at most the limit), files_scanned, files_skipped, truncated and reason, within
    a deadline that counts the waiting for a slot.

    Files are searched in up to PARTS runs of path order, each a job of its own with a tag; what was
    found before the deadline stays, so that a cut-off result is a prefix of the whole. A job that is
    under way then is cancelled.
    """
    options = options.checked()
    spark = files.sparkSession
    compiled(spark, options)
    end = time.monotonic() + seconds
    cut_off = {"matches": [], "files_scanned": 0, "files_skipped": 0, "truncated": True, "reason": "time"}
    if not slots.acquire(seconds):
        return cut_off
    tag, late = f"grep-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(max(end - time.monotonic(), 0), stop)
    timer.daemon = True
    timer.start()
    spark.sparkContext.addJobTag(tag)
    out = dict(cut_off, truncated=False, reason=None)
    try:
        seen = in_budget(files, options.max_file, options.budget).where("reached")
        whole = files.select("path").agg(F.count("*").alias("files")).first()["files"]
        part = seen.withColumn("part", F.least(F.lit(PARTS - 1), F.expr(f"cast(ahead * {PARTS} div {max(options.budget, 1)} as int)")))
        bounds = part.groupBy("part").agg(F.min(order_key(F.col("path"))).alias("lo"), F.max(order_key(F.col("path"))).alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
        for b in bounds:  # at most PARTS rows
            if late.is_set():
                break
            key = order_key(F.col("path"))
            mine = files.where((key >= F.array(*map(F.lit, b["lo"]))) & (key <= F.array(*map(F.lit, b["hi"]))))
            left = options.limit - len(out["matches"])
            rows = matches(mine.where(readable(mine, options.max_file)), replace(options, limit=max(left, 1))).collect()
            counts = mine.agg(F.count_if(readable(mine, options.max_file)).alias("a"), F.count("*").alias("n")).first()
            out["files_scanned"] += counts["a"]
            out["files_skipped"] += counts["n"] - counts["a"]
            out["matches"] += [r.asDict() for r in rows[:left]]
            if len(rows) > left:
                return out | {"truncated": True, "reason": "limit"}
        if late.is_set():
            return out | {"truncated": True, "reason": "time"}
        if sum(b["n"] for b in bounds) < whole:
            return out | {"truncated": True, "reason": "bytes"}
        return out
    except Exception:
        if late.is_set():  # the job was cancelled
            return out | {"truncated": True, "reason": "time"}
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
        slots.release()
