"""Notes to chunks: frontmatter, sections by heading, long sections, flat lists, links and tags."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from notelattice.functions.ship import ship
from notelattice.functions.slices import sliced

from .links import ITEM, code_ranges

#: The size of a chunk in UTF-16 units, and the share of items that makes a list.
LIMIT, LIST_SHARE = 1500, 0.7
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
#: Wiki links and tags.
WIKI = re.compile(r"\[\[([^\]]+)\]\]")
TAG = re.compile(r"(?:^|\s)#([A-Za-z0-9][A-Za-z0-9_/-]*)")
SCHEMA = "path string, chunk_index int, heading_path array<string>, text string, embed_text string, frontmatter string, links array<string>, tags array<string>, mtime_ms bigint, sha256 string"


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def embed_text(path: Column, headings: Column, text: Column) -> Column:
    """What is embedded: path, headings, body."""
    return F.concat(path, F.lit("\n"), F.when(F.size(headings) > 0, F.concat(F.array_join(headings, " > "), F.lit("\n"))).otherwise(F.lit("")), F.lit("\n"), text)


def split_frontmatter(source: str) -> tuple[dict, str]:
    """(fields, body). What is no mapping counts as none; dates become ISO texts."""
    m = re.match(r"---[ \t]*\r?\n(.*?\n)??---[ \t]*(?:\r?\n|$)", source, re.S)
    if not m:
        return {}, source
    import yaml

    try:
        value = yaml.safe_load(m[1] or "")
    except yaml.YAMLError:
        value = None
    return (_plain(value) if isinstance(value, dict) else {}), source[m.end() :]


def _plain(v):
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
    if isinstance(v, date):
        return v.strftime("%Y-%m-%dT00:00:00.000Z")
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def sections(body: str) -> list[tuple[list[str], str]]:
    """(heading path, text) from heading to heading. The stack is cut to level - 1 names, and names
    are counted, not levels: deeper headings without their parents nest by order."""
    out, stack, lines = [], [], []
    fenced = {i for a, b in code_ranges(body) if "\n" in body[a:b] for i in range(body.count("\n", 0, a), body.count("\n", 0, b))}
    started = False

    def close(after_heading: bool) -> None:
        text = "\n".join(lines).strip("\n")
        if text.strip() or after_heading:
            out.append((list(stack), text))

    rows = body.split("\n")
    for i, raw in enumerate(rows):
        line = raw.rstrip("\r")
        m = None if i in fenced else ATX.match(line)
        under = None if i in fenced or not lines or not lines[-1].strip() or ITEM.match(lines[-1]) or ATX.match(lines[-1]) else SETEXT.match(line)
        if under and (len(lines) < 2 or not lines[-2].strip()):
            level, name = (1 if under[1][0] == "=" else 2), lines.pop().strip()
        elif m:
            level, name = len(m[1]), (m[2] or "").strip()
        else:
            lines.append(line)
            continue
        close(started)
        del stack[level - 1 :]
        stack.append(name)
        lines.clear()
        started = True
    close(started)
    return out


def pieces(text: str) -> list[str]:
    """A section as chunks: the items of a list that is most of it, else paragraphs packed together."""
    items = flat_list(text)
    if items:
        return [p for item in items for p in packed(item)]
    return packed(text)


def packed(text: str) -> list[str]:
    if units(text) <= LIMIT:
        return [text]
    out, held = [], ""
    for part in re.split(r"\n{2,}", text):
        if held and units(held) + 2 + units(part) <= LIMIT:
            held += "\n\n" + part
            continue
        if held:
            out.append(held)
        left, at = units(part), 0
        while left > LIMIT:
            n = LIMIT
            while units(part[at : at + n]) > LIMIT:
                n -= 1
            out.append(part[at : at + n])
            left -= units(out[-1])
            at += n
        held = part[at:]
    return [*out, held] if held else out


def flat_list(text: str) -> list[str]:
    """Top-level items if the text is one list with few other blocks, else none. Markers become '* '."""
    blocks: list[tuple[str, list[str]]] = []
    blank, inside = True, 0  # where the text of the last item begins
    for line in text.split("\n"):
        m = ITEM.match(line)
        if m and not (blocks and blocks[-1][0] != "other" and len(m[1]) >= inside):
            # items of another marker are another list
            blocks.append((m[2][-1], ["* " + line[m.end() :]]))
            inside = len(m[0]) if line[m.end() :] else len(m[1]) + len(m[2]) + 1
        elif not line.strip():
            if blocks:
                blocks[-1][1].append(line)
            blank = True
            continue
        elif blocks and (line.startswith(("  ", "\t")) or (not blank and blocks[-1][0] != "other")):
            blocks[-1][1].append(line)
        elif blocks and blocks[-1][0] == "other" and not blank:
            blocks[-1][1].append(line)
        else:
            blocks.append(("other", [line]))
        blank = False
    kinds = [k for k, _ in blocks]
    lists = sum(k != "other" and (i == 0 or kinds[i - 1] != k) for i, k in enumerate(kinds))
    rest = kinds.count("other")
    n = len(kinds) - rest
    if lists != 1 or n / (n + rest) < LIST_SHARE:
        return []
    return ["\n".join(x).strip("\n") for k, x in blocks if k != "other"]


def without_code(text: str) -> str:
    out, last = [], 0
    for s, e in code_ranges(text):
        if s >= last:
            out.append(text[last:s])
            last = e
    return "".join([*out, text[last:]])


def tags_without_code(content: Column) -> Column:
    """Tags of a text, those in code left out, in first-seen order."""

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([list(dict.fromkeys(TAG.findall(without_code(t or "")))) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sliced(found, batches)

    return run(content)


def chunk_note(path: str, source: str) -> list[dict]:
    fields, body = split_frontmatter(source)
    out = []
    for headings, text in sections(body):
        links = list(dict.fromkeys(n for n in (m[1].split("|")[0].split("#")[0].strip() for m in WIKI.finditer(text)) if n))
        tags = list(dict.fromkeys(TAG.findall(without_code(text))))
        for piece in pieces(text):
            head = " > ".join(headings) + "\n" if headings else ""
            out.append({"path": path, "chunk_index": len(out), "heading_path": headings, "text": piece, "embed_text": f"{path}\n{head}\n{piece}", "frontmatter": json.dumps(fields, ensure_ascii=False), "links": links, "tags": tags})
    return out


def chunk_notes(files: DataFrame, every: bool = False) -> DataFrame:
    """Chunks of (path, content, mtime_ms, sha256) files, with `id`. With `every`, a file without chunks
    is a row without chunk_index."""
    ship(files.sparkSession)

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def chunked(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, content, mtime_ms, sha256 in zip(*(c.to_pylist() for c in part.columns), strict=True):
            rows += [{**c, "mtime_ms": mtime_ms, "sha256": sha256} for c in chunk_note(path, content or "")] or [{"path": path}] * every
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sliced(chunked, batches)

    rows = files.select("path", "content", "mtime_ms", "sha256").mapInArrow(run, SCHEMA)
    return rows.withColumn("id", F.concat("path", F.lit("#"), "chunk_index"))


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """path, pages, has_text, markdown of extracted page texts (path, page, text): trimmed, long gaps
    closed, a marker before every page but the first, empty pages left out."""
    clean = pages.withColumn("text", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n"))
    shown = F.when(F.col("text") == "", F.lit(None)).when(F.col("page") == 1, F.col("text")).otherwise(F.concat(F.lit("<!-- page "), F.col("page"), F.lit(" -->\n\n"), F.col("text")))
    out = clean.withColumn("shown", shown).groupBy("path").agg(F.count("*").alias("pages"), F.count("shown").alias("filled"), F.sort_array(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("page", "shown")))).alias("parts"))
    return out.select("path", "pages", (F.col("filled") > 0).alias("has_text"), F.array_join(F.transform("parts", lambda p: p["shown"]), "\n\n").alias("markdown"))
