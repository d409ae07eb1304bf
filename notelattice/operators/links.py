"""Links between notes: finding, resolving, and planning rewrites for a move."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from notelattice.functions.paths import folder_of, join_normalized, order_key, relative_form, segments, suffix_keys, under
from notelattice.functions.ship import ship
from notelattice.functions.slices import sliced
from notelattice.functions.text import decode_link, encode_link, unescape_markdown

#: The note grammar.
ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
WIKI = re.compile(r"!?\[\[([^\[\]\n]+)\]\]")
INLINE = re.compile(r"!?\[((?:[^\[\]\\]|\\.|\[\[[^\[\]]*\]\]|\[[^\[\]]*\])*)\]\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))+)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
LINK = "array<struct<kind:string,linkpath:string,raw_start:int,raw_end:int,angle:boolean,head:string,tail:string>>"


def indented_code(text: str, free: tuple[int, int]) -> list[tuple[int, int]]:
    """Lines of one part of a text that are indented code: four columns deeper than what they stand in,
    behind a blank line. Within a list that is the text of its last item."""
    out, at, blank, inside, code = [], free[0], True, 0, False
    for line in text[slice(*free)].splitlines(keepends=True):
        body, wide = line.strip(), line.expandtabs(4)
        deep = len(wide) - len(wide.lstrip())
        if body and deep >= inside + 4 and (blank or code):
            out.append((at, at + len(line)))
            code = True
        elif body:
            item = ITEM.match(line)
            if item:
                inside = len(item[0].expandtabs(4)) if line[item.end() :].strip() else len(item[1]) + 2
            elif deep < inside and blank:
                inside = 0
            code = False
        blank, at = not body, at + len(line)
    return out


def code_ranges(text: str) -> list[tuple[int, int]]:
    """Fenced and indented blocks and inline code spans, as code point ranges."""
    fenced, at, fence, opened = [], 0, None, 0
    for line in text.splitlines(keepends=True):
        m = FENCE.match(line)
        if fence is None and m:
            fence, opened = m[1], at
        elif fence is not None and m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
            fenced.append((opened, at + len(line)))
            fence = None
        at += len(line)
    if fence is not None:
        fenced.append((opened, at))
    blocks = sorted([*fenced, *(r for part in _between(fenced, len(text)) for r in indented_code(text, part))])
    out = list(blocks)
    for s, e in _between(blocks, len(text)):
        i = text.find("`", s, e)
        while i >= 0:
            n = 1
            while i + n < e and text[i + n] == "`":
                n += 1
            m = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(text, i + n, e)
            if m:
                out.append((i, m.end()))
                i = text.find("`", m.end(), e)
            else:
                i = text.find("`", i + n, e)
    return sorted(out)


def _between(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What ranges in order leave free."""
    edges = [0, *(x for r in ranges for x in r), size]
    return [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if s < e]


def find_links(text: str) -> list[dict]:
    """Wiki and inline Markdown links outside of code, with the place of their link path and what of
    the link stands before and after it. External targets, pure anchors and empty paths are no links."""
    code = code_ranges(text)
    out = []

    def add(kind: str, s: int, e: int, angle: bool, whole: tuple[int, int]) -> None:
        raw = text[s:e]
        bar = raw.find("|") if kind == "wiki" else -1
        if bar > 0 and raw[bar - 1] == "\\":  # as tables write it
            bar -= 1
        cut = min([i for i in (raw.find("#"), bar) if i >= 0], default=len(raw))
        path = raw[:cut]
        lead = len(path) - len(path.lstrip())
        s, path = s + lead, path.strip()
        if not path or SCHEME.match(path) or path.startswith("//") or any(a <= s < b for a, b in code):
            return
        out.append({"kind": kind, "linkpath": path, "raw_start": s, "raw_end": s + len(path), "angle": angle, "head": text[whole[0] : s], "tail": text[s + len(path) : whole[1]]})

    for m in WIKI.finditer(text):
        add("wiki", m.start(1), m.end(1), False, m.span())
    spans = [(0, len(text))]
    while spans:  # the text, then the labels of links, which may hold images
        for m in INLINE.finditer(text, *spans.pop()):
            angle = m[2].startswith("<")
            add("inline", m.start(2) + angle, m.end(2) - angle, angle, m.span())
            if "](" in m[1]:
                spans.append(m.span(1))
    return sorted(out, key=lambda x: x["raw_start"])


def links_of(notes: DataFrame) -> DataFrame:
    """source, link_no, kind, linkpath, raw_start, raw_end, angle of (path, content) notes."""
    ship(notes.sparkSession)

    kind = to_arrow_type(T.DataType.fromDDL(LINK))

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([find_links(t or "") for t in texts.to_pylist()], kind)

    @F.arrow_udf(LINK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sliced(found, batches)

    rows = notes.select(F.col("path").alias("source"), F.posexplode(run("content")).alias("link_no", "l"))
    return rows.select("source", "link_no", "l.*")


def wiki_links(text: Column) -> Column:
    """Link targets of a section in first-seen order, code included; the index keeps these."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    names = F.transform(raw, lambda r: F.trim(F.split_part(F.split_part(r, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def tags_of(stripped: Column) -> Column:
    """Tags of a text without code, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(stripped, F.lit(r"(?:^|\s)#([A-Za-z0-9][A-Za-z0-9_/-]*)"), F.lit(1)))


def file_keys(files: DataFrame) -> DataFrame:
    """key, path: every '/'-suffix of every file, case folded."""
    return files.select("path", F.explode(suffix_keys(F.lower("path"))).alias("key"))


def candidate_keys(links: DataFrame) -> DataFrame:
    """source, link_no, step, form, key, want: the keys that a link may mean, most wanted first.

    Step 1 is relative to the note's folder, step 2 the path from the root, step 3 any suffix; form 0
    is the path as written, 1 with '.md'. A relative path that climbs over the root means nothing.
    """
    target = F.when(F.col("kind") == "inline", decode_link(unescape_markdown(F.col("linkpath")))).otherwise(F.col("linkpath"))
    rows = links.withColumn("target", target).withColumn("folder", folder_of(F.col("source")))
    dotted = F.col("target").rlike(r"^\.{1,2}/") | F.col("target").isin(".", "..")
    rooted = F.startswith("target", F.lit("/"))
    near = F.when(dotted | ((F.col("kind") == "inline") & ~rooted), join_normalized(F.col("folder"), F.col("target")))
    clean = F.regexp_replace("target", "^/+", "")
    rows = rows.withColumn("near", near).withColumn("clean", clean).withColumn("dotted", dotted)
    far = F.when(~F.col("dotted"), F.col("clean"))
    choices = F.array(
        *[F.struct(F.lit(step).alias("step"), F.lit(form).alias("form"), F.concat(p, F.lit(end)).alias("want")) for step, p in ((1, F.col("near")), (2, far), (3, F.when(~rooted, far))) for form, end in ((0, ""), (1, ".md"))]
    )
    out = rows.select("source", "link_no", "folder", F.explode(choices).alias("c")).select("source", "link_no", "folder", "c.*")
    return out.where(F.coalesce(F.col("want"), F.lit("")) != "").withColumn("key", F.lower("want"))


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """source, link_no, target, step of every link that means a file.

    Narrowing by one rule after another is one sort: step, written form (steps 1 and 2 only), exact
    case, same folder and fewest segments (step 3 only), path order.
    """
    wanted = candidate_keys(links)
    met = wanted.join(file_keys(files).select("key", F.col("path").alias("target")), "key")
    met = met.where((F.col("step") == 3) | (F.lower("target") == F.col("key")))
    last = F.col("step") == 3
    exact = F.when(last, F.when(F.endswith("target", F.col("want")), 0).otherwise(1)).otherwise(F.when(F.col("target") == F.col("want"), 0).otherwise(1))
    same = F.when(last & (folder_of(F.col("target")) != F.col("folder")), 1).otherwise(0)
    depth = F.when(last, F.size(segments(F.col("target")))).otherwise(0)
    order = ["step", F.when(last, 0).otherwise(F.col("form")), exact, same, depth, order_key(F.col("target"))]
    best = met.withColumn("nth", F.row_number().over(W.partitionBy("source", "link_no").orderBy(*order)))
    return best.where("nth = 1").select("source", "link_no", "target", "step")


def moved_path(path: Column, src: str, dst: str) -> Column:
    """The path after a move; unchanged outside of what moves."""
    return F.when(under(path, src), F.concat(F.lit(dst), F.substr(path, F.lit(len(src) + 1)))).otherwise(path)


def move_map(files: DataFrame, src: str, dst: str) -> DataFrame:
    return files.where(under(F.col("path"), src)).select(F.col("path").alias("old"), moved_path(F.col("path"), src, dst).alias("new"))


def parsed_again(head: str, raw: str, tail: str, kind: str) -> str | None:
    """What the link says when its path is `raw`. None if the text then holds no such link there: other
    bounds, another kind, or a second link that overlaps it."""
    found = find_links(head + raw + tail)
    s, e = len(head), len(head) + len(raw)
    over = [x for x in found if x["raw_start"] < e and x["raw_end"] > s]
    return over[0]["linkpath"] if len(over) == 1 and (over[0]["kind"], over[0]["raw_start"], over[0]["raw_end"]) == (kind, s, e) else None


def touched(links: DataFrame, files: DataFrame, src: str) -> DataFrame:
    """The links that a move of src may change: those of moving notes, and those that may mean a
    moving file by some key. The others are never resolved."""
    keys = file_keys(files.where(under(F.col("path"), src))).select("key").distinct()
    hit = candidate_keys(links).join(keys, "key", "left_semi").select("source", "link_no").distinct()
    return links.where(under(F.col("source"), src)).unionByName(links.where(~under(F.col("source"), src)).join(hit, ["source", "link_no"], "left_semi"))


def choices(rows: DataFrame) -> DataFrame:
    """rows with `choice` and `form`: the ways to write `expected`, most wanted first.

    Bare names stay bare, relative paths relative, others go from the root; then come the relative
    form and the form from the root. '.md' is left off where the link had no extension.
    """
    bare_md = F.col("expected").rlike(r"(?i)\.md$") & ~F.col("linkpath").rlike(r"(?i)\.[a-z0-9]+$")
    target = F.when(bare_md, F.regexp_replace("expected", r"(?i)\.md$", "")).otherwise(F.col("expected"))
    near = relative_form(folder_of(F.col("new_source")), target)
    dotted = F.when(F.startswith(near, F.lit("../")), near).otherwise(F.concat(F.lit("./"), near))
    inline, relative = F.col("kind") == "inline", F.col("linkpath").rlike(r"^\.{1,2}/")
    rooted = F.concat(F.lit("/"), target)
    name = F.element_at(F.split(target, "/"), -1)
    by_name = (~inline & ~relative & (F.instr("linkpath", "/") == 0)) | (inline & (F.col("s0") == 3))
    first = (
        F.when(by_name, F.array(name, target))
        .when(~inline & ~relative, F.array(target))
        .when(relative | (F.col("s0") == 1), F.array(F.when(F.startswith("linkpath", F.lit("./")), dotted).otherwise(near)))
        .otherwise(F.array(F.when(F.startswith("linkpath", F.lit("/")), rooted).otherwise(target)))
    )
    forms = F.concat(first, F.array(dotted, F.when(inline, rooted).otherwise(target)))
    return rows.select("*", F.posexplode(forms).alias("choice", "form"))


def plan_move(files: DataFrame, notes: DataFrame, src: str, dst: str) -> DataFrame:
    """source, new_source (after the move), link_no, raw_start, raw_end, new_linkpath of the links to
    rewrite; new_linkpath is null where no form reads and resolves as it should.

    A link is rewritten if it meant a file, the note or the file moved, and after the move it would
    mean another file or none. A form counts only if the link that holds it is read again as one link
    and resolves to the file, both tried here.
    """
    ship(notes.sparkSession)
    links = touched(links_of(notes), files, src)
    before = resolve(links, files).select("source", "link_no", F.col("target").alias("t0"), F.col("step").alias("s0"))
    after_files = files.select(moved_path(F.col("path"), src, dst).alias("path"))
    after_links = links.withColumn("source", moved_path(F.col("source"), src, dst))
    after = resolve(after_links, after_files).select(F.col("source").alias("new_source"), "link_no", F.col("target").alias("t1"), F.col("step").alias("s1"))
    rows = links.join(before, ["source", "link_no"]).withColumn("new_source", moved_path(F.col("source"), src, dst)).withColumn("expected", moved_path(F.col("t0"), src, dst))
    rows = rows.where((F.col("expected") != F.col("t0")) | (F.col("new_source") != F.col("source"))).join(after, ["new_source", "link_no"], "left")
    todo = rows.where(F.col("t1").isNull() | (F.col("t1") != F.col("expected")) | ((F.col("s0") == 1) & (F.col("s1") != 1)))

    def read(part: pa.RecordBatch) -> pa.Array:
        return pa.array([parsed_again(*x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)], pa.string())

    @F.arrow_udf("string")
    def again(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from sliced(read, (pa.RecordBatch.from_arrays(list(x), ["head", "raw", "tail", "kind"]) for x in batches))

    tried = choices(todo).withColumn("raw", F.when(F.col("kind") == "wiki", F.col("form")).when(F.col("angle"), encode_link(F.col("form"), angle=True)).otherwise(encode_link(F.col("form"))))
    tried = tried.withColumn("reads", again("head", "raw", "tail", "kind"))
    # each choice is a link of its own to resolve
    asked = tried.where("reads IS NOT NULL").select(F.col("new_source").alias("source"), (F.col("link_no") * 8 + F.col("choice")).alias("link_no"), "kind", F.col("reads").alias("linkpath"))
    meant = resolve(asked, after_files).select(F.col("source").alias("new_source"), F.col("link_no").alias("asked"), F.col("target").alias("means"))
    met = tried.withColumn("asked", F.col("link_no") * 8 + F.col("choice")).join(meant, ["new_source", "asked"], "left")
    good = F.when(F.col("means") == F.col("expected"), F.struct("choice", "raw"))
    best = met.groupBy("source", "new_source", "link_no", "raw_start", "raw_end").agg(F.min(good)["raw"].alias("new_linkpath"))
    return best


def rewrite(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """path (after the move), content and links (how many were rewritten) of the notes to write. A
    note with a link that has no good form is left as it is."""
    ship(notes.sparkSession)
    whole = plan.groupBy("source").agg(F.bool_and(F.col("new_linkpath").isNotNull()).alias("whole")).where("whole").drop("whole")
    edits = plan.join(whole, "source", "left_semi").groupBy("source").agg(F.first("new_source").alias("path"), F.sort_array(F.collect_list(F.struct("raw_start", "raw_end", "new_linkpath"))).alias("edits"))

    def edited(part: pa.RecordBatch) -> pa.Array:
        return pa.array([splice(c, [tuple(x.values()) for x in e]) for c, e in zip(*(c.to_pylist() for c in part.columns), strict=True)], pa.string())

    @F.arrow_udf("string")
    def spliced(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from sliced(edited, (pa.RecordBatch.from_arrays(list(x), ["content", "edits"]) for x in batches))

    met = notes.select(F.col("path").alias("source"), "content").join(edits, "source")
    return met.select("path", spliced("content", "edits").alias("content"), F.size("edits").alias("links"))


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """text with the ranges replaced; ranges are sorted and apart."""
    out, last = [], 0
    for s, e, new in edits:
        out += [text[last:s], new]
        last = e
    return "".join([*out, text[last:]])


def backlinks(resolved: DataFrame) -> DataFrame:
    """How many notes link to each file; a by-product of resolution."""
    return resolved.groupBy("target").agg(F.countDistinct("source").alias("notes"), F.count("*").alias("links"))

