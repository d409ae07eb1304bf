"""Links after a move: random vaults and moves, held against a plain reading of the rules, and the
grammar of links on notes of our own."""

import random
import re
from posixpath import dirname, normpath
from urllib.parse import quote, unquote

import pytest

from notelattice.operators import links
from notelattice.serving import map_in_order

FOLDERS = ["", "quartz", "quartz/veins", "Mica", "flint", "flint/old (2)"]
STEMS = ["ore", "Ore", "seam 2", "lode_b", "tin", "50% tin"]
ENDS = [".md", ".md", ".md", ".png"]


def plain_target(link):
    if link["kind"] == "wiki":
        return link["linkpath"]
    path = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", link["linkpath"])
    return unquote(path) if not re.search(r"%(?![0-9A-Fa-f]{2})", path) else path


def under_root(folder, path):
    """folder/path without dots, or None over the root."""
    out = []
    for part in f"{folder}/{path}".split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def meaning(files, source, link):
    """(file, step) that a link means: near its note, then from the root, then by the end of a path."""
    target, folder = plain_target(link), dirname(source)
    dotted, rooted = re.match(r"\.{1,2}(/|$)", target), target.startswith("/")
    clean = target.lstrip("/")

    def pick(found, want):
        exact = [f for f in found if f == want] or found
        return min(exact, key=lambda f: f.split("/")) if exact else None

    steps = []
    if dotted or link["kind"] == "inline" and not rooted:
        steps.append((1, under_root(folder, target)))
    if not dotted:
        steps.append((2, clean))
    for step, path in steps:
        for end in ("", ".md"):
            want = (path or "") + end
            if path and (got := pick([f for f in files if f.lower() == want.lower()], want)):
                return got, step
    if not dotted and not rooted and clean:
        wants = [clean, clean + ".md"]
        found = [(f, w) for f in files for w in wants if f.lower() == w.lower() or f.lower().endswith("/" + w.lower())]
        if found:
            rank = lambda x: (not x[0].endswith(x[1]), dirname(x[0]) != folder, x[0].count("/"), x[0].split("/"))
            return min(found, key=rank)[0], 3
    return None, None


def written(rng, source, file):
    """A link to a file in some form of writing."""
    short = file[:-3] if file.endswith(".md") and rng.random() < 0.6 else file
    name = short.rsplit("/", 1)[-1]
    up = "../" * (dirname(source).count("/") + 1 if dirname(source) else 0)
    form = rng.choice([name, short, "/" + short, "./" + up + short, up + short, "missing " + name])
    if rng.random() < 0.5 and not re.search(r"[\[\]|#]", form):
        return rng.choice(["[[{}]]", "![[{}]]", "[[ {}#part|shown]]", "[[{}\\|cell]]"]).format(form)
    if rng.random() < 0.3:
        return f"[t](<{form.replace('%', '%25')}>)"
    if rng.random() < 0.5 and "_" in form:
        return f"[t]({quote(form, safe='/._').replace('_', chr(92) + '_')})"
    return f'[t {rng.choice(["*x*", "`y`", "z"])}]({quote(form, safe="/.")}{rng.choice(["", "#part"])}{rng.choice(["", chr(32) + chr(34) + "title" + chr(34)])})'


def world(seed):
    """Files, notes, and a move of a file or a folder to where nothing is."""
    rng = random.Random(seed)
    files = {(f"{d}/" if d else "") + rng.choice(STEMS) + rng.choice(ENDS) for d in FOLDERS for _ in range(2)}
    lower = {}
    files = sorted(lower.setdefault(f, f) for f in files)
    notes = {}
    for f in files:
        if f.endswith(".md"):
            parts = [rng.choice(["text", "`[[ore]]`", "> said", "1. one"]) + " " + written(rng, f, rng.choice(files)) for _ in range(4)]
            notes[f] = rng.choice(["\n\n", "\r\n", " "]).join(parts) + "\n\n    [[ore]] in code\n\n```\n[[tin]] [a](ore.md)\n```\n"
    if rng.random() < 0.4:
        src = rng.choice([d for d in FOLDERS if d and any(f.startswith(d + "/") for f in files)])
        return files, notes, src, rng.choice(["slate", "slate/deep", "flint/new"]) if src != "flint" else "slate"
    src = rng.choice(files)
    end = src[src.rindex(".") :]
    for _ in range(50):
        dst = rng.choice(["", "slate/", "quartz/", "flint/"]) + rng.choice([*STEMS, "new (1)", "a#b", "x]y"]) + end
        if dst.lower() not in {f.lower() for f in files}:
            return files, notes, src, dst
    return files, notes, src, "slate/other" + end


@pytest.fixture(scope="module")
def one_task(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage")}
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def faults(spark, seed):
    files, notes, src, dst = world(seed)
    moved = lambda p: dst + p[len(src) :] if p == src or p.startswith(src + "/") else p
    file_rows = spark.createDataFrame([(f,) for f in files], "path string").coalesce(1)
    note_rows = spark.createDataFrame(sorted(notes.items()), "path string, content string").coalesce(1)
    plan = links.plan_move(file_rows, note_rows, src, dst).collect()
    lost = {r["source"] for r in plan if r["new_linkpath"] is None}
    after = [moved(f) for f in files]
    out, rewritten = [], 0
    for note, text in notes.items():
        mine = sorted((r["raw_start"], r["raw_end"], r["new_linkpath"]) for r in plan if r["source"] == note)
        rewritten += len(mine)
        if any(r["new_source"] != moved(note) for r in plan if r["source"] == note):
            out.append((seed, note, "its new place"))
        if note in lost:
            continue
        old, new = links.find_links(text), links.find_links(links.splice(text, mine))
        if [x["kind"] for x in old] != [x["kind"] for x in new]:
            out.append((seed, note, "other links", text, mine))
            continue
        changed = {s for s, _, _ in mine}
        for a, b in zip(old, new, strict=True):
            before, step = meaning(files, note, a)
            now, now_step = meaning(after, moved(note), b)
            outside = before is None or moved(note) == note and moved(before) == before
            if outside:  # links of what stays to what stays are left alone, whatever they mean now
                if a["raw_start"] in changed:
                    out.append((seed, note, "a link that is no matter of the move was rewritten", a, b))
            elif now != moved(before):
                out.append((seed, note, "means another file", a, b, before, now))
            elif a["raw_start"] in changed:
                kept, kept_step = meaning(after, moved(note), a)
                if kept == moved(before) and not (step == 1 and kept_step != 1):
                    out.append((seed, note, "rewritten for nothing", a, b))
    return out, rewritten, len(lost)


def test_every_link_means_the_same_file_after_a_move(one_task):
    done = map_in_order(lambda seed: faults(one_task, seed), range(12), 6)
    assert [f for found, _, _ in done for f in found][:3] == []
    assert sum(n for _, n, _ in done) > 10


#: Note, its links outside of code.
GRAMMAR = [
    ("| [[vein\\|shown]] | [[tin|x]] |", [("wiki", "vein"), ("wiki", "tin")]),
    ("[a](lode\\_b.md) [b](no\\q.md)", [("inline", "lode\\_b.md"), ("inline", "no\\q.md")]),
    ("first\n\n    [[code]]\n\n[[text]]", [("wiki", "text")]),
    ("first\n    [[text]]", [("wiki", "text")]),
    ("\t[[code]]\n\n[[text]]", [("wiki", "text")]),
    ("- one\n\n  [[a]]\n\n      [[code]]\n\n    [[b]]\n\nend", [("wiki", "a"), ("wiki", "b")]),
    ("10. one\n\n    [[a]]\n", [("wiki", "a")]),
    ("~~~\n[[code]]\n    ~~~\n~~~\n[[text]]", [("wiki", "text")]),
    ("[x](https://a.b) [y](//c.d) [z](#top) [[#top]] [w]()", []),
    ("[![i](pic.png)](ore.md)", [("inline", "pic.png"), ("inline", "ore.md")]),
]


@pytest.mark.parametrize("text, want", GRAMMAR)
def test_grammar(text, want):
    assert [(x["kind"], x["linkpath"]) for x in links.find_links(text)] == want


def test_escapes_are_read_before_a_link_is_resolved(spark):
    notes = spark.createDataFrame([("n.md", "[a](lode\\_b.md) [b](old%20%282%29.md) [[c\\|x]]")], "path string, content string")
    files = spark.createDataFrame([(f,) for f in ("lode_b.md", "old (2).md", "c.md", "n.md")], "path string")
    got = links.resolve(links.links_of(notes), files).orderBy("link_no").collect()
    assert [r["target"] for r in got] == ["lode_b.md", "old (2).md", "c.md"]
    moved = links.plan_move(files, notes, "lode_b.md", "deep/lode_c.md").collect()
    assert [r["new_linkpath"] for r in moved] == ["deep/lode_c.md"]


def test_a_note_with_a_lost_link_is_left(spark):
    notes = spark.createDataFrame([("n.md", "[[a]]"), ("m.md", "[[a]] [[b]]")], "path string, content string")
    plan = spark.createDataFrame([("n.md", "n.md", 2, 3, "c"), ("m.md", "m.md", 2, 3, "c"), ("m.md", "m.md", 8, 9, None)], "source string, new_source string, raw_start int, raw_end int, new_linkpath string")
    assert [tuple(r) for r in links.rewrite(notes, plan).collect()] == [("n.md", "[[c]]", 1)]


def test_plain_reading_normalises_as_paths_do():
    assert under_root("a/b", "../c") == normpath("a/b/../c") and under_root("", "../c") is None
