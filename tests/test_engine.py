"""Scenarios: diversity, paging, edits, chunking, links, grep, upserts, the vault facade, streams."""

import random

import pytest
from pyspark.sql import functions as F

from notelattice.errors import AlreadyExists, DimensionMismatch, InvalidInput, NotFound, PatchAmbiguous, PatchNoMatch, PipelineTooNew, VaultNotFound
from notelattice.functions import paths, text
from notelattice.operators import chunking, embed, grep, links, listing, search, store
from notelattice.streaming import events
from notelattice.vault import Vault, Vaults


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def greedy(hits, lam, cap):
    left, out, seen = list(enumerate(hits)), [], {}
    while left:
        ok = [(i, h) for i, h in left if seen.get(h[1], 0) < cap]
        if not ok:
            break
        i, h = max(ok, key=lambda x: (round(lam * x[1][2] - (1 - lam) * (x[1][1] in seen), 9), -x[0]))
        out.append(h[0])
        seen[h[1]] = seen.get(h[1], 0) + 1
        left.remove((i, h))
    return out


@pytest.mark.parametrize("lam,cap", [(0.5, 3), (1.0, 1), (0.0, 2), (0.25, 2)])
def test_diversify_is_the_greedy_rule(spark, lam, cap):
    rng = random.Random(lam * 10 + cap)
    hits = sorted(((f"id{i:02d}", f"p{rng.randrange(4)}", rng.randrange(20) / 20) for i in range(15)), key=lambda h: (-h[2], h[0]))
    df = spark.createDataFrame(hits, "id string, path string, score double")
    got = [r["id"] for r in search.diversify(search.pool(df, 15), lam, cap).orderBy("position").collect()]
    assert got == greedy(hits, lam, cap)


def test_pages_visit_each_row_once_in_path_order(spark):
    names = ["a/x.md", "a-b.md", "a/b/c.md", "b.md", "a/！.md", "a/\U0001f600.md", "z/1.md"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for size in (1, 2, 3, 10):
        seen, cursor = [], None
        while True:
            rows = listing.page(df, cursor, size).orderBy(paths.order_key(F.col("path"))).collect()
            seen += [r["path"] for r in rows]
            cursor = rows[0]["next_cursor"] if rows else None
            if not cursor:
                break
        assert seen == sorted(names, key=lambda p: p.split("/"))
    with pytest.raises(InvalidInput):
        listing.page(df, "!", 5)


@pytest.mark.parametrize(
    "content,edits,want",
    [
        ("a b a", [("a", "x", True)], ("x b x", None)),
        ("a b a", [("a", "x", False)], (None, "patch_ambiguous")),
        ("a b", [("c", "x", False)], (None, "patch_no_match")),
        ("a b", [("a", "$&", False), ("$&", "y", False)], ("y b", None)),
        ("a", [("a", "a", False)], (None, "invalid_input")),
        ("aaa", [("aa", "b", False)], ("ba", None)),
    ],
)
def test_edits(spark, content, edits, want):
    col = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"), F.lit(a).alias("all")) for o, n, a in edits])
    r = one(spark, text.apply_edits(F.lit(content), col).alias("d"))["d"]
    assert (r["text"], r["error"]) == want


def test_lines_and_quoting(spark):
    r = one(spark, text.split_lines(F.lit("a\r\nb\rc\n\n")).alias("a"), text.split_lines(F.lit("")).alias("b"), text.decode_link(F.lit("a+b%20c")).alias("c"), text.decode_link(F.lit("50%")).alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == (["a", "b\rc", ""], [], "a+b c", "50%")


def test_paths(spark):
    p = lambda f, *a: one(spark, f(*map(F.lit, a)).alias("x"))["x"]
    assert p(paths.relative_form, "a/b", "a/c/d.md") == "../c/d.md"
    assert p(paths.relative_form, "", "c.md") == "c.md"
    assert p(paths.relative_form, "a", "a/b.md") == "b.md"
    assert p(paths.join_normalized, "a/b", "../../c") == "c"
    assert p(paths.join_normalized, "a", "../../c") is None
    assert p(paths.path_problem, "a/..b/c.md") == "hidden"
    assert p(paths.mime, "x/Y.HTML") == "text/html"


def test_chunks():
    note = "---\nt: 2024-01-02\n---\nintro\n## A\ntext #t1 [[L|x]]\n```\n# no #t2\n```\n## B\n### C\nbody"
    got = chunking.chunk_note("n.md", note)
    assert [c["heading_path"] for c in got] == [[], ["A"], ["A", "B"], ["A", "B", "C"]]
    assert got[1]["links"] == ["L"] and got[1]["tags"] == ["t1"] and got[2]["text"] == ""
    assert got[0]["frontmatter"] == '{"t": "2024-01-02T00:00:00.000Z"}'
    assert got[3]["embed_text"] == "n.md\nA > B > C\n\nbody"
    assert [c["text"] for c in chunking.chunk_note("l.md", "- a\n- b\n- c")] == ["* a", "* b", "* c"]
    long = chunking.chunk_note("l.md", "x" * 1600 + "\n\n" + "y" * 100)
    assert [len(c["text"]) for c in long] == [1500, 202] or [len(c["text"]) for c in long] == [1500, 100, 100]


def test_find_links():
    t = "[[A#h|b]] ![[img.png]] [x](a%20b.md) [y](<c d.md> \"t\") `[[no]]` [z](http://x) [q](#h)\n```\n[[no]]\n```\n[[ s ]]"
    got = [(x["kind"], x["linkpath"]) for x in links.find_links(t)]
    assert got == [("wiki", "A"), ("wiki", "img.png"), ("inline", "a%20b.md"), ("inline", "c d.md"), ("wiki", "s")]
    assert all(t[x["raw_start"] : x["raw_end"]] == x["linkpath"] for x in links.find_links(t))


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("a/n.md", "b/n.md", "c/d/n.md", "a/x.md", "N2.md", "n2.md")], "path string")
    rows = [("a/x.md", 0, "wiki", "n"), ("z/x.md", 1, "wiki", "n"), ("a/x.md", 2, "inline", "../b/n.md"), ("a/x.md", 3, "inline", "../../b/n.md"), ("a/x.md", 4, "wiki", "d/n"), ("a/x.md", 5, "wiki", "n2"), ("a/x.md", 6, "wiki", "gone")]
    got = {r["link_no"]: (r["target"], r["step"]) for r in links.resolve(spark.createDataFrame(rows, "source string, link_no int, kind string, linkpath string"), files).collect()}
    assert got == {0: ("a/n.md", 3), 1: ("a/n.md", 3), 2: ("b/n.md", 1), 4: ("c/d/n.md", 3), 5: ("n2.md", 2)}


def test_grep(spark):
    files = spark.createDataFrame([("a.md", "one\nTwo é\nthree", 14), ("b.md", "two\0", 4), ("c.md", "x two\ntwo", 9)], "path string, content string, size long")
    found, summary = grep.grep(files, grep.GrepOptions("É$", regex=True, ignore_case=True, context=1))
    assert [(r["path"], r["n"], r["col"], r["before"], r["after"]) for r in found.collect()] == [("a.md", 2, 5, ["one"], ["three"])]
    found, summary = grep.grep(files, grep.GrepOptions("two", limit=1))
    assert [(r["path"], r["n"], r["col"]) for r in found.collect()] == [("c.md", 1, 3)]
    assert summary.first().asDict() == {"files_scanned": 2, "files_skipped": 1, "truncated": True, "reason": "limit"}
    with pytest.raises(InvalidInput):
        grep.grep(files, grep.GrepOptions("(", regex=True))


def test_random_upserts(spark):
    rng, model = random.Random(3), {}
    df = spark.createDataFrame([], "path string, k int")
    for step in range(4):
        changed = {f"p{rng.randrange(6)}" for _ in range(3)}
        new = [(p, step * 10 + i) for p in sorted(changed) for i in range(rng.randrange(3))]
        df = store.upsert(df, spark.createDataFrame([(p,) for p in changed], "path string"), spark.createDataFrame(new, "path string, k int"))
        model = {p: v for p, v in model.items() if p not in changed}
        for p, k in new:
            model.setdefault(p, []).append(k)
    assert sorted(map(tuple, df.collect())) == sorted((p, k) for p, v in model.items() for k in v)


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.reconcile() == "reset" and t.reconcile() == "kept"
    rows = lambda n: spark.range(n).withColumn("path", F.concat(F.lit("p"), "id"))
    t.write(rows(3), dim=4)
    t.write(rows(5))
    assert t.read(4).count() == 5 and t.current()["version"] == 2
    with pytest.raises(DimensionMismatch):
        t.read(8)
    with pytest.raises(PipelineTooNew):
        t.reconcile(0)


@pytest.fixture
def vault(spark, tmp_path):
    root = tmp_path / "v"
    v = Vault(spark, str(root), "main", tables=str(tmp_path / "tables"), embedder=embed.HashEmbedder(8))
    root.mkdir()
    v.write_file("a/one.md", "# One\nalpha beta [[two]] #x/y\n", {"k": 1})
    v.write_file("a/two.md", "# Two\ngamma delta [up](../b/three.md)\n")
    v.write_file("b/three.md", "alpha alpha\n")
    v.write_file("b/pic.txt", "no note, alpha")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "h.md").write_text("alpha")
    (root / "link.md").symlink_to(root / "b" / "three.md")
    return v


def test_vault(spark, vault):
    assert vault.index() == {"documents": 3, "chunks": 3}
    hit = vault.search("alpha", mode="fts").collect()
    assert {h["path"] for h in hit} == {"a/one.md", "b/three.md"} and hit[0]["path"] == "b/three.md"
    assert vault.search("alpha beta").first()["score"] > 0
    assert [(r["tag"], r["count"], r["total"]) for r in vault.tags().collect()] == [("x/y", 1, 1)]
    assert [r["path"] for r in vault.paths().collect()] == ["a", "a/one.md", "a/two.md", "b", "b/pic.txt", "b/three.md"]
    assert [r["path"] for r in vault.resources().collect()] == ["a/one.md", "a/two.md", "b/three.md"]
    assert {r["path"] for r in vault.grep("alpha")[0].collect()} == {"a/one.md", "b/pic.txt", "b/three.md"}
    inner = vault.scoped("a")
    assert [r["path"] for r in inner.paths().collect()] == ["one.md", "two.md"] and inner == vault.scoped("a")
    assert {r["path"] for r in inner.search("alpha").collect()} == {"one.md", "two.md"}
    vault.patch_file("b/three.md", [("alpha alpha", "omega", False)])
    with pytest.raises(PatchNoMatch):
        vault.patch_file("b/three.md", [("nope", "x", False)])
    vault.append_file("b/three.md", "oo oo\n")
    with pytest.raises(PatchAmbiguous):
        vault.patch_file("b/three.md", [("oo", "x", False)])
    vault.delete_path("a/one.md")
    assert vault.index()["documents"] == 2
    assert vault.search("omega", mode="fts").first()["path"] == "b/three.md"


def test_move_rewrites_links(vault):
    assert vault.move_path("b", "c/b") == {"a/two.md": 1}
    assert "[up](../c/b/three.md)" in vault.read_file("a/two.md")["content"]
    assert vault.copy_path("a", "d")["files"] == 2 and vault.create_folder("e") and not vault.create_folder("e")
    with pytest.raises(AlreadyExists):
        vault.move_path("a", "d")
    with pytest.raises(NotFound):
        vault.move_path("zz", "y")
    for bad in ("../x", "/x", ".h/x", ""):
        with pytest.raises(InvalidInput):
            vault.delete_path(bad)


def test_vaults(vault):
    assert Vaults(vault).tool("create_folder")("main", "n")
    with pytest.raises(VaultNotFound):
        Vaults(vault)["other"]
    with pytest.raises(InvalidInput):
        Vaults(vault).tool("format_disk")


def test_change_stream_equals_a_rebuild(spark, vault, tmp_path):
    from notelattice.sources.vault import register

    register(spark)
    vault.table.reconcile()
    for _ in range(2):
        changes = spark.readStream.format("notelattice.changes").load(vault.root)
        events.index_stream(changes, vault.apply_changes, str(tmp_path / "cp")).awaitTermination(120)
        vault.write_file("b/four.md", "four")
        vault.delete_path("a/two.md") if (vault._at("a/two.md")).exists() else None
    changes = spark.readStream.format("notelattice.changes").load(vault.root)
    events.index_stream(changes, vault.apply_changes, str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["path"], r["sha256"]) for r in vault.chunks().collect()}
    vault.index()
    assert got == {(r["path"], r["sha256"]) for r in vault.chunks().collect()}
    assert {p for p, _ in got} == {"a/one.md", "b/three.md", "b/four.md"}


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"p{i % 3}", f"2024-01-01 00:00:{i % 60:02d}", "upsert" if i % 4 else "remove") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, path string, t string, kind string").select("event_id", "path", F.to_timestamp("t").alias("ts"), "kind")
    df.write.parquet(str(tmp_path / "in"))
    stream = events.debounced_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2000)
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in events.debounced(df, 2000).collect()}
    got = {tuple(r) for r in spark.table("bursts").collect()}
    assert got <= want


def test_config():
    from notelattice.config import ConfigError, load, parse_vaults

    assert [v.slug for v in parse_vaults('[{"name": " My Vault! "}, {"name": "x", "slug": "B c"}]')] == ["my-vault", "b-c"]
    for bad in ("", "{}", "[]", "[1]", '[{"name": ""}]', '[{"name": "!"}]', '[{"name": "a"}, {"name": "A"}]'):
        with pytest.raises(ConfigError):
            parse_vaults(bad)
    assert load({"VAULTS_JSON": '[{"name": "a"}]', "EMBEDDER_DIM": "8"}).dim == 8
    with pytest.raises(ConfigError):
        load({"VAULTS_JSON": '[{"name": "a"}]', "EMBEDDER": "other"})


def test_watch_and_health_config(capsys):
    from notelattice.config import ConfigError, Health, Watch, load, load_or_exit

    base = {"VAULTS_JSON": '[{"name": "a"}]'}
    assert load(base).watch == Watch(300, 30, True) and load(base).health == Health(0, 0, 3)
    own = load({**base, "STALL_SECONDS": "0", "POLL_SECONDS": "90", "LOG_FORWARD": "false", "MAX_CRASHES": "7", "FAILURES": "0"})
    assert own.watch == Watch(0, 90, False) and own.health == Health(7, 0, 0)
    for bad in ({"POLL_SECONDS": "0"}, {"STALL_SECONDS": "10"}, {"STALL_SECONDS": "-1"}, {"STALL_SECONDS": "1e3"}, {"LOG_FORWARD": "yes"}, {"MAX_CRASHES": "9" * 400}, {"MAX_STALLS": "10001"}, {"FAILURES": ""}):
        with pytest.raises(ConfigError):
            load({**base, **bad})
    with pytest.raises(SystemExit) as e:
        load_or_exit({})
    assert e.value.code == 78 and "VAULTS_JSON" in capsys.readouterr().err


def test_embedders():
    import numpy as np

    h = embed.HashEmbedder(8).embed(["a", "b", "a"])
    assert np.allclose(np.linalg.norm(h, axis=1), 1) and (h[0] == h[2]).all() and (h[0] != h[1]).any()
    assert embed.TableEmbedder({"a": [1.0, 2.0]}, 2).embed(["a", "x"]).tolist() == [[1, 2], [0, 0]]
    answers, waits = iter([(500, []), (429, []), (200, [[1.0], [2.0]]), (200, [[3.0]])]), []
    e = embed.HttpEmbedder(lambda t: next(answers), 1, batch=2, in_flight=1, sleep=waits.append, clock=lambda: float(sum(waits)))
    assert e.embed(["a", "b", "c"]).tolist() == [[1], [2], [3]] and waits == [1, 2]
    with pytest.raises(Exception, match="400"):
        embed.HttpEmbedder(lambda t: (400, []), 1).embed(["a"])
    assert embed.backoff(9) == 30


def test_golden_queries(spark, vault, tmp_path):
    """The verbatim query comes first, and the tables report it."""
    (tmp_path / "q.json").write_text('[{"query": "alpha alpha", "expectedPath": "b/three.md"}, {"query": "gamma delta", "expectedPath": "a/two.md", "mode": "fts"}]')
    vault.index()
    seeds = search.seed_queries(spark, str(tmp_path / "q.json"))
    hits = None
    for q in seeds.collect():
        part = vault.search(q["query"], mode=q["mode"], max_per_path=1).select(F.lit(q["query_id"]).alias("query_id"), "path", "position")
        hits = part if hits is None else hits.unionByName(part)
    row = search.evaluate(seeds, hits).first()
    assert row["recall_at_k"] == 1.0 and row["mrr"] > 0.7
    (tmp_path / "bad.json").write_text('[{"query": "x", "expectedPath": "y", "mode": "psychic"}]')
    with pytest.raises(InvalidInput):
        search.seed_queries(spark, str(tmp_path / "bad.json"))


def test_reading(vault):
    assert vault.read_note("a/one.md")["frontmatter"] == {"k": 1}
    (vault._at("b/raw.bin")).write_bytes(b"\xff\x00")
    assert vault.read_note("b/raw.bin") == {"path": "b/raw.bin", "encoding": "base64", "content": "/wA="}
    assert vault.status()["state"] == "starting"
    with pytest.raises(NotFound):
        vault.read_note("a/none.md")


def test_nested_items_stay_with_their_item():
    assert chunking.pieces("* a\n* b\n  1. c\n  2. d") == ["* a", "* b\n  1. c\n  2. d"]
    assert chunking.pieces("1. a\n2. b\n   - n\n\n   more\n3. c") == ["* a", "* b\n   - n\n\n   more", "* c"]
    assert chunking.pieces("- a\n- b\n+ c") == ["- a\n- b\n+ c"]  # two lists


def test_empty_frontmatter_is_frontmatter():
    assert chunking.split_frontmatter("---\n---\nbody") == ({}, "body")
    assert chunking.split_frontmatter("---\na: [1]\n---\nbody") == ({"a": [1]}, "body")
    assert chunking.split_frontmatter("---\nno end") == ({}, "---\nno end")
    assert chunking.split_frontmatter("text\n---\n---\n") == ({}, "text\n---\n---\n")


def test_budget_over_a_hot_folder(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"{rng.choice(['hot', 'hot', 'hot', 'a/b', 'a', 'z.d', 'é'])}/{rng.choice('xyz')}{i}.md", rng.randint(0, 90)) for i in range(400)]
    files = spark.createDataFrame(rows, "path string, size long").repartition(3)
    for cuts, budget in ((5, 7000), (127, 7000), (40, 10**9)):
        monkeypatch.setattr(grep, "CUTS", cuts)
        ahead, stopped, want = 0, False, []
        for path, size in sorted(rows, key=lambda r: [s.encode() for s in r[0].split("/")]):
            stopped = stopped or ahead + min(size, 81) > budget
            want.append((path, ahead, not stopped))
            ahead += size if size <= 80 else 0
        got = grep.in_budget(files, 80, budget).select("path", "ahead", "reached").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    parts = files.select(grep._part(files).alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 100
    assert grep.in_budget(files.limit(0)).count() == 0
