"""The facade: the index follows file changes, nothing leaves the root, moves survive a cut, greps keep
to their time, scopes and catalogues."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from notelattice import serving
from notelattice.errors import CODES, AlreadyExists, InvalidInput, InvalidPath, NotFound, VaultError, VaultNotFound, envelope
from notelattice.operators import embed, grep, store
from notelattice.sources import guard
from notelattice.sources import vault as source
from notelattice.vault import Vault, Vaults, parse_scope


@pytest.fixture
def vault(spark, tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    v = Vault(spark, str(root), "main", tables=str(tmp_path / "tables"), embedder=embed.HashEmbedder(8))
    v.write_file("a/one.md", "# One\nalpha beta [[two]] #x/y\n", {"k": 1})
    v.write_file("a/two.md", "# Two\ngamma delta [up](../b/three.md)\n")
    v.write_file("b/three.md", "alpha alpha\n")
    v.write_file("b/pic.txt", "no note, alpha")
    v.index()
    return v


def indexed(v):
    return {r["path"] for r in v.chunks().select("path").distinct().collect()}


def found(v, word):
    return {r["path"] for r in v.search(word, mode="fts").collect()}


def test_index_follows_changes(vault):
    assert vault.write_file("c/new.md", "omega word") and found(vault, "omega") == {"c/new.md"}
    assert vault.patch_file("c/new.md", [("omega", "psi", False)]) and not found(vault, "omega") and found(vault, "psi") == {"c/new.md"}
    assert vault.append_file("c/new.md", " chi") and found(vault, "chi") == {"c/new.md"}
    assert vault.copy_path("a", "d") == {"files": 2, "skipped": 0, "indexed": True} and {"d/one.md", "d/two.md"} <= indexed(vault)
    assert vault.delete_path("a/one.md") and "a/one.md" not in indexed(vault)
    assert vault.delete_path("d") and not any(p.startswith("d/") for p in indexed(vault))
    moved = vault.move_path("b", "deep/b")
    assert moved == {"a/two.md": 1} and moved.indexed and moved.type == "folder"
    assert indexed(vault) == {"a/two.md", "c/new.md", "deep/b/three.md"} and found(vault, "alpha") == {"deep/b/three.md"}
    before = {tuple(r) for r in vault.words.read().select("id", "token", "tf").collect()}
    vault.index()
    assert {tuple(r) for r in vault.words.read().select("id", "token", "tf").collect()} == before and indexed(vault) == {"a/two.md", "c/new.md", "deep/b/three.md"}
    assert vault.write_file("b/pic.txt", "x") and "b/pic.txt" not in indexed(vault)


def test_search_reads_no_text(vault):
    """The plan of a text search has the kept postings and the lengths, and no tokens of texts."""
    from notelattice.operators import search

    plan = search.search(vault.chunks(), None, ["alpha"], search.SearchOptions(mode="fts"), vault.words.read())._jdf.queryExecution().toString()
    assert "embed_text" not in plan.split("== Physical Plan ==")[1] and "regexp_extract_all" not in plan


def test_searches_by_index_are_those_by_scan(vault, monkeypatch):
    from notelattice.operators import vectors

    assert not vault.build_indexes()  # too few rows
    monkeypatch.setattr(vectors, "LEAST_ROWS", 1)
    shown = lambda **o: [(r["id"], r["score"], r["position"]) for r in vault.search("alpha beta words", **o).collect()]
    want = {mode: shown(mode=mode) for mode in ("hybrid", "vector", "fts")}
    assert vault.build_indexes() and vault.build_indexes()
    asked = []
    for index, name in ((vault.near, "search"), (vault.impacts, "scored")):
        own = getattr(index, name)
        monkeypatch.setattr(index, name, lambda *a, own=own, name=name: asked.append(name) or own(*a))
    assert {mode: shown(mode=mode) for mode in want} == want
    assert asked == ["search", "scored", "search", "scored"]
    assert vault.write_file("c/late.md", "alpha alpha") and "c/late.md" in found(vault, "alpha") and len(asked) == 4  # indexes are of the state before


def test_failed_index_never_fails_the_write(vault, monkeypatch):
    monkeypatch.setattr(vault, "_store", lambda *a: 1 / 0)
    assert vault.write_file("a/late.md", "later") is False and vault.read_file("a/late.md")["content"] == "later"
    monkeypatch.undo()
    vault.index()
    assert "a/late.md" in indexed(vault)


def test_drops_spare_what_is_there(vault, spark):
    vault.apply_changes(spark.createDataFrame([], "path string, mtime_ms long, content binary, sha256 string"), spark.createDataFrame([("a/one.md",), ("gone.md",)], "path string"))
    assert "a/one.md" in indexed(vault)
    os.unlink(f"{vault.root}/a/one.md")
    vault.apply_changes(spark.createDataFrame([], "path string, mtime_ms long, content binary, sha256 string"), spark.createDataFrame([("a/one.md",)], "path string"))
    assert "a/one.md" not in indexed(vault)


def test_nothing_leaves_the_root(vault, tmp_path):
    out = tmp_path / "outside"
    out.mkdir()
    (out / "x.md").write_text("secret")
    os.symlink(out, f"{vault.root}/link")
    os.symlink(out / "x.md", f"{vault.root}/x.md")
    for call in (
        lambda: vault.write_file("link/evil.md", "x"), lambda: vault.write_file("link/deep/evil.md", "x"), lambda: vault.read_file("link/x.md"), lambda: vault.read_file("x.md"), lambda: vault.append_file("x.md", "x"),
        lambda: vault.create_folder("link/new"), lambda: vault.delete_path("link"), lambda: vault.delete_path("link/x.md"), lambda: vault.copy_path("link", "c"), lambda: vault.copy_path("a", "link/a"),
        lambda: vault.move_path("a", "link/a"), lambda: vault.move_path("x.md", "y.md"), lambda: vault.write_file("a/one.md/sub.md", "x"), lambda: vault.write_file("../x.md", "x"), lambda: vault.write_file("", "x"),
    ):
        with pytest.raises(InvalidPath):
            call()
    assert sorted(os.listdir(out)) == ["x.md"] and (out / "x.md").read_text() == "secret"
    vault.index()
    assert not any("link" in p or p == "x.md" for p in indexed(vault))
    os.mkfifo(f"{vault.root}/pipe")
    with pytest.raises(InvalidPath):
        vault.move_path("pipe", "pipe2")


def test_parents_go_again(tmp_path):
    with pytest.raises(OSError), guard.parents(str(tmp_path), "p/q/r.md"):
        raise OSError
    assert os.listdir(tmp_path) == []
    with guard.parents(str(tmp_path), "p/q/r.md") as at:
        at.write_text("x")
    assert (tmp_path / "p/q/r.md").read_text() == "x"


def test_notes_of_any_size(vault):
    big = "needle\n" + "x" * 4000 + ("\n" + "-" * 1499) * 12_000
    assert vault.write_file("big.md", big[:16] + "alpha " + big[16:]) and len(big) > 16 << 20
    assert "big.md" in indexed(vault)
    vault.index()
    assert "big.md" in indexed(vault)


def test_unreadable_is_not_gone(vault, tmp_path, monkeypatch):
    with pytest.raises(guard.Gone):
        guard.read_regular(vault.root, "nope.md")
    monkeypatch.setattr(guard.os, "open", lambda *a: (_ for _ in ()).throw(PermissionError("no")))
    with pytest.raises(PermissionError):
        guard.read_regular(vault.root, "a/one.md")


def test_metadata_alone_opens_nothing(vault, spark):
    rows = source.read_vault(spark, vault.root, "main", content="false").collect()
    assert {r["path"] for r in rows} == {"a/one.md", "a/two.md", "b/three.md"} and all(r["content"] is None and r["size"] for r in rows)
    small = source.read_vault(spark, vault.root, "main", maxBytes="15").collect()
    assert {r["path"]: r["skip_reason"] for r in small} == {"a/one.md": "too_large", "a/two.md": "too_large", "b/three.md": None}


def test_a_cut_move_is_finished(vault, monkeypatch):
    monkeypatch.setattr(vault, "_finish", lambda journal: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        vault.move_path("b", "c")
    monkeypatch.undo()
    assert "../b/" in vault.read_file("a/two.md")["content"]  # renamed, not rewritten
    assert vault.finish_moves() == 1 and "](../c/three.md)" in vault.read_file("a/two.md")["content"]
    assert vault.finish_moves() == 0 and not (vault._journals()).exists()


def test_overwrite(vault):
    with pytest.raises(AlreadyExists):
        vault.copy_path("a/one.md", "a/two.md")
    assert vault.copy_path("a/one.md", "a/two.md", overwrite=True)["files"] == 1
    moved = vault.move_path("a/one.md", "b/three.md", overwrite=True)
    assert moved.indexed and indexed(vault) == {"a/two.md", "b/three.md"} and found(vault, "beta") == {"a/two.md", "b/three.md"}
    with pytest.raises(InvalidInput):
        vault.copy_path("a", "a/b")


@pytest.mark.parametrize(
    "pattern,line,hit",
    [
        (r"^\p{Lu}{2}", "ÉA x", True), (r"^\p{Lu}{2}", "éA", False), (r"(?<y>\d+)-\k<y>", "12-12", True), (r"\u{1F600}", "a \U0001f600", True), (r"a.c$", "abc", True), (r"[[a]x", "[x", True), (r"a\sb", "a\u00a0b", True),
        (r"\p{Script=Greek}", "λ", True), (r"[a&&b]", "&", True), (r"(?<=a)b(?!c)", "ab", True), (r"[^]", "x", True),
    ],
)
def test_patterns(spark, pattern, line, hit):
    files = spark.createDataFrame([("n.md", line, len(line.encode()))], "path string, content string, size long")
    found, _ = grep.grep(files, grep.GrepOptions(pattern, regex=True))
    assert bool(found.count()) == hit


def test_bad_patterns(spark):
    files = spark.createDataFrame([("n.md", "x", 1)], "path string, content string, size long")
    for bad in ("(", "[a", "a{2,1}", "\\q", "\\Qa", "(?<y>a)(?<y>b)"):
        with pytest.raises(InvalidInput):
            grep.grep(files, grep.GrepOptions(bad, regex=True))


def test_grep_in_time(vault, spark):
    whole = vault.grep_now("alpha", seconds=120)
    assert [m["path"] for m in whole["matches"]] == ["a/one.md", "b/pic.txt", "b/three.md"] and not whole["truncated"] and whole["files_scanned"] == 4
    assert vault.grep_now("alpha", seconds=120, limit=2)["reason"] == "limit"
    assert vault.grep_now("alpha", seconds=120, budget=60)["reason"] == "bytes"
    slow = F.udf(lambda t: time.sleep(20) or t)
    files = vault.texts().withColumn("content", slow("content"))
    start = time.time()
    got = grep.run(files, grep.GrepOptions("alpha"), 3, serving.FairSemaphore(1))
    assert got["reason"] == "time" and got["truncated"] and time.time() - start < 15
    busy = serving.FairSemaphore(1)
    assert busy.acquire() and grep.run(files, grep.GrepOptions("alpha"), 0.1, busy)["reason"] == "time"


def test_serving():
    turns, sem = [], serving.FairSemaphore(1)
    assert sem.acquire(0)
    threads = []
    for i in range(4):
        threads.append(threading.Thread(target=lambda i=i: (sem.acquire(), turns.append(i), sem.release())))
        threads[-1].start()
        time.sleep(0.05)
    sem.release()
    [t.join() for t in threads]
    assert turns == [0, 1, 2, 3] and sem.acquire(0) and not sem.acquire(0.01)
    assert serving.map_in_order(lambda x: time.sleep(0.02 * (3 - x)) or x, range(4)) == [0, 1, 2, 3]
    tries = []
    assert serving.retried(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else "done"), wait=lambda n: 0) == "done"
    with pytest.raises(ZeroDivisionError):
        serving.retried(lambda: 1 / 0, wait=lambda n: 0)
    sizes = []
    batch = serving.Batcher(lambda xs: sizes.append(len(xs)) or [x * 2 for x in xs], most=3, seconds=0.05)
    results = [batch.submit(i) for i in range(4)]
    assert [r() for r in results] == [0, 2, 4, 6] and sizes == [3, 1]
    last = batch.submit(5)
    batch.stop()
    assert last() == 10
    with pytest.raises(RuntimeError):
        batch.submit(1)
    locks = serving.PathLocks()
    with locks.held("b", "a", "b"):
        pass
    assert not locks._held


def test_pieces_are_ranges_apart(spark, tmp_path, monkeypatch):
    """Random upserts against a dict; a prefix opens only files that may hold it."""
    import random

    rng = random.Random(7)
    monkeypatch.setattr(store, "PIECE_ROWS", 15)
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    name = lambda: f"{rng.choice('abcé')}/{rng.choice('xyz')}{rng.randint(0, 30)}.md"
    frame = lambda rows: spark.createDataFrame(rows, "path string, n int")
    want = {}
    for step in range(6):
        new = {name(): [step * 100 + k for k in range(rng.randint(1, 4))] for _ in range(40 if step == 0 else 6)}
        gone = rng.sample(sorted(want), min(len(want), 4)) if step else []
        t.upsert(frame([(p, 0) for p in [*new, *gone]]).select("path"), frame([(p, n) for p, ns in new.items() for n in ns]))
        want = {p: ns for p, ns in {**want, **dict.fromkeys(gone, []), **new}.items() if ns}
        assert sorted(map(tuple, t.read().collect())) == sorted((p, n) for p, ns in want.items() for n in ns)
        pieces = t.current()["pieces"]
        assert all(a["high"].encode() < b["low"].encode() for a, b in zip(pieces, pieces[1:], strict=False))
        assert sum(p["rows"] for p in pieces) == sum(map(len, want.values()))
    for prefix in ("a/", "a/x1", "é/", "c", "nothing", ""):
        got = t.read(prefix=prefix)
        assert sorted(r["path"] for r in got.where(F.startswith("path", F.lit(prefix))).collect()) == sorted(p for p, ns in want.items() for _ in ns if p.startswith(prefix))
        assert prefix == "" or len(got.inputFiles()) < len(t.read().inputFiles())


def test_table_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PIECE_ROWS", 20)
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.range(200).select(F.concat(F.lit("p"), "id").alias("path"), "id")
    t.write(rows)
    first = t.current()
    t.upsert(rows.where("id = 7").select("path"), rows.where("id = 7").withColumn("id", F.lit(1000).cast("bigint")))
    second = t.current()
    assert len(first["pieces"]) > 5 and sum(p not in second["pieces"] for p in first["pieces"]) == 1
    assert t.read().agg(F.sum("id")).first()[0] == sum(range(200)) - 7 + 1000 and t.read().count() == 200
    held = t.read()
    t.upsert(rows.select("path"), rows.limit(0))
    assert t.read().count() == 0 and held.count() == 200
    t.write(rows)
    t.write(rows)
    assert len(t._names("pointer-")) == 2 and len(t._names("v")) <= 2
    with pytest.raises(VaultError):
        t._publish(t._names("pointer-")[-1], "{}")


def test_scopes(vault):
    vaults = Vaults(vault)
    assert parse_scope(["main", "a%20b", ".", ""], lambda s: True) == ("main", "a b")
    for bad in (["main", "a%2Fb"], ["main", "%ZZ"], ["main", ".."], ["main", ".h"], [], ["main", "a%5Cb"]):
        with pytest.raises(InvalidPath):
            parse_scope(bad, lambda s: True)
    with pytest.raises(VaultNotFound):
        vaults.scoped("other")
    a = vaults.scoped("main", "a")
    assert a is vaults.scoped("main", "a") and a.read_note("one.md")["frontmatter"] == {"k": 1}
    assert a.write_file("s/x.md", "sigma") and found(vault, "sigma") == {"a/s/x.md"} and {r["path"] for r in a.search("sigma", mode="fts").collect()} == {"s/x.md"}
    assert {r["path"] for r in a.grep("alpha")[0].collect()} == {"one.md"} and a.move_path("one.md", "s/one.md") == {}
    first = a.paths(limit=1).collect()
    assert [r["path"] for r in first] == ["s"] and [r["path"] for r in a.paths(limit=9, cursor=first[0]["next_cursor"]).collect()] == ["s/one.md", "s/x.md", "two.md"]
    assert [r["path"] for r in a.resources().collect()] == ["s/one.md", "s/x.md", "two.md"] and a.status()["slug"] == "main"
    with pytest.raises(VaultNotFound):
        a.status("other")
    for bad in ("../b/three.md", "/b", ""):
        with pytest.raises(InvalidPath):
            a.read_file(bad)
    assert a.patch_file("two.md", [("gamma", "rho", False)]) and a.append_file("two.md", "!") and a.create_folder("z") and a.copy_path("two.md", "z/two.md")["files"] == 1 and a.delete_path("z")
    whole = vaults.scoped("main")
    assert whole.read_file("b/three.md")["content"] == "alpha alpha\n" and {r["tag"] for r in whole.tags().collect()} == {"x/y"}


def test_catalogue_and_tools(vault, spark, tmp_path):
    (tmp_path / "w").mkdir()
    other = Vault(spark, str(tmp_path / "w"), "other", tables=str(tmp_path / "tables2"))
    other.write_file("n.md", "note")
    vaults = Vaults(vault, other)
    got, cursor = [], None
    while True:
        page = vaults.resources(cursor, limit=2)
        got += [r["uri"] for r in page["resources"]]
        cursor = page["next_cursor"]
        if not cursor:
            break
    assert got == ["vault://main/a/one.md", "vault://main/a/two.md", "vault://main/b/three.md", "vault://other/n.md"]
    assert vaults.read_resource("vault://other/n.md")["text"] == "note"
    for bad in ("vault://other/", "file:///etc/passwd", "vault://no/n.md", "vault://main/b/pic.txt", "vault://main/zz.md", "vault://main/../x.md"):
        with pytest.raises(NotFound):
            vaults.read_resource(bad)
    assert json.loads(vaults.call("read_file", "other", path="n.md")["content"][0]["text"])["content"] == "note"
    assert len(json.loads(vaults.call("grep", "main", pattern="alpha")["content"][0]["text"])["matches"]) == 3
    for name, arguments, code in (("read_file", {"path": "zz.md"}, "not_found"), ("read_file", {}, "invalid_input"), ("nope", {}, "invalid_input"), ("read_file", {"path": "../x"}, "invalid_path")):
        got = vaults.call(name, "other", **arguments)
        assert got["isError"] and json.loads(got["content"][0]["text"])["code"] == code
    assert len(CODES) == 14 and envelope(ValueError("secret"), "r1") == (500, {"error": {"code": "internal", "message": "internal server error", "details": {"requestId": "r1"}}})
    assert envelope(NotFound("x"))[0] == 404
