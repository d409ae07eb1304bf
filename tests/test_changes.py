"""Listings by Spark and the stream of versions."""

import os
import random

import pytest

from notelattice.sources.changes import Changes, list_entries
from notelattice.sources.vault import walk


def grow(root, rng, n):
    for i in range(n):
        at = root / rng.choice(["a", "a/b", "a/b/c/d", "hot", "hot", "hot", "node_modules", ".git", "x y"]) / f"n{i}{rng.choice(['.md', '.MD', '.txt', '.markdown'])}"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * (i % 7))


def test_a_listing_is_that_of_a_walk(spark, tmp_path):
    root = tmp_path / "vault"
    grow(root, random.Random(1), 300)
    (root / "hot" / "loop").symlink_to(root / "hot")
    (root / "empty").mkdir()
    got = list_entries(spark, str(root), str(tmp_path / "list")).collect()
    assert sorted((r["type"], r["path"]) for r in got) == sorted(walk(str(root), False))
    sizes = {r["path"]: r["size"] for r in got if r["type"] == "file"}
    assert all(os.path.getsize(root / p) == s for p, s in sizes.items())
    with pytest.raises(NotADirectoryError):
        list_entries(spark, str(tmp_path / "nowhere"), str(tmp_path / "list2"))


def test_versions_and_a_restart(spark, tmp_path):
    root = tmp_path / "vault"
    grow(root, random.Random(2), 40)
    changes = Changes(spark, str(tmp_path / "changes"), str(root))
    seen = []

    def read():
        query = (
            changes.stream().writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        out = sorted((r[0], r[1], r[4]) for r in seen)
        seen.clear()
        return out

    notes = sorted(p for _, p in walk(str(root), True))
    assert changes.version() == 0 and changes.poll() == 1 and changes.poll() is None
    assert read() == [("upsert", p, 1) for p in notes] and read() == []
    (root / notes[0]).unlink()
    (root / notes[1]).write_text("longer than it was")
    (root / "a" / "new.md").write_text("new")
    assert changes.poll() == 2
    (root / "a" / "new.md").unlink()
    assert changes.poll() == 3
    want = sorted([("remove", notes[0], 2), ("upsert", notes[1], 2), ("upsert", "a/new.md", 2), ("remove", "a/new.md", 3)])
    assert read() == want  # the reader was down for two versions
    assert sorted((r["kind"], r["path"], r["version"]) for r in changes.events(1).collect()) == want
    again = Changes(spark, str(tmp_path / "changes"), str(root))
    assert again.version() == 3 and again.poll() is None
    assert sorted(r["path"] for r in again.listing(3).collect()) == sorted(p for _, p in walk(str(root), True))
    (root / "last.md").write_text("x")
    assert again.poll() == 4
    again.forget(3)
    assert [int(n[1:]) for n in again._names("v")] == [3, 4] and not [n for n in os.listdir(tmp_path / "changes") if n.startswith(".work")]


def test_the_index_follows_versions(spark, tmp_path):
    from notelattice.operators.embed import HashEmbedder
    from notelattice.streaming.events import drain
    from notelattice.vault import Vault

    root = tmp_path / "vault"
    root.mkdir()
    (root / "a.md").write_text("---\nn: 1\n---\nalpha")
    (root / "empty.md").write_text("")
    vault = Vault(spark, str(root), "main", tables=str(tmp_path / "tables"), embedder=HashEmbedder(4))
    vault.changes().poll()
    query = vault.follow(str(tmp_path / "check"), processingTime="200 milliseconds")
    query.processAllAvailable()
    assert [r["path"] for r in vault.chunks().collect()] == ["a.md"]
    (root / "a.md").unlink()
    (root / "b.md").write_text("beta")
    (root / "empty.md").write_text("no more")
    vault.changes().poll()
    assert drain(query, 60) and not query.isActive
    assert sorted(r["path"] for r in vault.chunks().collect()) == ["b.md", "empty.md"]
