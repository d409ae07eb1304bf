"""The facade: a vault of notes with search, grep, tags, listing, file changes and move planning.

File changes are done by the driver, one writer at a time for a path, and the index follows each: rows
of what was written are replaced, rows of what went are dropped unless a note is there again. A failure
of the index never fails the file change; it is logged, and the next index() mends it.
"""

from __future__ import annotations

import base64
import json
import logging
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelattice.errors import AlreadyExists, InvalidBody, InvalidInput, InvalidPath, NotFound, PatchAmbiguous, PatchNoMatch, VaultError, VaultNotFound, tool_error
from notelattice.functions.frontmatter import safe_json
from notelattice.functions.paths import is_indexable, mime, under
from notelattice.functions.text import lenient_utf8
from notelattice.operators import chunking, grep, links, listing, search, store
from notelattice.operators import impacts as impact_index
from notelattice.operators import vectors as vector_index
from notelattice.operators.embed import Embedder, HashEmbedder, with_vectors
from notelattice.serving import FairSemaphore, PathLocks, map_in_order, retried
from notelattice.sources.changes import Changes
from notelattice.sources.guard import Gone, check_contained, check_source, parents, read_regular, safe_join, safe_path
from notelattice.sources.vault import contents, read_vault

log = logging.getLogger(__name__)
TEXT_TYPES = ("application/json", "application/xml", "application/yaml")
#: Greps that run at once, and the seconds that one may take, waiting included.
GREPS, GREP_SECONDS = 2, 5.0
SCHEME = "vault://"
_GREP_SLOTS = FairSemaphore(GREPS)


def index_folder(spark: SparkSession) -> str:
    """Where the index goes unless the caller says: the shared folder, or on one machine a new one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at:
        return f"{at.rstrip('/')}/index-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise InvalidInput("name a folder for the index that driver and executors share")
    return tempfile.mkdtemp(prefix="index-")


class Moved(dict):
    """{path: links rewritten} of a move, and how it went."""

    indexed, skipped, type = False, (), "file"


class Vault:
    """One folder of notes. `root` is seen by all executors; `tables` is where the index lives."""

    def __init__(self, spark: SparkSession, root: str, slug: str, tables: str | None = None, embedder: Embedder | None = None):
        self.spark, self.root, self.slug = spark, root.rstrip("/"), slug
        self.embedder = embedder or HashEmbedder()
        self.at = (tables or index_folder(spark)).rstrip("/") + "/" + slug
        self.table = store.VersionedTable(spark, self.at)
        self.words = store.VersionedTable(spark, self.at + "-words", ("token",))
        self.near = vector_index.VectorIndex(spark, self.at + "-vectors")
        self.impacts = impact_index.ImpactIndex(spark, self.at + "-impacts")
        self.locks, self.moves, self.building = PathLocks(), threading.Lock(), threading.Lock()

    # ---- reading

    def files(self, content: bool = True) -> DataFrame:
        """All files, with text content where it is valid enough to show, or names and sizes only."""
        rows = read_vault(self.spark, self.root, self.slug, entries="all", content="true" if content else "false")
        return rows.where("type = 'file'").withColumn("content_type", mime(F.col("path"))).withColumn("raw", F.col("content")).withColumn("content", lenient_utf8(F.col("raw")))

    def read_bytes(self, path: str) -> tuple[str, os.stat_result, bytes]:
        path = safe_path(path)
        check_contained(self.root, path)
        try:
            info, data = read_regular(self.root, path)
        except Gone as e:
            raise NotFound(path) from e
        return path, info, data

    def read_file(self, path: str) -> dict:
        path, info, data = self.read_bytes(path)
        row = self.spark.createDataFrame([(path, bytearray(data))], "path string, raw binary")
        row = row.select("path", mime(F.col("path")).alias("content_type"), lenient_utf8(F.col("raw")).alias("content"), F.sha2("raw", 256).alias("sha256")).first()
        return {**row.asDict(), "raw": data, "size": len(data), "mtime_ms": info.st_mtime_ns // 1_000_000}

    def read_note(self, path: str) -> dict:
        """A note as fields and body; other text as it is, and what is no text as base64."""
        row = self.read_file(path)
        try:
            text = row["raw"].decode("utf-8")
        except UnicodeDecodeError:
            return {"path": row["path"], "encoding": "base64", "content": base64.b64encode(row["raw"]).decode()}
        if row["content_type"] != "text/markdown":
            return {"path": row["path"], "encoding": "utf-8", "content": text}
        fields, body = chunking.split_frontmatter(text)
        return {"path": row["path"], "encoding": "utf-8", "content": body, "frontmatter": fields}

    def status(self) -> dict:
        """Documents, chunks and state of the index."""
        rows = self.table.read(self.embedder.dim)
        if rows is None:
            return {"slug": self.slug, "state": "starting", "documents": 0, "chunks": 0}
        return {"slug": self.slug, "state": "ready", **store.document_count(rows).first().asDict()}

    def chunks(self, prefix: str | None = None) -> DataFrame:
        """The indexed chunks; with a prefix, of the pieces that may hold such paths."""
        rows = self.table.read(self.embedder.dim, prefix)
        if rows is None:
            raise NotFound(f"{self.slug} is not indexed")
        return rows

    def search(self, query: str, **options) -> DataFrame:
        """Hits with their chunks. The text arm reads the kept postings of the query's words."""
        chosen = search.SearchOptions(**options).checked(query)
        vector = [float(x) for x in self.embedder.embed([query])[0]]
        one = self.spark.range(1).select(F.lit(vector).cast("array<float>").alias("query"))
        words = self.spark.range(1).select(search.tokens(F.lit(query)).alias("w")).first()["w"]
        chunks = self.chunks(chosen.path_prefix)
        near = scored = None
        if chosen.path_prefix is None and chosen.tag is None:  # the indexes are of everything
            mark, k = self._mark(), search.candidates(chosen)
            if chosen.mode != "fts" and (self.near.current() or {}).get("mark") == mark:
                near = self.near.search(vector, k)
            if chosen.mode != "vector" and (self.impacts.current() or {}).get("mark") == mark:
                scored, _ = self.impacts.scored(words, k)
        hits = search.search(chunks, one, words, chosen, self.words.read(prefix=chosen.path_prefix), near, scored)
        return hits.join(chunks.select("id", "chunk_index", "heading_path", "text", "links", "tags", safe_json(F.col("frontmatter")).alias("frontmatter")), "id").orderBy("position")

    def texts(self) -> DataFrame:
        return self.files().where(F.col("content_type").startswith("text/") | F.col("content_type").isin(*TEXT_TYPES))

    def grep(self, pattern: str, **options) -> tuple[DataFrame, DataFrame]:
        return grep.grep(self.texts(), grep.GrepOptions(pattern, **options))

    def grep_now(self, pattern: str, seconds: float = GREP_SECONDS, prefix: str = "", **options) -> dict:
        """Matches found in time, in path and line order, with counters and the reason of a cut. At
        most GREPS run at once; waiting for a turn counts."""
        files = self.texts().where(F.startswith("path", F.lit(prefix)))
        return grep.run(files, grep.GrepOptions(pattern, **options), seconds, _GREP_SLOTS)

    def tags(self, limit: int = 100, prefix: str | None = None) -> DataFrame:
        return store.top_tags(self.chunks(prefix), limit, prefix)

    def paths(self, prefix: str = "", recursive: bool = True, kind: str | None = None, cursor: str | None = None, limit: int = listing.PAGE) -> DataFrame:
        rows = read_vault(self.spark, self.root, self.slug, entries="all", content="false").drop("content")
        return listing.page(listing.listed(rows, prefix, recursive, kind), cursor, limit)

    def resources(self, cursor: str | None = None, limit: int = listing.PAGE) -> DataFrame:
        return listing.resources(self.files(content=False).drop("content", "raw"), cursor, limit)

    # ---- indexing

    def index(self) -> dict[str, int]:
        """Brings the index up to date with the files. Notes of an unchanged time are not opened, those
        of an unchanged hash not chunked."""
        self.finish_moves()
        if self.table.reconcile() == "reset":
            self.words.reconcile()
            self.words._remove(*self.words._names("pointer-"))
        seen = read_vault(self.spark, self.root, self.slug, content="false").select("path", "mtime_ms")
        old = self.table.read(self.embedder.dim)
        if old is None:
            self._store(contents(self.spark, self.root, seen), None)
        else:
            known = store.fingerprints(old)
            later = seen.join(known.select("path", F.col("mtime_ms").alias("known")), "path", "left").where("known IS NULL OR known <> mtime_ms")
            read = contents(self.spark, self.root, later)
            actions = store.classify(read.select("path", "mtime_ms", "sha256"), known).where("action IN ('new', 'changed')")
            self._store(read.join(actions.select("path"), "path", "left_semi"), store.swept(old, seen))
        return store.document_count(self.chunks()).first().asDict()

    def _mark(self) -> str:
        """The state of both tables that an index is made of."""
        return f"{(self.table.current() or {}).get('version')} {(self.words.current() or {}).get('version')}"

    def build_indexes(self) -> bool:
        """Makes the vector index and the impact index of what is stored now, one build at a time; false
        if there are fewer rows than an index is worth. Searches without filters use them until the
        next change, and scan as before from then on."""
        with self.building:
            chunks, mark = self.chunks(), self._mark()
            stats = chunks.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
            if stats.first()["n"] < vector_index.LEAST_ROWS:
                return False
            if (self.near.current() or {}).get("mark") != mark:
                self.near.build(chunks, mark=mark)
            if (self.impacts.current() or {}).get("mark") != mark:
                self.impacts.build(self.words.read(), stats, mark)
            return True

    def _store(self, notes: DataFrame, gone: DataFrame | None) -> None:
        """Chunks and postings of the notes in, rows of what is gone out. The batch is written to a
        table first, each note being read once: files may change meanwhile, and both tables must say
        the same."""
        staged = store.VersionedTable(self.spark, f"{self.at}-staged/{uuid.uuid4().hex}")
        try:
            rows = chunking.chunk_notes(notes.withColumn("content", lenient_utf8(F.col("content"))), every=True)
            rows = with_vectors(rows, self.embedder).withColumn("doc_len", F.size(search.tokens(F.col("embed_text"))))
            rows.write.parquet(f"{staged.root}/rows")
            read = self.spark.read.schema(rows.schema).parquet(f"{staged.root}/rows")
            made, changed = read.where("chunk_index IS NOT NULL"), read.select("path").distinct()
            if gone is not None:
                gone.select("path").write.parquet(f"{staged.root}/gone")
                changed = changed.unionByName(self.spark.read.schema("path string").parquet(f"{staged.root}/gone"))
            retried(lambda: self.words.upsert(changed, search.postings(made)))
            retried(lambda: self.table.upsert(changed, made, self.embedder.dim))
        finally:
            staged.remove()

    def _follow(self, written: Iterable[str] = (), gone: Iterable[str] = (), folders: Iterable[str] = ()) -> bool:
        """The index after a file change. Requested drops spare paths that hold a note by now. False if
        it failed; nothing to do before the first index()."""
        try:
            old = self.table.read(self.embedder.dim)
            if old is None:
                return False
            one = lambda paths: self.spark.createDataFrame([(p,) for p in paths], "path string")
            wanted = one(written).where(is_indexable(F.col("path")))
            drops = one(gone)
            for folder in folders:
                drops = drops.unionByName(old.where(under(F.col("path"), folder)).select("path"))
            notes = contents(self.spark, self.root, wanted.unionByName(drops.where(is_indexable(F.col("path")))).distinct())
            self._store(notes, store.guarded_drops(drops.unionByName(wanted), notes))
            return True
        except Exception:
            log.warning("the index of %s does not follow a change; the next run mends it", self.slug, exc_info=True)
            return False

    def apply_changes(self, upserts: DataFrame, removed: DataFrame) -> None:
        """One micro-batch of file events. A removed path that holds a note again is read instead."""
        old = self.table.read(self.embedder.dim)
        notes = upserts.select("path", "content", "mtime_ms", "sha256")
        back = contents(self.spark, self.root, removed.where(is_indexable(F.col("path"))))
        if old is not None:
            notes = store.fresh(notes, store.fingerprints(old))
        notes = notes.unionByName(back.select("path", "content", "mtime_ms", "sha256")).dropDuplicates(["path"])
        self._store(notes, store.guarded_drops(removed, notes))

    def changes(self) -> Changes:
        """Versions of the vault's listing; poll() makes the next one."""
        return Changes(self.spark, f"{self.at}-changes", self.root)

    def follow(self, checkpoint: str, **trigger) -> StreamingQuery:
        """The index follows the versions as they appear; events.drain() stops it. Of a path only its
        last event in a batch counts, and what is on disk by then."""

        def batch(events: DataFrame, _: int) -> None:
            last = events.groupBy("path").agg(F.max_by("kind", "version").alias("kind")).persist()
            try:
                if not last.isEmpty():
                    notes = contents(self.spark, self.root, last.where(is_indexable(F.col("path"))))
                    self._store(notes, store.guarded_drops(last, notes))
            finally:
                last.unpersist()

        rows = self.changes().stream().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return rows.trigger(**(trigger or {"availableNow": True})).start()

    # ---- changes of files

    def _at(self, path: str) -> Path:
        return safe_join(self.root, path)

    def _put(self, path: str, data: bytes) -> None:
        """The file appears whole, by a rename beside it."""
        with parents(self.root, path) as at:
            if at.is_dir():
                raise InvalidPath(f"{path} is a folder")
            tmp = at.with_name(f".{at.name}.{uuid.uuid4().hex}.tmp")
            try:
                tmp.write_bytes(data)
                os.replace(tmp, at)
            finally:
                tmp.unlink(missing_ok=True)

    def write_file(self, path: str, content: str, frontmatter: dict | None = None, encoding: str = "utf-8") -> bool:
        """Whether the index followed, as of every change."""
        path = safe_path(path)
        if encoding == "base64":
            if frontmatter:
                raise InvalidBody("frontmatter goes with text")
            try:
                data = base64.b64decode(content, validate=True)
            except ValueError as e:
                raise InvalidBody("bad base64") from e
        elif encoding == "utf-8":
            if frontmatter:
                content = "---\n" + "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in frontmatter.items()) + "\n---\n\n" + content
            data = content.encode("utf-8")
        else:
            raise InvalidBody(f"no encoding {encoding}")
        with self.locks.held(path):
            self._put(path, data)
            return self._follow([path])

    def append_file(self, path: str, content: str) -> bool:
        path = safe_path(path)
        with self.locks.held(path):
            _, _, data = self.read_bytes(path)
            self._put(path, data + content.encode("utf-8"))
            return self._follow([path])

    def patch_file(self, path: str, edits: list[tuple[str, str, bool]]) -> bool:
        """Ordered (old, new, all) edits, all or none."""
        path = safe_path(path)
        with self.locks.held(path):
            text = self.read_bytes(path)[2].decode("utf-8")
            for i, (old, new, every) in enumerate(edits):
                if not old or old == new:
                    raise InvalidInput("an edit changes something", edit=i)
                n = text.count(old)
                if n == 0:
                    raise PatchNoMatch(path, edit=i)
                if n > 1 and not every:
                    raise PatchAmbiguous(path, edit=i, occurrences=n)
                text = text.replace(old, new)
            self._put(path, text.encode("utf-8"))
            return self._follow([path])

    def create_folder(self, path: str) -> bool:
        """True if it is new."""
        with parents(self.root, path) as at:
            if at.is_dir():
                return False
            if at.exists():
                raise AlreadyExists(path)
            at.mkdir()
            return True

    def delete_path(self, path: str) -> bool:
        path = safe_path(path)
        with self.locks.held(path):
            info = check_contained(self.root, path)
            if info is None:
                raise NotFound(path)
            if check_source(info, path) == "folder":
                shutil.rmtree(self._at(path))
                return self._follow(folders=[path])
            self._at(path).unlink()
            return self._follow(gone=[path])

    def _check_target(self, src: str, dst: str, overwrite: bool = False) -> tuple[str, bool]:
        """(type of the source, whether the target is overwritten)."""
        info = check_contained(self.root, src)
        if info is None:
            raise NotFound(src)
        kind = check_source(info, src)
        if dst == src or dst.startswith(src + "/"):
            raise InvalidInput("the target would lie in the source")
        there = check_contained(self.root, dst)
        if there is not None and not (overwrite and kind == "file" and check_source(there, dst) == "file"):
            raise AlreadyExists(dst)
        return kind, there is not None

    def copy_path(self, src: str, dst: str, overwrite: bool = False) -> dict:
        """files and skipped (links and other types) of the copy, and whether the index followed.
        Hidden names stay behind."""
        src, dst = safe_path(src), safe_path(dst)
        with self.locks.held(src, dst):
            kind, _ = self._check_target(src, dst, overwrite)
            if kind == "file":
                self._put(dst, self.read_bytes(src)[2])
                return {"files": 1, "skipped": 0, "indexed": self._follow([dst])}
            done, skipped = [], 0
            with parents(self.root, dst) as to:
                to.mkdir()
            for folder, names, files in os.walk(self._at(src)):
                names[:] = sorted(n for n in names if not n.startswith("."))
                rel = os.path.relpath(folder, self._at(src))
                base = dst if rel == "." else f"{dst}/{rel}"
                for n in list(names):
                    if os.path.islink(os.path.join(folder, n)):
                        skipped += 1
                        names.remove(n)
                    else:
                        (Path(self.root) / base / n).mkdir(exist_ok=True)
                for n in sorted(f for f in files if not f.startswith(".")):
                    try:
                        _, data = read_regular(folder, n)
                    except Gone:
                        skipped += 1
                        continue
                    self._put(f"{base}/{n}", data)
                    done.append(f"{base}/{n}")
            return {"files": len(done), "skipped": skipped, "indexed": self._follow(done)}

    def plan_move(self, src: str, dst: str) -> DataFrame:
        notes = self.files().where(F.col("content_type") == "text/markdown").select("path", "content", "raw")
        # a note that is no UTF-8 is never rewritten
        notes = notes.where(F.is_valid_utf8(F.col("raw").cast("string"))).select("path", "content")
        return links.plan_move(self.files(content=False).select("path"), notes, safe_path(src), safe_path(dst))

    def move_path(self, src: str, dst: str, overwrite: bool = False) -> Moved:
        """Moves a file or folder and rewrites the links that would break: {path: links} of notes.

        The rewritten notes are staged, one at a time, beside a journal before anything moves; a move
        that was cut off is finished by finish_moves(), which index() calls.
        """
        src, dst = safe_path(src), safe_path(dst)
        with self.moves, self.locks.held(src, dst):
            kind, replaced = self._check_target(src, dst, overwrite)
            plan = self.plan_move(src, dst).persist()  # of the few notes with a link to what moves
            notes = self.files().where(F.col("content_type") == "text/markdown").select("path", "content")
            journal = self._journals() / uuid.uuid4().hex
            journal.mkdir(parents=True)
            out, lines = Moved(), []
            for row in links.rewrite(notes, plan).toLocalIterator():
                (journal / str(len(lines))).write_text(row["content"], encoding="utf-8", newline="")
                lines.append(row["path"])
                out[row["path"]] = row["links"]
            out.skipped = tuple(sorted(r["source"] for r in plan.where("new_linkpath IS NULL").select("source").distinct().toLocalIterator()))
            plan.unpersist()
            inode = os.lstat(self._at(src)).st_ino
            (journal / "tmp").write_text(json.dumps({"src": src, "dst": dst, "inode": inode, "notes": lines}))
            os.replace(journal / "tmp", journal / "ready")
            with parents(self.root, dst) as to:
                os.rename(self._at(src), to)
            self._finish(journal)
            moved = [dst] if kind == "file" else [f"{dst}/{p}" for t, p in self._walk(dst) if t == "file"]
            follows = self._follow([*moved, *lines], gone=[src] + [dst] * replaced, folders=[src] if kind == "folder" else [])
            out.indexed, out.type = follows and bool(moved), kind
            return out

    def _walk(self, folder: str):
        from notelattice.sources.vault import walk

        return walk(str(self._at(folder)), notes_only=False)

    def _journals(self) -> Path:
        """In the vault under a hidden name, which no listing shows: the same file system."""
        return Path(self.root) / ".moves"

    def _finish(self, journal: Path) -> None:
        plan = json.loads((journal / "ready").read_text())

        def put(pair: tuple[int, str]) -> None:
            staged = journal / str(pair[0])
            if staged.exists():
                self._put(pair[1], staged.read_bytes())
                staged.unlink()

        map_in_order(put, enumerate(plan["notes"]))
        shutil.rmtree(journal)
        try:
            journal.parent.rmdir()
        except OSError:  # another move's journal is there
            pass

    def finish_moves(self) -> int:
        """Finishes moves that were cut off after the rename (the target is what the source was), and
        forgets those that were cut off before."""
        done = 0
        for journal in sorted(self._journals().glob("*")) if self._journals().is_dir() else []:
            plan = json.loads((journal / "ready").read_text()) if (journal / "ready").exists() else None
            there = plan and check_contained(self.root, plan["dst"])
            if there and there.st_ino == plan["inode"] and check_contained(self.root, plan["src"]) is None:
                self._finish(journal)
                done += 1
            else:
                shutil.rmtree(journal)
        return done

    def scoped(self, prefix: str) -> ScopedVault:
        return ScopedVault(self, safe_path(prefix) if prefix else "")


def parse_scope(segments: list[str], known: Callable[[str], bool]) -> tuple[str, str]:
    """(slug, prefix) of the percent-encoded segments of a scope. They are decoded once; an encoded
    separator, a bad escape or an unsafe prefix is an error, and no prefix is the whole vault."""
    decoded = []
    for raw in segments:
        if re.search(r"%(?![0-9A-Fa-f]{2})", raw):
            raise InvalidPath("bad escape in a scope")
        try:
            part = unquote(raw, errors="strict")
        except UnicodeDecodeError as e:
            raise InvalidPath("bad escape in a scope") from e
        if "/" in part or "\\" in part:
            raise InvalidPath("an encoded separator in a scope")
        decoded.append(part)
    if not decoded:
        raise InvalidPath("a scope names a vault")
    rest = [p for p in decoded[1:] if p not in ("", ".")]
    prefix = safe_path("/".join(rest)) if rest else ""
    if not known(decoded[0]):
        raise VaultNotFound(decoded[0])
    return decoded[0], prefix


class ScopedVault:
    """A vault seen from one of its folders: paths go in and come out without the prefix, and nothing
    outside of it is reached. Links are still resolved over the whole vault."""

    def __init__(self, vault: Vault, prefix: str):
        self.vault, self.prefix = vault, prefix
        self.lead = prefix + "/" if prefix else ""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ScopedVault) and (self.vault.slug, self.prefix) == (other.vault.slug, other.prefix)

    def __hash__(self) -> int:
        return hash((self.vault.slug, self.prefix))

    def _in(self, path: str) -> str:
        return self.lead + safe_path(path)

    def _out(self, rows: DataFrame) -> DataFrame:
        return listing.scoped(rows, self.prefix) if self.prefix else rows

    def _cursor(self, cursor: str | None) -> str | None:
        return base64.b64encode(self.lead.encode() + base64.b64decode(cursor)).decode() if cursor and self.lead else cursor

    def _page(self, rows: DataFrame) -> DataFrame:
        if not self.lead:
            return rows
        inner = F.substr(F.unbase64("next_cursor").cast("string"), F.lit(len(self.lead) + 1))
        return self._out(rows.withColumn("next_cursor", F.base64(F.encode(inner, "UTF-8"))))

    def search(self, query: str, **options) -> DataFrame:
        return self._out(self.vault.search(query, path_prefix=self.lead + (options.pop("path_prefix", None) or ""), **options))

    def grep(self, pattern: str, **options) -> tuple[DataFrame, DataFrame]:
        files = self.vault.texts().where(F.startswith("path", F.lit(self.lead)))
        found, summary = grep.grep(files, grep.GrepOptions(pattern, **options))
        return self._out(found), summary

    def tags(self, limit: int = 100, prefix: str | None = None) -> DataFrame:
        return self.vault.tags(limit, self.lead + (prefix or ""))

    def paths(self, prefix: str = "", cursor: str | None = None, **options) -> DataFrame:
        return self._page(self.vault.paths(self.lead + prefix, cursor=self._cursor(cursor), **options))

    def resources(self, cursor: str | None = None, limit: int = listing.PAGE) -> DataFrame:
        rows = self.vault.files(content=False).where(F.startswith("path", F.lit(self.lead))).drop("content", "raw")
        return self._page(listing.resources(rows, self._cursor(cursor), limit))

    def read_file(self, path: str) -> dict:
        return {**self.vault.read_file(self._in(path)), "path": safe_path(path)}

    def read_note(self, path: str) -> dict:
        return {**self.vault.read_note(self._in(path)), "path": safe_path(path)}

    def write_file(self, path: str, content: str, frontmatter: dict | None = None, encoding: str = "utf-8") -> bool:
        return self.vault.write_file(self._in(path), content, frontmatter, encoding)

    def append_file(self, path: str, content: str) -> bool:
        return self.vault.append_file(self._in(path), content)

    def patch_file(self, path: str, edits: list[tuple[str, str, bool]]) -> bool:
        return self.vault.patch_file(self._in(path), edits)

    def create_folder(self, path: str) -> bool:
        return self.vault.create_folder(self._in(path))

    def delete_path(self, path: str) -> bool:
        return self.vault.delete_path(self._in(path))

    def copy_path(self, src: str, dst: str, overwrite: bool = False) -> dict:
        return self.vault.copy_path(self._in(src), self._in(dst), overwrite)

    def move_path(self, src: str, dst: str, overwrite: bool = False) -> dict[str, int]:
        """Links rewritten in notes of the scope; those outside are rewritten too, but not told."""
        done = self.vault.move_path(self._in(src), self._in(dst), overwrite)
        return {p.removeprefix(self.lead): n for p, n in done.items() if p.startswith(self.lead)}

    def status(self, slug: str | None = None) -> dict:
        """Of the scope's own vault only; counts are the vault's."""
        if slug not in (None, self.vault.slug):
            raise VaultNotFound(slug)
        return self.vault.status()


class Vaults:
    """Vaults by slug, the tools by name, and the catalogue of notes over all of them."""

    TOOLS = ("search", "grep", "tags", "paths", "read_file", "write_file", "append_file", "patch_file", "create_folder", "delete_path", "copy_path", "move_path", "resources", "status", "index")

    def __init__(self, *vaults: Vault):
        self.by_slug = {v.slug: v for v in vaults}
        if len(self.by_slug) < len(vaults):
            raise InvalidInput("two vaults have one slug")
        self.scoped = lru_cache(maxsize=64)(self._scoped)

    def __getitem__(self, slug: str) -> Vault:
        if slug not in self.by_slug:
            raise VaultNotFound(slug)
        return self.by_slug[slug]

    def _scoped(self, *segments: str) -> ScopedVault:
        """The view of a scope, of which the 64 used last are held."""
        slug, prefix = parse_scope(list(segments), self.by_slug.__contains__)
        return self[slug].scoped(prefix)

    def tool(self, name: str) -> Callable:
        """tool(slug, ...) by name."""
        if name not in self.TOOLS:
            raise InvalidInput(f"no tool {name}")
        return lambda slug, *a, **k: getattr(self[slug], name)(*a, **k)

    def call(self, name: str, slug: str, **arguments) -> dict:
        """A tool's answer as JSON text, or its error as such."""
        try:
            got = self.tool(name)(slug, **arguments)
            if isinstance(got, tuple):
                got = {"matches": got[0], **got[1].first().asDict()}
            plain = lambda x: [r.asDict(True) for r in x.collect()] if isinstance(x, DataFrame) else x
            got = {k: plain(v) for k, v in got.items() if k != "raw"} if isinstance(got, dict) else plain(got)
            return {"isError": False, "content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, default=str)}]}
        except TypeError as e:
            return tool_error(InvalidInput(str(e)))
        except Exception as e:
            if not isinstance(e, VaultError):
                log.exception("tool %s failed", name)
            return tool_error(e)

    def resources(self, cursor: str | None = None, limit: int = listing.PAGE) -> dict:
        """A page of notes of one vault, and the cursor of the next page or vault. A page may be empty
        and still have a cursor; an unknown vault in a cursor ends the list."""
        slugs = list(self.by_slug)
        slug, _, inner = base64.b64decode(cursor).decode().partition("\0") if cursor else ((slugs or [""])[0], "", "")
        if slug not in self.by_slug:
            return {"resources": [], "next_cursor": None}
        files = self[slug].files(content=False).drop("content", "raw")
        rows = listing.page(files, inner or None, limit).collect()
        notes = [{"uri": f"{SCHEME}{slug}/{r['path']}", "name": r["path"], "mime_type": r["content_type"]} for r in rows if r["content_type"] == "text/markdown"]
        after = rows[0]["next_cursor"] if rows else None
        later = slugs[slugs.index(slug) + 1 :]
        following = (slug, after) if after else (later[0], "") if later else None
        return {"resources": notes, "next_cursor": base64.b64encode("\0".join(following).encode()).decode() if following else None}

    def read_resource(self, uri: str) -> dict:
        """A note by its URI; whatever can't be read so is not found."""
        slug, slash, path = uri.removeprefix(SCHEME).partition("/")
        try:
            if not uri.startswith(SCHEME) or not slash or not path:
                raise NotFound(uri)
            row = self[slug].read_file(path)
        except VaultError as e:
            raise NotFound(uri, uri=uri) from e
        if row["content_type"] != "text/markdown":
            raise NotFound(uri, uri=uri)
        return {"uri": uri, "mime_type": "text/markdown", "text": row["content"]}
