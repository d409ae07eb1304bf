"""A Merkle manifest of documents: a tree for each source, a tree over the sources, proofs of rows.

Rows are sorted by range into a checkpointed RDD, whose partitions keep their place. Counts by
partition and source give each partition the offset of its first row within that row's source, so that
a task knows the place of all its rows and builds every subtree that lies whole within it. What is
left at a partition's two ends, a few nodes a level, is dealt by coordinate (source and block of
leaves) and finished block by block; a block's top meets the others in larger blocks until the root of the
source is there. The tree over the sources is made by the same steps. The way from each such node to the
root then meets the rows of its partition once more, where the proofs are written.

A hot source is spread over as many partitions as its rows fill; no task holds more than one
partition's rows or one block's nodes. The driver gets one row for each partition.

Defined results: leaves ascend by doc_id, nulls first, equal ids by leaf hash; a null id is never tampered
with; a tree of one leaf is that leaf, and its proof is the hash of nothing unless there are other sources;
a null text stays null, an empty one is 0 bytes; repeated rows are leaves each, and full duplicates may swap
places; hashes of texts of any length are taken by Spark; an empty table gives no rows; columns other
than the five are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, map_arrow, materialize, shared_dir

FAN = 3
#: Levels that one round of blocks finishes; a block has at most FAN ** STEP partitions' or blocks' nodes.
STEP = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 5000


def framed(value: Column) -> Column:
    """A value with its UTF-8 byte count, or '-'."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(framed(text if c == "text" else F.col(c)) for c in FIELDS)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """g (the source), k (the id), leaf, extra (the leaf after tampering, where that changes it) and a
    salt that lets the range sort part equal rows."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = hit & F.contains("text", F.lit("\n"))
    rows = docs.select(*FIELDS).select(
        F.col("source").alias("g"),
        F.col("doc_id").alias("k"),
        leaf_hash(F.col("text")).alias("leaf"),
        F.when(changed, leaf_hash(F.replace("text", F.lit("\n"), F.lit("")))).alias("extra"),
        F.monotonically_increasing_id().alias("salt"),
    )
    return materialize(rows, "leaves")


def node(children: list[bytes]) -> bytes:
    """The hex hash of hex hashes."""
    return sha256(b"".join(children)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    out = 0
    while n > 1:
        n = -(-n // FAN)
        out += 1
    return out


def subtrees(run: list[bytes], lo: int, n: int) -> tuple[list[tuple[int, list[bytes]]], list[tuple[int, int, bytes]]]:
    """(levels, tops) of the leaves lo to lo + len(run) of n: for each level its first place and its
    nodes that have all their leaves here, and (level, place, hash) of the nodes whose parent has not."""
    levels, tops, size = [(lo, run)], [], n
    while size > 1:
        start, nodes = levels[-1]
        end, up = start + len(nodes), -(-size // FAN)
        first, last = -(-start // FAN), up if start + len(nodes) == size else end // FAN
        own = range(first * FAN, min(last * FAN, size)) if last > first else range(0)
        tops += [(len(levels) - 1, j, nodes[j - start]) for j in range(start, end) if j not in own]
        if not own:
            return levels, tops
        levels.append((first, [node(nodes[j * FAN - start : (j + 1) * FAN - start]) for j in range(first, last)]))
        size = up
    tops.append((len(levels) - 1, levels[-1][0], levels[-1][1][0]))
    return levels, tops


def ordered(rows: DataFrame) -> DataFrame:
    """rows sorted by range, with `part`, checkpointed: its partitions are `part` after `part`."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(rows.sparkSession))
    key = ("g", "k", "leaf", "salt")
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()).checkpoint()


def offsets(rows: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """part: (leaves of its first group in earlier parts, all leaves of its first and of its last
    group, its own rows). One row for each part."""
    counts = rows.groupBy("part", "g").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("g", "n")).alias("first"), F.max(F.struct("g", "n")).alias("last"), F.sum("n").alias("rows")).orderBy("part").collect()
    spans: list[list] = []  # (group, leaves) of groups at the ends of parts, in order
    at: dict[int, tuple[int, int, int]] = {}
    for r in ends:
        if not spans or spans[-1][0] != r["first"]["g"]:
            spans.append([r["first"]["g"], 0])
        before, first = spans[-1][1], len(spans) - 1
        spans[-1][1] += r["first"]["n"]
        if r["last"]["g"] != r["first"]["g"]:
            spans.append([r["last"]["g"], r["last"]["n"]])
        at[r["part"]] = before, first, len(spans) - 1
    return {r["part"]: (at[r["part"]][0], spans[at[r["part"]][1]][1], spans[at[r["part"]][2]][1], r["rows"]) for r in ends}


NODES = "part int, g string, n long, lo long, level int, j long, h binary"


def local_nodes(rows: DataFrame, at: dict[int, tuple[int, int, int, int]]) -> DataFrame:
    """The tops of each partition's whole subtrees (NODES), and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, g, own, first, out = None, None, [], True, []

        def flush(last: bool) -> None:
            before, first_n, last_n, _ = at[part]
            lo = before if first else 0
            n = first_n if first else last_n if last else len(own)
            out.extend((part, g, n, lo, level, j, bytes.fromhex(h.decode())) for level, j, h in subtrees(own, lo, n)[1])

        for batch in batches:
            for part_, g_, leaf in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own and g_ != g:
                    flush(False)
                    own, first = [], False
                part, g = part_, g_
                own.append(leaf.hex().encode())
            if len(out) >= ROWS:
                yield table_of(out, NODES)
                out.clear()
        if own:
            flush(True)
        if out:
            yield table_of(out, NODES)

    return map_arrow(rows.select("part", "g", "leaf"), run, NODES)


ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def packed(left: list[bytes], right: list[bytes]) -> bytes:
    """One level of a path: how many siblings stand on each side, and their digests."""
    return bytes((len(left), len(right))) + b"".join(left + right)


def unpacked(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The siblings on both sides, as hex text, level by level."""
    at = 0
    while at < len(path):
        left, right = path[at] * 32, path[at + 1] * 32
        at += 2
        yield path[at : at + left].hex().encode(), path[at + left : at + left + right].hex().encode()
        at += left + right


PATHS = "g string, level int, j long, path binary, to_level int, to_j long, to_h binary"


def finish_block(nodes: list[tuple[int, int, bytes]], n: int, most: int) -> Iterator[tuple]:
    """(level, j, path, to_level, to_j, to_h) of each node of a block: the way to the block's top, which
    is at level `most` or is the root."""
    top = min(most, height(n))
    have: dict[int, dict[int, bytes]] = {level: {} for level in range(top + 1)}
    for level, j, h in nodes:
        have[level][j] = h
    size, sizes = n, []
    for level in range(top):
        sizes.append(size)
        for up in {j // FAN for j in have[level]}:
            have[level + 1][up] = bytes.fromhex(node([have[level][j].hex().encode() for j in range(up * FAN, min((up + 1) * FAN, size))]).decode())
        size = -(-size // FAN)
    for level, j, _ in nodes:
        path, to = b"", j
        for at in range(level, top):
            run = range(to // FAN * FAN, min((to // FAN + 1) * FAN, sizes[at]))
            path += packed([have[at][x] for x in run if x < to], [have[at][x] for x in run if x > to])
            to //= FAN
        yield level, j, path, top, to, have[top][to]


def block_paths(nodes: DataFrame, most: int) -> DataFrame:
    """PATHS of nodes below `most`, dealt by the block of FAN ** most leaves that they lie in."""
    block = F.expr(f"j div cast(pow({FAN}, {most} - level) as bigint)").alias("block")
    dealt = nodes.select("g", "n", "level", "j", "h", block).repartition("g", "block").sortWithinPartitions("g", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, own, out = None, 0, [], []

        def flush() -> None:
            out.extend((at[0], *row) for row in finish_block(own, n, most))

        for batch in batches:
            for g, size, level, j, h, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and at != (g, b):
                    flush()
                    own = []
                at, n = (g, b), size
                own.append((level, j, h))
            if len(out) >= ROWS:
                yield table_of(out, PATHS)
                out.clear()
        if own:
            flush()
        if out:
            yield table_of(out, PATHS)

    return map_arrow(dealt, run, PATHS)


def ways_up(rows: DataFrame, step: int = STEP) -> DataFrame:
    """Every top of local_nodes() with `path`, its way to the root of its group, and that root `to_h`."""
    at = offsets(rows)
    reach = local_nodes(rows, at).select("part", "g", "n", "lo", "level", "j", F.lit(b"").alias("path"), F.col("level").alias("to_level"), F.col("j").alias("to_j"), F.col("h").alias("to_h"))
    reach = materialize(reach, "tops")
    tallest = max((height(max(a[1], a[2])) for a in at.values()), default=0)
    most = height(max((a[3] for a in at.values()), default=1)) + step
    spanned = any(a[0] or a[1] > a[3] or a[2] > a[3] for a in at.values())
    while spanned:
        # a node of the ragged right edge may stand higher than the blocks of this round; it waits
        open_ = reach.where(F.col("to_level") < most).select("g", "n", F.col("to_level").alias("level"), F.col("to_j").alias("j"), F.col("to_h").alias("h")).distinct()
        done = block_paths(open_, most).select(*(F.col(c).alias(f"b_{c}") for c in ("g", "level", "j", "path", "to_level", "to_j", "to_h")))
        met = reach.join(done, F.col("g").eqNullSafe(F.col("b_g")) & F.expr("to_level = b_level AND to_j = b_j"), "left")
        onto = [F.coalesce(f"b_{c}", c).alias(c) for c in ("to_level", "to_j", "to_h")]
        reach = materialize(met.select("part", "g", "n", "lo", "level", "j", F.concat("path", F.coalesce("b_path", F.lit(b""))).alias("path"), *onto), "tops")
        spanned, most = most < tallest, most + step
    return reach


def descend(levels: list[tuple[int, list[bytes]]], level: int, j: int, proof: bytes, chain: tuple | None) -> Iterator[tuple[int, bytes, tuple | None]]:
    """(place, siblings up to the root as text, the same by level and side) of all leaves below a node."""
    if not level:
        yield j, proof, chain
        return
    start, nodes = levels[level - 1]
    run = nodes[j * FAN - start : (j + 1) * FAN - start]
    for i in range(len(run)):
        left, right = b"".join(run[:i]), b"".join(run[i + 1 :])
        yield from descend(levels, level - 1, j * FAN + i, left + right + proof, (left, right, chain))


def fold(leaf: bytes, chain: tuple | None) -> bytes:
    while chain:
        leaf = sha256(chain[0] + leaf + chain[1]).hexdigest().encode()
        chain = chain[2]
    return leaf


def linked(path: bytes) -> tuple[bytes, tuple | None]:
    """A path as the text of its siblings, and as a chain for fold()."""
    steps = list(unpacked(path))
    chain = None
    for left, right in reversed(steps):
        chain = (left, right, chain)
    return b"".join(left + right for left, right in steps), chain


def packed_chain(chain: tuple | None) -> bytes:
    out = []
    while chain:
        raw = [bytes.fromhex(side.decode()) for side in chain[:2]]
        out.append(bytes((len(raw[0]) // 32, len(raw[1]) // 32)) + raw[0] + raw[1])
        chain = chain[2]
    return b"".join(out)


def each_leaf(rows: DataFrame, tops: DataFrame, emit: Callable, schema: T.StructType) -> DataFrame:
    """Rows of emit(k, leaf, extra, root of the group, proof, chain, root) for every leaf. Each partition's rows
    meet the ways up of its tops, which come first; only one group of one part is held."""
    told = tops.groupBy("part", "g", "n", "lo", "to_h", "above", "root").agg(F.collect_list(F.struct("level", "j", "path")).alias("tops"))
    heads = told.select("part", "g", F.lit(0).alias("kind"), "n", "lo", "to_h", "above", "root", "tops")
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    columns = ("part", "g", "kind", "n", "lo", "to_h", "above", "root", "tops", "k", "leaf", "extra")
    dealt = both.repartition("part").sortWithinPartitions("part", "g", "kind", "k", "leaf", "salt").select(*columns)
    fields = schema.fieldNames()
    k_type = arrow_type(rows, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple = ()
        own: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            n, lo, subroot, above, root, tops = head
            levels, _ = subtrees([leaf.hex().encode() for _, leaf, _ in own], lo, n)
            high, high_chain = linked(above)
            out = []
            for top in tops:
                proof, chain = linked(top["path"] + above) if top["path"] else (high, high_chain)
                for j, siblings, steps in descend(levels, top["level"], top["j"], proof, chain):
                    out.append(emit(*own[j - lo], subroot, siblings, steps, root))
                    if len(out) == ROWS:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [k_type if f == fields[0] else pa.bool_() if f == "verified" else pa.binary() if f == "path" else pa.string() for f in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], fields)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(2, len(columns))), strict=True):
                if row[0] == 0:
                    if own:
                        yield from flush()
                    head, own = row[1:7], []
                else:
                    own.append(row[7:])
        if own:
            yield from flush()

    return map_arrow(dealt, run, schema)


def _way(k, leaf: bytes, _extra, _subroot, _proof, chain, _root) -> tuple:
    return k, fold(leaf.hex().encode(), chain).decode(), packed_chain(chain)


def _proved(k, leaf: bytes, extra, subroot: bytes, proof: bytes, chain, root: str) -> tuple:
    folded = fold((extra or leaf).hex().encode(), chain).decode()
    return k, leaf.hex(), subroot.hex(), root, sha256(proof).hexdigest(), folded, folded == root


def merkle_manifest(docs: DataFrame, step: int = STEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    text = T.StringType()
    rows = ordered(leaves(docs))
    tops = ways_up(rows, step)
    sources = tops.select("g", "to_h").distinct()
    above = ordered(sources.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("to_h").alias("leaf"), F.lit(None).cast("binary").alias("extra"), F.lit(0).cast("long").alias("salt")))
    own = ways_up(above, step).withColumns({"above": F.lit(b""), "root": F.lit("")})
    way = T.StructType([T.StructField("source", text), T.StructField("root", text), T.StructField("path", T.BinaryType())])
    roots = materialize(each_leaf(above, own, _way, way), "roots").withColumnRenamed("path", "above")
    met = tops.join(roots, F.col("g").eqNullSafe(F.col("source"))).drop("source")
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, text) for c in names), T.StructField("verified", T.BooleanType())])
    return each_leaf(rows, met, _proved, schema)
