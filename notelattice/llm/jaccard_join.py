"""N-gram Jaccard join by MinHash prefixes, every link verified exactly.

Texts become sets of hashed word 5-grams. Equal sets are one class, known by its least document id;
only classes go on. Each class has TREES runs of DEPTH MinHash values; classes that share a run in
any tree are candidates. DEPTH is the longest at which a pair that is just similar enough is found
with a probability of RECALL or more, whatever else the table holds; more similar pairs are found
with a higher one.

Candidates are not expanded into pairs. A prefix bucket gives a star of edges to its least class, the
stars give components, and the 5-gram sets of a component, or of each of its buckets where that is
less work, meet in blocks of BLOCK classes, so that a task holds two blocks, whatever the component's
size. Within a pair of blocks all similarities come from one sparse product; what leaves a task is a
sum of links for each class and a spanning forest.

Defined results: a null or empty text has no word and is a copy of the other such texts only; a text
of one to four words is one n-gram; repeated rows are copies; rows without id take part, and a class
of such rows only has a null class_id; an empty table gives no rows; columns other than doc_id and
text are passed through by keep_one() and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import ByteWords, Pairs, discard, map_arrow, materialize, mix64, text_blocks, window_hashes

N, THRESHOLD_PCT = 5, 80
TREES, RECALL = 16, 0.9995
#: Classes of a block, and n-grams of one; a block of longer texts has fewer of them.
BLOCK, HASHES = 256, 1_000_000
#: Parts that the classes of a component of several blocks are dealt to when they learn of them.
SALTS = 64
#: Bits for each key of the bitmap that keeps texts without candidates out of a shuffle, and at most:
#: a bitmap is broadcast, so that 16 MB bound it.
KEY_BITS, MOST_BITS = 32, 1 << 27


def recall(similarity: float, depth: int) -> float:
    """The probability that a pair of this similarity shares a run in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


DEPTH = max(d for d in range(1, 9) if recall(THRESHOLD_PCT / 100, d) >= RECALL)
_SEED = np.random.default_rng(20240229)
_MUL = _SEED.integers(1, 1 << 63, (TREES, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, (TREES, DEPTH), dtype=np.uint64)


def shingles(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct n-gram hashes of each text, one text after another."""
    w = ByteWords(texts)
    h = w.hashes()
    win = window_hashes(h, n)
    whole = w.doc[: len(win)] == w.doc[n - 1 :] if len(win) else np.empty(0, bool)
    doc, value = [w.doc[: len(win)][whole]], [win[whole]]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):  # all words of a short text, with their number
        doc.append(short)
        value.append(np.array([mix64(np.array([hash_all(h[w.first[i] : w.first[i + 1]])], np.uint64))[0] for i in short], np.uint64))
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[first], value[first]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), value


def hash_all(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
    return out


def set_keys(bounds: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, as two int64; (0, 0) of the empty one."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        k = np.zeros(len(bounds) - 1, np.uint64)
        if len(full):
            k[full] = np.add.reduceat(mix64(value ^ np.uint64(salt)), bounds[full])
        out.append(k.view(np.int64))
    return out[0], out[1]


def prefixes(bounds: np.ndarray, value: np.ndarray) -> np.ndarray:
    """[set, tree] hashes of a tree's MinHash values; only sets that are not empty."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(full), TREES), np.uint64)
    if not len(full):
        return out.view(np.int64)
    at = bounds[full]
    for t in range(TREES):
        for d in range(DEPTH):
            low = np.minimum.reduceat(value * _MUL[t, d] + _ADD[t, d], at)
            out[:, t] = mix64(out[:, t] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), k1, k2, n and trees of every document."""
    kinds = [("th", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("n", T.LongType()), ("trees", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, t) for n, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs, texts in text_blocks(_paired(batches)):
            bounds, value = shingles(texts)
            n = np.diff(bounds)
            k1, k2 = set_keys(bounds, value)
            ends = np.concatenate(([0], np.cumsum((n > 0) * TREES))).astype(np.int32)
            trees = pa.ListArray.from_arrays(ends, pa.array(prefixes(bounds, value).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(k1), pa.array(k2), pa.array(n), trees], schema.names)

    return map_arrow(_hashed(docs), run, schema)


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h")).alias("p"), text.alias("text"))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[Pairs]:
    """The struct column as pairs, which text_blocks() passes on."""
    for b in batches:
        p = b.column(0)
        yield Pairs(list(zip(p.field(0).to_pylist(), p.field(1).to_pylist(), strict=True)), b.column(1))


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least node that each node of edges (a, b) is connected with; a < b, 64-bit.

    Rounds of contraction: every node hooks to its least smaller neighbour, hooks are followed twice,
    and the edges between what is left go on. Stars, the usual case, take one round.
    """
    spark = edges.sparkSession
    edges = materialize(edges.distinct(), "edges")
    whole = None
    while not edges.isEmpty():
        up = first = materialize(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c")), "hooks")
        for _ in range(2):
            over = up.select(F.col("v").alias("v2"), F.col("c").alias("c2"))
            up = up.join(over, F.col("c") == F.col("v2"), "left").select("v", F.coalesce("c2", "c").alias("c"))
        up = materialize(up, "hooks")
        discard(first)
        a = up.select(F.col("v").alias("va"), F.col("c").alias("ca"))
        b = up.select(F.col("v").alias("vb"), F.col("c").alias("cb"))
        moved = edges.join(a, F.col("a") == F.col("va"), "left").join(b, F.col("b") == F.col("vb"), "left")
        moved = moved.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
        last, edges = edges, materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(last)
        if whole is None:
            whole = up
        else:
            old = whole.join(a, F.col("c") == F.col("va"), "left").select("v", F.coalesce("ca", "c").alias("c"))
            last, whole = whole, materialize(old.unionByName(up.join(whole.select("v"), "v", "left_anti")), "hooks")
            discard(last, up)
    return whole if whole is not None else spark.createDataFrame([], "v long, c long")


def link_blocks(left: list[tuple], right: list[tuple] | None) -> list[tuple]:
    """Links between two blocks of (v, k1, k2, copies, earlier, hashes), or within one: for each
    member (v, k1, k2, root, links). root is the least v that it is linked with here. A pair that
    shares one of its earlier runs has met there and does not count here."""
    rows = left + (right or [])
    n, cut = len(rows), len(left)
    sizes = np.array([len(r[5]) for r in rows], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, index, count = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
    shared = count[index] > 1
    owner, index = owner[shared], index[shared]
    number = np.cumsum(count > 1) - 1
    index = number[index]
    total = int((count > 1).sum())
    both = np.zeros((n, n), np.float32)
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    step = 4096
    edges = np.searchsorted(index, np.arange(0, total + step, step))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        m = np.zeros((n, min(step, total - k * step)), np.float32)
        m[owner[part], index[part] - k * step] = 1
        both += m @ m.T
    inter = np.rint(both).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = 100 * inter >= THRESHOLD_PCT * union
    np.fill_diagonal(linked, False)
    if right is not None:
        linked[:cut, :cut] = False
        linked[cut:, cut:] = False
    for run in np.array([r[4] for r in rows], np.int64).T:
        linked &= run[:, None] != run[None, :]
    copies = np.array([r[3] for r in rows], np.int64)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_v = sorted(range(n), key=lambda i: rows[i][0])
    rank = {i: k for k, i in enumerate(by_v)}
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
        a, b = find(i), find(j)
        if a != b:
            lo, hi = (a, b) if rank[a] < rank[b] else (b, a)
            parent[hi] = lo
    links = linked @ copies
    return [(*r[:3], rows[find(i)][0], int(links[i])) for i, r in enumerate(rows) if linked[i].any()]


RESULT = "v long, k1 long, k2 long, root long, links long"


def verify(members: DataFrame) -> DataFrame:
    """Links of members (m, hashes), block by block in each of their places; see links_of()."""
    placed = members.select("m.v", "m.k1", "m.k2", "m.copies", "m.trees", F.explode("m.places").alias("at"), "hashes").select("at.*", "v", "k1", "k2", "copies", "trees", "hashes")
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    earlier = F.expr("coalesce(slice(trees, 1, greatest(tree, 0)), cast(array() as array<bigint>))").alias("earlier")
    pairs = pairs.select("tree", "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "v", "k1", "k2", "copies", earlier, "hashes")
    dealt = pairs.repartition("tree", "comp", "lo", "hi").sortWithinPartitions("tree", "comp", "lo", "hi", "block", "v")

    def flush(group: list[tuple], lo: int, hi: int) -> list[tuple]:
        seen, parts = set(), ([], [])
        for block, *row in group:
            if (row[1], row[2]) not in seen:  # rows of one id and text may be repeated
                seen.add((row[1], row[2]))
                parts[block != lo].append((*row[:5], np.frombuffer(row[5], np.uint64)))
        if lo == hi:
            return link_blocks(parts[0], None) if len(parts[0]) > 1 else []
        return link_blocks(*parts) if parts[0] and parts[1] else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "k1", "k2", "root", "links"]
        group, at, out = [], None, []
        for batch in batches:
            for tree, comp, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (tree, comp, lo, hi):
                    if group:
                        out += flush(group, *at[2:])
                    group, at = [], (tree, comp, lo, hi)
                group.append(tuple(row))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []
        if group:
            out += flush(group, *at[2:])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return map_arrow(dealt, run, RESULT)


def bits_for(keys: int) -> int:
    """The size of the bitmap of so many keys."""
    return min(max(1 << (keys * KEY_BITS).bit_length(), 1 << 15), MOST_BITS)


def marks(keys: DataFrame, bits: int, *columns: str) -> DataFrame:
    """(bucket, map): a bitmap with the hashes of these columns, in pieces of 4 KB."""
    s = keys.select(F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("s")).distinct()
    # numbers are dealt, 8 bytes each, before there are bitmaps of 4 KB
    dealt = s.withColumn("bucket", F.bitmap_bucket_number("s")).repartition("bucket")
    return dealt.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("map"))


def marked(rows: DataFrame, bitmap: DataFrame, bits: int, *columns: str) -> DataFrame:
    """rows with a column `mark`: whether the bitmap may hold their hash. False is certain."""
    s = F.pmod(F.xxhash64(*columns), F.lit(bits))
    at = F.bitmap_bit_position(s)
    byte = F.conv(F.hex(F.substring("map", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    met = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(s) == F.col("bucket"), "left")
    bit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int"))
    return met.select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias("mark"))


def with_hashes(docs: DataFrame, members: DataFrame, count: int) -> DataFrame:
    """(m, hashes): members and the 5-gram hashes of their document, found by id and text hash. Only
    texts that a bitmap of the members lets through are shuffled: the few that have candidates, and
    others as the bitmap fills, which costs time and changes nothing else."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    texts = marked(texts, marks(members, bits_for(count), "doc_id", "th"), bits_for(count), "i", "h").where("mark")
    met = texts.join(members, F.expr("i <=> doc_id AND h = th")).select(F.struct("v", "k1", "k2", "copies", "trees", "places").alias("m"), "text")
    schema = T.StructType([met.schema["m"], T.StructField("hashes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0)
            keys = list(zip(m.field("k1").to_pylist(), m.field("k2").to_pylist(), strict=True))
            for rows, texts in text_blocks(iter([Pairs(list(range(len(m))), batch.column(1))])):
                bounds, value = shingles(texts)
                k1, k2 = set_keys(bounds, value)
                keep = [i for i, r in enumerate(rows) if keys[r] == (int(k1[i]), int(k2[i]))]
                if keep:
                    hashes = pa.array([value[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())
                    yield pa.RecordBatch.from_arrays([m.take(pa.array([rows[i] for i in keep])), hashes], ["m", "hashes"])

    return map_arrow(met, run, schema)


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links of classes (RESULT rows).

    A component's classes meet in blocks, or its prefix buckets' do, each for itself: whichever moves
    fewer rows, which is also fewer comparisons. A group of near copies shares most of its buckets
    and is one place; a long chain whose ends share none is as many places as it has buckets. A place
    is (tree, comp, block, blocks); tree is -1 of a component, and comp is the prefix of a bucket."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / HASHES)).cast("int").alias("blocks")
    nodes = classes.where("n > 0").select("v", "n", F.posexplode("trees").alias("tree", "prefix"))
    hubs = nodes.groupBy(F.col("tree").alias("t2"), F.col("prefix").alias("p2")).agg(F.min("v").alias("hub"), F.count("*").alias("size"), blocks).where("size > 1")
    hubs = materialize(hubs, "hubs")
    in_bucket = F.expr("tree = t2 AND prefix = p2")
    stars = nodes.join(hubs, in_bucket).where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b"))
    comps = components(stars)
    # a component's least node has no row of its own in there
    placed = comps.unionByName(comps.select(F.col("c").alias("v"), "c").distinct()).distinct()
    found = classes.join(placed, "v")
    whole = found.groupBy(F.col("c").alias("comp")).agg(F.count("*").alias("rows"), blocks)
    apart = hubs.join(placed, F.col("hub") == F.col("v")).groupBy(F.col("c").alias("c2")).agg(F.sum(F.expr("size * blocks")).alias("moved"))
    # few components have several blocks; only those need a word on them, and are dealt by a salt
    ways = whole.where("blocks > 1").join(apart, F.expr("comp = c2")).select("comp", "blocks", F.expr("moved < rows * blocks").alias("apart"))
    ways = ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.join(ways, (F.col("c") == F.col("comp")) & (F.pmod(F.xxhash64("v"), F.lit(SALTS)) == F.col("salt")), "left")
    told = [F.col("c").alias("comp"), F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("apart", F.lit(False)).alias("apart")]
    members = materialize(dealt.select("v", "k1", "k2", "copies", "doc_id", "th", "trees", *told), "members")
    block = F.expr("cast(pmod(xxhash64(v), blocks) as int)").alias("block")
    carried = ["v", "k1", "k2", "copies", "doc_id", "th"]
    together = members.where("NOT apart").select(*carried, F.lit(None).cast("array<bigint>").alias("trees"), F.array(F.struct(F.lit(-1).alias("tree"), "comp", block, "blocks")).alias("places"))
    each = members.where("apart").select(*carried, "trees", F.posexplode("trees").alias("tree", "prefix")).join(hubs, in_bucket)
    places = F.collect_list(F.struct("tree", F.col("prefix").alias("comp"), block, "blocks")).alias("places")
    each = each.groupBy(*carried).agg(F.first("trees").alias("trees"), places)
    out = materialize(verify(with_hashes(docs, together.unionByName(each), members.count())), "links")
    discard(hubs, members)
    return out


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: doc_id, th, k1, k2 of each document. classes: k1, k2, doc_id and th of
    the representative, copies, links (documents of other classes it is linked with), group (the
    representative's id of the least class it is connected with by links) and lead (whether it is
    that class)."""
    rows = materialize(signed(docs), "signed")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("rep")
    classes = rows.groupBy("k1", "k2").agg(rep, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("trees").alias("trees"))
    classes = materialize(classes.select("k1", "k2", "rep.doc_id", "rep.th", "copies", "n", "trees", F.xxhash64("k1", "k2").alias("v")), "classes")
    found = links_of(docs, classes)
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    groups = components(found.where("v <> root").select(F.least("v", "root").alias("a"), F.greatest("v", "root").alias("b")))
    joined = classes.drop("n", "trees").join(links, ["k1", "k2"], "left").join(groups, "v", "left").withColumn("c", F.coalesce("c", "v"))
    heads = joined.where("links IS NOT NULL").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "k1", "k2")).alias("head"))
    out = joined.join(heads.withColumnRenamed("c", "c2"), F.col("c") == F.col("c2"), "left")
    lead = F.coalesce((F.col("head.k1") == F.col("k1")) & (F.col("head.k2") == F.col("k2")), F.lit(True))
    return rows, out.select("k1", "k2", "doc_id", "th", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group"), lead.alias("lead"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (its class's least document id), n_copies, group_id (the least id of the
    class it is connected with) and n_links (documents it is linked with, copies included)."""
    rows, classes = near_duplicates(docs)
    named = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("doc_id").alias("class_id"), F.col("copies").alias("n_copies"), F.col("group").alias("group_id"), "links")
    met = rows.select("doc_id", "k1", "k2").join(named, F.expr("k1 = c1 AND k2 = c2"))
    return met.select("doc_id", "class_id", "n_copies", "group_id", (F.col("links") + F.col("n_copies") - 1).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one of least id.
    Documents that a bitmap shows to be alone stay where they are; only others are shuffled."""
    rows, classes = near_duplicates(docs)
    classes = materialize(classes.select("k1", "k2", "doc_id", "th", "copies", "lead"), "leads")
    shared = classes.where("copies > 1 OR NOT lead").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "copies")
    bits = bits_for(shared.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    bitmap = materialize(marks(rows.join(shared, F.expr("k1 = s1 AND k2 = s2"), "left_semi"), bits, "doc_id", "th"), "marks")
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h"))
    mine = marked(mine, bitmap, bits, "i", "h")
    kept = marked(classes.where("lead").select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")), bitmap, bits, "r_id", "r_th").where("mark").drop("mark")
    touched = mine.where("mark").withColumns({"no": F.col("i").isNull(), "i": F.coalesce("i", F.lit(0))})
    kept = kept.withColumns({"r_no": F.col("r_id").isNull(), "r_id": F.coalesce("r_id", F.lit(0))})
    met = touched.join(kept, F.expr("i = r_id AND h = r_th AND no = r_no"))
    # repeated rows of one id and text: one stays; the join has dealt the rows by these columns
    nth = F.row_number().over(W.partitionBy("i", "h", "no").orderBy(F.lit(0)))
    return mine.where("NOT mark").select("__row.*").unionByName(met.withColumn("nth", nth).where("nth = 1").select("__row.*"))
