"""Shared helpers of the llm operators: table access, shared scratch tables, text blocks.

Everything here is small on purpose: an operator is a function from DataFrames to a DataFrame, and
these are the few things that several of them need.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from notelattice.functions.ship import ship

#: The word separators of the contracts: space and U+0009 to U+000D.
WS = r"\x20\x09-\x0D"
#: Characters of text that a Python operator works on at once; bounds its memory, not the text.
BLOCK_CHARS = 600_000
#: Bytes of an Arrow batch of what an operator runs itself; both sides of a worker's pipe hold some.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine
    that has none gets a temporary one; on a cluster a folder of one machine would be of no use."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="scratch-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH bytes for what is run inside; the user's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, held)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, and a lost executor
    costs only the tasks it ran."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written = at
    return out


def discard(*written: DataFrame) -> None:
    """Removes tables that materialize() wrote, once nothing reads them any more."""
    for df in written:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(hadoop).delete(path, True)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column: what a worker passes on keeps its type."""
    return to_arrow_type(df.schema[column].dataType)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow, once the executors can import this package. Spark bounds a batch by bytes
    (spark.sql.execution.arrow.maxBytesPerBatch), however long its texts are. After its task a worker
    gives back the memory it doesn't use: workers are reused, and the next stage needs it."""
    ship(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return df.mapInArrow(lean, schema)


def text_blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) blocks of at most about `chars` characters from batches whose first two
    columns are doc_id and text; a null text is empty. One longer text is a block of its own."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            if texts and held + len(t) > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t) + 1
    if texts:
        yield ids, texts


class Pairs:
    """A batch for text_blocks() whose ids are any values."""

    def __init__(self, values: list, texts: pa.Array):
        self.values, self.texts = values, texts

    def column(self, i: int):
        return self if i == 0 else self.texts

    def to_pylist(self) -> list:
        return self.values


class ByteWords:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of texts as numpy arrays over its UTF-8 bytes.

    buf: all bytes, each text followed by one space; start, end: byte bounds of each word;
    doc: the index of its text; first: for each text the index of its first word (length n + 1).
    """

    def __init__(self, texts: list[str]):
        raw = (" ".join(texts) + " ").encode("utf-8", "surrogatepass")
        self.buf = np.frombuffer(raw, np.uint8)
        sep = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        size = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(size + 1)))
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, taken from running sums modulo
        2^64 and mixed; equal words have equal hashes anywhere."""
        return span_hashes(self.buf, self.start, self.end)


_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(which: str, n: int) -> np.ndarray:
    have = _POW[which]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have), 1 << 16), _BASE if which == "up" else _INV, np.uint64)
        step[0] = 1
        have = _POW[which] = np.multiply.accumulate(step)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers("down", len(buf)), out=run[1:])
    return mix64((run[end] - run[start]) * _powers("up", len(buf))[start])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes (also runs over text bounds; mask those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + words[k : k + m]
    return mix64(h)
