"""Embedders: the protocol, a deterministic hash embedder, a table embedder, a remote one."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.errors import DimensionMismatch, VaultError
from notelattice.functions.ship import ship


class Embedder(Protocol):
    """What the engine needs of a model; remote and local models plug in here."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


#: Powers of 33 modulo 2^32, the highest first: so many UTF-16 units are hashed at once.
_AT_ONCE = 1 << 14
_POWERS = np.multiply.accumulate(np.concatenate(([1], np.full(_AT_ONCE, 33))).astype(np.uint32), dtype=np.uint32)[::-1]


def string_hash(text: str) -> int:
    """h * 33 + unit over the UTF-16 units of a text, from 5381, modulo 2^32."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    h = np.uint32(5381)
    for at in range(0, len(units), _AT_ONCE):
        part = units[at : at + _AT_ONCE].astype(np.uint32)
        h = np.add(np.multiply(h, _POWERS[-1 - len(part)], dtype=np.uint32), np.sum(part * _POWERS[-len(part) :], dtype=np.uint32), dtype=np.uint32)
    return int(h)


class HashEmbedder:
    """Unit vectors from a 32-bit string hash that seeds a 32-bit xorshift; needs no model."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        x = np.array([string_hash(t) or 1 for t in texts], np.uint32)
        out = np.empty((len(texts), self.dim))
        for d in range(self.dim):
            x ^= x << np.uint32(13)
            x ^= x >> np.uint32(17)
            x ^= x << np.uint32(5)
            out[:, d] = x / 0x7FFFFFFF - 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32)


class TableEmbedder:
    """Vectors from a mapping; an unknown text is the zero vector."""

    def __init__(self, vectors: dict[str, list[float]], dim: int):
        self.vectors, self.dim = vectors, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vectors.get(t, [0.0] * self.dim) for t in texts], np.float32)


def with_vectors(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunks with `vector` of their embed_text, Arrow batch by batch; a missing one is zero."""
    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            got = embedder.embed(part.fillna("").tolist())
            short = len(part) - len(got)
            if short:
                got = np.vstack([got, np.zeros((short, embedder.dim), np.float32)])
            yield pd.Series(list(got))

    return chunks.withColumn("vector", run("embed_text"))


def backoff(attempt: int, first: float = 1.0, cap: float = 30.0) -> float:
    """Seconds to wait after a failed attempt, counted from 0."""
    return min(first * 2**attempt, cap)


class Pause:
    """Until when the calls of an executor wait: a refusal of one holds back all."""

    def __init__(self, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.clock, self.sleep, self.until, self.lock = clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            left = self.until - self.clock()
        if left > 0:
            self.sleep(left)

    def hold(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, self.clock() + seconds)


class HttpEmbedder:
    """Vectors from a remote service, through `post(texts) -> (status, vectors)`. A call takes at most
    `batch` texts, and at most `in_flight` calls run at once in a worker; their answers keep the order
    of the texts. 429 and server errors are tried again after a pause that holds all of the worker's calls,
    other failures are not. Without `dim`, the first answer says how long vectors are."""

    def __init__(
        self, post: Callable[[list[str]], tuple[int, list[list[float]]]], dim: int | None = None, batch: int = 96, attempts: int = 5,
        sleep: Callable[[float], None] = time.sleep, in_flight: int = 4, clock: Callable[[], float] = time.monotonic,
    ):
        self.post, self.dim, self.batch, self.attempts, self.sleep, self.in_flight, self.clock = post, dim, batch, attempts, sleep, in_flight, clock

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [texts[at : at + self.batch] for at in range(0, len(texts), self.batch)]
        pause = Pause(self.clock, self.sleep)
        if self.in_flight == 1 or len(parts) < 2:
            got = [self._call(p, pause) for p in parts]
        else:
            # what is asked for is bounded: a thread takes the next part when its call has ended
            with ThreadPoolExecutor(self.in_flight) as pool:
                got = list(pool.map(lambda p: self._call(p, pause), parts))
        rows = [v for part in got for v in part]
        if self.dim is None and rows:
            self.dim = len(rows[0])
        odd = next((len(v) for v in rows if len(v) != self.dim), None)
        if odd is not None:
            raise DimensionMismatch(self.dim, odd)
        return np.array(rows, np.float32).reshape(len(rows), self.dim or 0)

    def learned(self) -> HttpEmbedder:
        """This, with the length of its vectors known: asks for one if it is not."""
        if self.dim is None:
            self.embed(["dimension"])
        return self

    def _call(self, part: list[str], pause: Pause) -> list[list[float]]:
        for attempt in range(self.attempts):
            pause.wait()
            status, vectors = self.post(part)
            if status == 200:
                return vectors
            if status != 429 and status < 500:
                break
            if attempt + 1 < self.attempts:
                pause.hold(backoff(attempt))
        raise VaultError(f"the embedder answered {status}")
