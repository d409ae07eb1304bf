"""Arrow batches in slices, so that what Python works on at once is bounded by bytes.

Spark bounds an Arrow batch by rows and by tens of megabytes. As Python objects, or copied a few times, a full
one takes a worker many times that, and an executor runs a worker for each core. A batch comes in whole;
what is made of it is made slice by slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a slice; one longer row is a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch, most: int = SLICE_BYTES) -> Iterator:
    """Runs of rows of an array or a record batch, of at most so many bytes, in order."""
    if len(batch) < 2 or batch.nbytes <= most:
        yield batch
        return
    half = len(batch) // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def sliced(work: Callable, batches: Iterator) -> Iterator:
    """work() of every slice. After its task a worker gives back the memory that it doesn't use: workers
    are reused, and others wait beside it."""
    try:
        for batch in batches:
            for part in slices(batch):
                yield work(part)
            batch = part = None  # before the next one comes in
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)
