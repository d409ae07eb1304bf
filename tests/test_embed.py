"""Embedders: the string hash against its loop, calls that overlap, pauses that are shared."""

import threading
import time

import numpy as np
import pytest

from notelattice.errors import DimensionMismatch, VaultError
from notelattice.operators import embed


def plain_vector(text, dim):
    h = 5381
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = (h * 33 + unit) & 0xFFFFFFFF
    x, row = h or 1, []
    for _ in range(dim):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        row.append(x / 0x7FFFFFFF - 1)
    return np.array(row) / np.linalg.norm(row)


def test_hash_vectors():
    texts = ["", "a", "é 漢 \U0001f600", "x" * (embed._AT_ONCE - 1), "y" * embed._AT_ONCE, "word " * 20_000]
    got = embed.HashEmbedder(6).embed(texts)
    assert got.shape == (6, 6) and all(np.allclose(v, plain_vector(t, 6), atol=1e-6) for t, v in zip(texts, got, strict=True))
    assert embed.HashEmbedder(6).embed([]).shape == (0, 6)


class Service:
    """A slow service that counts its calls and how many run at once."""

    def __init__(self, seconds=0.05, refuse=()):
        self.seconds, self.refuse, self.lock = seconds, list(refuse), threading.Lock()
        self.calls, self.running, self.most = 0, 0, 0

    def __call__(self, texts):
        with self.lock:
            self.calls += 1
            self.running += 1
            self.most = max(self.most, self.running)
            status = self.refuse.pop(0) if self.refuse else 200
        time.sleep(self.seconds)
        with self.lock:
            self.running -= 1
        return status, [[float(t), 1.0] for t in texts] if status == 200 else []


def test_calls_overlap_and_keep_their_order():
    texts = [str(i) for i in range(160)]
    alone, many = Service(), Service()
    began = time.monotonic()
    one = embed.HttpEmbedder(alone, 2, batch=10, in_flight=1).embed(texts)
    middle = time.monotonic()
    four = embed.HttpEmbedder(many, 2, batch=10, in_flight=4).embed(texts)
    end = time.monotonic()
    assert one.tolist() == four.tolist() == [[float(i), 1.0] for i in range(160)]
    assert alone.calls == many.calls == 16 and alone.most == 1 and 2 <= many.most <= 4
    assert end - middle < 0.7 * (middle - began)


def test_a_refusal_holds_all_calls():
    now, waits, lock = [0.0], [], threading.Lock()

    def sleep(seconds):
        with lock:
            waits.append(seconds)
            now[0] += seconds

    service = Service(0, refuse=[429, 503])
    got = embed.HttpEmbedder(service, 2, batch=1, in_flight=1, sleep=sleep, clock=lambda: now[0]).embed(["1", "2"])
    assert got.tolist() == [[1.0, 1.0], [2.0, 1.0]] and waits == [1.0, 2.0] and service.calls == 4
    pause = embed.Pause(lambda: now[0], sleep)
    pause.hold(5)
    pause.hold(2)
    pause.wait()
    pause.wait()
    assert waits[2:] == [5.0]
    with pytest.raises(VaultError):
        embed.HttpEmbedder(Service(0, refuse=[400]), 2).embed(["1"])


def test_length_is_learned():
    e = embed.HttpEmbedder(lambda texts: (200, [[1.0, 2.0, 3.0]] * len(texts)))
    assert e.dim is None and e.learned().dim == 3 and e.embed([]).shape == (0, 3)
    with pytest.raises(DimensionMismatch):
        embed.HttpEmbedder(lambda texts: (200, [[1.0]] * len(texts)), 2).embed(["a"])
