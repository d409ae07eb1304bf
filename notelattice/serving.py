"""Small parts of serving: locks, a fair semaphore, bounded maps, retries, batches of a window."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

A, B = TypeVar("A"), TypeVar("B")


class PathLocks:
    """A lock for each key, there as long as someone holds or waits for it. Several are taken in
    order, each once, so that two callers never wait for each other."""

    def __init__(self):
        self._own = threading.Lock()
        self._held: dict[str, list] = {}

    @contextmanager
    def held(self, *keys: str) -> Iterator[None]:
        taken = []
        try:
            for key in sorted(set(keys)):
                with self._own:
                    entry = self._held.setdefault(key, [threading.RLock(), 0])
                    entry[1] += 1
                taken.append(key)
                entry[0].acquire()
            yield
        finally:
            for key in reversed(taken):
                with self._own:
                    entry = self._held[key]
                    entry[0].release()
                    entry[1] -= 1
                    if not entry[1]:
                        del self._held[key]


class FairSemaphore:
    """`slots` callers at a time; who waits longest is next."""

    def __init__(self, slots: int):
        self._own, self._free, self._waiting = threading.Lock(), slots, deque()

    def acquire(self, seconds: float | None = None) -> bool:
        """False if no slot came free in time."""
        with self._own:
            if self._free and not self._waiting:
                self._free -= 1
                return True
            turn = threading.Event()
            self._waiting.append(turn)
        if turn.wait(seconds):
            return True
        with self._own:
            if turn.is_set():  # it came just now
                return True
            self._waiting.remove(turn)
            return False

    def release(self) -> None:
        with self._own:
            if self._waiting:
                self._waiting.popleft().set()
            else:
                self._free += 1


def map_in_order(f: Callable[[A], B], items: Iterable[A], at_once: int = 4) -> list[B]:
    """f over the items by `at_once` threads; results in the items' order, the first error raised."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(f, items))


def retried(f: Callable[[], A], attempts: int = 3, wait: Callable[[int], float] = lambda n: 0.2 * (n + 1), stop: threading.Event | None = None) -> A:
    """f(), tried again after a failure; a set `stop` ends the waiting with the failure."""
    for n in range(attempts):
        try:
            return f()
        except Exception:
            if n + 1 == attempts or (stop.wait(wait(n)) if stop else time.sleep(wait(n))):
                raise
    raise AssertionError("no attempt")


class Batcher:
    """Collects items and hands them to `run` together: when `most` are there, or `seconds` after the
    first. flush() hands over what is there; stop() does so and refuses more."""

    def __init__(self, run: Callable[[list], list], most: int = 32, seconds: float = 0.1):
        self.run, self.most, self.seconds = run, most, seconds
        self._own, self._items, self._timer, self._stopped = threading.RLock(), [], None, False

    def submit(self, item) -> Callable[[], object]:
        """A function that waits for the item's result."""
        done, out = threading.Event(), {}
        with self._own:
            if self._stopped:
                raise RuntimeError("stopped")
            self._items.append((item, done, out))
            if len(self._items) >= self.most:
                self.flush()
            elif self._timer is None:
                self._timer = threading.Timer(self.seconds, self.flush)
                self._timer.daemon = True
                self._timer.start()

        def result():
            done.wait()
            if "error" in out:
                raise out["error"]
            return out["value"]

        return result

    def flush(self) -> None:
        with self._own:
            items, self._items = self._items, []
            if self._timer:
                self._timer.cancel()
                self._timer = None
        if not items:
            return
        try:
            for (_, done, out), value in zip(items, self.run([x for x, _, _ in items]), strict=True):
                out["value"] = value
        except Exception as e:  # every waiting caller gets it
            for _, _, out in items:
                out.setdefault("error", e)
        for _, done, _ in items:
            done.set()

    def stop(self) -> None:
        with self._own:
            self._stopped = True
        self.flush()
