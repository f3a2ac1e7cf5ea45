"""Words, hashed word bags and minhashes over Arrow batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    """Runs of letters and digits after lower-casing."""
    return WORD.findall(text.lower())


class WordHashes:
    """64-bit hashes of words by way of small numbers for the words seen lately.

    Words of ``marked`` are told apart by :meth:`plain`.
    """

    def __init__(self, marked: frozenset[str] = frozenset(), most: int = 500_000) -> None:
        self.marked, self.most = marked, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros(1024, dtype=np.uint64)
        self.free = np.ones(1024, dtype=bool)

    def _learn(self, tokens: Iterable[str]) -> None:
        for t in tokens:
            if t not in self.known:
                n = len(self.known)
                if n == len(self.values):
                    self.values = np.concatenate([self.values, np.zeros(n, dtype=np.uint64)])
                    self.free = np.concatenate([self.free, np.ones(n, dtype=bool)])
                self.known[t] = n
                self.values[n] = xxhash.xxh64_intdigest(t)
                self.free[n] = t not in self.marked

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Places in ``values`` and ``free``, good until the next call."""
        try:
            return np.array(list(map(self.known.__getitem__, tokens)), dtype=np.int64)
        except KeyError:
            pass
        if len(self.known) > self.most:
            self._clear()
        self._learn(tokens)
        return np.array(list(map(self.known.__getitem__, tokens)), dtype=np.int64)

    def of(self, tokens: list[str]) -> np.ndarray:
        number = self.numbers(tokens)  # may put new arrays in place
        return self.values[number]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MUL
    return x ^ (x >> np.uint64(29))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Features of a bag: the k-th occurrence of a word gets a value of its own."""
    if len(hashes) == 0:
        return hashes
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    start = np.empty(len(s), dtype=bool)
    start[0] = True
    np.not_equal(s[1:], s[:-1], out=start[1:])
    place = np.arange(len(s), dtype=np.int64)
    first = np.maximum.accumulate(np.where(start, place, 0))
    return mix(s + (place - first).astype(np.uint64) * _MIX)


def bag_id(features: np.ndarray) -> int:
    """A signed 64-bit id that equal bags of words share."""
    value = xxhash.xxh64_intdigest(np.sort(features).tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


def hash_parameters(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    return a, b


def minhashes(bags: Iterable[np.ndarray], count: int, seed: int) -> np.ndarray:
    """``count`` minhashes (rows) of each nonempty bag (columns)."""
    bags = list(bags)
    offsets = np.cumsum([0] + [len(b) for b in bags[:-1]])
    flat = np.concatenate(bags)
    a, b = hash_parameters(count, seed)
    out = np.empty((count, len(bags)), dtype=np.uint64)
    for i in range(count):
        out[i] = np.minimum.reduceat(mix(flat * a[i] + b[i]), offsets)
    return out


def common_share(a: list[str], b: list[str]) -> float:
    """Words in common divided by words in either, counted as often as they occur."""
    counts: dict[str, int] = {}
    for w in a:
        counts[w] = counts.get(w, 0) + 1
    shared = 0
    for w in b:
        left = counts.get(w, 0)
        if left:
            shared += 1
            counts[w] = left - 1
    either = len(a) + len(b) - shared
    return shared / either if either else 0.0


def kept(shared, build):
    """What ``build`` makes of a broadcast value, made once for the life of a Python worker.

    Workers hold their broadcasts from task to task, so later tasks find it on the object.
    """
    made = shared.__dict__.get("_kept")
    if made is None:
        made = shared._kept = build(shared.value)
    return made
