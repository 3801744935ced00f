"""In-memory indexes of a few thousand vectors that change as they are searched, and their registry by name.

A sketch keeps its centroids in one. Slots are numbered in the order of ``add``; a removed slot is not used again
until ``clear``. Searching an empty index gives (-1, inf); ties go to the smallest slot.
"""

from __future__ import annotations

import bisect
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np


class UpdatableSearcher(ABC):
    """What an index has to do; ``register`` makes one known by name."""

    def __init__(self, dim: int):
        self.dim = dim
        self.clear()

    def clear(self) -> None:
        """Remove everything."""
        self.v = np.empty((16, self.dim))
        self.alive = np.zeros(16, bool)
        self.used = 0

    def size(self) -> int:
        return int(self.alive.sum())

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.v[k] for k in range(self.used) if self.alive[k])

    def add(self, x: np.ndarray) -> int:
        """Add a vector; its slot."""
        if self.used == len(self.v):
            self.v = np.concatenate([self.v, np.empty_like(self.v)])
            self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
        slot = self.used
        self.v[slot], self.alive[slot] = x, True
        self.used += 1
        self._index(slot)
        return slot

    def add_all(self, rows: np.ndarray) -> list[int]:
        return [self.add(x) for x in rows]

    def move(self, slot: int, x: np.ndarray) -> None:
        """Give a slot another vector."""
        self._drop(slot)
        self.v[slot] = x
        self._index(slot)

    def remove(self, x: np.ndarray, epsilon: float) -> bool:
        """Remove the nearest vector if it is closer than ``epsilon``."""
        slot, distance = self.nearest(np.asarray(x, float))
        if slot < 0 or not distance < epsilon:
            return False
        self._drop(slot)
        self.alive[slot] = False
        return True

    def nearest(self, x: np.ndarray) -> tuple[int, float]:
        """(slot, distance) of the best candidate."""
        found = self.search(x, 1)
        return found[0] if found else (-1, float("inf"))

    def search(self, x: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k best candidates by exact distance."""
        some = self._candidates(x)
        some = some[self.alive[some]]
        if not len(some):
            return []
        d = np.sqrt(((self.v[some] - x) ** 2).sum(1))
        best = np.lexsort((some, d))[:k] if k > 1 else [np.lexsort((some, d))[0]] if (d == d.min()).sum() > 1 else [int(d.argmin())]
        return [(int(some[b]), float(d[b])) for b in best]

    @abstractmethod
    def _candidates(self, x: np.ndarray) -> np.ndarray:
        """Slots to look at, dead ones perhaps among them."""

    def _index(self, slot: int) -> None:
        """Note a slot's vector."""

    def _drop(self, slot: int) -> None:
        """Forget a slot's vector."""


class BruteSearcher(UpdatableSearcher):
    """Looks at everything."""

    def _candidates(self, x: np.ndarray) -> np.ndarray:
        return np.arange(self.used)


class ProjectionSearcher(UpdatableSearcher):
    """Looks at ``size`` neighbours on either side in the order of each random projection."""

    def __init__(self, dim: int, projections: int = 4, size: int = 10, seed: int = 1):
        self.basis, self.reach = np.random.default_rng(seed).normal(size=(projections, dim)), size
        super().__init__(dim)

    def clear(self) -> None:
        super().clear()
        self.places: list[list[tuple[float, int]]] = [[] for _ in self.basis]

    def _index(self, slot: int) -> None:
        for line, p in zip(self.places, self.basis @ self.v[slot], strict=True):
            bisect.insort(line, (float(p), slot))

    def _drop(self, slot: int) -> None:
        for line, p in zip(self.places, self.basis @ self.v[slot], strict=True):
            at = bisect.bisect_left(line, (float(p), slot))
            if at < len(line) and line[at][1] == slot:
                del line[at]
            else:  # the product's last bits may differ
                line[:] = [e for e in line if e[1] != slot]

    def _candidates(self, x: np.ndarray) -> np.ndarray:
        out: set[int] = set()
        for line, p in zip(self.places, self.basis @ x, strict=True):
            at = bisect.bisect_left(line, (float(p), -1))
            out.update(slot for _, slot in line[max(0, at - self.reach) : at + self.reach])
        return np.array(sorted(out), int)


class HashSearcher(UpdatableSearcher):
    """Looks at the ``size`` vectors whose 64 sign bits are nearest, and those as near as the last of them."""

    def __init__(self, dim: int, size: int = 20, seed: int = 1):
        self.basis, self.reach = np.random.default_rng(seed).normal(size=(64, dim)), size
        super().__init__(dim)

    def clear(self) -> None:
        super().clear()
        self.hash = np.zeros(len(self.v), np.uint64)

    def _code(self, x: np.ndarray) -> np.uint64:
        return np.packbits(self.basis @ x > 0).view(np.uint64)[0]

    def _index(self, slot: int) -> None:
        if slot >= len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
        self.hash[slot] = self._code(self.v[slot])

    def _candidates(self, x: np.ndarray) -> np.ndarray:
        slots = np.flatnonzero(self.alive[: self.used])
        if len(slots) <= self.reach:
            return slots
        apart = np.bitwise_count(self.hash[slots] ^ self._code(x))
        return slots[apart <= np.partition(apart, self.reach - 1)[self.reach - 1]]


#: Index makers by name: each takes a dimension.
SEARCHERS: dict[str, Callable[[int], UpdatableSearcher]] = {"brute": BruteSearcher, "projection": ProjectionSearcher, "hash": HashSearcher}


def register(name: str, maker: Callable[[int], UpdatableSearcher]) -> None:
    SEARCHERS[name] = maker


def create(kind: str | Callable[[int], UpdatableSearcher], dim: int) -> UpdatableSearcher:
    return (SEARCHERS[kind] if isinstance(kind, str) else kind)(dim)
