"""Array helpers of the Python stages: mixing, nearest smaller values, and batches that keep a worker small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a Python stage works on at a time, unless one text alone is longer.
SLICE_BYTES = 1 << 20


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def previous_smaller(v: np.ndarray, equal: bool = False, low: np.ndarray | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """For each place (of those given) the nearest one before it with a smaller value (or an equal one, if asked); -1 where there is none.

    All places jump at once: what stands between a place and its candidate is greater, so a candidate that is too great
    hands on its own candidate. Chains halve, so the rounds are logarithmic. ``low`` (in place): given the least of
    something between each place and the one before, it ends as the least between each place and the one found.
    """
    at = np.arange(-1, len(v) - 1)
    todo = np.arange(1, len(v)) if places is None else places
    while True:
        before = at[todo]
        keep = before >= 0
        todo, before = todo[keep], before[keep]
        greater = v[before] > v[todo] if equal else v[before] >= v[todo]
        todo, before = todo[greater], before[greater]
        if not len(todo):
            return at
        jump = at[before]
        if low is not None:
            low[todo] = np.minimum(low[todo], low[before])
        at[todo] = jump


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[range]:
    """Ranges of consecutive items of ``most`` in all, or of a single greater one."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def trimmed(part: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives the freed memory back when a task ends; workers stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from part(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
