"""Bloom filters over 64-bit key hashes, filled by the executors and held as one bounded bit array."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm.arrays import trimmed

_SALT = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + np.uint64((_SALT * (level + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Level:
    """A Bloom filter: bits in uint64 words, k probes by double hashing of a 64-bit key hash."""

    def __init__(self, level: int, items: int, rate: float, max_bits: int = 1 << 40):
        self.level = level
        self.bits = min(max_bits, max(64, 64 * math.ceil(items * -math.log(rate) / math.log(2) ** 2 / 64)))
        self.k = max(1, round(-math.log2(rate)))
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)

    def places(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a, b = _mixed(h, 2 * self.level), _mixed(h, 2 * self.level + 1) | np.uint64(1)
            return (a[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(self.bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Probe by probe, each only for what passed those before."""
        out = np.zeros(len(h), dtype=bool)
        left = np.arange(len(h))
        with np.errstate(over="ignore"):
            a, b = _mixed(h, 2 * self.level), _mixed(h, 2 * self.level + 1) | np.uint64(1)
            for i in range(self.k):
                p = (a + np.uint64(i) * b) % np.uint64(self.bits)
                ok = ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
                a, b, left = a[ok], b[ok], left[ok]
        out[left] = True
        return out

    def fill(self, keys: DataFrame) -> None:
        """OR the bits of keys (column h) into words, each task first into its own rows, then by an aggregation."""
        me = self

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = np.unique(me.places(b.column(0).to_numpy().view(np.uint64)))
                word = (p >> np.uint64(6)).astype(np.int64)
                mask = np.uint64(1) << (p & np.uint64(63))
                if len(word):
                    at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                    yield pa.record_batch([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(mask, at).view(np.int64))], names=["w", "m"])

        words = keys.select("h").mapInArrow(trimmed(part), "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        self.words[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
