"""Hashes of all K-byte runs of byte strings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_FACTOR = 0x9E3779B97F4A7C15


def _sums(one: np.ndarray, k: int) -> np.ndarray:
    """Of each run of k numbers the sum of number x factor ** (how many follow in the run): of two halves, and of one more where k is odd."""
    if k == 1:
        return one
    half = _sums(one, k // 2)
    out = half[: len(half) - k // 2] * np.uint64(pow(_FACTOR, k // 2, 1 << 64)) + half[k // 2 :]
    return out[:-1] * np.uint64(_FACTOR) + one[k - 1 :] if k % 2 else out


def gram_hashes(data: bytes | np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes, as signed numbers; none if there are fewer bytes."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = _sums(raw.astype(np.uint64) + np.uint64(1), k)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def rabin_karp(content: Column, k: int, prime: int = 2147483647) -> Column:
    """The hash of every run of k characters of an ASCII string: base 256, modulo a prime."""
    code = F.transform(F.sequence(F.lit(1), F.length(content)), lambda i: F.ascii(F.substring(content, i, F.lit(1))).cast("bigint"))
    runs = F.sequence(F.lit(1), F.length(content) - (k - 1))
    run = lambda c, i: F.aggregate(F.slice(c, i, k), F.lit(0).cast("bigint"), lambda a, b: (a * 256 + b) % prime)
    # The codes are an argument, so they are worked out once a string and not for each of its runs.
    hashes = F.element_at(F.transform(F.array(code), lambda c: F.transform(runs, lambda i: run(c, i))), 1)
    return F.when(F.length(content) >= k, hashes).otherwise(F.array().cast("array<bigint>"))
