"""Words of a column of texts, by whole-array operations on its UTF-8 bytes.

A word is a maximal run of word characters of the lower-cased text. Word characters are ``a-z``, ``0-9``
and the code points from U+00C0 on, but U+2000 to U+203F (general punctuation). As a regular expression:
``WORD``. Lower-casing never changes the number of bytes: a character whose lower case is longer or
shorter stays as it is, so offsets of words are offsets into the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[a-z0-9\x{C0}-\x{1FFF}\x{2040}-\x{10FFFF}]+"
M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
_word_byte = np.zeros(256, bool)
_word_byte[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hash of values[start:end] for each pair; equal slices have equal hashes."""
    p, inv = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=total[1:])
    h = (total[end] - total[start]) * inv[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def lower_same_size(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    changed = np.flatnonzero(np.asarray(pc.not_equal(pc.binary_length(texts), pc.binary_length(low))))
    if len(changed):
        out = low.to_pylist()
        for i in changed:
            out[i] = "".join(k if len((k := c.lower()).encode()) == len(c.encode()) else c for c in texts[i].as_py())
        low = pa.array(out, pa.string())
    return low


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets of the texts among them. Without nulls."""
    wide = texts.cast(pa.large_string())
    off = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    flat: np.ndarray  #: lower-cased bytes of all texts
    offsets: np.ndarray  #: where each text begins among them
    row: np.ndarray  #: text of each word
    start: np.ndarray  #: its first byte, among all
    end: np.ndarray
    hash: np.ndarray  #: 64 bits
    first: np.ndarray  #: first word of each text, n + 1 numbers


def words(texts: pa.Array) -> Words:
    """A null text has no words, as an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat, off = as_bytes(lower_same_size(pc.fill_null(texts, "")))
    n = len(flat)
    is_word = _word_byte[flat]
    at = np.flatnonzero(flat == 0xC2)
    is_word[at] = is_word[at + 1] = False
    at = np.flatnonzero(flat == 0xE2)
    at = at[flat[at + 1] == 0x80]
    is_word[at] = is_word[at + 1] = is_word[at + 2] = False
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    after = np.zeros(n + 1, bool)
    after[:n] = is_word
    before[off] = False
    cut = off[off > 0]
    start = np.flatnonzero(is_word & ~before[:n])
    shifted = after[1:].copy()
    shifted[cut - 1] = False
    end = np.flatnonzero(is_word & ~shifted) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(flat, off, row, start, end, spans_hash(flat, start, end), first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, in order: hash, first word, text. A text with fewer
    words, but one at least, has its whole self as its one run."""
    count = np.diff(w.first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + w.first[:-1][row]
    stop = np.minimum(at + n, w.first[1:][row])
    return spans_hash(w.hash, at, stop), at, row
