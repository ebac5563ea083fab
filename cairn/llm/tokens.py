"""Token ids of a public byte-level BPE vocabulary, found once for each different piece of a batch of texts.

The vocabulary's pattern cuts a text into pieces (a word with the space before it, a number, a run of signs, white space),
and byte-pair encoding never crosses a piece. Here whole-array operations cut all texts of a batch, and only one of
each group of equal pieces goes through the encoder. ``encode`` yields the very ids that the encoder yields for whole texts.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cairn.llm.textkernel import spans_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
KNOWN = 3_000_000  #: pieces that an encoder remembers at most
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(path: str | None = None) -> str:
    return path or os.environ.get("CAIRN_VOCABULARY", VOCABULARY)


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


class Encoder:
    def __init__(self, path: str | None = None) -> None:
        import tiktoken

        with open(vocabulary_path(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.direct = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _lookup(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, whole: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For different pieces, given by sorted hashes: where the ids of each begin, how many they are, and all ids.
        What was found before is kept in sorted parts, the later ones smaller."""
        at, size = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        before = 0
        for known, begin, n, ids in self.parts:
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            at[hit], size[hit] = begin[i[hit]] + before, n[i[hit]]
            before += len(ids)
        new = np.flatnonzero(size < 0)
        if len(new):
            encode = self.direct._core_bpe.encode_ordinary
            found = [encode(whole[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist())]
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((x for f in found for x in f), np.uint32, int(n.sum()))
            begin = np.cumsum(n) - n
            at[new], size[new] = begin + before, n
            self.parts.append((h[new], begin, n, ids))
        flat = np.concatenate([p[3] for p in self.parts])
        while len(self.parts) > 1 and 2 * len(self.parts[-1][0]) > len(self.parts[-2][0]):
            (h1, b1, n1, i1), (h2, b2, n2, i2) = self.parts[-2:]
            order = np.argsort(both := np.concatenate([h1, h2]), kind="stable")
            self.parts[-2:] = [(both[order], np.concatenate([b1, b2 + len(i1)])[order], np.concatenate([n1, n2])[order], np.concatenate([i1, i2]))]
        if sum(len(p[0]) for p in self.parts) > KNOWN:
            self.parts = []
        return at, size, flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 offsets of the texts among them. A null text has none."""
        listed = [t or "" for t in texts.to_pylist()]
        whole = "".join(listed)
        offsets = np.r_[0, np.cumsum([len(t) for t in listed])].astype(np.int64)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(listed) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = self._cut(points, offsets)
        end = np.r_[start[1:], len(points)]
        h = spans_hash(points, start, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        at, sizes, flat = self._lookup(h[first], start[first], end[first], whole)
        n = sizes[which]
        before = np.cumsum(n) - n
        out = flat[np.repeat(at[which] - before, n) + np.arange(int(n.sum()))]
        return out, np.r_[before, len(out)][np.searchsorted(start, offsets)]

    @staticmethod
    def _cut(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces begin."""
        n = len(points)
        kind = _classes()[points]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        cut = edge[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # Of white space before something else, the last character is by itself; a plain space joins what follows.
        last = (kind == SPACE) & np.r_[kind[1:] != SPACE, True] & ~edge[1:]
        cut[last] = True
        after = np.flatnonzero(last) + 1
        joins = points[after - 1] == 32
        cut[after[joins]] = False
        # Contractions: only where an apostrophe begins a piece.
        for p in np.flatnonzero((points == 39) & cut):
            stop = offsets[np.searchsorted(offsets, p, "right")]
            for tail in (1, 2):
                if p + tail < stop and "".join(map(chr, points[p + 1 : p + 1 + tail])) in ("s", "d", "m", "t", "ll", "ve", "re"):
                    cut[p + 1 : p + 1 + tail] = False
                    if p + 1 + tail < n:
                        cut[p + 1 + tail] = True
                        if kind[p + 1 + tail] != SPACE and points[p + tail] == 32:
                            cut[p + 1 + tail] = False
                    break
        return np.flatnonzero(cut)


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)
