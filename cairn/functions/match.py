"""Longest matches of texts in a dictionary: suffix array and greedy parse, by whole-array operations.

Many blocks are parsed in step: one array operation looks up the current place of each of them. The first eight bytes of
all dictionary suffixes, in suffix order, are sorted numbers, so one binary search finds the range of suffixes that share eight bytes with a
text, or else the neighbours that share most. Ranges are narrowed by eight more bytes at a time. Of all occurrences of a longest match the leftmost is
taken, which makes parses unique.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LITERAL = -1  #: offset of a literal
STRIPE = 256
MAX_DICTIONARY = 256 << 20


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that compare like the bytes; past the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)).byteswap()


def counted(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """As ``eight``, for bytes that may be zero: seven bytes from each place on and, in the last place, how many of them there are before ``stop``; so
    zeros differ from what is missing, and the shorter of two sorts first."""
    n = len(data)
    there = np.minimum(np.r_[stop - np.arange(n), 0], 7).astype(np.uint64)
    keep = ~((np.uint64(1) << ((np.uint64(8) - there) * np.uint64(8))) - np.uint64(1))
    return np.where(there > 0, (eight(data) & np.where(there > 0, keep, 0)) | there, 0)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Prefix doubling from eight bytes on. A suffix that is the beginning of another one comes first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    left = np.minimum(n - np.arange(n), 8)
    rank = np.unique(np.stack([eight(data)[:n], left.astype(np.uint64)], 1), axis=0, return_inverse=True)[1].astype(np.int64) if (data == 0).any() else np.unique(eight(data)[:n], return_inverse=True)[1].astype(np.int64)
    step = 8
    while rank.max() + 1 < n:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 1) + follow, return_inverse=True)[1].astype(np.int64)
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class LeastIn:
    """The least of values[a:b], for many ranges at once: of whole sixteens by a sparse table, of the rest by looking."""

    def __init__(self, values: np.ndarray) -> None:
        self.size = -(-max(1, len(values)) // 16)
        self.flat = np.full(self.size * 16 + 32, np.iinfo(np.int64).max)
        self.flat[: len(values)] = values
        self.levels = [self.flat[: self.size * 16].reshape(-1, 16).min(1)]
        while 2 << len(self.levels) <= 2 * self.size and len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.flat[a]
        one = b - a > 1
        if one.any():
            x, y = a[one], b[one]
            col = np.arange(16)
            top = np.iinfo(np.int64).max
            head = np.where(x[:, None] + col < y[:, None], self.flat[x[:, None] + col], top).min(1)
            tail_at = np.maximum(x, y - 16)
            tail = np.where(tail_at[:, None] + col < y[:, None], self.flat[tail_at[:, None] + col], top).min(1)
            best = np.minimum(head, tail)
            first, last = -(-x // 16), y // 16
            wide = np.flatnonzero(last > first)
            if len(wide):
                n = last[wide] - first[wide]
                level = np.floor(np.log2(n)).astype(np.int64)
                for k in np.unique(level):
                    w = wide[level == k]
                    best[w] = np.minimum(best[w], np.minimum(self.levels[k][first[w]], self.levels[k][last[w] - (1 << k)]))
            out[one] = best
        return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two big-endian numbers share."""
    x = a ^ b
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return 8 - (np.bitwise_count(x).astype(np.int64) + 7) // 8


@dataclass
class Index:
    """A dictionary that can be searched. ``plain``: words are eight bytes, for neither dictionary nor texts have a zero byte; else they are
    ``counted``, and hold one byte less."""

    data: np.ndarray
    order: np.ndarray
    head: np.ndarray  #: first word by suffix order
    words: np.ndarray  #: the word from each place on
    steps: list[np.ndarray]  #: by suffix order: where the suffixes begin that share the bytes before, and the next half word
    least: LeastIn
    plain: bool
    _other: Index | None = None

    @staticmethod
    def of(dictionary: bytes, order: np.ndarray | None = None, plain: bool | None = None) -> Index:
        """``order``: the suffix array, if it is known already."""
        if len(dictionary) > MAX_DICTIONARY:
            raise ValueError(f"a dictionary has at most {MAX_DICTIONARY} bytes, for it goes to every executor")
        data = np.frombuffer(dictionary, np.uint8)
        order, n = suffix_array(data) if order is None else order.astype(np.int64), len(data)
        plain = not (data == 0).any() if plain is None else plain
        words = eight(data) if plain else counted(data, np.full(n, n))
        out = Index(data, order, words[order], words, [], LeastIn(order), plain)
        depth = out.wide
        apart = np.r_[True, out.head[1:] != out.head[:-1]][:n]
        for _ in range(6 if n <= 4 << 20 else 2):
            begin = np.flatnonzero(apart)
            group = begin[np.cumsum(apart) - 1] if n else begin
            out.steps.append((group.astype(np.uint64) << np.uint64(32)) | out._half(words[np.minimum(order + depth, n)]))
            apart = np.r_[True, out.steps[-1][1:] != out.steps[-1][:-1]][:n]
            depth += out.wide // 2
        return out

    @property
    def wide(self) -> int:
        """Bytes of a word; a half word has half as many, rounded down."""
        return 8 if self.plain else 7

    def _half(self, words: np.ndarray) -> np.ndarray:
        return words >> np.uint64(32) if self.plain else (words >> np.uint64(40) << np.uint64(8)) | np.minimum(words & np.uint64(0xFF), np.uint64(3))

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, key: np.ndarray, right: bool) -> np.ndarray:
        """Where in each range of suffixes the eight bytes at ``depth`` reach (or pass) key."""
        lo, hi, n = lo.copy(), hi.copy(), len(self.data)
        on = np.flatnonzero(lo < hi)
        while len(on):
            mid = (lo[on] + hi[on]) // 2
            word = self.words[np.minimum(self.order[mid] + depth, n)]
            low = word <= key[on] if right else word < key[on]
            lo[on] = np.where(low, mid + 1, lo[on])
            hi[on] = np.where(low, hi[on], mid)
            on = on[lo[on] < hi[on]]
        return lo

    def _extend(self, words: np.ndarray, at: np.ndarray, place: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many bytes a text at ``at`` and the dictionary at ``place`` share."""
        most = np.minimum(room, len(self.data) - place)
        done, on, width = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 1
        while len(on):
            cols = np.arange(width) * self.wide
            a = words[np.minimum((at[on] + done[on])[:, None] + cols, len(words) - 1)]
            b = self.words[np.minimum((place[on] + done[on])[:, None] + cols, len(self.data))]
            differ = a != b
            first = np.where(differ.any(1), differ.argmax(1), width)
            some = first < width
            done[on] += first * self.wide
            row = np.flatnonzero(some)
            done[on[row]] += np.minimum(_shared(a[row, first[row]], b[row, first[row]]), self.wide)
            on = on[~some]
            on = on[done[on] < most[on]]
            width = min(64, width * 4)
        return np.minimum(done, most)

    def longest(self, words: np.ndarray, at: np.ndarray, room: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For texts that begin at ``at`` in words (of the index's kind), ``room`` bytes long: length of the longest match, and its
        leftmost place where it is longer than ``least``. In plain words zeros stand past an end only, so equal words without one are a true
        match; equal counted words are one if they are full, which a text's word with room is."""
        k, n = len(at), len(self.data)
        length, lo, hi = np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, n)
        known, depth, on, turn = np.full(k, LITERAL), 0, np.arange(k), 0
        while len(on):
            if depth and len(few := np.flatnonzero(hi[on] - lo[on] <= 8)):  # few places are left: compare straight on
                r, count = on[few], (hi[on] - lo[on])[few]
                first = np.cumsum(count) - count
                lane = np.repeat(np.arange(len(r)), count)
                place = self.order[np.arange(len(lane)) - first[lane] + lo[r][lane]]
                common = self._extend(words, (at[r] + depth)[lane], place + depth, (room[r] - depth)[lane])
                most = np.maximum.reduceat(common, first)
                length[r] = depth + most
                known[r] = np.minimum.reduceat(np.where(common == most[lane], place, n), first)
                on = np.delete(on, few)
                if not len(on):
                    break
            word = words[np.minimum(at[on] + depth, len(words) - 1)]
            if depth:
                word = np.where(depth < room[on], word, np.uint64(0))
            l0, h0 = lo[on], hi[on]
            if turn == 0:
                table, width, key = self.head, self.wide, word
            elif turn <= len(self.steps):
                table, width, key = self.steps[turn - 1], self.wide // 2, (l0.astype(np.uint64) << np.uint64(32)) | self._half(word)
            else:
                table, width, key = None, self.wide, word
            places, front = (4, 4) if 0 < turn <= len(self.steps) else (8, 0)  # of the key: bytes that vary, and those that don't

            def find(low: np.ndarray, high: np.ndarray, x: np.ndarray, y: np.ndarray, table=table, depth=depth) -> tuple[np.ndarray, np.ndarray]:
                if table is not None:
                    return np.searchsorted(table, low, "left"), np.searchsorted(table, high, "right")
                first = self._bound(x, y, depth, low, False)
                return first, self._bound(first, y, depth, high, True)

            a, b = find(key, key, l0, h0)
            full = (a < b) & (room[on] - depth >= width) & (((key & np.uint64(0xFF)) != 0) | (not self.plain))
            rest = np.flatnonzero(~full)
            if len(rest):
                r, q, x, l1, h1 = on[rest], key[rest], a[rest], l0[rest], h0[rest]
                best = np.zeros(len(r), np.int64)
                for y in (x - 1, x):
                    ok = (y >= l1) & (y < h1)
                    z = np.clip(y, 0, max(0, n - 1))
                    s = self.order[z] + depth if n else z
                    other = self.words[np.minimum(s, n)] if table is None else table[z] if n else q
                    common = np.minimum(np.minimum(_shared(q, other) - front, width), np.minimum(room[r] - depth, n - s))
                    best = np.maximum(best, np.where(ok, common, 0))
                length[r] = depth + best
                z = np.flatnonzero((best > 0) & (best < width) & (length[r] > least))
                if len(z):
                    below = (np.uint64(1) << ((places - best[z]).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
                    lo[r[z]], hi[r[z]] = find((q[z] & ~below) | (np.uint64(0) if self.plain else best[z].astype(np.uint64)), q[z] | below, l1[z], h1[z])
                eq = best == width
                lo[r[eq]], hi[r[eq]] = a[rest][eq], b[rest][eq]
            on, a, b = on[full], a[full], b[full]
            lo[on], hi[on] = a, b
            depth += width
            length[on] = depth
            turn += 1
        where = np.where(length > least, known, LITERAL)
        found = np.flatnonzero((length > least) & (known < 0))
        if len(found):
            where[found] = self.least(lo[found], hi[found])
        return length, where

    def parse(self, blocks: list[bytes], threshold: int = 3, times: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Greedy parse of each block: offsets (LITERAL for a literal) and lengths of its factors. Matches no longer
        than ``threshold`` are literals, and neighbouring literals merge while they are no longer than that together. With ``times`` 2 a
        match must occur twice in the dictionary."""
        if times > 1:
            pairs = [self._parse_one(b, threshold, times) for b in blocks]
            return [p[0] for p in pairs], [p[1] for p in pairs]
        zero = np.array([b"\0" in b for b in blocks], bool)
        if self.plain and zero.any():  # those blocks by counted words, the others by plain ones
            out: tuple[list, list] = ([None] * len(blocks), [None] * len(blocks))
            for index, some in ((self, np.flatnonzero(~zero)), (self.counting(), np.flatnonzero(zero))):
                for i, o, n in zip(some.tolist(), *index.parse([blocks[i] for i in some], threshold)):
                    out[0][i], out[1][i] = o, n
            return out
        sizes = np.array([len(b) for b in blocks], np.int64)
        first = np.cumsum(sizes + 8) - (sizes + 8)
        flat = np.frombuffer(b"".join(x for b in blocks for x in (b, bytes(8))), np.uint8)
        words = eight(flat) if self.plain else counted(flat, np.repeat(first + sizes, sizes + 8))
        length, where = self._walk(words, first, first + sizes, threshold)
        return self._factors(length, where, first, first + sizes, threshold)

    def counting(self) -> Index:
        """The same dictionary by counted words; made once, when a text with a zero byte comes."""
        if self._other is None:
            self._other = Index.of(self.data.tobytes(), self.order, False)
        return self._other

    def repeats(self) -> np.ndarray:
        """For each place of the dictionary how many bytes from there on occur at another place too."""
        n = len(self.order)
        out = np.zeros(n, np.int64)
        for a in range(0, n - 1, 1 << 20):
            x, y = self.order[a : min(n - 1, a + (1 << 20))], self.order[a + 1 : min(n - 1, a + (1 << 20)) + 1]
            common = self._extend(self.words, x, y, n - x)
            out[x] = np.maximum(out[x], common)
            out[y] = np.maximum(out[y], common)
        return out

    def factors_by_repeats(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many factors each segment of the dictionary takes, by matches that occur twice in it at least: all segments in step."""
        longest, at, n, on = self.repeats(), begin.copy(), np.zeros(len(begin), np.int64), np.flatnonzero(begin < end)
        while len(on):
            n[on] += 1
            at[on] += np.maximum(1, np.minimum(longest[at[on]], end[on] - at[on]))
            on = on[at[on] < end[on]]
        return n

    def _walk(self, words: np.ndarray, first: np.ndarray, stop: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches at all places that greedy parses of the blocks visit, and at few others. Besides the block's begin,
        a walk starts at every STRIPE-th byte, and ends where another one has been. Walks soon meet, so what follows
        from any visited place has been visited as well, and all walks go in step."""
        size = len(words)
        length, where, lane = np.zeros(size, np.int32), np.full(size, LITERAL, np.int64), np.empty(size, np.int32)
        end = np.repeat(stop, np.diff(np.r_[first, size]))
        n = -(-(stop - first) // STRIPE)
        at = np.repeat(first, n) + STRIPE * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        while len(at):
            n, w = self.longest(words, at, end[at] - at, threshold)
            length[at], where[at] = np.maximum(n, 1), w
            at = at + length[at]
            at = at[(at < end[at - 1]) & (length[at] == 0)]
            lane[at] = np.arange(len(at))  # walks that have met go on as one
            at = at[lane[at] == np.arange(len(at))]
        return length, where

    @staticmethod
    def _factors(length: np.ndarray, where: np.ndarray, first: np.ndarray, stop: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        on, some = np.zeros(len(length), bool), first < stop
        at, until = first[some], stop[some]
        while len(at):  # all blocks in step
            on[at] = True
            at = at + length[at]
            some = at < until
            at, until = at[some], until[some]
        places = np.flatnonzero(on)
        size, place = length[places].astype(np.int64), where[places]
        cut = np.searchsorted(places, np.r_[first, len(length)])
        short = place < 0
        place[short] = LITERAL
        keep = np.ones(len(size), bool)
        follows = short & np.r_[False, short[:-1]]  # literals after a literal of the same block
        follows[cut[cut < len(follows)]] = False
        if threshold > 1 and follows.any():  # literals merge
            total, last = 0, 0
            chain = np.flatnonzero(follows | np.r_[follows[1:], False])
            for i, n, more in zip(chain.tolist(), size[chain].tolist(), follows[chain].tolist()):
                if more and total + n <= threshold:
                    total += n
                    size[last] = total
                    keep[i] = False
                else:
                    total, last = n, i
        cut = np.r_[0, np.cumsum(keep)][cut].tolist()
        place, size = place[keep], size[keep]
        return [place[a:b] for a, b in zip(cut, cut[1:])], [size[a:b] for a, b in zip(cut, cut[1:])]

    def _parse_one(self, block: bytes, threshold: int, times: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, one factor after another, with any number of occurrences."""
        text, offsets, lengths, p, last = self.data.tobytes(), [], [], 0, -1
        while p < len(block):
            n, where = self._one(text, block, p, times)
            n = max(n, 1)
            if n <= threshold or where < 0:
                if last > 0 and last + n <= threshold:
                    lengths[-1] += n
                    last += n
                else:
                    offsets.append(LITERAL)
                    lengths.append(n)
                    last = n
            else:
                offsets.append(where)
                lengths.append(n)
                last = -1
            p += n
        return np.array(offsets, np.int64), np.array(lengths, np.int64)

    def _one(self, text: bytes, block: bytes, p: int, times: int) -> tuple[int, int]:
        lo, hi, n = 0, len(self.order), 0
        while p + n < len(block):
            c = block[p + n]
            a, b = lo, hi
            while a < b:
                m = (a + b) // 2
                i = int(self.order[m]) + n
                if i >= len(text) or text[i] < c:
                    a = m + 1
                else:
                    b = m
            new_lo, b = a, hi
            while a < b:
                m = (a + b) // 2
                i = int(self.order[m]) + n
                if i >= len(text) or text[i] <= c:
                    a = m + 1
                else:
                    b = m
            if a - new_lo < times:
                break
            lo, hi, n = new_lo, a, n + 1
        return (n, int(self.order[lo:hi].min())) if n else (0, LITERAL)
