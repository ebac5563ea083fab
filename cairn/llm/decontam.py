"""Benchmark decontamination: Wu-Manber search for the test strings of a benchmark in all documents.

Texts are compared as their words (``textkernel.WORD``), joined by single spaces. Test strings are all runs of
``window`` words of an item; an item with fewer words is one test string. A document is
contaminated by an item if a test string of it occurs in the document, from word to word.

The search follows Wu and Manber: a window as long as the shortest test string moves over the text; the hash of its last
eight bytes (a block; fewer for strings that are shorter) gives the shift to the next position at which any test string could end, and impossible positions
are never looked at. Where the shift is 0, the bucket of that block's hash lists the test strings with this block at this
place; their first eight bytes are compared, and then all. Many stripes of text move in step, by whole-array operations.
Strings of under 8, under 16 and more bytes have tables of their own, so that few short ones don't shorten all shifts.
Tables of more than ``TABLE_BYTES`` of test strings are split, and each part is searched for in turn.

Defined cases. A null or empty document contains nothing. An item that is null or has no word has no test string, so it matches
nothing. Items with equal text are all reported. Repeated documents
yield one row for each (doc_id, item_id), with the most windows of any. A null doc_id is reported as null by
``contaminated``; ``keep_clean`` looks at each row by itself, so ids don't matter. Empty tables give an empty result, or
leave all documents. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import pieces
from cairn.llm.textkernel import Words, words

WINDOW = 8
BLOCK = 8
STRIPE = 2048
TABLE_BYTES = 64 << 20


def joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ' word word ' of each text, and the n + 1 offsets. Eight more bytes follow."""
    lens = w.end - w.start
    n = len(w.offsets) - 1
    at = np.cumsum(lens + 1) - (lens + 1) + w.row + 1  # a space before each text, one after each word
    sizes = np.zeros(n, np.int64)
    np.add.at(sizes, w.row, lens + 1)
    offsets = np.r_[0, np.cumsum(sizes + 1)]
    out = np.full(int(offsets[-1]) + 8, 32, np.uint8)
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(at, lens) + step] = w.flat[np.repeat(w.start, lens) + step]
    return out, offsets


def test_strings(texts: list[str | None], window: int = WINDOW) -> list[list[bytes]]:
    """The different test strings of each item, with a space at both ends."""
    w, out = words(pa.array(texts, pa.string())), []
    for a, b in zip(w.first[:-1], w.first[1:]):
        word = [w.flat[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])]
        size = min(window, len(word))
        out.append(sorted({b" " + b" ".join(word[i : i + size]) + b" " for i in range(len(word) - size + 1)}) if word else [])
    return out


def _eight(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, without copying."""
    return np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, 0, (1,))


@dataclass
class Table:
    """Wu-Manber tables of test strings."""

    size: int  #: bytes of the window
    block: int  #: of its last block
    bits: int
    shift: np.ndarray
    bucket: np.ndarray  #: test strings by the hash of the window's last block
    begin: np.ndarray  #: where the bucket of each hash begins
    start: np.ndarray  #: of each test string in flat
    length: np.ndarray
    prefix: np.ndarray  #: its first eight bytes, and which of these it has
    masks: np.ndarray
    flat: np.ndarray

    @staticmethod
    def of(strings: list[bytes]) -> Table:
        length = np.array([len(s) for s in strings], np.int64)
        size = int(length.min())
        block = min(BLOCK, size)
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        eight = _eight(flat)
        bits = min(24, max(16, int(len(strings) * size * 16).bit_length()))
        shift = np.full(1 << bits, size - block + 1, np.int32)
        for end in range(block, size + 1):
            np.minimum.at(shift, _hash(eight[start + end - block] & _mask(block), bits), np.int32(size - end))
        last = _hash(eight[start + size - block] & _mask(block), bits)
        bucket = np.argsort(last, kind="stable")
        begin = np.searchsorted(last[bucket], np.arange((1 << bits) + 1))
        masks = np.array([_mask(min(8, n)) for n in length], np.uint64)
        return Table(size, block, bits, shift, bucket, begin, start, length, eight[start] & masks, masks, flat)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence in text (of which the last eight bytes don't count): test string, first byte."""
        eight, stop = _eight(text), len(text) - 8
        ends = np.arange(self.size, stop + 1, STRIPE)  # one past the window
        limit = np.minimum(ends + STRIPE, stop + 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ends):
            h = _hash(eight[ends - self.block] & _mask(self.block), self.bits)
            move = self.shift[h]
            hit = np.flatnonzero(move == 0)
            if len(hit):
                first, count = self.begin[h[hit]], self.begin[h[hit] + 1] - self.begin[h[hit]]
                entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                which, at = self.bucket[entry], np.repeat(ends[hit] - self.size, count)
                same = (self.prefix[which] == eight[at] & self.masks[which]) & (at + self.length[which] <= stop)
                which, at = which[same], at[same]
                equal = np.fromiter((np.array_equal(self.flat[self.start[k] : self.start[k] + self.length[k]], text[p : p + self.length[k]]) for k, p in zip(which, at)), bool, len(at))
                found.append((which[equal], at[equal]))
            ends = ends + np.maximum(move, 1)
            on = ends < limit
            ends, limit = ends[on], limit[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _mask(size: int) -> np.uint64:
    """The first ``size`` of eight bytes."""
    return np.uint64((1 << (8 * size)) - 1)


def _hash(block: np.ndarray, bits: int) -> np.ndarray:
    return ((block ^ (block >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _tables(benchmark: DataFrame, window: int, most: int) -> list[tuple[Table, list[list[int]], list]]:
    """(tables, items of each test string, item ids), in parts of at most ``most`` bytes of test strings."""
    items = benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toArrow()
    ids, out = items.column("item_id").to_pylist(), []
    by: list[dict[bytes, list[int]]] = [{}, {}, {}]  # by length
    size = [0, 0, 0]

    def close(k: int) -> None:
        out.append((Table.of(list(by[k])), list(by[k].values()), ids))
        by[k], size[k] = {}, 0

    for i, strings in enumerate(test_strings(items.column("text").to_pylist(), window)):
        for s in strings:
            k = (len(s) >= 8) + (len(s) >= 16)
            if by[k] and size[k] + len(s) > most and s not in by[k]:
                close(k)
            if s not in by[k]:
                size[k] += len(s)
            by[k].setdefault(s, []).append(i)
    for k in range(3):
        if by[k]:
            close(k)
    return out


def _hits(texts: pa.Array, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(text, test string) of the occurrences, each pair once."""
    text, offsets = joined(words(texts))
    which, at = table.search(text)
    pairs = np.unique(np.stack([np.searchsorted(offsets, at, "right") - 1, which], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, item_id, windows): each document and each item of which it contains test strings, and how many."""
    spark, out = docs.sparkSession, None
    schema = "doc_id bigint, h bigint, item_id bigint, windows bigint"
    for number, part in enumerate(_tables(benchmark, window, table_bytes)):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, items, ids = shared.value
            for batch in batches:
                for piece in pieces(batch, "text"):
                    counts: dict[tuple[int, int], int] = {}
                    for row, which in zip(*_hits(piece.column("text"), table)):
                        for i in items[which]:
                            counts[row, i] = counts.get((row, i), 0) + 1
                    if counts:
                        doc, h = (piece.column(c).take(pa.array([r for r, _ in counts])) for c in ("doc_id", "h"))
                        yield pa.RecordBatch.from_pydict({"doc_id": doc, "h": h, "item_id": pa.array([ids[i] for _, i in counts], pa.int64()), "windows": pa.array(list(counts.values()), pa.int64())})

        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema).withColumn("part", F.lit(number))
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, windows bigint")
    one = out.groupBy("doc_id", "item_id", "h", "part").agg(F.max("windows").alias("windows"))  # repeated rows are one document
    whole = one.groupBy("doc_id", "item_id", "h").agg(F.sum("windows").alias("windows"))
    return whole.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no test string; the columns are as they were."""
    for part in _tables(benchmark, window, table_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part[0])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "text"):
                    ok = np.ones(piece.num_rows, bool)
                    ok[_hits(piece.column("text"), shared.value)[0]] = False
                    yield piece.filter(pa.array(ok))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
