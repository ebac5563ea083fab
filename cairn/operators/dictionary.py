"""Dictionaries: representative bytes of the text, chosen by sampling, by coverage, or put together from frequent segments.

Each strategy takes blocks(block_id, raw_len, content) and a budget in bytes and gives the dictionary's bytes. A dictionary is small, its size
bounded by the budget whatever the text's; that is why it may be collected. No terminator is added, and no byte value is reserved.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashing import gram_hashes
from cairn.operators.blocks import BLOCK_SIZE, extract
from cairn.plans.scratch import write_table

SAMPLE = 1024
PART = 16 << 20  #: bytes of text, about, whose sampled runs are looked up in one group
GROUP = 8 << 20  #: bytes of text whose places are put together again in one group
HELD = 1 << 20  #: places that a task holds before it sends them out
LEAST_HOT = 64  #: places in the sample, that a frequent run has more than
FREQUENT = 1 << 20  #: runs at most, about, that every task knows because they are frequent


def text_size(blocks: DataFrame) -> int:
    return int(blocks.agg(F.coalesce(F.sum("raw_len"), F.lit(0))).first()[0])


def fingerprint(dictionary: bytes) -> int:
    return zlib.crc32(dictionary)


def none(blocks: DataFrame, budget: int, block_size: int = BLOCK_SIZE) -> bytes:
    return b""


def uniform_samples(blocks: DataFrame, budget: int, sample: int = SAMPLE, block_size: int = BLOCK_SIZE, size: int | None = None) -> DataFrame:
    """(sample_id, text_pos, content): ``budget // sample`` samples, one at least, at equal steps from place 0. Steps are rounded down, so there can be a few
    more. Where the step is under ``sample`` they would overlap; then it is ``sample``, and they are the whole text."""
    n = text_size(blocks) if size is None else size
    step = max(sample, n // max(1, budget // sample))
    if not n:
        return blocks.sparkSession.createDataFrame([], "sample_id bigint, text_pos bigint, content binary")
    asked = blocks.sparkSession.range(0, -(-n // step)).select(F.col("id").alias("req_id"), (F.col("id") * step).alias("off"))
    asked = asked.withColumn("len", F.least(F.lit(sample), F.lit(n) - F.col("off")))
    return extract(blocks, asked, block_size).select(F.col("req_id").alias("sample_id"), (F.col("req_id") * step).alias("text_pos"), "content")


def uniform(blocks: DataFrame, budget: int, sample: int = SAMPLE, block_size: int = BLOCK_SIZE) -> bytes:
    rows = uniform_samples(blocks, budget, sample, block_size).orderBy("sample_id").select("content").collect()
    return b"".join(bytes(r[0]) for r in rows)


def kgram_sample(blocks: DataFrame, k: int = 16, down: int = 512, seed: int = 2, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(h, n): the different hashes of a sample of the k-byte runs inside blocks, and how often each is in it. Sampled are the places whose own hash is 0 modulo
    ``down``, whatever the size of the text."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.zeros(0, np.int64)]
            for block, data in zip(batch.column("block_id").to_pylist(), batch.column("content").to_pylist()):
                h = gram_hashes(data, k)
                at = (np.arange(len(h), dtype=np.uint64) + np.uint64(block << 32) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
                at = (at ^ (at >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                some.append(h[(at >> np.uint64(20)) % np.uint64(down) == 0])
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(some))})

    return blocks.select("block_id", "content").mapInArrow(pick, "h bigint").groupBy("h").agg(F.count("*").alias("n"))


class Filter:
    """Bits by which most hashes that are not in a sample are told at once: two of each hash, in the slice of its first eight bits."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.inner, self.data = bits - 8, data

    @staticmethod
    def places(h: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << inner) - 1)
        return h & mask, (h >> np.uint64(24)) & mask

    @staticmethod
    def of(sample: DataFrame, size: int) -> Filter:
        """16 bits a hash and more, up to 128 MiB in all; beyond that it lets more through, and stays as large. Slices are made in parallel."""
        bits = min(30, max(14, int(16 * size).bit_length()))

        def build(rows: pa.Table) -> pa.Table:
            h = np.asarray(rows.column("h").combine_chunks()).view(np.uint64)
            on = np.zeros(1 << (bits - 8), bool)
            for at in Filter.places(h, bits - 8):
                on[at] = True
            return pa.table({"q": rows.column("q")[:1], "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

        whole = np.zeros((256, 1 << (bits - 11)), np.uint8)
        for r in sample.select(F.expr("cast(shiftrightunsigned(h, 56) as int)").alias("q"), "h").groupBy("q").applyInArrow(build, "q int, bits binary").toLocalIterator():
            whole[r["q"]] = np.frombuffer(r["bits"], np.uint8)
        return Filter(bits, whole.ravel())

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be in the sample."""
        u = h.view(np.uint64)
        on = np.arange(len(u))
        for k in range(2):
            x = u[on]
            at = ((x >> np.uint64(56)) << np.uint64(self.inner)) | Filter.places(x, self.inner)[k]
            on = on[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return on


def _joined(columns: list[pa.ChunkedArray]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in columns]


def _cut(keys: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """The different keys of sorted ones, and the bytes of each one's rows in every column."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    bounds = list(zip(at.tolist(), [*at[1:].tolist(), len(keys)]))
    return keys[at].tolist(), [[c[a:b].tobytes() for a, b in bounds] for c in columns]


def _found(blocks: DataFrame, sample: DataFrame, find: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], k: int, per: int) -> DataFrame:
    """(g, at, h, n): where hashes of the sample (h, n) are in the text, as packed numbers. ``find(block, places, hashes)`` gives what is to be known of the
    k-byte runs of a block that may be in the sample: at and h of each. g is at div ``per``, and has one row or more.

    The text is read once, whatever its size. A filter of bounded size leaves few runs besides those that are in the sample; they meet the sample in parts
    by their hash. Runs that are frequent in the sample, of which a part might have too many, are known to every task instead, about FREQUENT of them at most."""
    sample = write_table(sample, "sample")
    size, total, text = (int(x or 0) for x in (*sample.agg(F.count("*"), F.sum("n")).first(), text_size(blocks)))
    parts = min(1 << 16, max(1, -(-text // PART)))
    rows = sample.filter(F.col("n") > max(LEAST_HOT, total // FREQUENT)).orderBy("h").toArrow()
    hot, often = (np.asarray(rows.column(c).combine_chunks()) for c in ("h", "n"))
    shared = blocks.sparkSession.sparkContext.broadcast((Filter.of(sample, size), hot, often))

    def packed(some: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value[1:]
        at, h = (np.concatenate(x) for x in zip(*some))
        part = (((h.view(np.uint64) >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.int64)
        i = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        is_hot = known[i] == h if len(known) else np.zeros(len(h), bool)
        for on, key in ((is_hot, at // per), (~is_hot, part)):
            by = np.flatnonzero(on)
            by = by[np.argsort(key[by], kind="stable")]
            if len(by):
                counts = n[i[by]] if on is is_hot else np.zeros(len(by), np.int64)
                keys, (a, b, c) = _cut(key[by], at[by], h[by], counts)
                yield pa.RecordBatch.from_pydict({"hot": pa.array([on is is_hot] * len(keys)), "key": pa.array(keys, pa.int64()), "at": pa.array(a, pa.binary()), "h": pa.array(b, pa.binary()), "n": pa.array(c, pa.binary())})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, some, held = shared.value[0], [], 0
        for batch in batches:
            for block, data in zip(batch.column("block_id").to_pylist(), batch.column("content")):
                h = gram_hashes(np.frombuffer(data.as_buffer(), np.uint8), k)
                on = may(h)
                some.append(find(block, on, h[on]))
                held += len(some[-1][0])
                if held >= HELD:
                    yield from packed(some)
                    some, held = [], 0
        if held:
            yield from packed(some)

    def check(known: pa.Table, asked: pa.Table) -> pa.Table:
        h, n = (np.asarray(known.column(c).combine_chunks()) for c in ("h", "n"))
        by = np.argsort(h)
        h, n = h[by], n[by]
        at, x = _joined([asked.column("at"), asked.column("h")])
        i = np.minimum(np.searchsorted(h, x), max(0, len(h) - 1))
        on = np.flatnonzero(h[i] == x) if len(h) else np.zeros(0, np.int64)
        on = on[np.argsort(at[on] // per, kind="stable")]
        keys, (a, b, c) = _cut(at[on] // per, at[on], x[on], n[i[on]])
        return pa.table({"g": pa.array(keys, pa.int64()), "at": pa.array(a, pa.binary()), "h": pa.array(b, pa.binary()), "n": pa.array(c, pa.binary())})

    asked = write_table(blocks.select("block_id", "content").mapInArrow(look, "hot boolean, key bigint, at binary, h binary, n binary"), "asked")
    known = sample.select(F.expr(f"shiftright(shiftrightunsigned(h, 48) * {parts}L, 16)").alias("key"), "h", "n").groupBy("key")
    cold = known.cogroup(asked.filter("not hot").select("key", "at", "h").groupBy("key")).applyInArrow(check, "g bigint, at binary, h binary, n binary")
    return asked.filter("hot").select(F.col("key").alias("g"), "at", "h", "n").union(cold)


def coverage(blocks: DataFrame, budget: int, sample: int = SAMPLE, k: int = 16, down: int = 512, norm: float = 0.5, order: str = "rand", seed: int = 2, block_size: int = BLOCK_SIZE) -> bytes:
    """Of each epoch (a run of samples; as many epochs as samples fit the budget) the sample that covers most: the norm of the frequencies of its different sampled
    runs that no sample chosen before has. Epochs are visited in a seeded random order, or ``order="seq"``; the later of equal samples wins, and where none covers anything the first. Norm 0
    counts runs. Which runs each sample has is found in parallel; the choice is one after another, in one task that reads the samples as a stream and holds
    the runs covered so far, and only the chosen samples come to the driver."""
    n = text_size(blocks)
    if not n:
        return b""
    picks = max(1, budget // sample)
    total = -(-n // sample)
    per = max(1, total // picks)
    epochs = np.arange(-(-total // per))
    if order == "rand":
        epochs = np.random.default_rng(seed).permutation(epochs)
    epochs = epochs[:picks]
    rank = np.full(-(-total // per), -1)
    rank[epochs] = np.arange(len(epochs))

    def runs(block: int, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = (block * block_size + place) // sample
        by = np.lexsort((h, s))
        by = by[(np.r_[True, (np.diff(s[by]) != 0) | (np.diff(h[by]) != 0)][: len(by)]) & (rank[s[by] // per] >= 0)]
        return s[by], h[by]

    def samples(rows: pa.Table) -> pa.Table:
        s, h, f = _joined([rows.column(c) for c in ("at", "h", "n")])
        by = np.lexsort((h, s))
        by = by[np.r_[True, (np.diff(s[by]) != 0) | (np.diff(h[by]) != 0)][: len(by)]]
        keys, (h, f) = _cut(s[by], h[by], f[by])
        return pa.table({"rank": pa.array(rank[np.array(keys, np.int64) // per], pa.int64()), "s": pa.array(keys, pa.int64()), "runs": pa.array(h, pa.binary()), "counts": pa.array(f, pa.binary())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered, turn, best, score, has = np.zeros(0, np.int64), -1, -1, 0.0, None
        won = lambda: pa.RecordBatch.from_pydict({"rank": pa.array([turn], pa.int64()), "s": pa.array([best], pa.int64())})
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                turns, ids = np.asarray(b.column("rank")), np.asarray(b.column("s"))
                cuts = np.r_[0, np.flatnonzero(np.diff(turns)) + 1, len(turns)].tolist()
                for x, y in zip(cuts, cuts[1:]):
                    if turns[x] != turn:
                        if has is not None:
                            covered = np.union1d(covered, has)
                            yield won()
                        turn, best, score, has = int(turns[x]), -1, 0.0, None
                    rows = b.slice(x, y - x)
                    sizes = np.array([len(r) // 8 for r in rows.column("runs").to_pylist()], np.int64)
                    h, f = _joined([rows.column("runs"), rows.column("counts")])
                    new = ~np.isin(h, covered)
                    first = np.cumsum(sizes) - sizes
                    # About the value of each, to see which may win; those are worked out in full.
                    about = np.add.reduceat(np.where(new, f.astype(float) ** norm, 0.0), first) ** (1 / norm if norm else 1.0)
                    for i in np.flatnonzero((about > 0) & (about >= max(score, about.max()) * (1 - 1e-9))).tolist():
                        run = slice(first[i], first[i] + sizes[i])
                        g = f[run][new[run]]
                        value = float(len(g) if norm == 0 else (g.astype(float) ** norm).sum() ** (1 / norm))
                        if value > 0 and value >= score:
                            best, score, has = int(ids[x + i]), value, h[run]
        if has is not None:
            yield won()

    found = _found(blocks, kgram_sample(blocks, k, down, seed), runs, k, max(1, GROUP // sample)).groupBy("g").applyInArrow(samples, "rank bigint, s bigint, runs binary, counts binary")
    won = {r["rank"]: r["s"] for r in found.repartition(1).sortWithinPartitions("rank", "s").mapInArrow(choose, "rank bigint, s bigint").collect()}
    chosen = [won.get(i, e * per) for i, e in enumerate(epochs.tolist())]
    asked = blocks.sparkSession.createDataFrame([(c, c * sample, min(sample, n - c * sample)) for c in sorted(chosen)], "req_id bigint, off bigint, len bigint")
    return b"".join(bytes(r[0]) for r in extract(blocks, asked, block_size).orderBy("req_id").select("content").collect())


def segments(blocks: DataFrame, k: int = 16, down: int = 128, longest: int = 1024, seed: int = 2, disjoint: bool = False, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(text_pos, content): the longest runs of places whose k-byte runs are all in the sample; equal segments once, the first of them.
    With ``disjoint`` places step by k, so segments are whole chunks."""
    step = k if disjoint else 1

    def places(block: int, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on = place % step == 0
        return block * block_size + place[on], h[on]

    def grow(texts: pa.Table, rows: pa.Table) -> pa.Table:
        at = np.sort(np.frombuffer(b"".join(rows.column("at").to_pylist()), np.int64))
        begins, pieces = [np.zeros(0, np.int64)], []
        for block, data in zip(texts.column("block_id").to_pylist(), texts.column("content").to_pylist()) if len(at) else ():
            own = at[slice(*np.searchsorted(at, (block * block_size, (block + 1) * block_size)))] - block * block_size
            if not len(own):
                continue
            apart = np.flatnonzero(np.diff(own) != step)
            begin, end = own[np.r_[0, apart + 1]], own[np.r_[apart, len(own) - 1]] + k
            ok = end - begin <= longest
            begins.append(begin[ok] + block * block_size)
            pieces += [data[a:b] for a, b in zip(begin[ok].tolist(), end[ok].tolist())]
        return pa.table({"text_pos": pa.array(np.concatenate(begins), pa.int64()), "content": pa.array(pieces, pa.binary())})

    some = max(1, GROUP // block_size)
    where = _found(blocks, kgram_sample(blocks, k, down, seed), places, k, some * block_size).select("g", "at").groupBy("g")
    found = blocks.select(F.expr(f"block_id div {some}").alias("g"), "block_id", "content").groupBy("g").cogroup(where).applyInArrow(grow, "text_pos bigint, content binary")
    return found.groupBy("content").agg(F.min("text_pos").alias("text_pos")).select("text_pos", "content")


def assemble(blocks: DataFrame, budget: int, k: int = 16, down: int = 128, longest: int = 1024, seed: int = 2, disjoint: bool = False, block_size: int = BLOCK_SIZE) -> bytes:
    """The segments in the order of the text, as many as the budget holds."""
    out, size = [], 0
    few = segments(blocks, k, down, longest, seed, disjoint, block_size).orderBy("text_pos").select("content").limit(max(1, budget // k))
    for r in few.toLocalIterator():
        if size + len(r[0]) > budget:
            break
        out.append(bytes(r[0]))
        size += len(r[0])
    return b"".join(out)


STRATEGIES: dict[str, Callable[..., bytes]] = {"none": none, "uniform": uniform, "coverage": coverage, "assemble": assemble, "assemble_disjoint": lambda b, n, **k: assemble(b, n, disjoint=True, **k)}


def closest_offset(text_offset: int, size: int, dict_bytes: int, sample: int = SAMPLE) -> int:
    """Begin of the sample that was taken next to a place of the text."""
    return math.floor(text_offset * max(1, dict_bytes // sample) / max(1, size)) * sample
