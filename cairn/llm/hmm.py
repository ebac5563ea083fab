"""Language-model scores from a hidden Markov model over words.

Every word that occurs twice or more is a symbol, so the model grows with what it reads; words seen once are one symbol together, the
class of new words. Documents go by a hash of themselves to chunks of about ``CHUNK`` bytes of text, so what a chunk holds doesn't depend on how rows lie in
files; each has the sorted hashes of its different words and its texts as numbers of these. Emissions are tables by word, in parts by the upper bits of the
hash: a part's task sums the counts of its words and answers what each chunk asks for, and a chunk's task joins the answers to its texts. Nobody
holds a whole table. The chunks are bucketed, so no pass moves them.

Baum-Welch trains incrementally: the chunks form ``BATCHES`` batches; after each one its expected counts replace those it gave in the sweep before (a share
of the first emissions, at first), and new parameters follow from the counts of all batches. Every sweep reads the whole corpus, and whole sequences:
documents over ``PIECE`` words are cut into pieces, and vectors of the outer and transfer matrices of the inner ones give the exact forward and backward
vectors at each cut. Sweeps go on until the
relative gain of the log-likelihood is at most ``TOLERANCE``; while the model is no better than the words' plain frequencies it may be on the plateau before
the states part, so it stops only at ``PLATEAU`` times that gain. A score is the exact log-likelihood of a document's whole sequence, by the scaled forward recursion.

For scores the class of new words is spread evenly over twice as many words as were seen once: by Good and Turing, words never seen have
together about the share of those seen once.

Sums of float counts run in the order of chunks, and totals are whole numbers of 2**-16, so a result is the same however the rows are partitioned.

Defined cases. A text that is null or without a word has n_tokens 0 and null scores. Repeated rows get equal rows (they are one sequence with a
weight); a null doc_id is carried along. Very long texts are one sequence. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import _written, column, drop_table, pieces, shared_dir, write_table
from cairn.llm.textkernel import mix, words

STATES, BATCHES = 8, 4
TOLERANCE, PLATEAU = 1e-3, 1e-2
SPREAD, STAY = 4.0, 100.0  #: logarithmic range of the first emissions' noise, and weight of staying in a state: both tell the states apart from the first sweep on
SHARE = 0.02  #: of a word's count, given to its states in equal parts besides what was counted
MOVED = 1.0  #: added to the count of every start and move
CHUNK = 6 << 20  #: bytes of text
PART = 1 << 15  #: words of a part of the emissions, about
PIECE, STEP = 768, 1 << 20  #: words of a sequence, and of all sequences that advance in step
RESCALE = 4  #: steps between two scalings
UNIT = 65536.0  #: totals are counted in so many parts
RARE = 0  #: the symbol of words seen once
COUNTS = "part int, chunk bigint, words binary, counts binary, totals array<bigint>"
CHUNKS = "chunk bigint, batch int, known binary, n binary, symbols binary, size binary, doc_id array<bigint>, times array<bigint>"


@dataclass
class Model:
    """What the recursions need: all parameters, for the symbols of one chunk."""

    start: np.ndarray  #: by state
    move: np.ndarray  #: state to state
    emit: np.ndarray  #: a row of each state, by symbol: how many times more probable it makes the symbol than the corpus does


@dataclass
class Trained:
    """Parameters, and the tables that emissions follow from."""

    start: np.ndarray
    move: np.ndarray
    vocabulary: DataFrame  #: part, words, counts: how often each word occurs
    bits: int  #: of a hash that name its part
    size: int  #: how many symbols
    total: int  #: words of the corpus
    once: int  #: words that occur once
    plain: float  #: log-likelihood of the corpus by the frequencies of its symbols alone
    first: np.ndarray  #: totals by state of the first emissions
    tables: dict[int, DataFrame] = field(default_factory=dict)  #: by batch: expected counts of words by state
    totals: dict[int, np.ndarray] = field(default_factory=dict)
    batches: int = BATCHES

    def sums(self) -> tuple[np.ndarray, np.ndarray, float]:
        """By state: expected counts of all symbols, and of the class of new words; the share of the first emissions that is left."""
        k = len(self.start)
        left = 1 - len(self.totals) / self.batches
        rare = sum((t[-k:] for t in self.totals.values()), left * np.full(k, self.once / k)) + SHARE * self.once / k
        return sum((t[k + k * k : 2 * k + k * k] for t in self.totals.values()), left * self.first) + SHARE * self.total / k, rare, left

    def step(self, batch: int, table: DataFrame, totals: np.ndarray) -> Trained:
        k = len(self.start)
        new = replace(self, tables=self.tables | {batch: table}, totals=self.totals | {batch: totals})
        t = sum(new.totals.values())
        start, moves = t[:k] + MOVED, t[k : k + k * k].reshape(k, k) + MOVED
        new.start, new.move = start / start.sum(), moves / moves.sum(1, keepdims=True)
        return new


# --- recursions


def _in_step(first: np.ndarray, size: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """For sequences that are sorted by falling size: how many have a t-th word, where these begin if words are laid out by t, and their places."""
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    before = np.r_[0, np.cumsum(active)]
    t = np.repeat(np.arange(len(active)), active)
    return active.tolist(), before.tolist(), first[np.arange(before[-1]) - before[:-1][t]] + t


def _emissions(m: Model) -> np.ndarray:
    """A row of each symbol: what one word needs lies together."""
    return np.ascontiguousarray(m.emit.T)


def transfers(m: Model, flat: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each piece of so many words a matrix: from the state before it to the state at its end, with the probability of its words, scaled to a
    largest entry of 1."""
    k, n = len(m.start), len(first)
    step, emit = m.move.T.astype(np.float32), np.take(_emissions(m), flat[first + np.arange(size)[:, None]], 0)
    a = np.repeat(step[:, :, None], n, 2)  # state, state before, piece
    for t in range(size):
        if t:
            a = (step @ a.reshape(k, -1)).reshape(k, k, n)
        a *= np.ascontiguousarray(emit[t].T)[:, None]
        if not t % RESCALE or t == size - 1:
            a /= a.max((0, 1))
    return a.transpose(2, 1, 0).astype(float)


def openings(m: Model, flat: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each piece of so many words that opens a document the distribution of the state at its end, a column each."""
    step, emit = m.move.astype(np.float32), np.take(_emissions(m), flat[first + np.arange(size)[:, None]], 0)
    a, ones = np.repeat(m.start[None].astype(np.float32), len(first), 0), np.ones(len(m.start), np.float32)
    for t in range(size):
        if t:
            a = a @ step
        a *= emit[t]
        if not t % RESCALE:
            a /= (a @ ones)[:, None]
    return a.T.astype(float)


def closings(m: Model, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each piece that ends a document the likelihood of its words by the state before it, a column each."""
    order = np.argsort(-size, kind="stable")
    active, before, places = _in_step(np.zeros_like(order), size[order])
    rank = np.arange(len(places)) - np.repeat(before[:-1], active)
    back, emit = np.ascontiguousarray(m.move.T, np.float32), np.take(_emissions(m), flat[(first + size - 1)[order][rank] - places], 0)  # from the last word on
    b, out = np.ones((len(order), len(m.start)), np.float32), np.empty((len(m.start), len(order)))
    for t, (c, x) in enumerate(zip(active, before)):
        b = (b[:c] * emit[x : x + c]) @ back
        if not t % RESCALE:
            b /= b.max(1, keepdims=True)
        go = active[t + 1] if t + 1 < len(active) else 0
        if go < c:
            out[:, order[go:c]] = b[go:].T
    return out


@dataclass
class Pieces:
    """Sequences of at most PIECE words, sorted by falling size; what comes before and after in the same document is in vectors."""

    first: np.ndarray
    size: np.ndarray
    row: np.ndarray  #: document
    opens: np.ndarray  #: begins a document
    entry: np.ndarray  #: a column each: distribution of the state before, where it doesn't open a document
    leave: np.ndarray  #: likelihood of what follows, by the state at the end


def cut(m: Model, flat: np.ndarray, first: np.ndarray, size: np.ndarray, leaves: bool = True) -> Pieces:
    """The sequences flat[first:first + size] as pieces; without ``leaves`` what follows isn't looked at. Only pieces between two others need matrices."""
    k, longest = len(m.start), PIECE
    n = -(-size // longest)
    row = np.repeat(np.arange(len(size)), n)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = first[row] + turn * longest
    length = np.minimum(longest, first[row] + size[row] - start)
    entry, leave = np.full((k, len(row)), 1 / k), np.ones((k, len(row)))
    opens, closes = turn == 0, turn == n[row] - 1
    heads, tails, inner = np.flatnonzero(opens & ~closes), np.flatnonzero(closes & ~opens), np.flatnonzero(~opens & ~closes)
    if len(heads):
        v = openings(m, flat, start[heads], longest)
        entry[:, heads + 1] = v / v.sum(0)
        between = transfers(m, flat, start[inner], longest) if len(inner) else []
        for i, t in zip(inner, between):  # few: one for each PIECE words
            v = entry[:, i] @ t
            entry[:, i + 1] = v / v.sum()
        if leaves:
            v = closings(m, flat, start[tails], length[tails])
            leave[:, tails - 1] = v / v.max(0)
            for i, t in zip(inner[::-1], between[::-1]):
                v = t @ leave[:, i]
                leave[:, i - 1] = v / v.max()
    order = np.argsort(-length, kind="stable")
    return Pieces(start[order], length[order], row[order], opens[order], entry[:, order], leave[:, order])


@dataclass
class Run:
    """A forward recursion over pieces."""

    active: list[int]  #: layout, as of ``_in_step``
    before: list[int]
    symbols: np.ndarray  #: in this layout
    table: np.ndarray  #: of ``_emissions``
    alpha: np.ndarray  #: scaled forward vectors in this layout, a row each, if they are kept
    scales: list[tuple[int, np.ndarray] | None]  #: by step: the first of the pieces that were scaled, and by what
    like: np.ndarray  #: by piece: sum of its scales' logarithms


def _forward(m: Model, flat: np.ndarray, p: Pieces, keep: bool) -> Run:
    """Every RESCALE steps all pieces are scaled to sums of 1, and each at its end; with ``keep`` all vectors are kept."""
    active, before, places = _in_step(p.first, p.size)
    symbols, table = flat[places].astype(np.intp), _emissions(m)
    a = np.where(p.opens[:, None], m.start, p.entry.T @ m.move).astype(np.float32)
    step, ones, here, alpha = m.move.astype(np.float32), np.ones(len(m.start), np.float32), np.empty_like(a), a
    if keep:
        alpha = np.empty((before[-1], len(m.start)), np.float32)
        alpha[: len(a)] = a
    scales, like = [], np.zeros(len(p.first))
    for t, (c, x) in enumerate(zip(active, before)):
        if keep:
            a = np.matmul(a[:c], step, out=alpha[x : x + c]) if t else alpha[:c]
        elif t:
            a = a[:c] @ step
        a *= np.take(table, symbols[x : x + c], 0, here[:c], "clip")
        go = active[t + 1] if t % RESCALE and t + 1 < len(active) else 0
        if go < c:
            s = a[go:] @ ones
            a[go:] /= s[:, None]
            like[go:c] += np.log(s, dtype=np.float64)
        scales.append((go, s) if go < c else None)
    return Run(active, before, symbols, table, alpha, scales, like)


def forward(m: Model, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For sequences of one symbol at least: how much their log-likelihoods exceed those by the symbols' frequencies."""
    p = cut(m, flat, first, size, leaves=False)
    return np.bincount(p.row, _forward(m, flat, p, False).like, len(size))


def expected(m: Model, flat: np.ndarray, first: np.ndarray, size: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward on sequences, each counted so many times: adds each symbol's expected states to counts (a row a state); gives those of starts
    and moves, and what the log-likelihood is above that by the symbols' frequencies."""
    p = cut(m, flat, first, size)
    weight = times[p.row].astype(np.float32)
    run = _forward(m, flat, p, True)
    active, before, symbols, alpha = run.active, run.before, run.symbols, run.alpha
    last = np.array(before[:-1])[p.size - 1] + np.arange(len(p.size))
    leave = p.leave.T / (alpha[last] * p.leave.T).sum(1, keepdims=True)
    if (weight != 1).any():
        alpha *= weight[np.arange(before[-1]) - np.repeat(before[:-1], active)][:, None]
    leave, back, here = leave.astype(np.float32), np.ascontiguousarray(m.move.T, np.float32), np.empty((len(weight), len(m.start)), np.float32)
    moves, b = np.zeros((len(m.start), len(m.start))), leave[: active[-1]]
    for t in range(len(active) - 1, -1, -1):
        c, x = active[t], before[t]
        ahead = np.take(run.table, symbols[x : x + c], 0, here[:c], "clip")
        ahead *= b
        alpha[x : x + c] *= b
        if run.scales[t]:
            go, s = run.scales[t]
            ahead[go:] /= s[:, None]
        if t:
            y, more = before[t - 1], active[t - 1]
            moves += alpha[y : y + c].T @ ahead
            b = ahead @ back
            if more > c:
                b = np.concatenate([b, leave[c:more]])
    inner = ~p.opens
    moves += (p.entry * weight)[:, inner] @ ahead[inner]
    for k in range(len(counts)):
        counts[k] += np.bincount(symbols, alpha[:, k], counts.shape[1])
    return alpha[: active[0]][p.opens].sum(0, dtype=float), moves * m.move, float((run.like * weight).sum())


def _bundles(size: np.ndarray) -> Iterator[np.ndarray]:
    """The sequences that aren't empty, longest first, in bundles of about STEP words."""
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    group = (np.cumsum(size[order]) - size[order]) // STEP
    for at in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(at):
            yield at


# --- chunks


def _release() -> None:
    """Gives memory that a worker has freed back to its machine: the next chunk may go to another worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def encode(docs: DataFrame, batches: int = BATCHES, chunk_bytes: int = CHUNK) -> DataFrame:
    """CHUNKS: documents by a hash of themselves. ``known`` are the chunk's different words, ``n`` how often each occurs, ``symbols`` places among them;
    rows that repeat a document are counted in ``times``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(batches, -(-size // chunk_bytes))
    own = F.xxhash64("doc_id", "text")
    placed = docs.select("doc_id", "text", own.alias("h"), F.pmod(own, F.lit(chunks)).alias("chunk"))

    def tokenise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                h, chunk = np.asarray(part.column("h")), np.asarray(part.column("chunk"))
                _, at, times = np.unique(h, return_index=True, return_counts=True)
                by = np.lexsort((h[at], chunk[at]))
                at, times = at[by], times[by]
                heads = np.r_[0, np.flatnonzero(np.diff(chunk[at])) + 1]
                ids, some = part.column("doc_id").take(pa.array(at)), list(zip(heads, np.r_[heads[1:], len(at)]))
                off = pa.array(np.r_[heads, len(at)].astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(chunk[at[heads]]), "doc_id": pa.ListArray.from_arrays(off, ids), "h": pa.ListArray.from_arrays(off, pa.array(h[at])), "times": pa.ListArray.from_arrays(off, pa.array(times)),
                    "size": _lists([np.diff(w.first)[at[a:b]] for a, b in some]), "words": pa.array([b"".join(w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in at[a:b]) for a, b in some], pa.binary()),
                })

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        h, times, size = (np.asarray(t[c].combine_chunks().flatten()) for c in ("h", "times", "size"))
        ids = t["doc_id"].combine_chunks().flatten()
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t["words"]])
        first = np.cumsum(size) - size
        _, at, group = np.unique(h, return_index=True, return_inverse=True)
        first, size, n = first[at], size[at], np.bincount(group, times, len(at)).astype(np.int64)
        flat = flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        known, symbols = np.unique(flat, return_inverse=True)
        seen = np.bincount(symbols, np.repeat(n, size), len(known)).astype(np.int64)
        chunk = t["chunk"][0].as_py()
        del t, flat
        _release()
        return _chunk(chunk, chunk % batches, known, seen, symbols, size, ids.take(pa.array(at)), pa.array(n))

    rows = placed.mapInArrow(tokenise, "chunk bigint, doc_id array<bigint>, h array<bigint>, times array<bigint>, size array<bigint>, words binary")
    return write_table(rows.groupBy("chunk").applyInArrow(build, CHUNKS), "chunks")


def _chunk(chunk: int, batch: int, known: np.ndarray, n: np.ndarray, symbols: np.ndarray, size: np.ndarray, ids: pa.Array, times: pa.Array) -> pa.Table:
    whole = pa.array([0, len(ids)], pa.int32())
    return pa.table({
        "chunk": [chunk], "batch": pa.array([batch], pa.int32()), "known": [known.tobytes()], "n": [n.tobytes()], "symbols": [symbols.astype(np.uint32).tobytes()], "size": [size.astype(np.int64).tobytes()],
        "doc_id": pa.ListArray.from_arrays(whole, ids), "times": pa.ListArray.from_arrays(whole, times),
    })


def _bucketed(df: DataFrame, by: str, apart: str, buckets: int, name: str) -> DataFrame:
    """A table in the shared folder, in folders by ``apart`` and buckets by ``by``: reading it grouped by ``by`` moves no row."""
    spark, table = df.sparkSession, f"cairn_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/cairn-{name}-{table}"
    df.write.partitionBy(apart).bucketBy(buckets, by).format("parquet").option("path", path).saveAsTable(table)
    _written.append(path)
    return spark.table(table)


def _parts(known: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted words."""
    part = (known >> np.uint64(64 - bits)).astype(np.int64)
    at = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    return [(int(part[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:]) if b > a]


def _rows(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = {"part": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "counts": pa.binary(), "totals": pa.list_(pa.int64())}
    return {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}


def _asks(coded: DataFrame, bits: int) -> DataFrame:
    """What the chunks want to know: their words, by part."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for chunk, words_ in zip(b.column("chunk").to_pylist(), b.column("known")):
                known = np.frombuffer(words_.as_buffer(), np.uint64)
                yield pa.RecordBatch.from_pydict(_rows([(p, chunk, known[x:y].tobytes(), None, None) for p, x, y in _parts(known, bits)]))

    return coded.select("chunk", "known").mapInArrow(ask, COUNTS)


def _answers(asks: DataFrame, tables: list[DataFrame], value: Callable[[np.ndarray, list[tuple[int, np.ndarray, bytes]]], np.ndarray]) -> DataFrame:
    """(part, chunk, counts): for each ask the rows that ``value(words, rows of all tables)`` gives of its words."""

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk").combine_chunks()
        rows = [(t["chunk"][i].as_py(), np.frombuffer(t["words"][i].as_buffer(), np.uint64), t["counts"][i]) for i in range(t.num_rows)]
        given = [(c, w, x.as_buffer()) for c, w, x in rows if c < 0]
        h = next((w for c, w, _ in given if c == -1), np.zeros(0, np.uint64))
        table, part, out = value(h, given), t["part"][0].as_py(), []
        for chunk, w, _ in rows:
            if chunk >= 0:
                i = np.searchsorted(h, w)
                i[np.r_[h, np.uint64(0)][i] != w] = len(h)
                out.append((part, chunk, None, table[i].tobytes(), None))
        return pa.table(_rows(out))

    marked = [t.select("part", F.lit(-1 - i).cast("bigint").alias("chunk"), "words", "counts", F.lit(None).cast("array<bigint>").alias("totals")) for i, t in enumerate(tables)]
    return reduce(DataFrame.union, [asks, *marked]).groupBy("part").applyInArrow(answer, COUNTS).select("part", "chunk", "counts")


def _answered(right: pa.Table, kind: type, width: int) -> np.ndarray:
    right = right.sort_by("part")
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(c.as_buffer(), kind) for c in right["counts"])]).reshape(-1, width)


def pruned(coded: DataFrame, vocabulary: DataFrame, bits: int) -> DataFrame:
    """The chunks with RARE and the words of the vocabulary as their symbols, bucketed by chunk; symbol i is word i - 1 of ``known``."""

    def value(h: np.ndarray, given: list) -> np.ndarray:
        return np.r_[np.ones(len(h), np.uint8), np.uint8(0)]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out, keep = [], _answered(right, np.uint8, 1)[:, 0].astype(bool)
        for row in (left.slice(i, 1) for i in range(left.num_rows)):
            known, n, symbols, size = (np.frombuffer(row[c][0].as_buffer(), kind) for c, kind in (("known", np.uint64), ("n", np.int64), ("symbols", np.uint32), ("size", np.int64)))
            new = np.where(keep, np.cumsum(keep), RARE)
            ids, times = (row[c].combine_chunks().flatten() for c in ("doc_id", "times"))
            out.append(_chunk(row["chunk"][0].as_py(), row["batch"][0].as_py(), known[keep], n[keep], new[symbols], size, ids, times))
        return pa.concat_tables(out)

    answers = _answers(_asks(coded, bits), [vocabulary], value)
    joined = coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, CHUNKS)
    n = coded.count()
    batches = max(1, coded.select("batch").distinct().count())
    return _bucketed(joined, "chunk", "batch", min(50_000, max(1, 2 * n // batches)), "symbols")


# --- training


def _noise(words_: np.ndarray, states: int, seed: int = 5) -> np.ndarray:
    """The first shares of each word's states."""
    salt = words_[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = np.exp(SPREAD * ((mix(salt) >> np.uint64(11)) / float(1 << 53) - 0.5))
    return x / x.sum(1, keepdims=True)


def _summed(table: DataFrame) -> np.ndarray:
    """The element-wise sum of a table's totals; they are whole numbers, so the order doesn't matter."""
    rows = table.filter("totals is not null").select(F.posexplode("totals").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows], float) / UNIT


def initial(coded: DataFrame, states: int = STATES, batches: int = BATCHES) -> Trained:
    """The vocabulary of the chunks and the first parameters."""

    def list_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for known, n in zip(b.column("known"), b.column("n")):
                yield pa.RecordBatch.from_pydict({"h": column(np.frombuffer(known.as_buffer(), np.uint64)), "n": pa.array(np.frombuffer(n.as_buffer(), np.int64))})

    counts = write_table(coded.select("known", "n").mapInArrow(list_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    often = F.col("n") > 1
    size, total, once, logs = (x or 0 for x in counts.agg(F.sum(often.cast("bigint")), F.sum("n"), F.sum((~often).cast("bigint")), F.sum(F.when(often, (F.col("n") * F.log("n") * UNIT).cast("bigint")))).first())
    bits = max(4, (size // PART).bit_length())

    def pack(t: pa.Table) -> pa.Table:
        h, n = np.asarray(t["h"].combine_chunks()).view(np.uint64), np.asarray(t["n"].combine_chunks())
        by = np.argsort(h)
        h, n = h[by], n[by].astype(float)
        first = (n[:, None] * _noise(h, states)).sum(0)
        return pa.table(_rows([(int(h[0] >> np.uint64(64 - bits)), -1, h.tobytes(), n.tobytes(), (first * UNIT).round().astype(np.int64).tolist())]))

    vocabulary = write_table(counts.filter(often).groupBy(F.expr(f"cast(shiftrightunsigned(h, {64 - bits}) as int)").alias("part")).applyInArrow(pack, COUNTS), "vocabulary")
    drop_table(counts)
    move = np.full((states, states), 1.0) + STAY * np.eye(states)
    first = _summed(vocabulary) if size else np.zeros(states)
    plain = float(logs) / UNIT + (once * np.log(once) if once else 0.0) - total * float(np.log(max(1, total)))
    return Trained(np.full(states, 1 / states), move / move.sum(1, keepdims=True), vocabulary, bits, size, total, once, plain, first + once / states, batches=batches)


def _joined(coded: DataFrame, model: Trained, work: Callable[[int, Model, np.ndarray, pa.Table], dict], schema: str, columns: list[str], plain: bool) -> DataFrame:
    """What ``work(chunk, model of its symbols, logarithms of their frequencies, row)`` gives for every chunk; without ``plain`` no logarithms are sent."""
    states, total, once, start, move = len(model.start), max(1, model.total), model.once, model.start, model.move
    sums, rare, left = model.sums()

    def value(h: np.ndarray, given: list) -> np.ndarray:
        out = np.zeros((len(h) + 1, states + plain), np.float32)
        n = next((np.frombuffer(x, np.float64) for c, _, x in given if c == -1), np.zeros(0))
        counts = (left * n[:, None]) * _noise(h, states) if left else np.zeros((len(h), states))
        for c, w, x in sorted((g for g in given if g[0] < -1), key=lambda g: -g[0]):
            counts[np.searchsorted(h, w)] += np.frombuffer(x, np.float32).reshape(-1, states)
        out[:-1, :states] = (counts + SHARE / states * n[:, None]) / sums * (total / n[:, None])
        if plain:
            out[:-1, states] = np.log(n / total)
        return out

    def join(left_: pa.Table, right: pa.Table) -> pa.Table:
        given, out = _answered(right, np.float32, states + plain), []
        emit = np.empty((len(given) + 1, states), np.float32)
        emit[1:] = given[:, :states]
        emit[RARE] = rare / sums * (total / max(1, once)) if once else 1.0
        logs = np.r_[np.log(max(1, once) / total), given[:, states:].ravel().astype(float)]
        for row in (left_.slice(i, 1) for i in range(left_.num_rows)):
            out.append(pa.table(work(row["chunk"][0].as_py(), Model(start, move, emit.T), logs, row)))
        return pa.concat_tables(out)

    answers = _answers(_asks(coded, model.bits), [model.vocabulary, *(t for _, t in sorted(model.tables.items()))], value)
    return coded.select(*columns).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, schema)


def _texts(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbols, size = (np.frombuffer(row[c][0].as_buffer(), kind) for c, kind in (("symbols", np.uint32), ("size", np.int64)))
    return symbols.astype(np.int32), np.cumsum(size) - size, size


def batch_of(coded: DataFrame, model: Trained, batch: int) -> tuple[Trained, float]:
    """The model after a batch was read again; what the batch's log-likelihood under the old model is above that by frequencies."""
    states, bits = len(model.start), model.bits

    def work(chunk: int, m: Model, logs: np.ndarray, row: pa.Table) -> dict:
        flat, first, size = _texts(row)
        known = np.frombuffer(row["known"][0].as_buffer(), np.uint64)
        times = np.asarray(row["times"].combine_chunks().flatten())
        counts, start, moves, like = np.zeros((states, len(known) + 1)), np.zeros(states), np.zeros((states, states)), 0.0
        for at in _bundles(size):
            s, mv, more = expected(m, flat, first[at], size[at], times[at], counts)
            start, moves, like = start + s, moves + mv, like + more
        totals = (np.r_[start, moves.ravel(), counts.sum(1), like, counts[:, RARE]] * UNIT).round().astype(np.int64).tolist()
        by_word = np.ascontiguousarray(counts[:, 1:].T, np.float32)
        rows = [(p, chunk, known[a:b].tobytes(), by_word[a:b].tobytes(), None) for p, a, b in _parts(known, bits)]
        del counts, by_word
        _release()
        return _rows([(chunk % (1 << bits), chunk, None, None, totals), *rows])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk").combine_chunks()
        totals = [np.asarray(x.values) for x in t["totals"] if x.is_valid]
        rows = [(np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.float32).reshape(-1, states)) for w, c in zip(t["words"], t["counts"]) if w.is_valid]
        h, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in rows)]), return_inverse=True)
        c = np.concatenate([np.zeros((0, states), np.float32), *(c for _, c in rows)])
        summed = np.stack([np.bincount(at, c[:, k], len(h)) for k in range(states)], 1).astype(np.float32)
        return pa.table(_rows([(t["part"][0].as_py(), batch, h.tobytes(), summed.tobytes(), sum(totals).tolist() if totals else None)]))

    mine = coded.filter(F.col("batch") == batch)
    counted = _joined(mine, model, work, COUNTS, ["chunk", "known", "symbols", "size", "times"], False)
    table = write_table(counted.groupBy("part").applyInArrow(merge, COUNTS), "emissions")
    t = _summed(table)
    if not len(t):
        t = np.zeros(3 * states + states * states + 1)
    like, old = t[2 * states + states * states], model.tables.get(batch)
    new = model.step(batch, table, np.delete(t, 2 * states + states * states))
    if old is not None:
        drop_table(old)
    return new, float(like)


def converged(likes: list[float], plain: float) -> bool:
    """Whether the log-likelihoods of the sweeps so far have come to rest; that of a corpus without words is 0."""
    if likes and likes[-1] == 0:
        return True
    most = TOLERANCE if likes and likes[-1] > plain else TOLERANCE * PLATEAU
    return len(likes) > 1 and likes[-1] - likes[-2] <= most * abs(likes[-2])


def train(docs: DataFrame, states: int = STATES, batches: int = BATCHES, sweeps: int | None = None, chunk_bytes: int = CHUNK) -> tuple[Trained, DataFrame, list[float]]:
    """The trained model, the documents' symbols as a table in the shared folder, and the log-likelihood of each sweep (of each batch under the model
    that it met). Without ``sweeps`` they go on until they converge."""
    raw = encode(docs, batches, chunk_bytes)
    model = initial(raw, states, batches)
    coded = pruned(raw, model.vocabulary, model.bits)
    drop_table(raw)
    likes: list[float] = []
    while len(likes) < sweeps if sweeps is not None else not converged(likes, model.plain):
        like = model.plain
        for batch in range(batches):
            model, more = batch_of(coded, model, batch)
            like += more
        likes.append(like)
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()  # else the shuffle files of all sweeps stay
    return model, coded, likes


def score(coded: DataFrame, model: Trained) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of the documents that ``pruned`` encoded with the model's vocabulary."""
    spread = float(np.log(2 * max(1, model.once)))

    def work(chunk: int, m: Model, logs: np.ndarray, row: pa.Table) -> dict:
        flat, first, size = _texts(row)
        times = np.asarray(row["times"].combine_chunks().flatten())
        logs[RARE] -= spread
        like = np.full(len(size), np.nan)
        for at in _bundles(size):
            like[at] = forward(m, flat, first[at], size[at])
        some = np.flatnonzero(size > 0)
        if len(some):
            like[some] += np.add.reduceat(logs[flat], first[some])
        ids, per = row["doc_id"].combine_chunks().flatten(), like / np.maximum(size, 1)
        every = np.repeat(np.arange(len(size)), times)
        del flat
        _release()
        return {"doc_id": ids.take(pa.array(every)), "n_tokens": pa.array(size[every]), "log_likelihood": pa.array(like[every], from_pandas=True), "per_token": pa.array(per[every], from_pandas=True)}

    return _joined(coded, model, work, "doc_id bigint, n_tokens bigint, log_likelihood double, per_token double", ["chunk", "known", "symbols", "size", "doc_id", "times"], True)


def score_docs(docs: DataFrame, model: Trained) -> DataFrame:
    """The scores of documents that the model wasn't trained on."""
    return score(pruned(encode(docs), model.vocabulary, model.bits), model)


def score_corpus(docs: DataFrame, sweeps: int | None = None) -> DataFrame:
    model, coded, _ = train(docs, sweeps=sweeps)
    return score(coded, model)
