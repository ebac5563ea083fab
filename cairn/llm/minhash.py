"""Near-duplicate removal: MinHash signatures joined under a Hamming threshold by multi-index hashing.

A document's signature has ``parts`` components, each the low ``BITS`` bits of a minimum over its word 2-grams
(b-bit MinHash). The distance of two signatures is the number of components in which they differ; about
``parts * (1 - Jaccard)``. All pairs at a distance of ``most`` at most are found, by the pigeonhole principle:
the components are split into chunks with error allowances that sum to ``most - chunks + 1``, so such a pair keeps to
the allowance in one chunk at least. The allowed errors of a chunk are enumerated: one key for each choice of
positions left out. A pair shares a key exactly if it keeps to the allowance in that chunk.

Documents in one connected component of these pairs form a group; the one with the least doc_id stays. Pairs are
compared inside key groups, each document only with those not joined to it yet, and without any cap: that finds a
spanning forest of exactly the graph of all pairs, but doesn't write out the squares of large groups.

Defined cases. Texts that are null or without a word have no signature and are never duplicates. A document with one
word has this one word as its only shingle. Rows are told apart by doc_id and a 64-bit hash of the text: a row that
repeats both is one document, and one copy of it stays. Rows with a null doc_id can't be named in a result; they are
neither grouped nor removed. Ties in doc_id (with different texts) are broken by the text's hash. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, pieces, repeated, whole_groups, write_table
from cairn.llm.components import components
from cairn.llm.textkernel import grams, mix, spans_hash, words

PARTS = 64
BITS = 16
SHINGLE = 2
MOST = 24  #: of 64 components: guaranteed for all pairs that agree in 40


def signatures(texts: pa.Array, parts: int = PARTS, shingle: int = SHINGLE, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """uint16 matrix with a row for each text that has a word, and the numbers of these texts."""
    w = words(texts)
    h, _, row = grams(w, shingle)
    some = np.flatnonzero(np.diff(w.first) > 0)
    at = np.searchsorted(row, some)
    rng = np.random.default_rng(seed)
    factor, shift = (rng.integers(0, 1 << 32, parts, dtype=np.uint32) for _ in range(2))
    low, out = (h >> np.uint64(16)).astype(np.uint32), np.empty((len(some), parts), np.uint16)
    if len(some):
        for k in range(parts):
            v = np.minimum.reduceat((low ^ shift[k]) * (factor[k] | np.uint32(1)), at)
            out[:, k] = mix(v.astype(np.uint64) + np.uint64(k << 33)) >> np.uint64(64 - BITS)
    return out, some


def plan(parts: int = PARTS, most: int = MOST) -> list[list[tuple[int, ...]]]:
    """For each chunk, the choices of components that are hashed to one key. So many chunks that the keys together
    are few while each one keeps at least four components where it can."""
    best: tuple[float, list, list] = (np.inf, [], [])
    for chunks in range(1, min(parts, most + 1) + 1):
        sizes = [parts // chunks + (i < parts % chunks) for i in range(chunks)]
        spare, errors = most - chunks + 1, [0] * chunks
        for _ in range(spare):  # the next error where it costs fewest keys
            cost = [_choose(s, e + 1) - _choose(s, e) + 1000.0 * max(0, 4 - (s - e - 1)) ** 3 if e + 1 < s else np.inf for s, e in zip(sizes, errors)]
            errors[int(np.argmin(cost))] += 1
        total = sum(_choose(s, e) * 4.0 ** max(0, 4 - (s - e)) for s, e in zip(sizes, errors))
        if max(e - s for s, e in zip(sizes, errors)) < 0 and total < best[0]:
            best = total, sizes, errors
    if not best[1]:
        raise ValueError("the threshold leaves no component to index")
    starts = np.cumsum(best[1]) - best[1]
    return [list(combinations(range(a, a + s), s - e)) for a, s, e in zip(starts.tolist(), best[1], best[2])]


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def keys_of(sig: np.ndarray, chunks: list[list[tuple[int, ...]]]) -> np.ndarray:
    """A column of 64-bit keys for each choice of each chunk."""
    out, wide = [], sig.astype(np.uint64) + np.uint64(1)
    for number, choices in enumerate(c for chunk in chunks for c in chunk):
        h = np.full(len(sig), number + 1, np.uint64)
        for i in choices:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, i])
        out.append(h)
    return np.stack(out, 1) if out else np.zeros((len(sig), 0), np.uint64)


def forest(sig: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of all pairs within ``most``."""
    left, edges = np.arange(len(sig)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (sig[left] != sig[i]).sum(1) <= most
            for j in left[near]:
                edges.append((i, int(j)))
                queue.append(int(j))
            left = left[~near]
    return edges


def signed(docs: DataFrame, parts: int = PARTS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, sig binary, node): the documents that have a signature; node is a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sig, at = signatures(part.column("text"), parts, shingle)
                some = pa.array(at)
                node = spans_hash(sig.ravel(), np.arange(len(sig)) * parts, np.arange(1, len(sig) + 1) * parts)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(some), "text_hash": part.column("text_hash").take(some), "sig": pa.array([r.tobytes() for r in sig], pa.binary()), "node": column(node)})

    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, sig binary, node bigint")


def near_edges(sigs: DataFrame, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """sigs(node bigint, sig binary), one row a node -> (a, b): edges that connect exactly the nodes that pairs within
    ``most`` connect."""
    chunks = plan(parts, most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20000):
                part = batch.slice(k, 20000)
                keys = keys_of(np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, parts), chunks)
                node = np.asarray(part.column("node"))
                yield pa.RecordBatch.from_pydict({"key": column(keys.ravel()), "node": pa.array(np.repeat(node, keys.shape[1]))})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only keys that two nodes have."""
        return repeated(batches, "key", ["key", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key"):
            key, node = np.asarray(group.column("key")), np.asarray(group.column("node"))
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, parts)
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            two = two[(sig[two] != sig[two + 1]).sum(1) <= most]
            pairs = {(int(node[i]), int(node[i + 1])) for i in two}
            for a, b in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2]):
                pairs.update((int(node[a + i]), int(node[a + j])) for i, j in forest(sig[a:b], most))
            if pairs:
                e = np.array(sorted(pairs), np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})

    keyed = sigs.select("node", "sig").mapInArrow(emit, "key bigint, node bigint")
    some = keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(shared, "key bigint, node bigint")
    return some.join(sigs.select("node", "sig"), "node").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint").filter("a <> b").distinct()


def groups(docs: DataFrame, parts: int = PARTS, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, copies, keep_id, keep_hash): every document that isn't alone in its group (or that
    repeats), and the one that stays of this group."""
    all_docs = write_table(signed(docs, parts, shingle), "signed")
    sigs = write_table(all_docs.groupBy("node").agg(F.first("sig").alias("sig")), "nodes")
    roots = write_table(components(near_edges(sigs, parts, most)), "roots")
    rows = all_docs.groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("copies")).join(roots, "node", "left")
    root = rows.select("doc_id", "text_hash", "copies", F.coalesce("root", "node").alias("root"))
    # Groups of any size: the one that stays by partial sums, then a join, which splits a large group.
    kept = root.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"), F.sum("copies").alias("n")).filter("n > 1")
    return root.join(kept, "root").select("doc_id", "text_hash", "copies", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"))


def near_duplicates(docs: DataFrame, parts: int = PARTS, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, duplicate_of): a row for each document that goes, with the one of its group that stays. Rows that
    repeat the one that stays are no second document and yield no row."""
    return groups(docs, parts, most, shingle).filter("doc_id <> keep_id or text_hash <> keep_hash").select("doc_id", F.col("keep_id").alias("duplicate_of"))


def keep_one(docs: DataFrame, parts: int = PARTS, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group; the columns are as they were. Of rows that repeat the one that stays any one is taken."""
    marks = write_table(groups(docs, parts, most, shingle).select(
        F.col("doc_id").alias("_go_id"), F.col("text_hash").alias("_go_hash"), F.expr("doc_id <> keep_id or text_hash <> keep_hash").alias("_go"), "copies").filter("_go or copies > 1"), "marks")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    # Null-safe, so that both uses have one plan of the texts' side and share its shuffle; as a merge at any size, as marks grow with the rows.
    same = F.col("_id").eqNullSafe(F.col("_go_id")) & F.col("_hash").eqNullSafe(F.col("_go_hash"))
    marked = packed.join(marks.select("_go_id", "_go_hash", "_go").hint("merge"), same, "left")
    single = marked.filter("_go is null").select("_row.*")
    # With partial sums, so a row that repeats a billion times is no burden.
    one = marked.filter("not _go").groupBy("_id", "_hash").agg(F.any_value("_row").alias("_row"))
    return single.unionByName(one.select("_row.*"))


