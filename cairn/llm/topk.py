"""Exact k nearest neighbours of binary codes, by incremental multi-index hashing.

A code of ``bits`` bits is cut into segments of about log2(n) bits; each segment has an index from its value to the codes
that have it. A query looks up the values within radius 0 of its own segments, then within radius 1, and so on, one segment after
another. Once segments 0..j have been searched up to radius r, and the others up to r - 1, every code at a distance of at most
m * r + j (m segments) has been met: if it were farther in each segment than searched, its distance would be larger. A query is done as soon as its k-th verified
distance is no more than that.

Codes have any number of bits, 64 to a number; a segment lies within one number. Of rows with the same code only the k + 1 with the least ids are indexed: ties
are settled by the id, so no other can be among the k best of any query. The index is cut into shards of at most ``SHARD_BYTES`` and the queries into blocks as large; each
shard meets each block in a task, and the best of all shards are merged. No candidate is dropped.

Defined cases. Neighbours are ordered by (distance, id), so ties are settled by the id, and all ties at the k-th place are compared. A row is no
neighbour of itself; rows with the same code are at distance 0. Rows that repeat an id and its code are one row; an id with several codes has
one query for each, and the same id is never its own neighbour. A null vector, or null id, is neither query nor neighbour. Elements that are
null or NaN, or missing at the end, give bit 0; codes are as long as the longest vector. With fewer than k others all are listed. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import write_table

K = 10
SHARD_BYTES = 64 << 20


def codes(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, code) and the number of bits: the signs of all elements, 64 to a number."""
    some = vectors.filter("embedding is not null and vec_id is not null")
    bits = some.agg(F.max(F.size("embedding"))).first()[0] or 1
    bit = "case when get(embedding, w * 64 + i) > 0 and not isnan(get(embedding, w * 64 + i)) then shiftleft(1L, i) else 0L end"
    code = F.expr(f"transform(sequence(0, {(bits - 1) // 64}), w -> aggregate(sequence(0, 63), 0L, (a, i) -> a | {bit}))")
    return some.select(F.col("vec_id").alias("id"), code.alias("code")).distinct(), bits


@dataclass
class Index:
    """Tables of one shard: for each segment the codes sorted by its value."""

    ids: np.ndarray
    codes: np.ndarray  #: a row of numbers each
    words: list[int]  #: of each segment: the number it is in,
    shifts: list[int]  #: its first bit there,
    widths: list[int]  #: and how many bits it has
    order: list[np.ndarray]
    begin: list[np.ndarray]

    @staticmethod
    def of(ids: np.ndarray, values: np.ndarray, bits: int) -> Index:
        most = min(20, max(4, int(np.log2(max(len(ids), 2)))))
        words, shifts, widths, order, begin = [], [], [], [], []
        for word in range(values.shape[1]):
            here = min(64, bits - 64 * word)
            m = -(-here // most)
            for i in range(m):
                widths.append(here // m + (i < here % m))
                words.append(word)
                shifts.append(sum(widths[len(widths) - 1 - i : -1]))
        for word, s, w in zip(words, shifts, widths):
            part = (values[:, word] >> np.uint64(s)) & np.uint64((1 << w) - 1)
            order.append(np.argsort(part, kind="stable"))
            begin.append(np.searchsorted(part[order[-1]], np.arange((1 << w) + 1, dtype=np.uint64)))
        return Index(ids, values, words, shifts, widths, order, begin)

    def search(self, ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
        """Rows (query, distance, id): each query's k best of the shard."""
        n, m = len(ids), len(self.widths)
        kth, have = np.full(n, 1 << 20), np.zeros((0, 3), np.int64)
        active = np.arange(n)
        parts = [((values[:, word] >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for word, s, w in zip(self.words, self.shifts, self.widths)]
        for r in range(max(self.widths) + 1):
            for j in range(m):
                found = [have]
                if r <= self.widths[j] and len(active):
                    for flips in combinations(range(self.widths[j]), r):
                        mask = sum(1 << f for f in flips)
                        value = parts[j][active] ^ mask
                        first = self.begin[j][value]
                        count = self.begin[j][value + 1] - first
                        total = int(count.sum())
                        if not total:
                            continue
                        q = np.repeat(active, count)
                        at = self.order[j][np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)]
                        x = values[q] ^ self.codes[at]
                        d = np.bitwise_count(x).sum(1, dtype=np.int64)
                        ok = (d <= kth[q]) & (self.ids[at] != ids[q])
                        q, at, x, d = q[ok], at[ok], x[ok], d[ok]
                        for i in range(m):  # met before, in another segment
                            if i != j and len(q):
                                own = np.bitwise_count((x[:, self.words[i]] >> np.uint64(self.shifts[i])) & np.uint64((1 << self.widths[i]) - 1))
                                new = own > r if i < j else own >= r
                                q, at, x, d = q[new], at[new], x[new], d[new]
                        if len(q):
                            found.append(np.stack([q, d, self.ids[at]], 1))
                if len(found) > 1:
                    have = np.concatenate(found)
                    have = have[np.lexsort((have[:, 2], have[:, 1], have[:, 0]))]
                    fresh = np.r_[True, (have[1:] != have[:-1]).any(1)]
                    have = have[fresh]
                    start = np.searchsorted(have[:, 0], np.arange(n))
                    have = have[np.arange(len(have)) - start[have[:, 0]] < k]
                    start = np.searchsorted(have[:, 0], np.arange(n + 1))
                    full = np.diff(start) >= k
                    kth[full] = have[start[:-1][full] + k - 1, 1]
                active = active[kth[active] > m * r + j]
            if not len(active):
                break
        return have


def nearest(coded: DataFrame, bits: int, k: int = K, asked: str = "true", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """coded(id, code) -> (id, rank, neighbour_id, distance): the k nearest others of every row that ``asked`` names."""
    spark, wide = coded.sparkSession, (bits - 1) // 64 + 1
    coded = write_table(coded, "codes")
    queries = coded.filter(asked)
    size = lambda rows: max(1, -(-rows * 8 * (wide + 1) // shard_bytes))
    n_asked = queries.count()
    shards = size(coded.count())
    blocks = max(size(n_asked), min(-(-spark.sparkContext.defaultParallelism // shards), -(-n_asked // 256)), 1)
    spread = F.xxhash64("id", "code")
    turn = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    index = coded.withColumn("turn", turn).filter(F.col("turn") <= k + 1).select("id", "code", F.pmod(spread, F.lit(shards)).alias("shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    queries = queries.select("id", "code", F.pmod(spread, F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))

    def values(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.combine_chunks()
        return np.asarray(t["id"].combine_chunks()), np.asarray(t["code"].combine_chunks().flatten()).view(np.uint64).reshape(-1, wide)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, own), out = values(left), []
        if left.num_rows and right.num_rows:
            table = Index.of(*values(right), bits)
            for a in range(0, len(ids), 1024):
                found = table.search(ids[a : a + 1024], own[a : a + 1024], k)
                out.append(found + np.array([a, 0, 0]))
        q, d, i = (np.concatenate([np.zeros((0, 3), np.int64), *out])).T
        return pa.table({"id": pa.array(ids[q]), "code": left["code"].combine_chunks().take(pa.array(q)), "distance": pa.array(d.astype(np.int32)), "neighbour_id": pa.array(np.ascontiguousarray(i))})

    found = queries.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInArrow(search, "id bigint, code array<bigint>, distance int, neighbour_id bigint")
    rank = F.row_number().over(Window.partitionBy("id", "code").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour_id", "distance")
