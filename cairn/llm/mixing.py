"""Mixing sources to target weights.

Tokens (runs of non-white-space of a text) are packed, by source, into blocks of ``block`` tokens. The output consists of
shards of ``shard`` slots each; every shard draws from the multinomial distribution of the target weights how many of
its slots each source fills. The k-th slot of a source, counted over all shards, takes block number perm(k mod n) of the source's n blocks,
where perm is a pseudorandom permutation of the n indices (a Feistel network with cycle walking), another one for
each round through the source. So within a round no block is used twice, and in full rounds every one is used once.
Slots and blocks are joined by (source, index).

To pack without a global order, the documents of a source are spread by a hash of (doc_id, text) over stripes of about
``STRIPE_TOKENS`` tokens, packed within a stripe in the order (doc_id, text), and the stripes' blocks are numbered one stripe after another. The stripes' counts and
first numbers are a table, by two levels of prefix sums; a slot finds its stripe by a join on cells of the index, and the texts are
shuffled once, to where their stripe's slots are. Where a source is gone through many times, every ``ROUNDS`` rounds are a group of their own, so
the slots of a group are bounded. The driver has a few numbers of each source.

Without given weights, the target weight of a source is proportional to its tokens to the power ``TEMPERATURE``. There are as
many slots as blocks unless ``slots`` says otherwise.

Defined cases. Texts that are null or blank have no tokens and go into no block. A null source is a source like any other (its
weight is under None). The last block of a stripe may be shorter; no token is lost or padded. A source with weight but without tokens is left out, and
the other weights are scaled up; a source without weight fills no slot. Repeated rows are repeated text. A null doc_id sorts
first and is left out of ``doc_ids``. Very long texts run over many blocks. An empty table, or one without tokens, gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import write_table
from cairn.llm.textkernel import mix

BLOCK = 512
SHARD = 256
STRIPE_TOKENS = 1 << 18
TEMPERATURE = 0.5
ROUNDS = 4
GROUP = 1024  #: shards whose counts are added up at once
SCHEMA = "shard bigint, slot int, source string, round bigint, block bigint, n_tokens int, doc_ids array<bigint>, lang string, text string"
_TOKENS = r"\s+"
_WHITE, _RARE = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile("[\x1c-\x1f]")


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), chosen by key, at these indices."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for turn in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            left, right = right, left ^ (mix(right + salt) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo[todo] = x[todo] >= size
    return x.astype(np.int64)


def draws(shard: int, slots: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """How many of the shard's slots each source fills."""
    return np.random.default_rng([seed, shard]).multinomial(slots, weights)


def _of(source: object) -> int:
    """A number that stands for a source in keys."""
    data = b"\0" if source is None else b"\1" + str(source).encode()
    h = 1469598103934665603
    for c in data:
        h = ((h ^ c) * 1099511628211) & ((1 << 64) - 1)
    return h


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, slots: int | None = None, block: int = BLOCK, shard: int = SHARD, stripe_tokens: int = STRIPE_TOKENS, seed: int = 11) -> DataFrame:
    """A row for each slot of each output shard, with SCHEMA's columns; text holds the block's tokens with single
    spaces between, doc_ids the documents they come from, lang the language of the first."""
    spark = docs.sparkSession
    cols = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    tokens = F.size(F.filter(F.split(F.col("text"), _TOKENS), lambda t: t != ""))
    docs = docs.select(*cols).filter("text is not null")
    spread = F.xxhash64("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (size // stripe_tokens + 1).bit_length()  # a token has a byte at least, so no source needs more fine stripes
    fine = docs.select("source", F.pmod(spread, F.lit(1 << bits)).alias("fine"), tokens.alias("n")).groupBy("source", "fine").agg(F.sum("n").alias("n")).filter("n > 0")
    fine = write_table(fine, "stripes")
    totals = sorted(((r["source"], r["n"]) for r in fine.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    if not totals:
        return spark.createDataFrame([], SCHEMA)
    target = np.array([float((weights or {}).get(s, 0.0)) if weights is not None else float(n) ** TEMPERATURE for s, n in totals])
    if not (target > 0).any():
        return spark.createDataFrame([], SCHEMA)
    target /= target.sum()
    names = [s for s, _ in totals]
    stripes = [1 << max(0, (n - 1) // stripe_tokens).bit_length() for _, n in totals]
    known = F.broadcast(spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(zip(names, stripes))], "k int, _source string, stripes bigint"))
    of_source = F.col("source").eqNullSafe(F.col("_source"))
    mine = fine.join(known, of_source).groupBy("k", F.pmod("fine", "stripes").alias("stripe")).agg(F.expr(f"(sum(n) + {block - 1}) div {block}").alias("blocks")).withColumn("part", F.floor(F.col("stripe") / GROUP))
    upper = mine.groupBy("k", "part").agg(F.sum("blocks").alias("b"))
    upper = upper.select("k", "part", (F.sum("b").over(Window.partitionBy("k").orderBy("part")) - F.col("b")).alias("before"))
    inner = F.sum("blocks").over(Window.partitionBy("k", "part").orderBy("stripe")) - F.col("blocks")
    bases = write_table(mine.withColumn("inner", inner).join(upper, ["k", "part"]).select("k", "stripe", "blocks", (F.col("before") + F.col("inner")).alias("base")), "bases")
    n_blocks = [n for _, n in sorted((r["k"], r["n"]) for r in bases.groupBy("k").agg(F.sum("blocks").alias("n")).collect())]
    slots = sum(n_blocks) if slots is None else slots
    shards = -(-slots // shard)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            n = np.array([draws(int(i), min(shard, slots - int(i) * shard), target, seed) for i in ids]).reshape(len(ids), len(names))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.repeat(ids, len(names))), "k": pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(ids))), "n": pa.array(n.ravel())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots of each (shard, source), with the index of their block."""
        for b in batches:
            sh, k, n, before, inside = (np.asarray(b.column(c)) for c in ("shard", "k", "n", "before", "inside"))
            row = np.repeat(np.arange(len(n)), n)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            out_index, out_round = (np.zeros(len(row), np.int64) for _ in range(2))
            for i in np.unique(k):
                mine = np.flatnonzero(k[row] == i)
                out_round[mine], index = np.divmod(before[row[mine]] + turn[mine], n_blocks[i])
                for r in np.unique(out_round[mine]):
                    now = out_round[mine] == r
                    index[now] = permute(index[now], n_blocks[i], _of(names[i]) ^ (seed * 1000003 + int(r)))
                out_index[mine] = index
            yield pa.RecordBatch.from_pydict({"k": pa.array(k[row]), "index": pa.array(out_index), "shard": pa.array(sh[row]), "slot": pa.array((inside[row] + turn).astype(np.int32)), "round": pa.array(out_round)})

    tasks = int(min(max(1, shards // 64), 20_000))
    drawn = spark.range(0, shards, 1, tasks).mapInArrow(count, "shard bigint, k int, n bigint").withColumn("part", F.floor(F.col("shard") / GROUP))
    parts = drawn.groupBy("part", "k").agg(F.sum("n").alias("n"))
    parts = parts.select("part", "k", (F.sum("n").over(Window.partitionBy("k").orderBy("part")) - F.col("n")).alias("start"))
    within = F.sum("n").over(Window.partitionBy("part", "k").orderBy("shard")) - F.col("n")
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("k")) - F.col("n")
    ranked = drawn.withColumn("within", within).join(parts, ["part", "k"]).withColumn("inside", inside).withColumn("before", F.col("within") + F.col("start")).filter("n > 0")
    wanted = ranked.select("shard", "k", "n", "before", "inside").mapInArrow(fill, "k int, index bigint, shard bigint, slot int, round bigint")
    cell = max(1, stripe_tokens // block)
    cells = bases.select("k", "stripe", "base", "blocks", F.explode(F.expr(f"sequence(base div {cell}, (base + blocks - 1) div {cell})")).alias("cell"))
    wanted = wanted.withColumn("cell", F.expr(f"index div {cell}")).join(cells, ["k", "cell"]).filter("index >= base and index < base + blocks")
    wanted = wanted.select("k", "stripe", F.floor(F.col("round") / ROUNDS).alias("turn"), "index", "base", "shard", "slot", "round")
    # How many turns a source has at most: its slots are no more than all.
    turns = drawn.groupBy("k").agg(F.sum("n").alias("n")).collect()
    turns = spark.createDataFrame([(r["k"], names[r["k"]], stripes[r["k"]], -(-r["n"] // (n_blocks[r["k"]] * ROUNDS))) for r in turns if r["n"]], "k int, _source string, stripes bigint, turns bigint")
    placed = docs.join(F.broadcast(turns), of_source).select("k", F.pmod(spread, "stripes").alias("stripe"), F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"), "doc_id", "text", "lang")

    def pack(key: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
        k = key[0].as_py()
        if not asked.num_rows or not texts.num_rows:
            return _out([], [], [], [], [], [], [], [], [])
        texts = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if texts.column("doc_id").null_count == 0 else _nulls_first(texts)
        ids, langs = texts.column("doc_id").to_pylist(), texts.column("lang").to_pylist()
        words: list[str] = []
        ends = np.zeros(len(ids), np.int64)
        for i, t in enumerate(texts.column("text")):
            words.extend(_split(t.as_py()))
            ends[i] = len(words)
        index, base, sh, slot, rnd = (np.asarray(asked.column(c)) for c in ("index", "base", "shard", "slot", "round"))
        made: dict[int, tuple] = {}
        rows = []
        for j in range(len(index)):
            at = int(index[j] - base[j])
            if at not in made:
                a, b = at * block, min((at + 1) * block, len(words))
                first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
                some = [ids[x] for x in range(first, last + 1) if ids[x] is not None and ends[x] > (ends[x - 1] if x else 0)]
                made[at] = (b - a, some, langs[first], " ".join(words[a:b]))
            rows.append((int(sh[j]), int(slot[j]), names[k], int(rnd[j]), int(index[j]), *made[at]))
        return _out(*zip(*rows))

    return placed.groupBy("k", "stripe", "turn").cogroup(wanted.groupBy("k", "stripe", "turn")).applyInArrow(pack, SCHEMA)


def _split(text: str) -> list[str]:
    """As Spark's split by ``_TOKENS``: only ASCII white space parts tokens."""
    return text.split() if text.isascii() and not _RARE.search(text) else [t for t in _WHITE.split(text) if t]


def _nulls_first(t: pa.Table) -> pa.Table:
    import pyarrow.compute as pc

    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def _out(*cols: object) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, cols, types)})


def as_documents(mixed: DataFrame, shard: int = SHARD) -> DataFrame:
    """Mixed blocks as rows of documents: doc_id is the number of the slot in the whole output."""
    return mixed.select((F.col("shard") * shard + F.col("slot")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
