"""The stores: blocks as factors of a dictionary in three coded streams, and blocks compressed each by itself."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import decode, encode
from cairn.functions.match import LITERAL, MAX_DICTIONARY, Index, suffix_array
from cairn.operators import dictionary as dictionaries
from cairn.operators import prune
from cairn.operators.blocks import BLOCK_SIZE, extract

ENCODED = "block_id bigint, raw_len int, n_factors int, len_stream binary, lit_stream binary, off_stream binary"
FACTORS = "block_id bigint, seq int, is_literal boolean, offset int, len int, literal binary"


@dataclass(frozen=True)
class StoreConfig:
    dictionary: str = "uniform"
    dict_bytes: int = 8 << 20
    sample: int = 1024
    prune: str = "none"
    pruned_bytes: int = 0
    block_size: int = BLOCK_SIZE
    threshold: int = 3
    select: str = "leftmost"
    coder: str = "three"
    codecs: tuple[str, str, str] = ("zlib-9", "zlib-9", "zlib-9")  #: of lengths, literals, offsets
    options: dict = field(default_factory=dict)

    def name(self) -> str:
        import hashlib

        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


PRESETS = {
    "standard": StoreConfig(),
    "zzz": StoreConfig(),
    "u32v": StoreConfig(codecs=("vbyte", "aligned", "aligned")),
    "zz": StoreConfig(threshold=1, coder="two"),
    "ll": StoreConfig(threshold=1, coder="two", codecs=("lzma-6", "lzma-6", "lzma-6")),
    "coverage": StoreConfig(dictionary="coverage"),
}


@lru_cache(2)
def _index(data: bytes, order: bytes) -> Index:
    return Index.of(data, np.frombuffer(order, np.int32))


def encode_block(block: bytes, offsets: np.ndarray, lengths: np.ndarray, cfg: StoreConfig) -> tuple[bytes, bytes, bytes]:
    """Streams of lengths - 1, literal bytes and offsets. The two-stream coder has offsets and literal bytes in one."""
    literal = offsets == LITERAL
    ends = np.cumsum(lengths)
    flags = np.repeat(literal, lengths)
    raw = np.frombuffer(block, np.uint8)
    first = encode(cfg.codecs[0], (lengths - 1).astype(np.uint32))
    if cfg.coder == "two":
        size = np.where(literal, lengths, 1)
        at = np.cumsum(size) - size
        mixed = np.zeros(int(size.sum()), np.uint32)
        mixed[at[~literal]] = offsets[~literal]
        n = lengths[literal]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        mixed[np.repeat(at[literal], n) + inside] = raw[np.repeat((ends - lengths)[literal], n) + inside]
        return first, b"", encode(cfg.codecs[2], mixed)
    return first, encode(cfg.codecs[1], raw[flags].copy()), encode(cfg.codecs[2], offsets[~literal].astype(np.uint32))


def decode_streams(n: int, streams: tuple[bytes, bytes, bytes], cfg: StoreConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (LITERAL for a literal), lengths and all literal bytes of a block. Counts follow from the lengths."""
    lengths = decode(cfg.codecs[0], streams[0], n).astype(np.int64) + 1
    literal = lengths <= cfg.threshold
    offsets = np.full(n, LITERAL)
    if cfg.coder == "two":
        size = np.where(literal, lengths, 1)
        mixed = decode(cfg.codecs[2], streams[2], int(size.sum()))
        of_literal = np.repeat(literal, size)
        offsets[~literal] = mixed[~of_literal]
        return offsets, lengths, mixed[of_literal].astype(np.uint8)
    bytes_ = decode(cfg.codecs[1], streams[1], int(lengths[literal].sum()), np.uint8)
    offsets[~literal] = decode(cfg.codecs[2], streams[2], int((~literal).sum()))
    return offsets, lengths, bytes_


def decode_block(n: int, streams: tuple[bytes, bytes, bytes], data: np.ndarray, cfg: StoreConfig) -> bytes:
    offsets, lengths, literals = decode_streams(n, streams, cfg)
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(begin, lengths)
    literal = np.repeat(offsets == LITERAL, lengths)
    out = np.empty(total, np.uint8)
    out[literal] = literals
    out[~literal] = data[(np.repeat(offsets, lengths) + inside)[~literal]]
    return out.tobytes()


def _batches(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(np.asarray(batch.column("raw_len")).astype(np.int64)) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(size)) + 1, batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def _shared(blocks: DataFrame, data: bytes) -> Broadcast:
    """The dictionary and its suffix array, which is made once, on the driver."""
    if len(data) > MAX_DICTIONARY:
        raise ValueError(f"a dictionary has at most {MAX_DICTIONARY} bytes, for it goes to every executor")
    order = suffix_array(np.frombuffer(data, np.uint8)).astype(np.int32).tobytes()
    return blocks.sparkSession.sparkContext.broadcast((data, order))


def usage_of(blocks: DataFrame, data: bytes, cfg: StoreConfig) -> DataFrame:
    """What ``prune.usage`` gives for the factors of all blocks: they are parsed where they are, and only each task's sums leave it."""
    shared = _shared(blocks, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, steps = _index(*shared.value), np.zeros(len(shared.value[0]) + 1, np.int64)
        for whole in batches:
            for b in _batches(whole):
                content = b.column("content").dictionary_encode()
                times = np.bincount(np.asarray(content.indices), minlength=len(content.dictionary))
                for offsets, lengths, n in zip(*index.parse(content.dictionary.to_pylist(), cfg.threshold), times.tolist()):
                    copies = offsets != LITERAL
                    np.add.at(steps, offsets[copies], n)
                    np.add.at(steps, offsets[copies] + lengths[copies], -n)
        at = np.flatnonzero(steps)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(at.astype(np.int32)), "d": pa.array(steps[at])})

    return prune.summed(blocks.select("raw_len", "content").mapInArrow(run, "pos int, d bigint"))


def encode_blocks(blocks: DataFrame, data: bytes, cfg: StoreConfig) -> DataFrame:
    """Parses and encodes every block where it is; no shuffle. Equal blocks of a batch are parsed once."""
    shared = _shared(blocks, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*shared.value)
        for whole in batches:
            for b in _batches(whole):
                content = b.column("content").dictionary_encode()
                raw = content.dictionary.to_pylist()
                offsets, lengths = index.parse(raw, cfg.threshold)
                coded = [encode_block(*x, cfg) for x in zip(raw, offsets, lengths)]
                columns = [pa.array([len(x) for x in lengths], pa.int32()), *(pa.array([c[i] for c in coded], pa.binary()) for i in range(3))]
                yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("raw_len"), *(c.take(content.indices) for c in columns)], [c.split()[0] for c in ENCODED.split(", ")])

    return blocks.select("block_id", "raw_len", "content").mapInArrow(run, ENCODED)


def _streams(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(b.column("n_factors").to_pylist(), zip(*(b.column(c).to_pylist() for c in ("len_stream", "lit_stream", "off_stream"))))


def decode_blocks(encoded: DataFrame, data: bytes, cfg: StoreConfig) -> DataFrame:
    """(block_id, raw_len, content)."""
    shared = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for b in _batches(whole):
                yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("raw_len"), pa.array([decode_block(n, s, text, cfg) for n, s in _streams(b)], pa.binary())], ["block_id", "raw_len", "content"])

    return encoded.mapInArrow(run, "block_id bigint, raw_len int, content binary")


def factors_of(encoded: DataFrame, cfg: StoreConfig) -> DataFrame:
    """A row for each factor, from the streams alone. Equal streams of a batch are decoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _batches(whole, 1 << 20):
                seen: dict[tuple, int] = {}
                which = [seen.setdefault(x, len(seen)) for x in _streams(b)]
                decoded = [decode_streams(n, s, cfg) for n, s in seen]
                offsets, lengths, literals = (np.concatenate([decoded[w][i] for w in which]) for i in range(3))
                size = np.asarray(b.column("n_factors")).astype(np.int64)
                first, n = np.repeat(np.cumsum(size) - size, size), int(size.sum())
                literal = offsets == LITERAL
                data = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(np.packbits(literal, bitorder="little")), pa.py_buffer(np.r_[0, np.cumsum(np.where(literal, lengths, 0))].astype(np.int32)), pa.py_buffer(literals)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("block_id")), size)), pa.array((np.arange(n) - first).astype(np.int32)), pa.array(literal), pa.array(offsets.astype(np.int32), mask=literal), pa.array(lengths.astype(np.int32)), data], [c.split()[0] for c in FACTORS.split(", ")])

    return encoded.mapInArrow(run, FACTORS)


@dataclass
class Store:
    """A store of blocks: tables and a dictionary."""

    encoded: DataFrame
    data: bytes
    cfg: StoreConfig

    def blocks(self, ids: list[int] | None = None) -> DataFrame:
        """All blocks decoded, or those with the given ids; the ids reach the scan as a filter."""
        rows = self.encoded if ids is None else self.encoded.filter(F.col("block_id").isin(list(ids)))
        return decode_blocks(rows, self.data, self.cfg)

    block = blocks

    def scan(self) -> DataFrame:
        return self.blocks()

    def factors(self, ids: list[int] | None = None) -> DataFrame:
        return factors_of(self.encoded if ids is None else self.encoded.filter(F.col("block_id").isin(list(ids))), self.cfg)

    def block_factors(self, ids: list[int]) -> DataFrame:
        sizes = self.stream_sizes()
        return self.factors(ids).join(sizes, "block_id")

    def stream_sizes(self) -> DataFrame:
        return self.encoded.select("block_id", *(F.octet_length(f"{c}_stream").alias(f"{c}_bytes") for c in ("len", "lit", "off")))

    def block_map(self) -> DataFrame:
        size = F.octet_length("len_stream") + F.octet_length("lit_stream") + F.octet_length("off_stream")
        return self.encoded.select("block_id", "n_factors", size.alias("encoded_bytes"))

    def extract(self, requests: DataFrame) -> DataFrame:
        """requests(req_id, off, len) -> (req_id, content). Each block that is asked for is decoded once."""
        b = self.cfg.block_size
        needed = requests.filter("len > 0 and off >= 0").select(F.explode(F.expr(f"sequence(off div {b}, (off + len - 1) div {b})")).alias("block_id")).distinct()
        return extract(decode_blocks(self.encoded.join(needed, "block_id", "left_semi"), self.data, self.cfg), requests, b)

    def documents(self, corpus: DataFrame, ids: list[str]) -> DataFrame:
        """(ids, content): documents by their places in the text; corpus has ids, start, n_bytes."""
        asked = corpus.select(*ids, F.col("start").alias("req_id"), F.col("start").alias("off"), F.col("n_bytes").alias("len"))
        found = self.extract(asked.filter("len > 0").select("req_id", "off", "len"))
        return asked.join(found.select(F.col("req_id").alias("found"), "content"), (F.col("req_id") == F.col("found")) & (F.col("len") > 0), "left").select(*ids, F.coalesce("content", F.lit(b"")).alias("content"))

    def size(self) -> int:
        return int(self.encoded.agg(F.coalesce(F.sum("raw_len"), F.lit(0))).first()[0])

    def size_in_bytes(self) -> int:
        return int(self.block_map().agg(F.coalesce(F.sum("encoded_bytes"), F.lit(0))).first()[0]) + len(self.data)

    def reencode(self, codecs: tuple[str, str, str] | None = None, coder: str | None = None) -> Store:
        """The same factors in other codecs; nothing is matched again."""
        new = replace(self.cfg, codecs=codecs or self.cfg.codecs, coder=coder or self.cfg.coder)
        old, shared = self.cfg, self.encoded.sparkSession.sparkContext.broadcast(self.data)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text = np.frombuffer(shared.value, np.uint8)
            for whole in batches:
                for b in _batches(whole):
                    coded = []
                    for n, s in _streams(b):
                        offsets, lengths, _ = decode_streams(n, s, old)
                        coded.append(encode_block(decode_block(n, s, text, old), offsets, lengths, new))
                    yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("raw_len"), b.column("n_factors"), *(pa.array([c[i] for c in coded], pa.binary()) for i in range(3))], [c.split()[0] for c in ENCODED.split(", ")])

        return Store(self.encoded.mapInArrow(run, ENCODED), self.data, new)

    def save(self, path: str) -> None:
        spark = self.encoded.sparkSession
        self.encoded.repartitionByRange("block_id").sortWithinPartitions("block_id").write.parquet(f"{path}/encoded")
        row = [(json.dumps(asdict(self.cfg), sort_keys=True), dictionaries.fingerprint(self.data), bytearray(self.data))]
        spark.createDataFrame(row, "config string, dict_id bigint, content binary").coalesce(1).write.parquet(f"{path}/manifest")


def build(blocks: DataFrame, cfg: StoreConfig = StoreConfig()) -> Store:  # noqa: B008
    data = dictionaries.STRATEGIES[cfg.dictionary](blocks, cfg.dict_bytes, block_size=cfg.block_size, **({} if cfg.dictionary in ("none", "assemble", "assemble_disjoint") else {"sample": cfg.sample}), **cfg.options)
    if cfg.prune != "none" and cfg.pruned_bytes and len(data) > cfg.pruned_bytes:
        data = prune.STRATEGIES[cfg.prune](data, usage_of(blocks, data, cfg), cfg.pruned_bytes)
    return Store(encode_blocks(blocks, data, cfg), data, cfg)


def load(spark: SparkSession, path: str) -> Store:
    """A saved store; it fails if a part is missing or the dictionary isn't the one that the manifest names."""
    row = spark.read.parquet(f"{path}/manifest").first()
    data, cfg = bytes(row["content"]), json.loads(row["config"])
    if dictionaries.fingerprint(data) != row["dict_id"]:
        raise ValueError("LOAD FAILED: the dictionary has another fingerprint")
    cfg["codecs"] = tuple(cfg["codecs"])
    return Store(spark.read.parquet(f"{path}/encoded"), data, StoreConfig(**cfg))


def build_or_load(blocks: DataFrame, root: str, cfg: StoreConfig = StoreConfig(), rebuild: bool = False) -> Store:  # noqa: B008
    """The store of this configuration under ``root``, built unless it is there."""
    spark = blocks.sparkSession
    path = f"{root}/{cfg.name()}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS"))
    if rebuild or not done:
        fs.delete(at, True)
        build(blocks, cfg).save(path)
    return load(spark, path)


def verify(decoded: DataFrame, blocks: DataFrame) -> DataFrame:
    """(n_blocks, n_bad): every block of either side is compared."""
    a = blocks.select("block_id", F.sha2("content", 256).alias("h"))
    b = decoded.select(F.col("block_id").alias("other"), F.sha2("content", 256).alias("g"))
    return a.join(b, a["block_id"] == b["other"], "full").agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum((~F.col("h").eqNullSafe(F.col("g"))).cast("bigint")), F.lit(0).cast("bigint")).alias("n_bad"))


def lz_encode(blocks: DataFrame, codec: str = "zlib-9") -> DataFrame:
    """(block_id, raw_len, codec, payload): every block compressed by itself. Of a batch few are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _batches(whole):
                data = [encode(codec, np.frombuffer(x.as_buffer(), np.uint8)) for x in b.column("content")]
                yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("raw_len"), pa.array([codec] * len(data)), pa.array(data, pa.binary())], ["block_id", "raw_len", "codec", "payload"])

    return blocks.select("block_id", "raw_len", "content").mapInArrow(run, "block_id bigint, raw_len int, codec string, payload binary")


def lz_decode(lz: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _batches(whole):
                data = [decode(c, p, n, np.uint8).tobytes() for c, p, n in zip(*(b.column(x).to_pylist() for x in ("codec", "payload", "raw_len")))]
                yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("raw_len"), pa.array(data, pa.binary())], ["block_id", "raw_len", "content"])

    return lz.mapInArrow(run, "block_id bigint, raw_len int, content binary")
