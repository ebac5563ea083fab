"""Token-id output as sorted-string-table shards: documents keyed by identifier, found by binary search.

A shard is a run of bytes:

    data blocks | Bloom filter | index | footer

A data block holds entries in key order: varint of the bytes shared with the key before, varint of the others, varint of the value's
size, the others, the value. Every ``RESTART``-th key is whole; the offsets of these (u32), their number (u32) and
a CRC-32 close the block. The index has for each block its last key (``KEY`` bytes), offset and size (u64). The footer
has the counts and places of the parts and a magic number. All numbers are little-endian, keys big-endian.

A key is one byte, 0 for a null doc_id and 1 else, and eight bytes of doc_id with the sign flipped, so bytes sort as ids do. A value is
one byte, 0 for a null text and 1 else, and the token ids of the text: two bytes each when the vocabulary has at most
65,536 entries, else four. Byte-level ids give back the very text.

Defined cases. A null doc_id has a key of its own, which sorts first; a null text and an empty one are told apart. Repeated
keys are all kept, in the order of their texts, and a lookup returns all of them. A document larger than a block or a shard gets a block, or a shard,
of its own. An empty table gives no shard. Extra columns are not read. Where shards begin depends on the range partitioning; what they hold together doesn't.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import pieces
from cairn.llm.textkernel import mix
from cairn.llm.tokens import encoder, vocabulary_path

KEY = 9
RESTART = 16
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 8 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"CAIRNSST"
FOOTER = struct.Struct("<QQQQQQII8s")  # entries, tokens, bloom offset and size, index offset and size, bytes an id, CRC of both, magic
SCHEMA = "first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, n_bytes bigint, shard binary"


def keys_of(ids: pa.Array) -> np.ndarray:
    """A row of KEY bytes for each id."""
    number = np.asarray(ids.fill_null(0).cast(pa.int64())).view(np.uint64) ^ np.uint64(1 << 63)
    out = np.zeros((len(ids), KEY), np.uint8)
    some = np.asarray(ids.is_valid())
    out[:, 1:] = number.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[~some] = 0
    out[some, 0] = 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """A row of BLOOM_HASHES bit numbers for each key."""
    low = np.ascontiguousarray(keys[:, 1:]).view("<u8").ravel() ^ keys[:, 0].astype(np.uint64)
    a = mix(low.copy())
    b = mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Collects entries in key order and closes a shard's bytes."""

    def __init__(self, width: int, block_bytes: int = BLOCK_BYTES) -> None:
        self.width, self.block_bytes = width, block_bytes
        self.out, self.index, self.keys, self.tokens = bytearray(), [], [], 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, shared: int, value: bytes) -> None:
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        self.block += _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.keys.append(key)
        self.tokens += (len(value) - 1) // self.width
        if len(self.block) >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.count:
            self.block += struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append(self.last + struct.pack("<QQ", len(self.out), len(self.block)))
            self.out += self.block
            self._open()

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close()
        keys = np.frombuffer(b"".join(self.keys), np.uint8).reshape(-1, KEY)
        bits = -(-max(64, len(keys) * BLOOM_BITS) // 8) * 8
        bloom = np.zeros(bits, bool)
        bloom[_bloom_places(keys, bits).ravel()] = True
        packed, index, at = np.packbits(bloom, bitorder="little").tobytes(), b"".join(self.index), len(self.out)
        self.out += packed + index
        self.out += FOOTER.pack(len(keys), self.tokens, at, len(packed), at + len(packed), len(index), self.width, zlib.crc32(packed + index), MAGIC)
        return bytes(self.out)


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.entries, self.tokens, bloom_at, bloom_n, index_at, index_n, self.width, crc, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC or zlib.crc32(data[bloom_at : index_at + index_n]) != crc:
            raise ValueError("not a whole shard")
        self.bloom, self.bits = data[bloom_at : bloom_at + bloom_n], bloom_n * 8
        self.blocks = [(data[i : i + KEY], *struct.unpack_from("<QQ", data, i + KEY)) for i in range(index_at, index_at + index_n, KEY + 16)]

    def may_have(self, key: bytes) -> bool:
        at = _bloom_places(np.frombuffer(key, np.uint8).reshape(1, KEY), self.bits)[0]
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in at.tolist())

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, size = self.blocks[i]
        block = self.data[at : at + size]
        if zlib.crc32(block[:-4]) != struct.unpack_from("<I", block, size - 4)[0]:
            raise ValueError("a block is damaged")
        (n,) = struct.unpack_from("<I", block, size - 8)
        return block[: size - 8 - 4 * n], list(struct.unpack_from(f"<{n}I", block, size - 8 - 4 * n))

    @staticmethod
    def _entries(block: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, block[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray | None]]:
        for i in range(len(self.blocks)):
            for key, value in self._entries(self._block(i)[0], 0):
                yield self.id_of(key), self.ids_of(value)

    def get(self, doc_id: int | None) -> list[np.ndarray | None]:
        """Token ids of every document with this id; None for a null text."""
        key = keys_of(pa.array([doc_id], pa.int64()))[0].tobytes()
        if not self.may_have(key):
            return []
        low, high = 0, len(self.blocks)
        while low < high:  # the first block whose last key isn't smaller
            mid = (low + high) // 2
            if self.blocks[mid][0] < key:
                low = mid + 1
            else:
                high = mid
        out: list[np.ndarray | None] = []
        for i in range(low, len(self.blocks)):
            block, restarts = self._block(i)
            a, b = 0, len(restarts)
            while a < b:  # the first restart whose key isn't smaller; the key may begin one before
                mid = (a + b) // 2
                if next(self._entries(block, restarts[mid]))[0] < key:
                    a = mid + 1
                else:
                    b = mid
            for k, value in self._entries(block, restarts[max(0, a - 1)]):
                if k == key:
                    out.append(self.ids_of(value))
                elif k > key:
                    return out
        return out

    @staticmethod
    def id_of(key: bytes) -> int | None:
        return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None

    def ids_of(self, value: bytes) -> np.ndarray | None:
        return np.frombuffer(value, f"<u{self.width}", offset=1) if value[0] else None


def write_shards(docs: DataFrame, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each shard, with SCHEMA's columns. Shards don't overlap but in repeated ids, and sort by first_id."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if enc.size <= 1 << 16 else 4
        shard, ids, before = Writer(width, block_bytes), [], None

        def close() -> pa.RecordBatch:
            data = shard.finish()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((ids[0], pa.int64()), (ids[-1], pa.int64()), (len(ids), pa.int64()), (shard.tokens, pa.int64()), (len(data), pa.int64()), (data, pa.binary()))], ["first_id", "last_id", "n_docs", "n_tokens", "n_bytes", "shard"])

        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                keys = keys_of(part.column("doc_id"))
                shared = np.zeros(len(keys), np.int64)
                shared[1:] = np.where((keys[1:] == keys[:-1]).all(1), KEY, (keys[1:] != keys[:-1]).argmax(1))
                flat, at = enc.encode(part.column("text"))
                raw = flat.astype(f"<u{width}").tobytes()
                valid, listed = part.column("text").is_valid().to_pylist(), part.column("doc_id").to_pylist()
                rows, same = keys.tobytes(), shared.tolist()
                bounds = (at * width).tolist()
                for i, doc_id in enumerate(listed):
                    key = rows[i * KEY : (i + 1) * KEY]
                    shared_now = same[i] if i or before is None else next((j for j in range(KEY) if key[j] != before[j]), KEY)
                    shard.add(key, shared_now, b"\1" + raw[bounds[i] : bounds[i + 1]] if valid[i] else b"\0")
                    ids.append(doc_id)
                    before = key
                    if shard.size() >= shard_bytes:
                        yield close()
                        shard, ids = Writer(width, block_bytes), []
        if ids:
            yield close()

    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.mapInArrow(run, SCHEMA)


def lookup(shards: DataFrame, ids: list[int | None]) -> DataFrame:
    """(doc_id, tokens): the documents with these ids. Shards whose range or Bloom filter excludes all ids aren't searched."""
    some = [i for i in ids if i is not None]
    near = F.lit(False)
    if some:
        near = near | (F.coalesce(F.col("last_id"), F.lit(min(some) - 1)) >= min(some)) & (F.coalesce(F.col("first_id"), F.lit(min(some))) <= max(some))
    if len(some) < len(ids):
        near = near | F.col("first_id").isNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("shard"):
                shard = Shard(data.as_py())
                found = [(i, v) for i in ids for v in shard.get(i)]
                if found:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in found], pa.int64()), "tokens": pa.array([None if v is None else v.tolist() for _, v in found], pa.list_(pa.int32()))})

    return shards.filter(near).select("shard").mapInArrow(run, "doc_id bigint, tokens array<int>")


def scan(shards: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text): all documents, decoded."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for data in batch.column("shard"):
                rows = [(i, None if v is None else enc.direct.decode_bytes(v.tolist()).decode("utf-8", "surrogatepass")) for i, v in Shard(data.as_py()).scan()]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})

    return shards.select("shard").mapInArrow(run, "doc_id bigint, text string")
