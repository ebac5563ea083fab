"""Codecs for arrays of unsigned integers. Each is named by a string, such as ``vbyte``, ``fixed-7``, ``aligned``, ``zlib-9``,
``bzip2-9``, ``lzma-6``, ``lz4`` or ``brotli-6``; the number of elements is kept elsewhere."""

from __future__ import annotations

import bz2
import lzma
import zlib

import numpy as np
import pyarrow as pa

NAMES = ["vbyte", "fixed-7", "aligned", "zlib-9", "bzip2-9", "lzma-6", "lz4", "brotli-6"]


def _vbyte(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the high bit says that more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[at[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def _unvbyte(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)[:n]
    first = np.r_[0, last[:-1] + 1] if n else last
    out = np.zeros(n, np.uint64)
    for k in range(int((last - first).max()) + 1 if n else 0):
        some = first + k <= last
        out[some] |= (raw[first[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def encode(codec: str, values: np.ndarray) -> bytes:
    """values: an array of uint8, uint32 or uint64."""
    if values.dtype.kind != "u":
        raise TypeError("only unsigned integers can be encoded")
    name, _, level = codec.partition("-")
    if name == "vbyte":
        return _vbyte(values)
    if name == "fixed":
        width = int(level)
        if len(values) and int(values.max()) >> width:
            raise ValueError(f"a value needs more than {width} bits")
        bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
    raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
    if name == "aligned":
        return raw
    if name == "zlib":
        z = zlib.compressobj(int(level or 9), zlib.DEFLATED, 15, 9)
        return z.compress(raw) + z.flush()
    if name == "bzip2":
        return bz2.compress(raw, max(1, min(int(level or 9), -(-len(raw) // 100_000))))  # larger blocks than the data only cost memory
    if name == "lzma":
        few = {"id": lzma.FILTER_LZMA2, "preset": int(level or 6)} | ({"dict_size": max(4096, len(raw))} if len(raw) < 1 << 20 else {})
        return lzma.compress(raw, check=lzma.CHECK_NONE, filters=[few])
    if name == "lz4":
        return pa.Codec("lz4_raw").compress(raw, asbytes=True) if raw else b""
    if name == "brotli":
        return pa.Codec("brotli", compression_level=int(level or 6)).compress(raw, asbytes=True) if raw else b""
    raise ValueError(f"unknown codec {codec}")


def decode(codec: str, data: bytes, n: int, kind: type = np.uint32) -> np.ndarray:
    name, _, level = codec.partition("-")
    dtype = np.dtype(kind).newbyteorder("<")
    if name == "vbyte":
        return _unvbyte(data, n).astype(kind)
    if name == "fixed":
        width = int(level)
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
        return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(kind)
    size = n * dtype.itemsize
    if name == "aligned":
        raw = data
    elif name == "zlib":
        raw = zlib.decompress(data)
    elif name == "bzip2":
        raw = bz2.decompress(data)
    elif name == "lzma":
        raw = lzma.decompress(data)
    elif name in ("lz4", "brotli"):
        raw = pa.Codec("lz4_raw" if name == "lz4" else "brotli").decompress(data, decompressed_size=size, asbytes=True) if size else b""
    else:
        raise ValueError(f"unknown codec {codec}")
    if len(raw) != size:
        raise ValueError("the stream has another size than its array")
    return np.frombuffer(raw, dtype).astype(kind)
