"""Blocks of equal size over the long text, and reading ranges of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SIZE = 64 << 10


def to_blocks(corpus: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(block_id, raw_len, content); the last block may be shorter. One shuffle, by block_id."""
    b = block_size
    some = corpus.filter("n_bytes > 0").select("start", "n_bytes", "content")
    cut = some.select("*", F.explode(F.expr(f"sequence(start div {b}, (start + n_bytes - 1) div {b})")).alias("block_id"))
    first = F.greatest(F.lit(0), F.col("block_id") * b - F.col("start"))
    last = F.least(F.col("n_bytes"), (F.col("block_id") + 1) * b - F.col("start"))
    piece = cut.select("block_id", "start", F.substring("content", (first + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    whole = piece.groupBy("block_id").agg(F.expr("listagg(piece) within group (order by start)").alias("content"))
    return whole.select("block_id", F.octet_length("content").alias("raw_len"), "content")


def spread(rows: DataFrame, each: int = 20_000) -> DataFrame:
    """The rows in tasks of about ``each``, whatever files they lie in: a table of short rows is often one file, which one task would read and work on."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def extract(blocks: DataFrame, requests: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """requests(req_id, off, len) -> (req_id, content). The blocks that a request touches are known from its numbers, so ranges join by
    equality. Bytes past the end are left out; a request without any byte yields no row."""
    b = block_size
    parts = requests.filter("len > 0 and off >= 0").select("req_id", "off", "len", F.explode(F.expr(f"sequence(off div {b}, (off + len - 1) div {b})")).alias("block_id"))
    joined = parts.join(blocks.select("block_id", "content"), "block_id")
    first = F.greatest(F.lit(0), F.col("off") - F.col("block_id") * b)
    last = F.least(F.octet_length("content"), F.col("off") + F.col("len") - F.col("block_id") * b)
    piece = joined.filter(last > first).select("req_id", "block_id", F.substring("content", (first + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    return piece.groupBy("req_id").agg(F.expr("listagg(piece) within group (order by block_id)").alias("content"))
