"""Statistics of stores, each a DataFrame."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _encoded() -> Column:
    return F.octet_length("len_stream") + F.octet_length("lit_stream") + F.octet_length("off_stream")


def encoding_summary(encoded: DataFrame, dict_bytes: int) -> DataFrame:
    """Text and encoding bytes (the dictionary included), their ratio in percent, factors, bits a factor, blocks."""
    sums = encoded.agg(F.sum("raw_len").alias("text_bytes"), F.sum(_encoded()).alias("stream_bytes"), F.sum("n_factors").alias("n_factors"), F.count("*").alias("n_blocks"))
    size = F.col("stream_bytes") + dict_bytes
    return sums.select(
        "text_bytes", size.alias("encoding_bytes"), (size / F.col("text_bytes") * 100).alias("ratio_pct"), (100 - size / F.col("text_bytes") * 100).alias("savings_pct"),
        "n_factors", (size * 8 / F.col("n_factors")).alias("bits_per_factor"), (F.col("stream_bytes") * 8 / F.col("n_factors")).alias("stream_bits_per_factor"),
        "n_blocks", (F.col("n_factors") / F.col("n_blocks")).alias("factors_per_block"),
    )


def distribution(rows: DataFrame, value: Column) -> DataFrame:
    """min, q1, median, mean, q3, max; quartiles are the values at the ranks n/4, n/2 and 3n/4, counted from 0."""
    v = rows.select(value.cast("bigint").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    seen = v.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("v")))
    return seen.agg(F.min("v").alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), at(0.75).alias("q3"), F.max("v").alias("max"))


def block_sizes(encoded: DataFrame) -> DataFrame:
    return distribution(encoded, _encoded())


def factors_per_block(encoded: DataFrame) -> DataFrame:
    return distribution(encoded, F.col("n_factors"))


def length_histogram(factors: DataFrame) -> DataFrame:
    """(len, n): factors by length; literals count at 0."""
    return factors.groupBy(F.when(F.col("is_literal"), 0).otherwise(F.col("len")).alias("len")).agg(F.count("*").alias("n"))


def literal_share(factors: DataFrame) -> DataFrame:
    return factors.agg(F.count("*").alias("n_factors"), F.sum(F.col("is_literal").cast("bigint")).alias("n_literals"), F.sum(F.when(F.col("is_literal"), F.col("len")).otherwise(0)).alias("literal_bytes"), F.sum("len").alias("text_bytes"))


def usage_thresholds(bytes_used: DataFrame) -> DataFrame:
    """(at_least, n): bytes that no factor copies (at_least 0), and those copied at least 1, 2, 4, ... times."""
    zero = F.array(F.struct(F.lit(0).cast("bigint").alias("at_least"), (F.col("freq") == 0).cast("bigint").alias("n")))
    powers = F.expr("transform(sequence(0, cast(floor(log2(freq)) as int)), i -> struct(shiftleft(1L, i) as at_least, 1L as n))")
    steps = bytes_used.select(F.inline(F.when(F.col("freq") > 0, F.concat(zero, powers)).otherwise(zero)))  # one pass; no row is counted twice
    none = bytes_used.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("at_least"), F.lit(None).cast("bigint").alias("n"))
    return steps.union(none).groupBy("at_least").agg(F.sum("n").alias("n"))


def zero_runs(bytes_used: DataFrame) -> DataFrame:
    """(offset, length) of the longest runs of bytes that no factor copies."""
    zero = bytes_used.filter("freq = 0").withColumn("island", F.col("pos") - F.row_number().over(Window.orderBy("pos")))
    return zero.groupBy("island").agg(F.min("pos").alias("offset"), F.count("*").alias("length")).drop("island")


def zero_places(bytes_used: DataFrame, modulo: int = 1024) -> DataFrame:
    return bytes_used.filter("freq = 0").groupBy((F.col("pos") % modulo).alias("place")).agg(F.count("*").alias("n"))


def heatmap(bytes_used: DataFrame, data: bytes, start: int, end: int, cells: int) -> DataFrame:
    """(cell, start, stop, freq, avg_freq, content): the use of a stretch of the dictionary, in equal cells."""
    width = max(1, -(-(end - start) // cells))
    rows = bytes_used.filter((F.col("pos") >= start) & (F.col("pos") < end)).groupBy(F.expr(f"(pos - {start}) div {width}").alias("cell")).agg(F.sum("freq").alias("freq"), F.avg("freq").alias("avg_freq"))
    first = F.col("cell") * width + start
    content = F.substring(F.lit(bytearray(data)), (first + 1).cast("int"), F.lit(width))
    return rows.select("cell", first.alias("start"), F.least(first + width, F.lit(end)).alias("stop"), "freq", "avg_freq", printable(content).alias("content"))


def printable(content: Column) -> Column:
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), "[^ -~]", "?")


def count_of_counts(grams: DataFrame) -> DataFrame:
    """(freq, n): how many different runs occur freq times."""
    return grams.groupBy("freq").agg(F.count("*").alias("n"))


def archive_ratio(encoded: DataFrame, data: bytes) -> DataFrame:
    """Streams, block map (12 bytes a block) and the compressed dictionary against the text."""
    packed = len(zlib.compress(data, 9))
    return encoded.agg(((F.sum(_encoded() + 12) + packed) / F.sum("raw_len")).alias("ratio"))


def lz_archive_ratio(lz: DataFrame) -> DataFrame:
    return lz.groupBy("codec").agg((F.sum(F.octet_length("payload") + 8) / F.sum("raw_len")).alias("ratio"))


def checksum(blocks: DataFrame) -> DataFrame:
    """(n_blocks, n_bytes, crc): touches every decoded byte; for timing a whole decode."""
    return blocks.agg(F.count("*").alias("n_blocks"), F.sum(F.octet_length("content")).alias("n_bytes"), F.sum(F.crc32("content")).alias("crc"))


def factor_checksum(factors: DataFrame) -> DataFrame:
    return factors.agg(F.count("*").alias("n_factors"), F.sum(F.coalesce("offset", F.lit(0))).alias("offsets"), F.sum("len").alias("lengths"))


def random_requests(blocks: DataFrame, size: int, n: int = 10_000, length: int = 16 << 10) -> DataFrame:
    """Request table of the random-access workload: n ranges at places that look random but follow from their numbers."""
    spread = F.pmod(F.col("id") * F.lit(2654435761), F.lit(max(1, size - length)))
    return blocks.sparkSession.range(n).select(F.col("id").alias("req_id"), spread.alias("off"), F.lit(length).cast("bigint").alias("len"))
