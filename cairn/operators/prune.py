"""Taking the least useful bytes out of a dictionary."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.match import Index


def usage(factors: DataFrame) -> DataFrame:
    """(pos, freq) where the number of factors that copy a dictionary byte changes: freq holds from pos up to the next pos. Steps up and down are summed by place;
    no byte is listed by itself."""
    copies = factors.filter("not is_literal")
    ends = F.array(F.struct(F.col("offset").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("offset") + F.col("len")).alias("pos"), F.lit(-1).alias("d")))
    steps = copies.select(F.inline(ends))  # both ends in one pass over the factors
    return summed(steps)


def summed(steps: DataFrame) -> DataFrame:
    """The same from steps(pos, d), of which many may be at one place."""
    change = steps.groupBy("pos").agg(F.sum("d").alias("d")).filter("d <> 0")
    return change.select("pos", F.sum("d").over(Window.orderBy("pos")).alias("freq"))


def dense(use: DataFrame, size: int) -> np.ndarray:
    """How many factors copy each byte of a dictionary of ``size`` bytes."""
    rows = use.orderBy("pos").toArrow()
    pos, freq = (np.asarray(rows.column(c).combine_chunks()).astype(np.int64) for c in ("pos", "freq"))
    out = np.zeros(size, np.int64)
    keep = pos < size
    pos, freq = pos[keep], freq[keep]
    if len(pos):
        n = np.diff(np.r_[pos, size])
        out[pos[0] :] = np.repeat(freq, n)
    return out


def per_byte(use: DataFrame, size: int) -> DataFrame:
    """(pos, freq) of every byte, zeros included; a dictionary's size is bounded, the corpus isn't touched."""
    marks = use.sparkSession.range(size).select(F.col("id").cast("int").alias("pos"))
    joined = marks.join(use, "pos", "left")
    last = F.last("freq", ignorenulls=True).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("pos", F.coalesce(last, F.lit(0)).cast("bigint").alias("freq"))


def rem_blocks(bytes_used: DataFrame, size: int, target: int, block: int = 1024) -> DataFrame:
    """(dict_block, weight): the blocks that go, those with the least maximum use, the earlier ones first."""
    count = max(0, (size - target) // block)
    weights = bytes_used.groupBy(F.expr(f"pos div {block}").alias("dict_block")).agg(F.max("freq").alias("weight"))
    return weights.orderBy("weight", "dict_block").limit(count)


def prune_none(data: bytes, use: DataFrame, target: int) -> bytes:
    return data


def prune_rem(data: bytes, use: DataFrame, target: int, block: int = 1024) -> bytes:
    away = {int(r["dict_block"]) for r in rem_blocks(per_byte(use, len(data)), len(data), target, block).collect()}
    return b"".join(data[i : i + block] for i in range(0, len(data), block) if i // block not in away)


def runs(bytes_used: DataFrame, most: int, shortest: int) -> DataFrame:
    """(offset, length, total_usage): the longest runs of bytes used ``most`` times at most, if they are ``shortest`` long."""
    low = bytes_used.filter(F.col("freq") <= most).withColumn("island", F.col("pos") - F.row_number().over(Window.orderBy("pos")))
    found = low.groupBy("island").agg(F.min("pos").alias("offset"), F.count("*").alias("length"), F.sum("freq").alias("total_usage"))
    return found.filter(F.col("length") >= shortest).select("offset", "length", "total_usage")


def prune_care(data: bytes, use: DataFrame, target: int, most: int = 8, shortest: int = 64, method: str = "FF") -> bytes:
    """Takes out little-used segments that the rest of the dictionary can replace with few factors. The allowed use doubles until the
    segments hold the bytes to remove. A segment's score is (factors of it by matches that occur twice) x use / length, for method FFT divided by
    its length once more; the lowest go, the last one in part."""
    away = len(data) - target
    if away <= 0:
        return data
    freq = dense(use, len(data))
    top = int(freq.max()) if len(freq) else 0
    while True:
        on = np.r_[False, freq <= most, False].astype(np.int8)
        begin, end = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
        ok = end - begin >= shortest
        begin, end = begin[ok], end[ok]
        if int((end - begin).sum()) >= away or (most >= top and shortest <= 1):
            break
        most, shortest = (most * 2, shortest) if most < top else (most, max(1, shortest // 2))
    index = Index.of(data)
    used = np.r_[0, np.cumsum(freq)]
    size = end - begin
    score = index.factors_by_repeats(begin, end) * (used[end] - used[begin]) / size
    score = score / size if method == "FFT" else score
    keep, left = np.ones(len(data), bool), away
    for i in np.lexsort((begin, score)):
        n = min(left, int(size[i]))
        keep[begin[i] : begin[i] + n] = False
        left -= n
        if not left:
            break
    return np.frombuffer(data, np.uint8)[keep].tobytes()


STRATEGIES: dict[str, Callable[..., bytes]] = {"none": prune_none, "rem": prune_rem, "care": prune_care, "care_fft": lambda d, u, t: prune_care(d, u, t, method="FFT")}
