"""Connected components of an undirected graph, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger neighbours (large) or its smaller ones and itself to its least neighbour."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The least neighbour by partial sums and a join, which splits the edges of a hub; a window would sort them in one task.
    m = both.groupBy("a").agg(F.min("b").alias("m"))
    least = both.join(m, "a").withColumn("m", F.least("a", "m"))
    if large:
        out = least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = least.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a bigint, b bigint) -> (node, root): every node of an edge with the least node it is joined to.

    Rounds double what is linked, so their number grows with the logarithm of the longest chain. Each round is
    written to the shared folder, so a lost executor costs no more than the round at hand."""
    now = write_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = write_table(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == mark:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
