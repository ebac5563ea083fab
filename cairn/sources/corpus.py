"""From tables or files to a corpus: documents as bytes at places of one long text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.scratch import write_table


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of raw files; each is a document."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of files of ``<DOC>`` ... ``</DOC>`` records."""
    rows = spark.read.option("lineSep", "</DOC>").text(path).filter(F.col("value").rlike(r"\S"))
    return rows.select(F.regexp_extract("value", r"<DOCNO>\s*(.*?)\s*</DOCNO>", 1).alias("docno"), F.concat("value", F.lit("</DOC>")).alias("text"))


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def sanitize(content: Column) -> Column:
    """Bytes 0 and 1 become 0xFE and 0xFF. It can't be undone, so it is done on demand only."""
    return F.encode(F.translate(_latin(content), "\x00\x01", "\xfe\xff"), "ISO-8859-1")


def replaced(content: Column) -> Column:
    """How many bytes ``sanitize`` replaces."""
    return F.octet_length(content) - F.length(F.translate(_latin(content), "\x00\x01", ""))


OUTPUT = ("start", "n_bytes", "content")


def named(ids: list[str]) -> list[str]:
    """The names that columns of ids have in a corpus: their own, or ``id_`` before those that the corpus has itself."""
    return [f"id_{c}" if c.lower() in OUTPUT else c for c in ids]


def to_corpus(df: DataFrame, ids: list[str], text: str, clean: bool = False) -> DataFrame:
    """(ids, start, n_bytes, content): documents at places of one long text, in the order of ids, of which null is the least. ``text`` may be a string or bytes.

    The rows are spread over range partitions once and written in order; the running sum goes along within each partition, and the partitions'
    totals (as many as there are partitions) are summed up before. No row is joined to another, so ids need not be unique, nor set.

    Defined cases. A null text is empty. Rows that share their ids follow each other in the order of a hash of their bytes, and of the bytes; each has its own place.
    A column of ids that is called as one of the result's (start, n_bytes, content) is called id_start, and so on; extra columns are not
    read, whatever their names. An empty table gives an empty corpus."""
    raw = F.col(text) if dict(df.dtypes)[text] == "binary" else F.encode(F.col(text), "UTF-8")
    raw = F.coalesce(raw, F.lit(b""))
    rows = df.select(F.struct(*(F.col(c).alias(n) for c, n in zip(ids, named(ids)))).alias("ids"), (sanitize(raw) if clean else raw).alias("content"))
    # The last key tells equal rows apart, of which there may be more than one partition holds.
    keys = [F.col("ids").asc_nulls_first(), F.xxhash64("content"), F.col("content"), F.col("turn")]
    spread = rows.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = spread.select(F.spark_partition_id().alias("part"), F.octet_length("content").alias("n_bytes"), "ids", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            n = np.asarray(b.column("n_bytes")).astype(np.int64)
            upto = np.cumsum(n) + before
            before = int(upto[-1]) if len(n) else before
            yield pa.RecordBatch.from_arrays([pa.array(upto - n), *b.columns], names=["within", *b.schema.names])

    schema = T.StructType([T.StructField("within", T.LongType()), *placed.schema.fields])
    parts = write_table(placed.mapInArrow(run, schema), "corpus")
    total = parts.groupBy("part").agg(F.sum("n_bytes").alias("total"))
    starts = total.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return parts.join(F.broadcast(starts), "part").select("ids.*", (F.col("before") + F.col("within")).alias("start"), "n_bytes", "content")


def doc_order(corpus: DataFrame) -> DataFrame:
    """(docno, pos): every ``<DOCNO>`` tag and the place of its first byte in the long text."""
    latin = _latin(F.col("content"))
    found = corpus.select("start", latin.alias("t")).filter(F.instr("t", "<DOCNO>") > 0)
    pieces = found.select("start", F.posexplode(F.split("t", "<DOCNO>", -1)).alias("i", "piece"))
    here = Window.partitionBy("start").orderBy("i")
    at = pieces.withColumn("pos", F.col("start") + F.sum(F.length("piece") + 7).over(here) - F.length("piece") - 14).filter("i > 0 and instr(piece, '</DOCNO>') > 0")
    return at.select(F.trim(F.substring_index("piece", "</DOCNO>", 1)).alias("docno"), F.col("pos").cast("bigint").alias("pos"))
