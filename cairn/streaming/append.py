"""Growing a store by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.store import ENCODED, Store, StoreConfig, decode_blocks, encode_blocks


def append(stream: DataFrame, store: Store, path: str, id_col: str = "doc_id", text_col: str = "text", **options: str) -> StreamingQuery:
    """Every document of a stream becomes a block of its own, coded with the store's dictionary, under ``path``. A micro-batch
    writes a folder named by its number and replaces what an earlier try left there, so a batch that runs twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
        rows = batch.select(F.col(id_col).alias("block_id"), F.octet_length(raw).alias("raw_len"), raw.alias("content"))
        encode_blocks(rows, store.data, store.cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.trigger(availableNow=True).start()


def appended(store: Store, path: str) -> DataFrame:
    """(block_id, raw_len, content) of what ``append`` has written; block_id is the document's id."""
    rows = store.encoded.sparkSession.read.parquet(path).select(*(c.split()[0] for c in ENCODED.split(", ")))
    return decode_blocks(rows, store.data, store.cfg)


__all__ = ["StoreConfig", "append", "appended"]
