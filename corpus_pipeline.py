"""The corpus pipeline: documents in, token shards out. Each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontam, langid, minhash, mixing, sstable
from cairn.llm.common import table, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages of the labelled ones go: those without a word, those of unknown letters. A
    null or empty text goes; ties, repeats and long texts are judged each by itself; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id."""
    return minhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test string of the benchmark go."""
    return decontam.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as blocks, mixed to the target weights of their sources. A block is a row of documents: doc_id numbers the
    slots of the output, n_chars is the length of the block's text, lang that of its first document."""
    return mixing.as_documents(mixing.mix_sources(docs))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sorted-string-table shards of token ids, keyed by doc_id."""
    return sstable.write_shards(docs)


STAGES = [("language_id", language), ("minhash_dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sstable", token_shards)]

#: MinHash, support vector machines and multinomial draws have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
