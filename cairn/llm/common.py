"""Tables, scratch space and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_own_dir: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder serves, but only when the executors are threads of this very process."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="cairn-"))
    return _own_dir[0]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete one table that ``write_table`` made."""
    names = {part for f in df.inputFiles() for part in f.split("/")}
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in names]:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that ``write_table`` made in this process. Results that still read them end."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def pieces(batch: pa.RecordBatch, column: str, target: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``target`` bytes of text each; rows are never cut."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = np.cumsum(sizes) // target
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup sorted batches so that all rows of a key lie in one table."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        same = int(pc.index(keys, last).as_py())
        if rest and rest[-1].column(key)[-1] == last and same == 0:
            rest.append(batch)
            continue
        if rest and rest[-1].column(key)[-1] == last:
            raise ValueError("the rows are not sorted")
        rest.append(batch.slice(0, same))
        if any(r.num_rows for r in rest):
            yield pa.Table.from_batches(rest)
        rest = [batch.slice(same)]
    if rest:
        yield pa.Table.from_batches(rest)


def repeated(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Of sorted batches the rows whose key another row has too. One row is held back at a time, so a frequent key takes no memory."""
    held, known, last = None, False, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.asarray(batch.column(key))
        same, begins = keys[1:] == keys[:-1], held is not None and last == keys[0]
        if held is not None and (known or begins):
            yield held
        use = np.r_[begins, same][:-1] | same
        if use.any():
            yield batch.slice(0, n - 1).select(columns).filter(pa.array(use))
        held, known, last = batch.slice(n - 1).select(columns), bool(same[-1]) if n > 1 else begins, keys[-1]
    if held is not None and known:
        yield held


def column(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's bigint."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)
