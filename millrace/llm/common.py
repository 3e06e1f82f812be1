"""Helpers that the operators of this subpackage share.

Text leaves the JVM in Arrow batches and is handled as one UTF-8 buffer with offsets, so that
most work is vectorised. Nothing here depends on a local path of the driver or an executor.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark only (any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, deleted when the driver ends; a temporary one where that is unset and the master local."""
    return shared_folder(spark)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for actions on tables whose rows hold whole texts of pairs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back.

    The written table cuts the lineage: a lost executor costs no recomputation of what is
    above, and what was computed once stays the same for every later reader.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001  for release()
    return out


def release(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def strings_of(column: pa.Array) -> list[str]:
    """Each text as str; null counts as empty."""
    return column.fill_null("").to_pylist()


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; a larger row is a range of its own."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order, by sorting: numpy's own hashes them, which takes many times as long."""
    ordered = np.sort(keys)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each one's place among them."""
    order = keys.argsort()
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], at


def ragged(sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of the elements of the numbered runs, one run after the other, where runs of such sizes follow each other."""
    begins, own = np.cumsum(sizes) - sizes, sizes[numbers]
    ends = np.cumsum(own)
    return np.repeat(begins[numbers] - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with a function per task: make() is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)
