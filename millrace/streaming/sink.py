"""A keyed sink for micro-batches: an append-only log of Parquet folders, one for each batch.

A batch writes its rows under its own number and replaces that folder alone, so a batch that is
run again changes nothing. The table is, for each key, the row of the latest batch. ``compact``
folds settled batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedLog:
    """Rows by key in ``folder``. A key comes once in a batch; of several the greatest row counts."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys, self.schema = spark, folder.rstrip("/"), keys, schema

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole."""
        fs, path = self._path("")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        found = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return [n for n in found if fs.exists(self._path(f"batch={n}/_SUCCESS")[1])]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch, or write it again. Batches that a compaction has folded are left as they are."""
        done = self.batches()
        if batch_id not in done and done and batch_id < done[0]:
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def rows(self, before: int | None = None) -> DataFrame:
        """Every row of the whole batches with its ``batch``; only those before a batch, if one is given."""
        done = [n for n in self.batches() if before is None or n < before]
        schema = f"{self.schema}, batch long"
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*[f"{self.folder}/batch={n}" for n in done])

    def table(self) -> DataFrame:
        """The latest row of each key, with the batch that wrote it."""
        rows = self.rows()
        rest = [c for c in rows.columns if c not in self.keys and c != "batch"]
        latest = rows.groupBy(*self.keys).agg(F.max(F.struct("batch", *rest)).alias("_last"))
        return latest.select(*self.keys, *[F.col(f"_last.{c}").alias(c) for c in rest], F.col("_last.batch").alias("batch"))

    def compact(self) -> None:
        """Fold all whole batches into the last one's folder, beside which they are written first."""
        done = self.batches()
        if len(done) < 2:
            return
        fs, aside = self._path(f"_compact-{done[-1]}")
        fs.delete(aside, True)
        self.table().drop("batch").write.parquet(aside.toString())
        target = self._path(f"batch={done[-1]}")[1]
        fs.delete(target, True)
        fs.rename(aside, target)
        for n in done[:-1]:
            fs.delete(self._path(f"batch={n}")[1], True)


def keyed(stream: DataFrame, log: KeyedLog, checkpoint: str, mode: str = "update", change: Callable[[DataFrame, int], DataFrame] | None = None):
    """Start a stream that writes to a log all that has landed; ``change`` turns a batch into what is written."""

    def put(rows: DataFrame, batch_id: int) -> None:
        log.write(change(rows, batch_id) if change else rows, batch_id)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def claimed(log: KeyedLog, most: int):
    """A change for ``keyed``: submissions (id, submitted_at, keyword) as rows of the job table. The first ``most`` that no earlier batch
    has left in work or done are taken up (``processing``), the others wait (``pending``); waiting ones of earlier batches are taken up first. Which rows are
    taken depends on the batches before alone, so a batch that is run again takes the same.
    """

    def change(rows: DataFrame, batch_id: int) -> DataFrame:
        fresh = rows.select("id", "submitted_at", "keyword", F.lit("pending").alias("status"))
        earlier = log.rows(before=batch_id)
        rest = ["submitted_at", "keyword", "status"]
        latest = earlier.groupBy("id").agg(F.max(F.struct("batch", *rest)).alias("l")).select("id", *[F.col(f"l.{c}").alias(c) for c in rest])
        waiting = latest.where("status = 'pending'").unionByName(fresh.join(latest, "id", "left_anti").dropDuplicates(["id"]))
        taken = waiting.orderBy("submitted_at", "id").limit(most).select("id", F.lit(True).alias("_taken"))
        found = waiting.join(F.broadcast(taken), "id", "left")  # at most ``most`` ids
        return found.withColumn("status", F.when(F.col("_taken"), "processing").otherwise(F.col("status"))).drop("_taken")

    return change
