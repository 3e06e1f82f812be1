"""Session defaults and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def builder(name: str = "millrace") -> SparkSession.Builder:
    """A session builder with UTC times, adaptive execution and skew handling."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, deleted when the driver ends.

    Only a local master may do without that setting: it gets a temporary folder. On a cluster,
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="millrace-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        return f"file://{_OWN[0]}"
    folder = f"{base}/millrace-{sc.applicationId}"
    if folder not in _OWN:
        _OWN.append(folder)
        atexit.register(_removed, spark, folder)
    return folder


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path  # noqa: SLF001  for released()
    return out


def released(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_written_path", None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
