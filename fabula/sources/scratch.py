"""Tables written to the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fabula-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/fabula/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Delete every table this process has written here. Call when results have been consumed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop()[1])
        where.getFileSystem(conf).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and nothing reads any more, as a round of an iteration does."""
    spark = df.sparkSession
    path = next((p for s, p in _WRITTEN if p == getattr(df, "_fabula_path", None)), None)
    if path:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove(next(x for x in _WRITTEN if x[1] == path))


@atexit.register
def _at_exit() -> None:
    if not _WRITTEN:
        return
    spark = _WRITTEN[-1][0]
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the JVM may be gone already; the folder is scratch space
        _WRITTEN.clear()


def materialize(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._fabula_path = path
    return back
