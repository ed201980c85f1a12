"""Scratch tables in the cluster's shared folder, and Arrow text helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from fabula.session import ship

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fabula-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    ship(spark)
    path = f"{shared_dir(spark)}/fabula/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs a re-read, not a recomputation.

    ``tidy`` lets the driver collect its garbage, upon which Spark deletes the shuffle files of
    finished jobs; without it they stay until the driver happens to need memory.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if tidy:
        collect_garbage(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._fabula_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: what was made from them is written itself."""
    for df in tables:
        path = getattr(df, "_fabula_path", None)
        at = next((i for i, (_, p) in enumerate(_WRITTEN) if p == path), None)
        if at is not None:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _WRITTEN.pop(at)


def collect_garbage(spark: SparkSession) -> None:
    """Let go of finished jobs, upon which Spark deletes their shuffle files.

    What Python lets go of reaches the JVM with the next calls, and Spark's cleaner works on what one
    collection found while the next one runs; so there are two, a moment apart.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    for pause in (0.1, 0.2):
        jvm.System.currentTimeMillis()
        time.sleep(pause)
        jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every scratch table this process wrote. Call when results have been consumed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        _, path = _WRITTEN.pop()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


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


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
