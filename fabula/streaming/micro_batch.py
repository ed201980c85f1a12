"""Structured Streaming: keyed merges per micro-batch, windows with watermarks, threshold triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.operators.state import upsert
from fabula.sources.scratch import new_path


def file_stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """New parquet files under ``path`` as a stream with the schema of ``like``, at most so many in a batch."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands every micro-batch that is there to ``each`` and stops. The checkpoint makes a restart go on where it ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the last row of each key in versioned tables under ``path``.

    Version n is written from version n - 1, so a batch that is repeated after a failure writes the
    same version again: exactly once.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if n > 0:
            last = upsert(spark.read.parquet(f"{path}/v{n - 1}"), last, key)
        last.write.mode("overwrite").parquet(f"{path}/v{n}")

    return each


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that was written whole, found in the folder itself, so a restart loses no count."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    whole = [int(n[1:]) for n in names if n[0] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(whole)}")


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, late: str = "1 day", window: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Count and sum of each window and group; rows later than ``late`` are left out by the watermark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("v"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "v")


def session_counts(df: DataFrame, ts: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """Rows of each session of a group; the same on a stream (with ``late``) and on a table."""
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns all it put out, from a folder of its own."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-checkpoint")
    run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/b={n}"), checkpoint, mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def due(queue: DataFrame, status: str, value: str, at_least: int) -> bool:
    """Whether enough rows wait in a status to start the next step."""
    return queue.where(F.col(status) == value).limit(at_least).count() >= at_least


#: Which step is due for a status, in order of priority.
STEPS = [("pending_clustering", "clustering"), ("pending_relationship", "relationships"), ("pending_extraction", "extraction"), ("pending_triage", "triage")]


def recommend(state: DataFrame, status: str = "current_status") -> str:
    """The first step in order of priority for which a row waits."""
    waiting = {r[status] for r in state.groupBy(status).count().collect()}  # a few statuses
    return next((step for name, step in STEPS if name in waiting), "none")


# What the steps of a row's life lead to.
MOVES = {
    "pending_triage": ["pending_review", "pending_extraction", "rejected"], "pending_review": ["pending_extraction", "pending_learning"],
    "pending_learning": ["pending_triage"], "pending_extraction": ["pending_clustering", "failed"], "pending_clustering": ["pending_relationship"],
    "pending_relationship": ["completed", "failed"], "failed": ["pending_triage"],
}


def moves(state: DataFrame, wanted: DataFrame, key: str, status: str) -> DataFrame:
    """wanted(key, to) -> (key, status, moved): the new status where the old one may lead to it, else the old one."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = state.select(key, status).join(wanted.select(key, "to"), key, "left")
    may = F.coalesce(F.array_contains(F.element_at(allowed, F.col(status)), F.col("to")), F.lit(False))
    return rows.select(key, F.when(may, F.col("to")).otherwise(F.col(status)).alias(status), may.alias("moved"))


def run_stages(state: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Hands a table through named stages, each written before the next; stops at the first that fails and returns what
    the one before it left, with a log of (stage, "done" or the error)."""
    from fabula.sources.scratch import materialize

    log = []
    for name, stage in stages:
        try:
            state = materialize(stage(state), f"stage-{name}")
        except Exception as error:  # the log tells; the caller decides whether to go on from here
            log.append((name, type(error).__name__))
            break
        log.append((name, "done"))
    return state, log
