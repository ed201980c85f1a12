"""Sums of large arrays over all partitions, without sending every partition's array to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from ._shared import collect_garbage

SLICES = 32
SCHEMA = "slice int, body binary"


def slices(array: np.ndarray) -> pa.RecordBatch:
    """The rows a partition yields for its array; its length is a multiple of SLICES."""
    parts = np.ascontiguousarray(array).reshape(SLICES, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "body"])


def parts(array: np.ndarray, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``slices`` in batches that stay small however long the array is."""
    whole = slices(array)
    step = max(1, limit // max(1, array.nbytes // SLICES))
    for at in range(0, SLICES, step):
        yield whole.slice(at, step)


def total(rows: DataFrame, dtype: str, length: int, salts: int = 64) -> np.ndarray:
    """Adds up what the partitions yielded, in two levels (``salts`` sums for each slice first), in
    double precision; ``length`` is that of one partition's array."""

    def add(table: pa.Table) -> pa.Table:
        whole = np.zeros(length // SLICES)
        for body in table["body"]:
            whole += np.frombuffer(body.as_buffer(), dtype)
        return pa.table({"slice": table["slice"].slice(0, 1), "body": pa.array([whole.astype(dtype).tobytes()], pa.binary())})

    ship(rows.sparkSession)
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = salted.groupBy("slice", "salt").applyInArrow(add, SCHEMA)
    out = np.zeros((SLICES, length // SLICES), dtype)
    for row in first.groupBy("slice").applyInArrow(add, SCHEMA).toLocalIterator():  # a few slices at a time
        out[row["slice"]] = np.frombuffer(row["body"], dtype)
    del salted, first
    collect_garbage(rows.sparkSession)  # iterations would pile up shuffle files as large as the array times the tasks
    return out.reshape(-1)
