"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a pair of grouped minima and joins over the edges; each minimum is written to the
shared folder, so that both sides of a join are plain exchanges whose hot keys Spark can split, and
so that a lost executor never costs more than a round. Rounds are logarithmic in the diameter.

Edge tables of at most ``small`` rows, a fixed number, take one task with a union-find instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with v < u."""
    down = edges.select("u", "v")
    pairs = down.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    lows = materialize(pairs.groupBy("u").agg(F.min("v").alias("low")), "cc-lows")
    met = pairs.join(lows.select(F.col("u"), F.least("u", "low").alias("m")), "u")
    if large:
        new = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = new.select("e.u", "e.v")
    return new.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.concat_tables(tables)
    nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    u, v = np.split(ends, 2)
    low = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller, then jump to the root
        a, b = low[u], low[v]
        if (a == b).all():
            break
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low != low[low]).any():
            low = low[low]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["node", "comp"])


def components(edges: DataFrame, limit: int = 60, small: int = 500_000) -> DataFrame:
    """edges(u long, v long) -> (node, comp): every node that has an edge, with the least node it reaches."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "cc-edges")
    before = _state(edges)
    if before[0] <= small:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, comp long")
    for _ in range(limit):
        if before[0] == 0:
            break
        edges = materialize(_star(materialize(_star(edges, True), "cc-large"), False), "cc-small")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
