"""Vector search by brute force: blocks of rows meet blocks of queries, each pair of blocks as one Arrow matrix product.

Blocks follow the number of rows, so a task's memory does not grow with the input; queries are a stated side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.session import ship

BLOCK = 4096  # rows of a side that meet in one task


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def _unit(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = F.when(norm > 0, F.transform(F.col(vector), lambda x: x.cast("double") / norm)).otherwise(F.transform(F.col(vector), lambda x: F.lit(0.0)))
    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias(name), unit.alias(f"{name}_v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK))


def _meet(left: DataFrame, right: DataFrame, every_pair: bool, keep: Callable, schema: str) -> DataFrame:
    """left, right (id, v) as blocks that meet pairwise; ``keep`` turns ids and a matrix of products into a table.
    With ``every_pair`` both are the same rows and a pair of blocks meets once."""
    spark = left.sparkSession
    ship(spark)
    n, m = _blocks(left.count()), _blocks(right.count())
    wide = max(n, m, 2 if every_pair else 1)  # a few blocks even of few rows, for some parallelism
    n, m = (wide, wide) if every_pair else (max(n, 4), m)
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    left, right = (x.select(F.col("id").alias(k), F.col("v").alias(f"{k}_v")) for x, k in ((left, "a"), (right, "b")))  # columns of their own: both may be one table
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    a = left.withColumn("i", place("a", n))
    a = a.withColumn("j", each(F.col("i") if every_pair else F.lit(0), F.lit(m - 1)))
    b = right.withColumn("j", place("b", m))
    b = b.withColumn("i", each(F.lit(0), F.col("j") if every_pair else F.lit(n - 1)))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return keep(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), False)
        ids, others = x["a"].to_numpy(), y["b"].to_numpy()
        return keep(ids, others, _matrix(x["a_v"]) @ _matrix(y["b_v"]).T, x["i"][0].as_py() == x["j"][0].as_py())

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, schema)


def knn(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, threshold: float = -2.0, overfetch: int = 1) -> DataFrame:
    """query_id, id, similarity, rank: the k most similar other rows, ties to the smaller id.

    Every pair of blocks keeps only its own best of a query before they meet. The threshold applies
    after fetching ``k * overfetch``.
    """
    fetched = k * overfetch

    def best(ids, asked, products, same):
        found = [], [], []
        for column, query in enumerate(asked):
            scores = np.where(ids == query, -np.inf, products[:, column])
            at = np.argpartition(-scores, fetched - 1)[:fetched] if len(ids) > fetched else np.arange(len(ids))
            at = np.flatnonzero((scores >= scores[at].min()) & (scores > -np.inf)) if len(ids) > fetched else at[scores[at] > -np.inf]
            at = at[np.lexsort((ids[at], -scores[at]))][:fetched]
            for out, values in zip(found, (np.full(len(at), query), ids[at], scores[at])):
                out.append(values)
        whole = [np.concatenate(x) if x else np.zeros(0) for x in found]
        return pa.table({"query_id": pa.array(whole[0].astype(np.int64)), "id": pa.array(whole[1].astype(np.int64)), "similarity": pa.array(whole[2].astype(float))})

    pick = lambda rows: _unit(rows, key, vector, "id").select(F.col("id").cast("long").alias("id"), F.col("id_v").alias("v"))
    local = _meet(pick(df), pick(queries), False, best, "query_id long, id long, similarity double")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= fetched)
    return ranked.where((F.col("similarity") >= threshold) & (F.col("rank") <= k)).select("query_id", "id", "similarity", "rank")


def all_within_cosine(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of all rows with at least the given cosine; only these leave a task."""

    def near(ids, others, products, same):
        i, j = np.nonzero(products >= threshold)
        a, b, s = ids[i], others[j], products[i, j]
        once = a < b if same else a != b  # within a block both orders come up
        a, b, s = a[once], b[once], s[once]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "similarity": pa.array(s.astype(float))})

    rows = _unit(df, key, vector, "id").select(F.col("id").cast("long").alias("id"), F.col("id_v").alias("v"))
    return _meet(rows, rows, True, near, "a long, b long, similarity double")


def within_cosine(df: DataFrame, key: str, vector: str, by: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of one group (``by``) with at least the given cosine."""
    group = lambda name: df.select(F.col(key).cast("long").alias(name), F.col(by).alias(f"__{name}"))
    pairs = all_within_cosine(df, key, vector, threshold).join(group("a"), "a").join(group("b"), "b")
    return pairs.where("__a = __b").select(F.col("__a").alias("block"), "a", "b", "similarity")


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector of each group, components averaged separately so that sums combine before the shuffle."""
    parts = df.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
