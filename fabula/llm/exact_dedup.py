"""Exact dedup by a tree-merge of sorted digest runs (built-in functions only).

Every document belongs to one of ``R`` runs (a power of two, by a hash of its id). A run is the
table (run, digest) -> (best id, copies), combined map-side. In each binomial round ``2**b``
neighbouring runs exchange and merge: rows meet on (run >> b, digest), so a round is a multiway
merge that is itself spread over the cluster by digest. Every level keeps the best identifier that
was verified so far. After the last round the verdicts travel back down the same tree: level k
joins level k+1 on (run >> b, digest), where one parent row meets at most ``2**b`` child rows, and
documents join their own run. A digest that holds a third of all rows is therefore spread over
``R`` keys at the bottom and never meets in one task.

Two texts merge only if SHA-256, byte length and xxHash64 of the normalised text all agree.

Defined results: null text counts as empty text; null ids lose against any id; of rows that repeat
both id and text one is kept; an empty table gives an empty table; input columns other than the id
and the text are not touched, so clashing names do no harm.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, parallelism

KEY = ["sha", "bytes", "xx"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select(
        "id",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
        F.octet_length("norm").alias("bytes"),
        F.xxhash64("norm").alias("xx"),
    )


def tree_merge(docs: DataFrame, keep: str, runs: int, bits: int) -> DataFrame:
    """docs(run, id, KEY) -> docs + keep_id, group_size by merging runs in binomial rounds; every level is
    written once, for the next one up and for the way down."""
    best = F.max if keep == "max" else F.min
    level = lambda df: materialize(df, "exact-level")
    levels = [level(docs.groupBy("run", *KEY).agg(best("id").alias("best"), F.count(F.lit(1)).alias("n")))]
    left = runs
    while left > 1:
        below = levels[-1].withColumn("run", F.shiftright("run", bits))
        levels.append(level(below.groupBy("run", *KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))))
        left = -(-left >> bits) if left >= 1 << bits else 1
    verdict = levels.pop().select("run", *KEY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    while levels:
        child = levels.pop().select(F.col("run").alias("own"), F.shiftright("run", bits).alias("run"), *KEY)
        verdict = child.join(verdict, ["run", *KEY]).drop("run").withColumnRenamed("own", "run")
    return docs.join(verdict, ["run", *KEY])


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int | None = None, bits: int = 4
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names which identifier of equal texts stays (``min`` or ``max``); ``runs`` defaults to
    four per shuffle partition, rounded up to a power of two.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    runs = 1 << ((runs or 4 * parallelism(df.sparkSession)) - 1).bit_length()
    docs = digests(df, id_col, text_col).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int"))
    merged = tree_merge(materialize(docs, "exact-digests"), keep, runs, bits)
    order = F.desc_nulls_last("id") if keep == "max" else F.asc_nulls_last("id")
    first = F.row_number().over(Window.partitionBy("run", *KEY).orderBy(order)) == 1
    return merged.select(
        "id",
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, one for each distinct normalised text."""
    kept = exact_groups(df, id_col, text_col, keep).where("kept").select(
        F.col("id").alias("__fb_id"), F.unhex("text_sha256").alias("__fb_sha")
    )
    sha = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    rows = df.withColumns({"__fb_sha": sha, "__fb_id": F.col(id_col)})
    joined = rows.alias("l").join(
        kept.alias("r"),
        F.col("l.__fb_id").eqNullSafe(F.col("r.__fb_id")) & (F.col("l.__fb_sha") == F.col("r.__fb_sha")),
        "left_semi",
    )
    nth = F.row_number().over(Window.partitionBy("__fb_id", "__fb_sha").orderBy(F.lit(1)))
    return joined.withColumn("__fb_n", nth).where("__fb_n = 1").select(*[F.col(f"`{c}`") for c in df.columns])
