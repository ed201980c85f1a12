"""Grouped summaries of events, entities and patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_key(ts: Column, unit: str) -> Column:
    """Day, week or month as text; the week key joins the calendar year and the unpadded ISO week.
    Any other unit gives months."""
    if unit == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "week":
        return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.weekofyear(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")


def frequency(df: DataFrame, ts: str, unit: str) -> DataFrame:
    return df.groupBy(bucket_key(F.col(ts), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_text(df: DataFrame, by: Sequence[str], key: Column, alias: str) -> DataFrame:
    """A group's counts by key as ``key:count,...`` in key order; keys are few by nature (months, types)."""
    counts = df.groupBy(*by, key.alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.sort_array(F.collect_list(F.struct("__k", "__n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["__k"], F.lit(":"), p["__n"].cast("string"))), ",")
    return counts.groupBy(*by).agg(text.alias(alias))


def by_type(df: DataFrame, kind: str, participant: str, ts: str) -> DataFrame:
    """Count, distinct participants, their ratio and a month histogram for each type."""
    base = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(participant).alias("n_participants"))
    base = base.withColumn("avg_participants", F.col("n_participants") / F.col("n_events"))
    return base.join(histogram_text(df, [kind], bucket_key(F.col(ts), "month"), "months"), kind)


def co_participants(members: DataFrame, event: str, entity: str, k: int = 5) -> DataFrame:
    """For each entity its events and the k entities it shares most events with, ties to the smaller id."""
    other = members.select(event, F.col(entity).alias("other"))
    pairs = members.join(other, event).where(F.col(entity) != F.col("other")).groupBy(entity, "other").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("shared"), "other"))
    top = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"].cast("string")), ",")
    counts = members.groupBy(entity).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.join(top.groupBy(entity).agg(listed.alias("top_co")), entity, "left")


def trend(df: DataFrame, by: Sequence[str], bucket: Column, recent: int = 3) -> DataFrame:
    """Sum of the last buckets over the sum of the rest, and what that says."""
    counts = df.groupBy(*by, bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__b")))
    sums = counts.withColumn("__at", last).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.sum(F.when(F.col("__at") <= recent, F.col("__n")).otherwise(0)).alias("recent"),
        F.sum(F.when(F.col("__at") > recent, F.col("__n")).otherwise(0)).alias("earlier"),
    )
    ratio = F.col("recent") / F.nullif(F.col("earlier"), F.lit(0))
    label = (
        F.when(F.col("n_buckets") < 2, "insufficient_data").when(F.col("earlier") == 0, "new_activity")
        .when(ratio > 1.2, "increasing").when(ratio < 0.8, "decreasing").otherwise("stable")
    )
    return sums.withColumns({"ratio": ratio, "trend": label})


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Min, max, mean and the upper median: the element at n // 2 of the sorted values."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(value)), "__n": F.count(F.lit(1)).over(w)})
    return rows.groupBy(*by).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"),
        F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col(value))).alias("upper_median"),
    )


def peak_hours(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Hours of the day whose count is their group's largest, ties included."""
    counts = df.groupBy(*by, F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy(*by))
    return counts.withColumn("__m", top).where(F.col("n") == F.col("__m")).drop("__m")


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def field_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column: rows without a value (null or blank), and their share in percent to two places. One scan."""
    missing = [F.sum(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0)).alias(c) for c in columns]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *missing)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])
    long = wide.select("__n", F.explode(rows).alias("r"))
    return long.select("r.field", "r.missing", F.round(100 * F.col("r.missing") / F.col("__n"), 2).alias("missing_pct"))


def mode_merge(df: DataFrame, by: Sequence[str], kind: str, description: str, source: str, separator: str = "<SEP>") -> DataFrame:
    """One row for each key: the most frequent kind (ties to the smaller), sorted distinct descriptions and sources."""
    counts = df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("__n"))
    modes = counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(kind).alias("k"))).alias("__m"))
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), separator)
    texts = df.groupBy(*by).agg(join(description).alias(description), join(source).alias(source))
    return texts.join(modes.select(*by, F.col("__m.k").alias(kind)), list(by))


def hyperedge_merge(df: DataFrame, key: str, weight: str, source: str, separator: str = "<SEP>") -> DataFrame:
    """Weights add up; source lists (joined by the separator) become one sorted set union."""
    parts = df.withColumn("__s", F.explode(F.split(F.col(source), separator)))
    union = parts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("__s")), separator).alias(source))
    return df.groupBy(key).agg(F.sum(weight).alias(weight)).join(union, key)


def growth(df: DataFrame, by: Sequence[str], recent: Column) -> DataFrame:
    """Counts in the recent and the older part, growth = recent / max(older, 1)."""
    counts = df.groupBy(*by).agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("older"))
    return counts.withColumn("growth", F.col("recent") / F.greatest(F.col("older"), F.lit(1)))
