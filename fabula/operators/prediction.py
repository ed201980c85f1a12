"""Patterns put to use: matching, evolution, next events, missing attributes, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_from_patterns(recent: DataFrame, patterns: DataFrame, statistics: DataFrame, by: str, k: int) -> DataFrame:
    """by, event_type, probability, rank: pattern votes (confidence of each pattern that continues the latest type)
    plus .3 of the overall share of what follows it, normalised for each group."""
    votes = recent.join(patterns, "event_type").groupBy(by, F.col("next_type").alias("candidate")).agg(F.sum("confidence").alias("v"))
    base = recent.join(statistics, "event_type").select(by, F.col("next_type").alias("candidate"), (0.3 * F.col("probability")).alias("v"))
    total = votes.unionByName(base).groupBy(by, "candidate").agg(F.sum("v").alias("v"))
    share = total.withColumn("probability", F.col("v") / F.sum("v").over(Window.partitionBy(by)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("probability"), "candidate"))
    return share.withColumn("rank", rank).where(F.col("rank") <= k).select(by, F.col("candidate").alias("event_type"), "probability", "rank")


def evolve(patterns: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Support grows by the matches seen; unseen patterns stay as they are."""
    seen = observed.groupBy(key).agg(F.count(F.lit(1)).alias("__m"))
    return patterns.join(seen, key, "left").withColumn("support", F.col("support") + F.coalesce("__m", F.lit(0))).drop("__m")


def infer_attribute(df: DataFrame, by: str, attribute: str, coverage: float = 0.3, accuracy: float = 0.6) -> DataFrame:
    """by, value, coverage, accuracy: the most frequent value where enough rows have one and enough of those agree."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(attribute).alias("filled"))
    values = df.where(F.col(attribute).isNotNull()).groupBy(by, attribute).agg(F.count(F.lit(1)).alias("c"))
    mode = values.groupBy(by).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(attribute).alias("v"))).alias("m"))
    out = sizes.join(mode, by).select(by, F.col("m.v").alias("value"), (F.col("filled") / F.col("n")).alias("coverage"), (-F.col("m.c") / F.col("filled")).alias("accuracy"))
    return out.where((F.col("coverage") >= coverage) & (F.col("accuracy") >= accuracy))


def map_to_patterns(events: DataFrame, patterns: DataFrame, event: str, pattern: str, threshold: float, at_most: int) -> DataFrame:
    """The best patterns of each event: .4 if its type is in the sequence, .3 by support up to 10, .3 confidence.

    Events and patterns meet on the type, so a pattern costs only the events it can hold.
    """
    typed = patterns.select(pattern, "support", "confidence", F.explode(F.array_distinct("sequence")).alias("event_type"))
    score = 0.4 + 0.3 * F.least(F.col("support") / 10, F.lit(1.0)) + 0.3 * F.col("confidence")
    scored = events.join(typed, "event_type").select(event, pattern, score.alias("score")).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy(event).orderBy(F.desc("score"), pattern))
    return scored.withColumn("rank", rank).where(F.col("rank") <= at_most)


def add_mappings(mappings: DataFrame, new: DataFrame, event: str, pattern: str) -> DataFrame:
    """New (event, pattern) pairs only."""
    return mappings.unionByName(new.join(mappings, [event, pattern], "left_anti"), allowMissingColumns=True)
