"""Relations between events inferred by rules, over pairs that are near in time within a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that cause others, and how sure that is.
CAUSES = {("investment", "business_cooperation"): 0.7, ("personnel_change", "organizational_change"): 0.6, ("product_launch", "market_expansion"): 0.8}


def pairs_within(df: DataFrame, by: Sequence[str], key: str, ts: str, seconds: int, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b (by time, then key) of one group at most so many seconds apart. Time falls into buckets as long as the
    window; a row looks into its own and the next one, so only near rows meet."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(micros / F.lit(seconds * 1_000_000))
    names = [key, ts, *carry]
    a = df.select(*by, *[F.col(c).alias(f"a_{c}") for c in names], micros.alias("__a"), F.explode(F.array(bucket, bucket + 1)).alias("__k"))
    b = df.select(*by, *[F.col(c).alias(f"b_{c}") for c in names], micros.alias("__b"), bucket.alias("__k"))
    later = (F.col("__b") > F.col("__a")) | ((F.col("__b") == F.col("__a")) & (F.col(f"b_{key}") > F.col(f"a_{key}")))
    return a.join(b, [*by, "__k"]).where(later & (F.col("__b") - F.col("__a") <= seconds * 1_000_000)).drop("__k")


def _cause(first: Column, second: Column) -> Column:
    out = F.lit(None).cast("double")
    for (x, y), sure in CAUSES.items():
        out = F.when((F.lower(first) == x) & (F.lower(second) == y), sure).otherwise(out)
    return out


def infer(df: DataFrame, by: Sequence[str], key: str, ts: str, kind: str, seconds: int, least: float = 0.3) -> DataFrame:
    """(source, target, relation, confidence, strength) for pairs within the window: the earlier one before the later
    (.8); of the same time, a cause by their types in either direction, else correlation (.5) in both."""
    pairs = pairs_within(df, by, key, ts, seconds, [kind])
    tie = F.col("__a") == F.col("__b")
    before = pairs.where(~tie).select(F.col(f"a_{key}").alias("source"), F.col(f"b_{key}").alias("target"), F.lit("temporal_before").alias("relation"), F.lit(0.8).alias("confidence"), F.lit(0.6).alias("strength"))
    sides = []
    for x, y in (("a", "b"), ("b", "a")):
        cause = _cause(F.col(f"{x}_{kind}"), F.col(f"{y}_{kind}"))
        relation = F.when(cause.isNotNull(), "causal").otherwise("correlation")
        sides.append(F.struct(F.col(f"{x}_{key}").alias("source"), F.col(f"{y}_{key}").alias("target"), relation.alias("relation"), F.coalesce(cause, F.lit(0.5)).alias("confidence"), F.coalesce(cause * 0.8, F.lit(0.4)).alias("strength")))
    ties = pairs.where(tie).select(F.explode(F.array(*sides)).alias("r")).select("r.*")
    return before.unionByName(ties).where(F.col("confidence") >= least)


def pattern_kind(name: Column) -> Column:
    """causal, sequential, conditional or associative, by the words in a pattern's name."""
    has = lambda w: F.contains(F.lower(name), F.lit(w))
    return F.when(has("causal"), "causal").when(has("temporal") | has("before") | has("after"), "sequential").when(has("conditional"), "conditional").otherwise("associative")


def fallback_event(text: Column, key: Column) -> Column:
    """The one event of a text that gave none."""
    return F.struct(F.concat(F.lit("fallback_"), key.cast("string")).alias("id"), F.lit("OTHER").alias("kind"), F.substring(text, 1, 200).alias("description"))
