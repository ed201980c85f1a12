"""Ordered analytics: pairs, gaps, spans, n-grams, look-ahead and range joins.

Windows are always partitioned; ties are broken by an id column given in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered


def _window(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def timeline(df: DataFrame, ts: str, ids: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """Rows with a time, of the given ids if any, in time order within the result."""
    rows = df.where(F.col(ts).isNotNull())
    return (rows.join(ids, key, "left_semi") if ids is not None else rows).orderBy(ts, key)


def consecutive_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str], steps: int = 1) -> DataFrame:
    """Each row with the ``steps``-th row after it: carried columns come again as ``next_<name>``."""
    w = _window(by, order)
    paired = df.select(*df.columns, *[F.lead(c, steps).over(w).alias(f"next_{c}") for c in carry])
    return paired.where(F.col(f"next_{carry[0]}").isNotNull())


def following(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``consecutive_pairs`` for groups of any size: rows are numbered over ranges and meet the next number by a join, so
    a group that holds most of the table is no single task."""
    rows = numbered(df, by, order, "__n")
    keys = [f"__k{i}" for i in range(len(by))]
    after = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], (F.col("__n") - 1).alias("__m"), *[F.col(c).alias(f"next_{c}") for c in carry])
    on = " AND ".join(["__n = __m", *(f"`{c}` <=> {k}" for c, k in zip(by, keys))])
    return rows.join(after, F.expr(on)).select(*df.columns, *[f"next_{c}" for c in carry])


def lookahead_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str], ahead: int = 3) -> DataFrame:
    """Each row with up to ``ahead`` rows after it, from one window pass: no self-join."""
    w = _window(by, order)
    structs = F.array(*[F.lead(F.struct(*carry), i).over(w) for i in range(1, ahead + 1)])
    listed = df.withColumn("__then", structs)
    rows = listed.select(*df.columns, F.posexplode("__then").alias("step", "then")).where(F.col("then").isNotNull())
    return rows.select(*df.columns, (F.col("step") + 1).alias("step"), *[F.col(f"then.{c}").alias(f"next_{c}") for c in carry])


def gap_anomalies(df: DataFrame, by: Sequence[str], order: Sequence[str], seconds: Column, factor: float = 2.0) -> DataFrame:
    """Gaps between consecutive rows above ``factor`` times their group's mean gap, for groups of three rows or more."""
    gaps = df.withColumn("gap_s", seconds - F.lag(seconds).over(_window(by, order)))
    whole = Window.partitionBy(*by)
    gaps = gaps.withColumns({"mean_gap_s": F.avg("gap_s").over(whole), "n": F.count(F.lit(1)).over(whole)})
    return gaps.where((F.col("n") > 2) & (F.col("gap_s") > factor * F.col("mean_gap_s"))).drop("n")


def temporal_span(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """First and last time, and whole days between them (0 for fewer than two rows)."""
    out = df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(ts).alias("n_events"))
    micros = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    return out.withColumn("span_days", F.floor(micros / F.lit(86_400_000_000)))


def ngrams(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str, lengths: Sequence[int], separator: str = ">") -> DataFrame:
    """Every window of each length over the ordered items of a group: ``<by>, length, gram``."""
    w = _window(by, order)
    longest = max(lengths)
    ahead = F.array(F.col(item), *[F.lead(item, i).over(w) for i in range(1, longest)])
    rows = df.select(*by, F.filter(ahead, lambda x: x.isNotNull()).alias("items"))
    grams = F.array(*[F.when(F.size("items") >= n, F.struct(F.lit(n).alias("length"), F.array_join(F.slice("items", 1, n), separator).alias("gram"))) for n in lengths])
    rows = rows.select(*by, F.explode(grams).alias("g")).where(F.col("g").isNotNull())
    return rows.select(*by, "g.length", "g.gram")


def mine_sequences(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str, lengths: Sequence[int] = (2, 3, 4, 5), min_support: int = 2) -> DataFrame:
    """Counts of n-grams over all groups; support is the count over the number of n-grams of that length."""
    counts = ngrams(df, by, order, item, lengths).groupBy("length", "gram").agg(F.count(F.lit(1)).alias("frequency"))
    total = Window.partitionBy("length")
    counts = counts.withColumn("support", F.col("frequency") / F.sum("frequency").over(total))
    return counts.where(F.col("frequency") >= min_support)


def range_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs with left_ts < right_ts <= left_ts + seconds in the same group.

    Time falls into buckets as long as the range; a left row looks into its own and the next bucket, so
    the join is an equi-join on (group, bucket) and only near rows ever meet.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = seconds * 1_000_000
    a = left.withColumn("__b", F.explode(F.array(F.floor(micros(left_ts) / span), F.floor(micros(left_ts) / span) + 1)))
    b = right.withColumn("__b", F.floor(micros(right_ts) / span))
    joined = a.join(b, [*by, "__b"]).drop("__b")
    return joined.where((micros(right_ts) > micros(left_ts)) & (micros(right_ts) <= micros(left_ts) + span))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row at or before it, by one sort over both sides."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(right.select(F.struct(*carry).alias("x")).schema["x"].dataType))
    b = right.select(*by, ts, F.struct(*carry).alias("__r")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*left.columns, *[F.col(f"__seen.{c}").alias(f"asof_{c}") for c in carry])


def sessions(df: DataFrame, by: Sequence[str], order: Sequence[str], seconds: Column, gap: int) -> DataFrame:
    """Numbers rows of a group by session: a new one starts after ``gap`` seconds without rows."""
    w = _window(by, order)
    starts = F.coalesce((seconds - F.lag(seconds).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("__new", starts).withColumn("session", F.sum("__new").over(w)).drop("__new")
