"""Summaries of layers, stores and runs: grouped counts and one-row reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row(df: DataFrame, **values: Column) -> DataFrame:
    """Aggregates over a whole table, combined map-side."""
    return df.agg(*[c.alias(n) for n, c in values.items()])


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 without a whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; nulls and blanks count as ``missing``."""
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("missing"))
    parts = F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(parts).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def entity_frequency(df: DataFrame, entities: str, k: int) -> DataFrame:
    """The k entities in most records, each counted once a record; ties to the smaller name."""
    each = df.select(F.explode(F.array_distinct(entities)).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return each.orderBy(F.desc("n"), "entity").limit(k)


def by_domain(patterns: DataFrame, domain: str, support: str, confidence: str, kind: str) -> DataFrame:
    """Patterns of each domain (``general`` where unknown): number, mean support and confidence, kinds."""
    return patterns.groupBy(F.coalesce(domain, F.lit("general")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(support).alias("support"), F.avg(confidence).alias("confidence"), F.count_distinct(kind).alias("kinds")
    )


def frequent_domain(df: DataFrame, by: Sequence[str], domain: str) -> DataFrame:
    """The most frequent domain of each group (``general`` where unknown), ties to the smaller name."""
    counts = df.groupBy(*by, F.coalesce(domain, F.lit("general")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "d")).alias("m"))
    return best.select(*by, F.col("m.d").alias("domain"))


def frequent_groups(df: DataFrame, by: str, least: int) -> DataFrame:
    """Groups of at least so many rows; the noise group -1 is none."""
    return df.where(F.col(by) != -1).groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def hypergraph(members: DataFrame, edge: str, node: str) -> DataFrame:
    """One row: nodes, edges, mean and largest degree of both."""
    rows = members.select(edge, node).distinct()
    degrees = lambda c, name: one_row(rows.groupBy(c).agg(F.count(F.lit(1)).alias("d")), **{f"{name}s": F.count(F.lit(1)), f"avg_{name}": F.avg("d"), f"max_{name}": F.max("d")})
    return degrees(node, "node").join(F.broadcast(degrees(edge, "edge")))  # one row each


def entities(df: DataFrame, kind: str, aliases: str, events: str) -> DataFrame:
    """For each kind: entities, those with several aliases and those with several events."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(aliases) > 1).alias("with_aliases"), F.count_if(F.col(events) > 1).alias("with_events"))


def links(df: DataFrame, base: str, confidence: str) -> DataFrame:
    """One row: entities, linked ones (with a base), their rate and confidence."""
    linked = F.col(base).isNotNull()
    value = F.when(linked, F.col(confidence))
    return one_row(
        df, entities=F.count(F.lit(1)), linked=F.count_if(linked), rate=rate(F.count_if(linked), F.count(F.lit(1))),
        mean=F.coalesce(F.avg(value), F.lit(0.0)), least=F.coalesce(F.min(value), F.lit(0.0)), most=F.coalesce(F.max(value), F.lit(0.0)),
    )


def merges(df: DataFrame, strategy: str, similarity: str) -> DataFrame:
    """One row: merges, those made automatically and by hand, mean similarity."""
    kind = F.col(strategy)
    return one_row(df, merges=F.count(F.lit(1)), automatic=F.count_if(kind == "auto"), manual=F.count_if(kind == "manual"), similarity=F.coalesce(F.avg(similarity), F.lit(0.0)))


def mappings(df: DataFrame, event: str, pattern: str, score: str, confidence: str) -> DataFrame:
    """One row: mappings, events and patterns that have one, scores by thirds and confidences."""
    s = F.col(score)
    return one_row(
        df, mappings=F.count(F.lit(1)), events=F.count_distinct(event), patterns=F.count_distinct(pattern), high=F.count_if(s >= 0.8), medium=F.count_if((s >= 0.5) & (s < 0.8)), low=F.count_if(s < 0.5),
        mean_confidence=F.avg(confidence), least_confidence=F.min(confidence), most_confidence=F.max(confidence),
    )


def layers(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(layer, n) for each table and their sum as ``total``; each table is counted on its own."""
    rows = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(rows.agg(F.lit("total").alias("layer"), F.sum("n").alias("n")))


def first_seen_groups(df: DataFrame, by: str, order: str, default: str) -> DataFrame:
    """(group, number, n): groups (a default for rows without one) numbered from 0 as they first appear.

    Groups are numbered after they are counted, so one task sees a row for each group only.
    """
    counts = df.groupBy(F.coalesce(by, F.lit(default)).alias("group")).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("number", F.row_number().over(Window.orderBy("__first", "group")) - 1).drop("__first")


def merge_edges(df: DataFrame, source: str, target: str, weight: str, origin: str, separator: str = "<SEP>") -> DataFrame:
    """Edges of the same ends become one: weights add up, origins are a sorted set."""
    return df.groupBy(source, target).agg(F.sum(weight).alias(weight), F.array_join(F.sort_array(F.collect_set(origin)), separator).alias(origin))


def attribute_results(df: DataFrame, by: str, confidence: str, checks: str) -> DataFrame:
    """For each group: attributes, mean confidence, share of those all of whose checks passed."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.forall(checks, lambda x: x).cast("int")).alias("passed"))


def temporal_profile(df: DataFrame, bucket: Column) -> DataFrame:
    """One row: buckets, the busiest one's rows, mean rows, and how a bucket goes with the next (Pearson)."""
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    after = counts.withColumn("next", F.lead("n").over(Window.orderBy("b")))  # one row for each bucket of time
    return one_row(after, buckets=F.count(F.lit(1)), busiest=F.max("n"), mean=F.avg("n"), autocorrelation=F.corr("n", "next"))


def relevance_text(df: DataFrame, by: str, relevance: str) -> DataFrame:
    """A line for each group: how many, mean and best relevance, how many above 0.7."""
    n, good = F.count(F.lit(1)), F.count_if(F.col(relevance) > 0.7)
    text = F.concat(n.cast("string"), F.lit(" items, mean "), F.format_number(F.avg(relevance), 2), F.lit(", best "), F.format_number(F.max(relevance), 2), F.lit(", above 0.7: "), good.cast("string"))
    return df.groupBy(by).agg(text.alias("summary"))


def run_counters(df: DataFrame, by: str, ok: Column, items: str, seconds: str) -> DataFrame:
    """For each group of calls: number, success rate, mean seconds, items a second; 0 where nothing divides."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("ok"), F.sum(items).alias("items"), F.sum(seconds).alias("seconds")).select(
        by, "calls", rate(F.col("ok"), F.col("calls")).alias("success"), rate(F.col("seconds"), F.col("calls")).alias("mean_seconds"), rate(F.col("items"), F.col("seconds")).alias("throughput")
    )
