"""Data-quality rules as data: each rule is (name, severity, predicate that holds for bad rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, Column]


def violations(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(id, rule, severity) for every rule that a row breaks; all rules in one scan."""
    hits = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, bad in rules])
    rows = df.select(F.col(key).alias("id"), F.explode(hits).alias("v")).where(F.col("v").isNotNull())
    return rows.select("id", "v.rule", "v.severity")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(references: DataFrame, known: DataFrame, reference: str, key: str) -> DataFrame:
    """References without a row they refer to, with their number."""
    missing = references.where(F.col(reference).isNotNull()).join(known.select(F.col(key).alias(reference)), reference, "left_anti")
    return missing.groupBy(reference).agg(F.count(F.lit(1)).alias("n"))


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def relation_checks(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with the problems of their ends' times: causes after effects, causes too far apart, confidence out of range."""
    a = nodes.select(F.col("event_id").alias("source_event_id"), F.col("ts").alias("t0"))
    b = nodes.select(F.col("event_id").alias("target_event_id"), F.col("ts").alias("t1"))
    days = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / F.lit(86_400e6)
    timed = relations.join(a, "source_event_id", "left").join(b, "target_event_id", "left").withColumn("days", days)
    error = F.array_compact(F.array(
        F.when(F.col("t0").isNull() | F.col("t1").isNull(), "missing_end"), F.when((F.col("relation_type") == "causal") & (F.col("days") < 0), "effect_before_cause"),
        F.when(~F.col("confidence").between(0, 1), "confidence_range"),
    ))
    warning = F.array_compact(F.array(F.when((F.col("relation_type") == "causal") & (F.col("days") > 30), "cause_too_early"), F.when(F.col("confidence") < 0.3, "low_confidence")))
    score = F.when(F.size("errors") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("confidence") - 0.1 * F.size("warnings")))
    return timed.withColumns({"errors": error, "warnings": warning}).withColumn("score", score)
