"""Scores and date parsing as Column expressions. Weights, bounds and date patterns are fixed values: they decide results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def fuzzy_date(text: Column) -> Column:
    """Y-M-D, Y-M, Y-H1/H2, Y-Q1..Q4, Y; else the first 20th- or 21st-century year in the text; else 2023-01-01."""
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i)
    date = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    one = F.lit("1")
    day, month, half, quarter, year = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})-(\d{1,2})$", r"^(\d{4})-H([12])$", r"^(\d{4})-Q([1-4])$", r"((?:19|20)\d{2})"
    made = (
        F.when(F.rlike(t, F.lit(day)), date(part(day, 1), part(day, 2), part(day, 3)))
        .when(F.rlike(t, F.lit(month)), date(part(month, 1), part(month, 2), one))
        .when(F.rlike(t, F.lit(half)), date(part(half, 1), F.when(part(half, 2) == "1", "1").otherwise("6"), one))
        .when(F.rlike(t, F.lit(quarter)), date(part(quarter, 1), F.when(part(quarter, 2) == "4", "10").otherwise(F.translate(part(quarter, 2), "23", "47")), one))
        .when(F.rlike(t, F.lit(year)), date(part(year, 1), one, one))
    )
    return F.coalesce(made, F.make_date(F.lit(2023), F.lit(1), F.lit(1)))


def time_similarity(a: Column, b: Column, days: float = 30.0) -> Column:
    """exp(-|whole days| / 30), 0.5 without a time. Days are floored, so an hour back counts a day and an hour ahead none."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return F.coalesce(F.exp(-F.abs(F.floor(micros / F.lit(86_400_000_000))) / days), F.lit(0.5))


def structural(relations: Column, nodes: Column, depth: Column) -> Column:
    return 0.4 * F.least(relations / 10, F.lit(1.0)) + 0.4 * F.least(nodes / 20, F.lit(1.0)) + 0.2 * (1 - 0.1 * (depth - 1))


def fusion(vector: Column, graph: Column) -> Column:
    return 0.6 * F.coalesce(vector, F.lit(0.0)) + 0.4 * F.coalesce(graph, F.lit(0.0))


def event_similarity(kind: Column, participants: Column, text: Column, time: Column, place: Column, attributes: Column) -> Column:
    """Weighted sum of partial similarities, at most 1."""
    return F.least(0.3 * kind + 0.25 * participants + 0.2 * text + 0.1 * time + 0.1 * place + 0.05 * attributes, F.lit(1.0))


def quality_score(elements: Column, errors: Column, warnings: Column) -> Column:
    """100 less the penalty share in percent (10 an error, 2 a warning), 0 if the penalty reaches the elements."""
    penalty = 10 * errors + 2 * warnings
    return F.when((elements <= 0) | (penalty >= elements), 0.0).otherwise(F.round(100 - 100 * penalty / elements, 2))


def relevance(keywords: Column, entities: Column, in_range: Column) -> Column:
    return F.least(0.3 * keywords + 0.4 * entities + 0.3 * in_range.cast("int"), F.lit(1.0))


def mapping_confidence(score: Column, support: Column, pattern: Column, completeness: Column) -> Column:
    return (score + F.least(support / 10, F.lit(1.0)) + pattern + completeness) / 4


def complexity(sequence: Column, conditions: Column) -> Column:
    return F.size(sequence) + F.size(conditions)


def quantise(v: Column) -> Column:
    """array<float> -> struct(lo, hi, codes): each component as one of 256 steps between least and largest."""
    lo, hi = F.array_min(v), F.array_max(v)
    step = F.when(hi > lo, (hi - lo) / 255).otherwise(F.lit(1.0))
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.transform(v, lambda x: F.floor((x - lo) / step + 0.5).cast("int")).alias("codes"))


def dequantise(q: Column) -> Column:
    step = F.when(q["hi"] > q["lo"], (q["hi"] - q["lo"]) / 255).otherwise(F.lit(1.0))
    return F.transform(q["codes"], lambda c: q["lo"] + c * step)


def place_similarity(a: Column, b: Column) -> Column:
    """1 for places that agree but for case, 0 for others, 0.5 where one is unknown."""
    known = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(F.coalesce(known, F.lit(False)), (F.lower(a) == F.lower(b)).cast("double")).otherwise(0.5)


def attribute_similarity(a: Column, b: Column) -> Column:
    """Share of the common keys of two maps whose values agree; 0.5 where a map is empty, 0 without common keys."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = F.size(F.filter(common, lambda k: F.element_at(a, k).eqNullSafe(F.element_at(b, k))))
    empty = F.coalesce((F.size(F.map_keys(a)) == 0) | (F.size(F.map_keys(b)) == 0), F.lit(True))
    return F.when(empty, 0.5).when(F.size(common) == 0, 0.0).otherwise(same / F.greatest(F.size(common), F.lit(1)))


def pattern_match(in_sequence: Column, attributes: Column, same_domain: Column) -> Column:
    """0.4 for the type, 0.3 of a neutral 0.5 for participants, 0.2 of the attributes' share, 0.1 for the domain (0.5 if another)."""
    return F.least(0.4 * in_sequence.cast("int") + 0.15 + 0.2 * attributes + 0.1 * F.when(F.coalesce(same_domain, F.lit(False)), 1.0).otherwise(0.5), F.lit(1.0))


def decayed(score: Column, factor: float = 0.95, least: float = 0.01) -> Column:
    """The score times the factor, where that changes it by more than ``least``."""
    return F.when(F.abs(score * factor - score) > least, score * factor).otherwise(score)


def retrieval_quality(events: Column, relations: Column, relevance_: Column) -> Column:
    """Up to 10 events weigh 0.3, up to 20 relations 0.2, mean relevance 0.5; 0 without events."""
    full = 0.3 * F.least(events / 10, F.lit(1.0)) + 0.2 * F.least(relations / 20, F.lit(1.0)) + 0.5 * relevance_
    return F.when(events > 0, F.least(full, F.lit(1.0))).otherwise(0.0)


def context_relevance(tokens: Column, coverage: Column, most: int = 4000) -> Column:
    """0.8, 0.1 more or less by how a context's length compares with 0.7 of the budget, and a tenth of the entity coverage."""
    ratio = tokens / (0.7 * most)
    length = F.when(tokens <= 0, 0.0).when(ratio.between(0.5, 1.0), 0.1).when(ratio > 1, -0.1).otherwise(0.0)
    return F.least(F.lit(0.8) + length + F.coalesce(0.1 * coverage, F.lit(0.0)), F.lit(1.0))


def consistency(entities: Column, issues: Mapping[str, Column]) -> Column:
    """100 less the weighted issues (critical 10, major 5, minor 1, info 0.5) over ten times the entities, in percent."""
    weights = {"critical": 10.0, "major": 5.0, "minor": 1.0, "info": 0.5}
    penalty = sum((weights[k] * n for k, n in issues.items()), F.lit(0.0))
    return F.when(entities == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 - 100 * penalty / (10 * entities)), 2))


def relation_consistency(errors: Column, warnings: Column, confidence: Column) -> Column:
    return F.when(errors > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence - 0.1 * warnings)))


def richness(name: Column, aliases: Column, attributes: Column, events: Column) -> Column:
    """How much is known of an entity: 0.2 for a name of three letters, capped tenths for aliases, attributes and events."""
    total = F.when(F.length(name) > 2, 0.2).otherwise(0.0) + F.least(aliases * 0.1, F.lit(0.3)) + F.least(attributes * 0.1, F.lit(0.3)) + F.least(events * 0.05, F.lit(0.2))
    return F.least(total, F.lit(1.0))


def match_confidence(score: Column, kind: Column, rich_a: Column, rich_b: Column) -> Column:
    """A match's score by its kind (alias 0.95, fuzzy 0.8, semantic 0.7) and by the poorer entity's richness."""
    factor = F.when(kind == "alias", 0.95).when(kind == "fuzzy", 0.8).when(kind == "semantic", 0.7).otherwise(1.0)
    return F.least(score * factor * (0.8 + 0.2 * F.least(rich_a, rich_b)), F.lit(1.0))


def link_confidence(similarity: Column, exact: Column, alias: Column, more: Column) -> Column:
    """0.6 of the names' similarity, 0.2 for equal names, 0.15 for a common alias, 0.1 for a description or fitting type."""
    bonus = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    return F.least(0.6 * similarity + bonus(exact, 0.2) + bonus(alias, 0.15) + bonus(more, 0.1), F.lit(1.0))


def generality(size: Column, kinds: Column) -> Column:
    return 0.6 * F.least(size / 20, F.lit(1.0)) + 0.4 * F.least(kinds / 5, F.lit(1.0))


def rule_validation(frequency: Column, support: Column, confidence: Column, steps: Column, has_relations: Column) -> Column:
    """0.5 and 0.1 for each of: frequency 5, support 0.2, confidence 0.7, two to five steps, relations at all."""
    bonus = [frequency >= 5, support >= 0.2, confidence >= 0.7, steps.between(2, 5), has_relations]
    return F.least(F.round(F.lit(0.5) + sum((0.1 * F.coalesce(b, F.lit(False)).cast("int") for b in bonus), F.lit(0.0)), 10), F.lit(1.0))


def overall_confidence(retrieval: Column, enhancement: Column, patterns: Column) -> Column:
    """Weights 0.4, 0.3, 0.3 over those that are there; 0 without any."""
    parts = [(retrieval, 0.4), (enhancement, 0.3), (patterns, 0.3)]
    total = sum((F.coalesce(w * c, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def field_accuracy(field: Column, text: Column, number: Column, firm: str) -> Column:
    """How far a field's value looks right: firms 0.9 by pattern else 0.6, amounts 1 if not negative else 0.5, others 0.8."""
    firms = F.contains(field, F.lit("company")) | F.contains(field, F.lit("acquire"))
    amount = F.when(F.coalesce(number >= 0, F.lit(False)), 1.0).otherwise(0.5)
    return F.when(firms, F.when(F.rlike(text, F.lit(firm)), 0.9).otherwise(0.6)).when(F.contains(field, F.lit("amount")), amount).otherwise(0.8)


def query_time_range(text: Column, today: Column) -> Column:
    """struct(start, end) of the first pattern that fits: a year, year and month, a date (each a point, one day long),
    the last n days, the last n months of 30 days, last year; null without any. A year hides the month after it."""
    part = lambda p, i: F.regexp_extract(text, p, i)
    fits = lambda p: F.rlike(text, F.lit(p))
    number = lambda p, i=1: F.nullif(part(p, i), F.lit("")).try_cast("int")
    point = lambda d: F.struct(d.alias("start"), F.date_add(d, 1).alias("end"))
    back = lambda days: F.struct(F.date_sub(today, days).alias("start"), today.alias("end"))
    year, date, days, months = "([0-9]{4})年", "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "最近([0-9]+)天", "最近([0-9]+)个月"
    iso = F.try_to_timestamp(F.concat_ws("-", part(date, 1), F.lpad(part(date, 2), 2, "0"), F.lpad(part(date, 3), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    last = F.year(today) - 1
    return (
        F.when(fits(year), point(F.make_date(number(year), F.lit(1), F.lit(1))))
        .when(fits(date) & iso.isNotNull(), point(iso))
        .when(fits(days), back(number(days)))
        .when(fits(months), back(number(months) * 30))
        .when(F.contains(text, F.lit("去年")), F.struct(F.make_date(last, F.lit(1), F.lit(1)).alias("start"), F.make_date(last, F.lit(12), F.lit(31)).alias("end")))
    )


def date_like(text: Column) -> Column:
    """Whether a text begins like a date: YYYY-MM-DD, YYYY/MM/DD or YYYY年M月D日."""
    return F.coalesce(F.rlike(text, F.lit("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)")), F.lit(False))
