"""Consistency of entities and relations: rules as data, issues as rows, one row for each culprit (never for each pair).

Entities: (id, name, kind, attributes map<string,string>, aliases array<string>). Edges: (edge_id, kind, names
array<string>) or members (edge_id, id, role). Every check is a grouped aggregate or a semi or anti join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import scores

# Rule tables that decide results.
REQUIRED = {"person": ["name"], "company": ["name"], "location": ["name"], "event": ["name", "timestamp"]}
ALLOWED_KINDS = {
    "employment": ["person", "company"], "investment": ["company"], "acquisition": ["company"], "partnership": ["company"],
    "location": ["person", "location", "company"],
}
FAMILIES = {
    "person": ["individual", "executive", "founder", "ceo", "chairman"],
    "company": ["organization", "corporation", "enterprise", "firm", "business"],
    "location": ["place", "city", "country", "region", "address"],
    "product": ["service", "technology", "platform", "solution"],
    "event": ["announcement", "transaction", "merger", "acquisition"],
}
ROLES = {
    "person": ["employee", "executive", "founder", "ceo", "chairman", "director"],
    "company": ["employer", "organization", "acquirer", "target", "parent", "subsidiary"],
    "location": ["location", "headquarters", "office", "base"],
    "product": ["product", "service", "technology", "platform"],
}
CRITICAL, MAJOR = ["name", "id", "type", "legal_name"], ["industry", "founded", "headquarters", "ceo"]
INCOMPATIBLE = [
    ("temporal_before", "temporal_after"), ("temporal_before", "temporal_simultaneous"), ("temporal_after", "temporal_simultaneous"),
    ("causal_direct", "contrast_opposite"), ("conditional_necessary", "contrast_opposite"),
]
NAME_ENDINGS = ["inc", "corp", "ltd", "llc", "co"]


def plain_name(name: Column, endings: Sequence[str] = NAME_ENDINGS) -> Column:
    """Lower case without punctuation, spaces collapsed, every known ending removed in the list's order."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\w\s]", ""), r"\s+", " "))
    for e in endings:
        out = F.trim(F.regexp_replace(out, rf"\s{e}$", ""))
    return out


def _map(pairs: Mapping[str, Sequence[str]]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def family(kind: Column) -> Column:
    """The kind that stands for all kinds it is compatible with."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for base, others in FAMILIES.items() for o in others for x in (o, base)]), kind), kind)


def missing_attributes(entities: DataFrame, rules: Mapping[str, Sequence[str]] = REQUIRED) -> DataFrame:
    """(id, attribute, issue, severity): attributes that an entity's kind requires and it lacks."""
    wanted = F.array_except(F.coalesce(F.element_at(_map(rules), F.col("kind")), F.array().cast("array<string>")), F.coalesce(F.map_keys("attributes"), F.array().cast("array<string>")))
    return entities.select("id", F.explode(wanted).alias("attribute"), F.lit("type_consistency").alias("issue"), F.lit("warning").alias("severity"))


def wrong_kinds(edges: DataFrame, entities: DataFrame, rules: Mapping[str, Sequence[str]] = ALLOWED_KINDS) -> DataFrame:
    """(edge_id, name, issue, severity): ends whose kind the edge's kind does not allow; a name stands for its least id."""
    named = entities.groupBy("name").agg(F.min(F.struct("id", F.col("kind").alias("k"))).alias("e"))
    ends = edges.select("edge_id", F.element_at(_map(rules), F.col("kind")).alias("allowed"), F.explode("names").alias("name")).where("allowed IS NOT NULL")
    bad = ends.join(named, "name").where(~F.array_contains("allowed", F.col("e.k")))
    return bad.select("edge_id", "name", F.lit("relation_type").alias("issue"), F.lit("warning").alias("severity"))


def bad_times(entities: DataFrame) -> DataFrame:
    """(id, attribute, issue, severity): attributes named like a time whose value is no ISO date or time."""
    pairs = entities.select("id", F.explode("attributes").alias("attribute", "value")).where("value IS NOT NULL")
    named = F.contains(F.lower("attribute"), F.lit("time")) | F.contains(F.lower("attribute"), F.lit("date"))
    iso = F.rlike("value", F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$")) & F.try_to_timestamp(F.substring("value", 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return pairs.where(named & ~iso).select("id", "attribute", F.lit("temporal").alias("issue"), F.lit("warning").alias("severity"))


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, issue, severity): entities whose name no edge holds."""
    held = edges.select(F.explode("names").alias("name")).distinct()
    return entities.join(held, "name", "left_anti").select("id", F.lit("isolated").alias("issue"), F.lit("info").alias("severity"))


def name_conflicts(entities: DataFrame) -> DataFrame:
    """(id, other): entities that share their plain name, an alias and the kinds' family with ``other``, the least such id."""
    rows = entities.select("id", plain_name(F.col("name")).alias("n"), family(F.col("kind")).alias("f"), F.explode("aliases").alias("alias"))
    least = rows.groupBy("n", "f", "alias").agg(F.min("id").alias("other"))
    return rows.join(least, ["n", "f", "alias"]).where("id > other").groupBy("id").agg(F.min("other").alias("other"))


def type_conflicts(entities: DataFrame) -> DataFrame:
    """(name, kinds, n): plain names whose entities are of kinds that do not go together."""
    rows = entities.select(plain_name(F.col("name")).alias("name"), "kind").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))
    found = rows.groupBy("name").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kinds"), F.count_distinct(family(F.col("kind"))).alias("f"))
    return found.where("f > 1").select("name", "kinds", "n")


def attribute_conflicts(entities: DataFrame) -> DataFrame:
    """(name, attribute, n_values, severity): attributes whose values differ by more than case and punctuation."""
    pairs = entities.select(plain_name(F.col("name")).alias("name"), F.explode("attributes").alias("attribute", "value")).where("value IS NOT NULL")
    values = pairs.select("name", "attribute", F.regexp_replace(F.lower("value"), r"\W", "").alias("value")).distinct()
    found = values.groupBy("name", "attribute").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    severity = F.when(F.lower("attribute").isin(CRITICAL), "critical").when(F.lower("attribute").isin(MAJOR), "major").otherwise("minor")
    return found.withColumn("severity", severity)


def alias_conflicts(entities: DataFrame) -> DataFrame:
    """(alias, n): aliases of several entities no two of which are of one family, so that none can be the same."""
    rows = entities.select("id", family(F.col("kind")).alias("f"), F.explode("aliases").alias("alias")).select("id", "f", plain_name(F.col("alias")).alias("alias")).distinct()
    found = rows.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("f").alias("families"))
    return found.where("n > 1 AND families = n").select("alias", "n")


def role_conflicts(members: DataFrame, entities: DataFrame, rules: Mapping[str, Sequence[str]] = ROLES) -> DataFrame:
    """(kind, role, n): roles that a kind's entities may not have, and how many entities do."""
    rows = members.join(entities.select("id", "kind"), "id").withColumn("allowed", F.element_at(_map(rules), F.col("kind")))
    return rows.where(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("role"))).groupBy("kind", "role").agg(F.count_distinct("id").alias("n"))


def report(entities: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: entities, issues by severity (column ``severity``) and the score out of 100."""
    kinds = ("critical", "major", "minor", "info")
    found = issues.agg(F.count(F.lit(1)).alias("issues"), *[F.count_if(F.col("severity") == k).alias(k) for k in kinds])
    both = entities.agg(F.count(F.lit(1)).alias("entities")).join(F.broadcast(found))  # one row each
    return both.withColumn("score", scores.consistency(F.col("entities"), {k: F.col(k) for k in kinds}))


def relation_set(relations: DataFrame, source: str, target: str, kind: str, score: str) -> DataFrame:
    """Adds ``conflicts`` and lowers the score by a fifth for each relation of the same ends whose kind does not go
    with this one's (the table is one way). Kinds of one pair of ends are counted first, so pairs never meet row by row."""
    counts = relations.groupBy(source, target, F.col(kind).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in INCOMPATIBLE])
    against = counts.select(source, target, "n", F.explode(F.transform(F.filter(bad, lambda p: p["b"] == F.col("other")), lambda p: p["a"])).alias(kind))
    against = against.groupBy(source, target, kind).agg(F.sum("n").alias("conflicts"))
    out = relations.join(against, [source, target, kind], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return out.withColumn(score, F.col(score) * F.pow(F.lit(0.8), F.col("conflicts")))


def typed_rows(df: DataFrame, key: str, schema: Mapping[str, tuple[str, bool, Column | None]]) -> DataFrame:
    """(id, field, problem) of text columns against ``field -> (type, required, predicate)``: ``missing`` where a required
    one is null or blank, ``type`` where it does not cast, ``range`` where the predicate does not hold."""
    found = []
    for field, (kind, required, holds) in schema.items():
        blank = F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == "")
        broken = F.col(field).cast("string").try_cast(kind).isNull()
        wrong = ~F.coalesce(holds, F.lit(True)) if holds is not None else F.lit(False)
        problem = F.when(blank, F.lit("missing") if required else F.lit(None)).when(broken, "type").when(wrong, "range")
        found.append(F.struct(F.lit(field).alias("field"), problem.alias("problem")))
    rows = df.select(F.col(key).alias("id"), F.explode(F.array(*found)).alias("p"))
    return rows.select("id", "p.field", "p.problem").where("problem IS NOT NULL")
