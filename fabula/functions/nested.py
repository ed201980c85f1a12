"""JSON, maps and arrays: tolerant parsing, typed unpivots, rule-based extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_or_default(text: Column, schema: str, default: str) -> Column:
    """The parsed value, or the default JSON where the text is null, blank or broken."""
    parsed = F.from_json(text, schema)
    return F.coalesce(parsed, F.from_json(F.lit(default), schema))


# Lead-ins that answers begin with.
LEAD_INS = ["Here's the extracted event information:", "Based on the text, here's the event data:", "Event extraction result:", "JSON output:", "Result:"]


def tolerant_json(text: Column) -> Column:
    """struct(json, confidence, method) by the first way that gives valid JSON: as it is (1.0), a fenced or quoted block
    (.9), a brace expression (.8), without lead-in and fences (.7), from the first to the last brace with commas, quotes
    and keys mended (.6), or ``key: value`` lines (.5); else null and 0. Values of lines become booleans and numbers
    where they look like them."""
    valid = lambda t: F.coalesce(F.try_parse_json(t).isNotNull(), F.lit(False))
    first = lambda p: F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda x: F.trim(x)), valid), F.lit(0))
    fenced = F.coalesce(*[first(p) for p in (r"```json\s*([\s\S]*?)\s*```", r"```\s*([\s\S]*?)\s*```", r"`([^`]+)`")])
    braces = F.coalesce(first(r"(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"), first(r"(\{[\s\S]*\})"))
    bare = F.trim(text)
    for lead in LEAD_INS:
        bare = F.when(F.startswith(F.lower(bare), F.lit(lead.lower())), F.trim(F.substr(bare, F.lit(len(lead) + 1)))).otherwise(bare)
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?m)^```json\s*", ""), r"(?m)\s*```$", ""))
    span = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(span, r",\s*}", "}"), r",\s*]", "]")
    mended = F.regexp_replace(F.regexp_replace(mended, r"(?<!\\)'", '"'), r"(\w+):", '"$1":')
    mended = F.when(~obviously_incomplete(span), mended)
    return _first_valid([(F.trim(text), 1.0, "direct"), (fenced, 0.9, "fenced"), (braces, 0.8, "braces"), (bare, 0.7, "cleaned"), (mended, 0.6, "mended"), (_lines_as_json(text), 0.5, "lines")], valid)


def _first_valid(tries, valid) -> Column:
    out = F.struct(F.lit(None).cast("string").alias("json"), F.lit(0.0).alias("confidence"), F.lit("failed").alias("method"))
    for candidate, confidence, method in reversed(tries):
        good = F.struct(candidate.alias("json"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
        out = F.when(valid(candidate), good).otherwise(out)
    return out


def _lines_as_json(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))

    def pair(line: Column) -> Column:
        key = F.replace(F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))), F.lit(" "), F.lit("_"))
        value = F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        plain = F.rlike(value, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"))
        quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        shown = F.when(F.lower(value).isin("true", "false"), F.lower(value)).when(plain, value).otherwise(quoted)
        return F.concat(F.lit('"'), key, F.lit('":'), shown)

    return F.when((F.size(lines) > 0) & ~looks_incomplete(text), F.concat(F.lit("{"), F.array_join(F.transform(lines, pair), ","), F.lit("}")))


def schema_adjusted(confidence: Column, fits: Column) -> Column:
    """A tenth more where the value fits its schema, two tenths less where not; kept in [0, 1]."""
    return F.when(fits, F.least(confidence + 0.1, F.lit(1.0))).otherwise(F.greatest(confidence - 0.2, F.lit(0.0)))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def obviously_incomplete(text: Column) -> Column:
    """Whether more braces open than close, a comma trails, or the text says that it was cut."""
    cut = F.lit(False)
    for sign in ("...", "(truncated)", "(incomplete)"):
        cut = cut | F.contains(F.lower(text), F.lit(sign))
    return (_count(text, "{") > _count(text, "}")) | F.endswith(F.trim(text), F.lit(",")) | cut


def looks_incomplete(text: Column) -> Column:
    """Whether a text begins like an object or array that does not end, or has quoted keys and an open brace."""
    t = F.trim(text)
    starts = lambda a, b: F.startswith(t, F.lit(a)) & ~F.endswith(t, F.lit(b))
    keys = F.contains(t, F.lit('"')) & F.contains(t, F.lit(":")) & (_count(t, "{") > _count(t, "}"))
    return starts("{", "}") | starts("[", "]") | keys


def unpivot_typed(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, role, value): dates become ``timestamp``, numbers ``property``, texts ``entity``. One pass, no shuffle."""
    role = {c: "timestamp" if t.startswith(("date", "timestamp")) else "entity" if t == "string" else "property" for c, t in df.dtypes}
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(role[c]).alias("role"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.explode(parts).alias("p")).select(key, "p.field", "p.role", "p.value").where("value IS NOT NULL")


def extract_by_rules(df: DataFrame, key: str, text: str, rules: Mapping[str, Sequence[str]], entities: Sequence[str]) -> DataFrame:
    """(key, event_type, entities): a type fires when one of its keywords and any entity are contained."""
    t = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(e)), F.lit(e)) for e in entities]))
    types = F.array_compact(F.array(*[F.when(F.array_contains(F.array(*[F.contains(t, F.lit(w)) for w in words]), True), F.lit(name)) for name, words in rules.items()]))
    rows = df.select(key, found.alias("entities"), types.alias("types")).where(F.size("entities") > 0)
    return rows.select(key, F.explode("types").alias("event_type"), F.array_join("entities", "|").alias("entities"))


def json_body(text: Column) -> Column:
    """The text from the first to the last brace on one line, single quotes doubled; null without one or if it is no JSON."""
    body = F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.lit(""))
    flat = F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("")), F.lit("\n"), F.lit("")), F.lit("'"), F.lit('"'))
    return F.when(F.try_parse_json(flat).isNotNull(), flat)


def get_or(value: Column, key: str, default: Column) -> Column:
    """A map's value, or the default where the map or the key is missing."""
    return F.coalesce(F.try_element_at(value, F.lit(key)), default)


def flat_distinct(value: Column) -> Column:
    """All items of a map of arrays, once each, in order of keys and places."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.map_entries(value)), lambda e: e["value"])))


def keys_like(value: Column, parts: Sequence[str]) -> Column:
    """The entries of a map whose key contains one of the parts."""
    return F.map_filter(value, lambda k, _: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(k, p)))


def value_type(text: Column) -> Column:
    """What an attribute's text holds: boolean, int, double or string."""
    return F.when(F.lower(text).isin("true", "false"), "boolean").when(F.rlike(text, F.lit(r"^[-+]?[0-9]+$")), "int").when(F.rlike(text, F.lit(r"^[-+]?[0-9]*\.[0-9]+$")), "double").otherwise("string")


def delimited_records(df: DataFrame, key: str, text: str, record: str = "##", field: str = "<|>", end: str = "<|COMPLETE|>") -> DataFrame:
    """(key, position, kind, fields, relation): parenthesised records of delimited fields; an entity belongs to the last
    hyper-relation before it in its text."""
    from pyspark.sql import Window

    pieces = F.split(F.col(text), "|".join("\\Q" + m + "\\E" for m in (record, end)))
    rows = df.select(key, F.posexplode(pieces).alias("position", "piece"))
    fields = F.transform(F.split(F.regexp_extract("piece", r"\(([\s\S]*)\)", 1), "\\Q" + field + "\\E"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    rows = rows.withColumn("fields", fields).where(F.size("fields") > 1).withColumn("kind", F.col("fields")[0])
    named = F.when(F.col("kind") == "hyper-relation", F.col("fields")[1])
    last = F.last(named, ignorenulls=True).over(Window.partitionBy(key).orderBy("position"))
    return rows.select(key, "position", "kind", "fields", last.alias("relation"))


def event_from_json(text: Column) -> Column:
    """struct(id, kind, title, participants): nested ``event_data`` where the top level lacks a field; defaults else."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(text, p) for p in paths])
    people = F.coalesce(F.from_json(get("$.participants", "$.event_data.participants"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(get("$.id", "$.event_id"), F.md5(text.cast("binary"))).alias("id"), F.coalesce(get("$.event_type", "$.event_data.event_type"), F.lit("other")).alias("kind"),
        F.coalesce(get("$.title", "$.event_data.title", "$.description"), F.lit("")).alias("title"), people.alias("participants"),
    )


# Relation names that answers use.
RELATION_NAMES = {"causal": "causal", "因果": "causal", "temporal": "temporal", "时序": "temporal", "correlation": "correlation", "相关": "correlation", "conditional": "conditional", "条件": "conditional"}


def relation_from_answer(text: Column, least: float = 0.3) -> Column:
    """struct(kind, confidence) of a JSON answer; null for an unknown kind that is not sure enough."""
    got = F.from_json(json_body(text), "relation_type string, confidence double")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in RELATION_NAMES.items() for x in p]), F.lower(got["relation_type"])), F.lit("unknown"))
    sure = F.coalesce(got["confidence"], F.lit(0.5))
    return F.when(got["relation_type"].isNotNull() & ~((kind == "unknown") & (sure < least)), F.struct(kind.alias("kind"), sure.alias("confidence")))


def json_or_list(text: Column) -> Column:
    """An answer as JSON: without fences, as it is; else with its quotes mended; else what stands between its brackets,
    split at commas, as a list of texts; null without brackets."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    mended = F.replace(bare, F.lit("'"), F.lit('"'))
    inside = F.regexp_extract(bare, r"(?s)\[(.*)\]", 1)
    items = F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    listed = F.when(F.rlike(bare, F.lit(r"(?s)\[.*\]")), F.to_json(F.filter(items, lambda x: x != "")))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(bare), valid(mended), listed)
