"""Event schemas by name, and checks of JSON events against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of each event kind; ``!`` marks required ones, a type other than string follows the colon.
_COMMON = "source! publish_date!:date"
_FIELDS = {
    "company_merger_and_acquisition": "acquirer! acquired! deal_amount:double status announcement_date!:date",
    "investment_and_financing": "investors!:array company! funding_amount!:double round! related_products:array",
    "executive_change": "company! executive_name! position! change_type! change_date!:date",
    "legal_proceeding": "plaintiff! defendant! cause_of_action! amount_involved:double judgment filing_date!:date",
    "capacity_expansion": "company! location! investment_amount:double new_capacity! technology_node estimated_production_time!:date",
    "technological_breakthrough": "organization! technology_name! key_metrics application_field release_date!:date",
    "supply_chain_dynamics": "company dynamic_type affected_link involved_materials affected_objects",
    "collaboration_joint_venture": "trigger_words:array partners!:array domain! method goal validity_period",
    "intellectual_property": "company! ip_type! ip_details! amount_involved:double judgment_result",
    "domain_event": "event_id! event_type! trigger arguments!:map sub_events:array description timestamp!:date location status confidence_score:double",
    "domain_event_relation": "source_event_id! target_event_id! relation_type! description confidence_score:double",
}
OTHER_NAMES = {"collaboration": "collaboration_joint_venture"}
SHARES = {"confidence_score"}  # lie between 0 and 1
PATTERNS = {("executive_change", "change_type"): "^(上任|离职)$"}


def schema_of(name: str) -> dict[str, tuple[str, bool]] | None:
    """field -> (type, required) of an event kind, whatever its case; None for an unknown one."""
    name = OTHER_NAMES.get(name.lower(), name.lower())
    if name not in _FIELDS:
        return None
    parts = [f.partition(":") for f in f"{_COMMON} {_FIELDS[name]}".split()]
    return {f.rstrip("!"): (kind or "string", f.endswith("!")) for f, _, kind in parts}


def registry(spark) -> DataFrame:
    """(kind, field, type, required, pattern, share): a row for each field of each kind, under all its names."""
    rows = [
        (name, field, kind, required, PATTERNS.get((name, field)), field in SHARES)
        for name in [*_FIELDS, *OTHER_NAMES] for field, (kind, required) in schema_of(name).items()
    ]
    return spark.createDataFrame(rows, "kind string, field string, type string, required boolean, pattern string, share boolean")


def _fits(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "double", value.try_cast("double").isNotNull()).when(kind == "date", value.try_cast("date").isNotNull())
        .when(kind == "array", F.startswith(value, F.lit("["))).when(kind == "map", F.startswith(value, F.lit("{"))).otherwise(True)
    )


def violations(df: DataFrame, key: str, kind: str, json: str) -> DataFrame:
    """(id, field, problem) of JSON events against the schema of their kind: ``unknown kind``, ``broken``, or for a field
    ``missing``, ``type``, ``range`` or ``pattern``. The registry has a row for each known field, so it is broadcast."""
    rows = df.select(F.col(key).alias("id"), F.lower(kind).alias("kind"), F.from_json(json, "map<string,string>").alias("v"), F.try_parse_json(json).isNotNull().alias("ok"))
    fields = F.broadcast(registry(df.sparkSession))  # under a hundred rows
    known = fields.select("kind").distinct()
    whole = rows.join(F.broadcast(known.withColumn("known", F.lit(True))), "kind", "left")
    problem = F.when(F.col("known").isNull(), "unknown kind").when(~F.coalesce("ok", F.lit(False)), "broken")
    first = whole.select("id", F.lit("").alias("field"), problem.alias("problem")).where("problem IS NOT NULL")
    each = rows.where("ok").join(fields, "kind").withColumn("value", F.try_element_at("v", F.col("field")))
    blank = F.col("value").isNull() | (F.trim("value") == "")
    number = F.col("value").try_cast("double")
    wrong = (
        F.when(blank, F.when(F.col("required"), "missing")).when(~_fits(F.col("type"), F.col("value")), "type")
        .when(F.col("share") & ~number.between(0, 1), "range").when(F.col("pattern").isNotNull() & ~F.expr("value RLIKE pattern"), "pattern")
    )
    return first.unionByName(each.select("id", "field", wrong.alias("problem")).where("problem IS NOT NULL"))
