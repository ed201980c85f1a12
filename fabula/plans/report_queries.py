"""Queries for consistency checks and statistics, over entities made of customers and edges made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.operators import consistency as co
from fabula.operators import statistics as st

from .binding import events, news, NEWS, order_events, table
from .registry import query

#: Customers under forty made-up firm names; kinds, attributes and aliases by their number.
_PARTS = {
    "name": "'Acme ' || (c_custkey % 40) || CASE c_custkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Ltd' ELSE '' END",
    "kind": "CASE c_custkey % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'company' WHEN 2 THEN 'organization' WHEN 3 THEN 'event' WHEN 4 THEN 'product' WHEN 5 THEN 'firm' ELSE 'alien' END",
    "founded": "CASE c_custkey % 4 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '1.1.2020' WHEN 2 THEN '2020-02-30' ELSE '2021-03-04T10:00:00Z' END",
    "shown": "CASE WHEN c_custkey % 5 = 0 THEN 'shown' END",
    "alias": "CASE WHEN c_custkey % 11 < 9 THEN 'Also ' || (c_custkey % 80) ELSE 'Pair ' || cast(floor(c_custkey / 2) AS int) END",
    "plain": "'acme ' || (c_custkey % 40)",
}
ENTITIES = "(SELECT c_custkey AS id, c_mktsegment, c_acctbal, " + ", ".join(f"{v} AS {k}" for k, v in _PARTS.items()) + ", CASE WHEN c_custkey % 7 IN (1, 2, 5) THEN 'company' ELSE kind END AS family FROM customer)"
ROLE = "CASE o_orderkey % 4 WHEN 0 THEN 'founder' WHEN 1 THEN 'target' WHEN 2 THEN 'technology' ELSE 'witness' END"


def _entities(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment", "c_acctbal", *[f"{v} AS {k}" for k, v in _PARTS.items()])
    entry = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    attributes = F.map_from_entries(F.array_compact(F.array(
        entry("industry", "c_mktsegment"), entry("founded_date", "founded"), F.when(F.col("shown").isNotNull(), entry("name", "shown")),
    )))
    return rows.select("id", "name", "kind", attributes.alias("attributes"), F.array("alias").alias("aliases"), "c_acctbal")


def _edges(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ["employment", "investment", "location", "gossip"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    firm = F.concat(F.lit("Acme "), (F.col("o_custkey") % 40).cast("string"), F.lit(" Ltd"))
    name = F.when(F.col("o_custkey") % 3 == 0, "Nobody").otherwise(firm)  # so that some firms are in no edge
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), kinds.alias("kind"), F.array(name).alias("names"))


EDGES = """(SELECT o_orderkey AS edge_id, CASE o_orderkey % 4 WHEN 0 THEN 'employment' WHEN 1 THEN 'investment' WHEN 2 THEN 'location' ELSE 'gossip' END AS kind, CASE WHEN o_custkey % 3 = 0 THEN 'Nobody' ELSE 'Acme ' || (o_custkey % 40) || ' Ltd' END AS name FROM orders)"""


@query(f"""SELECT id, 'name' AS attribute, 'type_consistency' AS issue, 'warning' AS severity FROM {ENTITIES} WHERE kind IN ('person', 'company', 'event') AND shown IS NULL
    UNION ALL SELECT id, 'timestamp', 'type_consistency', 'warning' FROM {ENTITIES} WHERE kind = 'event'""")
def missing_attributes(spark, d):
    return co.missing_attributes(_entities(spark, d))


@query(f"""WITH e AS (SELECT name, min_by(kind, id) AS kind FROM {ENTITIES} GROUP BY 1) SELECT edge_id, x.name, 'relation_type' AS issue, 'warning' AS severity FROM {EDGES} x JOIN e USING (name)
    WHERE x.kind = 'employment' AND e.kind NOT IN ('person', 'company') OR x.kind = 'investment' AND e.kind <> 'company' OR x.kind = 'location' AND e.kind NOT IN ('person', 'location', 'company')""")
def wrong_end_kinds(spark, d):
    return co.wrong_kinds(_edges(spark, d), _entities(spark, d))


@query("SELECT c_custkey AS id, 'founded_date' AS attribute, 'temporal' AS issue, 'warning' AS severity FROM customer WHERE c_custkey % 4 IN (1, 2)")
def bad_time_attributes(spark, d):
    return co.bad_times(_entities(spark, d))


@query(f"SELECT id, 'isolated' AS issue, 'info' AS severity FROM {ENTITIES} WHERE name NOT IN (SELECT name FROM {EDGES})")
def isolated_entities(spark, d):
    return co.isolated(_entities(spark, d), _edges(spark, d))


@query(f"SELECT id, other FROM (SELECT id, min(id) OVER (PARTITION BY plain, family, alias) AS other FROM {ENTITIES}) WHERE id > other")
def name_conflicts(spark, d):
    return co.name_conflicts(_entities(spark, d))


@query(f"SELECT plain AS name, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds, count(*) AS n FROM {ENTITIES} GROUP BY 1 HAVING count(DISTINCT family) > 1")
def type_conflicts(spark, d):
    return co.type_conflicts(_entities(spark, d))


@query(f"""SELECT plain AS name, 'industry' AS attribute, count(DISTINCT lower(c_mktsegment)) AS n_values, 'major' AS severity FROM {ENTITIES} GROUP BY 1 HAVING count(DISTINCT lower(c_mktsegment)) > 1
    UNION ALL SELECT plain, 'founded_date', count(DISTINCT founded), 'minor' FROM {ENTITIES} GROUP BY 1 HAVING count(DISTINCT founded) > 1""")
def attribute_conflicts(spark, d):
    return co.attribute_conflicts(_entities(spark, d))


@query(f"SELECT lower(alias) AS alias, count(*) AS n FROM {ENTITIES} GROUP BY 1 HAVING count(*) > 1 AND count(*) = count(DISTINCT family)")
def alias_conflicts(spark, d):
    return co.alias_conflicts(_entities(spark, d))


def _members(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS edge_id", "o_custkey AS id", f"{ROLE} AS role")


@query(f"""SELECT kind, role, count(DISTINCT id) AS n FROM (SELECT o_custkey AS id, {ROLE} AS role FROM orders) JOIN {ENTITIES} USING (id)
    WHERE kind = 'person' AND role <> 'founder' OR kind = 'company' AND role <> 'target' OR kind = 'product' AND role <> 'technology' GROUP BY 1, 2""")
def role_conflicts(spark, d):
    return co.role_conflicts(_members(spark, d), _entities(spark, d))


@query(f"""WITH t AS (SELECT plain FROM {ENTITIES} GROUP BY 1 HAVING count(DISTINCT family) > 1), a AS (SELECT (SELECT count(*) FROM t) AS critical, (SELECT count(*) FROM (SELECT id, min(id) OVER (PARTITION BY plain, family, alias) AS o FROM {ENTITIES}) WHERE id > o)
    + (SELECT count(*) FROM (SELECT plain FROM {ENTITIES} GROUP BY 1 HAVING count(DISTINCT lower(c_mktsegment)) > 1)) AS major, (SELECT count(*) FROM (SELECT plain FROM {ENTITIES} GROUP BY 1 HAVING count(DISTINCT founded) > 1)) AS minor,
    (SELECT count(*) FROM {ENTITIES} WHERE name NOT IN (SELECT name FROM {EDGES})) AS info, (SELECT count(*) FROM customer) AS entities)
    SELECT entities, critical + major + minor + info AS issues, critical, major, minor, info, round(greatest(0, 100 - 100 * (10 * critical + 5 * major + minor + .5 * info) / (10 * entities)), 2) AS score FROM a""")
def consistency_report(spark, d):
    e = _entities(spark, d)
    severity = lambda df, s: df.select(F.lit(s).alias("severity"))
    found = severity(co.type_conflicts(e), "critical").unionByName(severity(co.name_conflicts(e), "major"))
    found = found.unionByName(co.attribute_conflicts(e).select("severity")).unionByName(co.isolated(e, _edges(spark, d)).select("severity"))
    return co.report(e, found)


_KIND = "CASE event_type WHEN 'view' THEN 'temporal_before' WHEN 'click' THEN 'temporal_after' WHEN 'error' THEN 'temporal_simultaneous' WHEN 'purchase' THEN 'causal_direct' ELSE 'contrast_opposite' END"
_RELATIONS = f"(SELECT event_id AS id, user_id % 50 AS src, event_id % 30 AS dst, {_KIND} AS kind, 0.5 + (event_id % 5) / 10.0 AS score FROM events)"


@query(f"""WITH r AS {_RELATIONS}, bad(a, b) AS (VALUES ('temporal_before', 'temporal_after'), ('temporal_before', 'temporal_simultaneous'), ('temporal_after', 'temporal_simultaneous'), ('causal_direct', 'contrast_opposite'), ('conditional_necessary', 'contrast_opposite'))
    SELECT id, conflicts, round(s * power(.8, conflicts), 9) AS score FROM (SELECT r.id, any_value(r.score) AS s, count(o.id) AS conflicts FROM r LEFT JOIN bad ON bad.a = r.kind LEFT JOIN r o ON o.src = r.src AND o.dst = r.dst AND o.kind = bad.b GROUP BY r.id)""")
def relation_set_conflicts(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS id", "user_id % 50 AS src", "event_id % 30 AS dst", f"{_KIND} AS kind", "cast(0.5 + (event_id % 5) / 10.0 AS double) AS score")
    return co.relation_set(rows, "src", "dst", "kind", "score").select("id", "conflicts", F.round("score", 9).alias("score"))


_SHEET = {"amount": "CASE WHEN event_id % 5 = 0 THEN 'many' WHEN event_id % 5 = 1 THEN '-3' ELSE value::VARCHAR END", "day": "CASE event_id % 4 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '' WHEN 2 THEN '2024-01-32' END", "sure": "CASE WHEN event_id % 3 = 0 THEN '1.5' ELSE '0.5' END"}


@query("""SELECT event_id AS id, 'amount' AS field, CASE WHEN event_id % 5 = 0 THEN 'type' ELSE 'range' END AS problem FROM events WHERE event_id % 5 <= 1 UNION ALL SELECT event_id, 'day', CASE WHEN event_id % 4 = 2 THEN 'type' ELSE 'missing' END FROM events WHERE event_id % 4 > 0
    UNION ALL SELECT event_id, 'sure', 'range' FROM events WHERE event_id % 3 = 0""")
def schema_validation(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", *[f"{v.replace('::VARCHAR', '')} AS {k}" if "VARCHAR" not in v else f"{v.replace('value::VARCHAR', 'cast(value AS string)')} AS {k}" for k, v in _SHEET.items()])
    number = lambda c: F.col(c).try_cast("double")
    return co.typed_rows(rows, "event_id", {"amount": ("double", True, number("amount") >= 0), "day": ("date", True, None), "sure": ("double", False, number("sure").between(0, 1))})


# -- statistics --------------------------------------------------------------------------------------------


@query("""SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'category', CASE event_type WHEN 'purchase' THEN '经济' WHEN 'signup' THEN '科技' WHEN 'view' THEN '体育' ELSE 'missing' END, count(*) FROM events GROUP BY 2""")
def value_histograms(spark, d):
    return st.histograms(news(spark, d), ["event_type", "category"])


@query("SELECT entity, count(*) AS n FROM (SELECT DISTINCT event_id, unnest([event_type, 'u' || (user_id % 9), event_type]) AS entity FROM events) GROUP BY 1 ORDER BY n DESC, entity LIMIT 20")
def entity_frequency(spark, d):
    rows = events(spark, d).select(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")), "event_type").alias("e"))
    return st.entity_frequency(rows, "e", 20)


@query("SELECT coalesce(CASE WHEN p_size % 4 > 0 THEN p_brand END, 'general') AS domain, count(*) AS n, round(avg(p_size), 6) AS support, round(avg(p_retailprice), 6) AS confidence, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1")
def patterns_by_domain(spark, d):
    parts = table(spark, d, "part").withColumn("domain", F.when(F.col("p_size") % 4 > 0, F.col("p_brand")))
    out = st.by_domain(parts, "domain", "p_size", "p_retailprice", "p_type")
    return out.withColumns({"support": F.round("support", 6), "confidence": F.round("confidence", 6)})


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, s AS domain FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s) = 1""")
def inferred_domain(spark, d):
    return st.frequent_domain(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT cluster, count(*) AS n FROM (SELECT CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id END AS cluster FROM events) WHERE cluster <> -1 GROUP BY 1 HAVING count(*) >= 5")
def large_clusters(spark, d):
    rows = events(spark, d).select(F.when(F.col("user_id") % 7 == 0, -1).otherwise(F.col("user_id")).alias("cluster"))
    return st.frequent_groups(rows, "cluster", 5)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS v FROM lineitem), n AS (SELECT count(*) AS k FROM m GROUP BY v), h AS (SELECT count(*) AS k FROM m GROUP BY e)
    SELECT (SELECT count(*) FROM n) AS nodes, (SELECT round(avg(k), 6) FROM n) AS avg_node, (SELECT max(k) FROM n) AS max_node, (SELECT count(*) FROM h) AS edges, (SELECT round(avg(k), 6) FROM h) AS avg_edge, (SELECT max(k) FROM h) AS max_edge""")
def hypergraph_statistics(spark, d):
    return st.hypergraph(order_events(spark, d), "event_id", "entity_id").withColumns({"avg_node": F.round("avg_node", 6), "avg_edge": F.round("avg_edge", 6)})


@query(f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE id % 3 = 0) AS with_aliases, count(*) FILTER (WHERE coalesce(o, 0) > 1) AS with_events FROM {ENTITIES} LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = id GROUP BY 1")
def entity_statistics(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    rows = _entities(spark, d).withColumn("aliases", F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("aliases")))
    return st.entities(rows.join(n, "id", "left"), "kind", "aliases", "events")


@query("""SELECT count(*) AS entities, count(*) FILTER (WHERE c_custkey % 3 > 0) AS linked, round(count(*) FILTER (WHERE c_custkey % 3 > 0) / count(*), 9) AS rate, round(avg(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END), 6) AS mean,
    min(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END) AS least, max(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END) AS most FROM customer""")
def linking_statistics(spark, d):
    rows = table(spark, d, "customer").withColumn("kb", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")))
    return st.links(rows, "kb", "c_acctbal").withColumns({"rate": F.round("rate", 9), "mean": F.round("mean", 6)})


@query("SELECT count(*) AS merges, count(*) FILTER (WHERE event_type = 'view') AS automatic, count(*) FILTER (WHERE event_type = 'click') AS manual, round(avg(value), 6) AS similarity FROM events")
def merge_statistics(spark, d):
    kind = F.when(F.col("event_type") == "view", "auto").when(F.col("event_type") == "click", "manual").otherwise("other")
    return st.merges(events(spark, d).withColumn("strategy", kind), "strategy", "value").withColumn("similarity", F.round("similarity", 6))


@query("""SELECT count(*) AS mappings, count(DISTINCT user_id) AS events, count(DISTINCT event_type) AS patterns, count(*) FILTER (WHERE value / 100 >= .8) AS high, count(*) FILTER (WHERE value / 100 >= .5 AND value / 100 < .8) AS medium, count(*) FILTER (WHERE value / 100 < .5) AS low,
    round(avg(value), 6) AS mean_confidence, min(value) AS least_confidence, max(value) AS most_confidence FROM events""")
def mapping_statistics(spark, d):
    return st.mappings(events(spark, d).withColumn("score", F.col("value") / 100), "user_id", "event_type", "score", "value").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""SELECT 'events' AS layer, count(*) AS n FROM events UNION ALL SELECT 'patterns', count(*) FROM part UNION ALL SELECT 'entities', count(*) FROM customer
    UNION ALL SELECT 'total', (SELECT count(*) FROM events) + (SELECT count(*) FROM part) + (SELECT count(*) FROM customer)""")
def layer_statistics(spark, d):
    return st.layers({"events": table(spark, d, "events"), "patterns": table(spark, d, "part"), "entities": table(spark, d, "customer")})


@query("""SELECT "group", row_number() OVER (ORDER BY f, "group") - 1 AS number, n FROM (SELECT coalesce(CASE WHEN user_id % 5 > 0 THEN 'story' || user_id END, 'unassigned') AS "group", min(event_id) AS f, count(*) AS n FROM events GROUP BY 1)""")
def story_groups(spark, d):
    rows = events(spark, d).withColumn("story", F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("story"), F.col("user_id").cast("string"))))
    return st.first_seen_groups(rows, "story", "event_id", "unassigned")


@query("SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, array_to_string(list_sort(list(DISTINCT 's' || (c_custkey % 4))), '<SEP>') AS origin FROM customer GROUP BY 1, 2")
def edge_merge(spark, d):
    rows = table(spark, d, "customer").withColumn("origin", F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string")))
    return st.merge_edges(rows, "c_nationkey", "c_mktsegment", "c_acctbal", "origin").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS confidence, round(avg((value > 10 AND user_id % 2 = 0)::INT), 9) AS passed FROM events GROUP BY 1")
def attribute_statistics(spark, d):
    rows = events(spark, d).withColumn("checks", F.array(F.col("value") > 10, F.col("user_id") % 2 == 0))
    out = st.attribute_results(rows, "event_type", "value", "checks")
    return out.withColumns({"confidence": F.round("confidence", 6), "passed": F.round("passed", 9)})


@query("""WITH c AS (SELECT ts::DATE AS b, count(*) AS n FROM events GROUP BY 1), l AS (SELECT n, lead(n) OVER (ORDER BY b) AS m FROM c)
    SELECT count(*) AS buckets, max(n) AS busiest, round(avg(n), 6) AS mean, round(corr(n, m), 6) AS autocorrelation FROM l""")
def temporal_profile(spark, d):
    return st.temporal_profile(events(spark, d), F.to_date("ts")).withColumns({"mean": F.round("mean", 6), "autocorrelation": F.round("autocorrelation", 6)})


@query("""SELECT event_type, format('{} items, mean {:.2f}, best {:.2f}, above 0.7: {}', count(*), avg((event_id % 101) / 101), max((event_id % 101) / 101), count(*) FILTER (WHERE (event_id % 101) / 101 > .7)) AS summary FROM events GROUP BY 1""")
def relevance_summary(spark, d):
    return st.relevance_text(events(spark, d).withColumn("r", (F.col("event_id") % 101) / 101), "event_type", "r")


@query("""SELECT event_type, count(*) AS calls, round(count(*) FILTER (WHERE value > 20) / count(*), 9) AS success, round(sum(value) / count(*), 6) AS mean_seconds, round(sum(user_id % 10) / sum(value), 6) AS throughput FROM events GROUP BY 1""")
def run_counters(spark, d):
    out = st.run_counters(events(spark, d).withColumn("items", F.col("user_id") % 10), "event_type", F.col("value") > 20, "items", "value")
    return out.withColumns({"success": F.round("success", 9), "mean_seconds": F.round("mean_seconds", 6), "throughput": F.round("throughput", 6)})


@query(f"""SELECT id, 'v_' || id AS vector_id, part, body FROM (SELECT id, unnest([0, 1, 2]) AS part, unnest([content, event_type, 'u' || user_id]) AS body FROM {NEWS}) WHERE body <> ''""")
def three_granularities(spark, d):
    from fabula.operators import retrieval as rt

    rows = news(spark, d).withColumn("entities", F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    return rt.granular_rows(rows, "id", "content", "event_type", "entities").select("id", F.concat(F.lit("v_"), "id").alias("vector_id"), "part", "body")
