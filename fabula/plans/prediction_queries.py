"""Queries for patterns in use, communities and nested data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import nested as ne
from fabula.functions import scores
from fabula.functions import text as tx
from fabula.operators import graph as gr
from fabula.operators import prediction as pr
from fabula.operators import sequences as seq

from .analysis_queries import PEERS, _peers
from .binding import events, table
from .registry import query

_PAIRS = "(SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events)"
_STATS = f"(SELECT event_type, next_type, n / sum(n) OVER (PARTITION BY event_type) AS probability, n FROM (SELECT event_type, next_type, count(*) AS n FROM {_PAIRS} WHERE next_type IS NOT NULL GROUP BY ALL))"


def _statistics(spark, d):
    pairs = seq.consecutive_pairs(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type"])
    counts = pairs.groupBy("event_type", F.col("next_event_type").alias("next_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("event_type")))


@query(f"""WITH s AS {_STATS}, r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1), p AS (SELECT event_type, next_type, probability AS confidence FROM s WHERE event_type <> next_type AND probability > .19),
    t AS (SELECT user_id, c, sum(v) AS v FROM (SELECT user_id, next_type AS c, confidence AS v FROM r JOIN p USING (event_type) UNION ALL SELECT user_id, next_type, .3 * probability FROM r JOIN s USING (event_type)) GROUP BY ALL)
    SELECT user_id, c AS event_type, round(v / sum(v) OVER (PARTITION BY user_id), 9) AS probability, row_number() OVER (PARTITION BY user_id ORDER BY round(v, 12) DESC, c) AS rank FROM t QUALIFY rank <= 3""")
def predict_next_events(spark, d):
    stats = _statistics(spark, d)
    patterns = stats.where("event_type <> next_type AND probability > 0.19").select("event_type", "next_type", F.col("probability").alias("confidence"))
    latest = events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    out = pr.next_from_patterns(latest, patterns, stats, "user_id", 3)
    return out.withColumn("probability", F.round("probability", 9))


@query("""SELECT event_type AS pattern, n AS support0, n + (SELECT count(*) FROM events x WHERE x.event_type = p.event_type AND x.value > 50) AS support FROM (SELECT event_type, count(*) AS n FROM events WHERE value <= 50 GROUP BY 1) p""")
def evolve_patterns(spark, d):
    rows = events(spark, d).withColumnRenamed("event_type", "pattern")
    old = rows.where("value <= 50").groupBy("pattern").agg(F.count(F.lit(1)).alias("support0")).withColumn("support", F.col("support0"))
    return pr.evolve(old, rows.where("value > 50").select("pattern"), "pattern").select("pattern", "support0", "support")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS c FROM orders WHERE o_totalprice > 50000 GROUP BY ALL), n AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_totalprice > 50000) AS f FROM orders GROUP BY 1)
    SELECT o_custkey, arg_min(v, (-c, v)) AS value, round(f / n, 9) AS coverage, round(max(c) / f, 9) AS accuracy FROM v JOIN n USING (o_custkey) GROUP BY o_custkey, f, n HAVING f / n >= .3 AND max(c) / f >= .6""")
def infer_attributes(spark, d):
    rows = table(spark, d, "orders").withColumn("p", F.when(F.col("o_totalprice") > 50_000, F.col("o_orderpriority")))
    out = pr.infer_attribute(rows, "o_custkey", "p")
    return out.withColumns({"coverage": F.round("coverage", 9), "accuracy": F.round("accuracy", 9)})


@query(f"""WITH p AS (SELECT event_type || '>' || next_type AS pattern, [event_type, next_type] AS s, n AS support, probability AS confidence FROM {_STATS}), e AS (SELECT event_id, pattern, round(.4 + .3 * least(support / 10, 1) + .3 * confidence, 9) AS score FROM events JOIN p ON list_contains(s, event_type))
    SELECT event_id, pattern, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, pattern) AS rank FROM e WHERE score >= .7 QUALIFY rank <= 5""")
def map_events_to_patterns(spark, d):
    stats = _statistics(spark, d)
    patterns = stats.select(F.concat_ws(">", "event_type", "next_type").alias("pattern"), F.array("event_type", "next_type").alias("sequence"), F.col("n").alias("support"), F.col("probability").alias("confidence"))
    rows = events(spark, d).select("event_id", "event_type")
    return pr.map_to_patterns(rows, patterns, "event_id", "pattern", 0.7, 5).withColumn("score", F.round("score", 9))


def _label_sql(rounds: int) -> str:
    parts = [f"WITH u AS MATERIALIZED (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS}), n AS MATERIALIZED (SELECT a, b FROM u UNION SELECT a, a FROM u), l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS c FROM n)"]
    for i in range(1, rounds + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT a AS id, arg_min(c, (-k, c)) AS c FROM (SELECT a, c, count(*) AS k FROM n JOIN l{i - 1} ON id = b GROUP BY ALL) GROUP BY 1)")
    return ", ".join(parts) + f" SELECT id, c AS community FROM l{rounds} WHERE c IN (SELECT c FROM l{rounds} GROUP BY 1 HAVING count(*) >= 3)"


@query(_label_sql(5))
def communities(spark, d):
    return gr.communities(_peers(spark, d))


def _power_sql(rounds: int) -> str:
    parts = [f"WITH u AS MATERIALIZED (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS}), s0 AS MATERIALIZED (SELECT DISTINCT a AS id, 1.0::DOUBLE AS s FROM u)"]
    for i in range(1, rounds + 1):
        parts.append(f"s{i} AS MATERIALIZED (SELECT id, s / sqrt(sum(s * s) OVER ()) AS s FROM (SELECT x.id, any_value(x.s) + sum(y.s) AS s FROM s{i - 1} x JOIN u ON u.a = x.id JOIN s{i - 1} y ON y.id = u.b GROUP BY 1))")
    return ", ".join(parts) + f" SELECT id, round(s, 9) AS score FROM s{rounds}"


@query(_power_sql(10))
def eigenvector_centrality(spark, d):
    return gr.eigenvector(_peers(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH u AS (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS}), p AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events)
    SELECT p.a, p.b, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.a = p.a AND u.b = p.b) THEN 1 WHEN EXISTS (SELECT 1 FROM u x JOIN u y ON x.b = y.a WHERE x.a = p.a AND y.b = p.b) THEN 2 END AS hops FROM p
    WHERE hops IS NOT NULL""")
def association_hops(spark, d):
    pairs = events(spark, d).select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).distinct()
    return gr.shortest_hops(_peers(spark, d), pairs, 2)


@query("""SELECT o_orderkey, field, role, value FROM (SELECT o_orderkey, 'o_orderstatus' AS field, 'entity' AS role, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', 'property', o_custkey::VARCHAR FROM orders
    UNION ALL SELECT o_orderkey, 'day', 'timestamp', strftime(o_orderdate, '%Y-%m-%d') FROM orders)""")
def unpivot_typed(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return ne.unpivot_typed(rows, "o_orderkey", ["o_orderstatus", "o_custkey", "day"])


_RULES = {"growth": ["ation", "growth"], "legal": ["law", "right"], "trade": ["ting", "deal"]}
_NAMES = ["the", "and", "der", "que"]


def _rules_sql() -> str:
    found = ", ".join(f"CASE WHEN contains(lower(text), '{e}') THEN '{e}' END" for e in _NAMES)
    types = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS event_type, e FROM f WHERE " + " OR ".join(f"contains(t, '{w}')" for w in ws) for n, ws in _RULES.items())
    return f"WITH f AS (SELECT doc_id, lower(text) AS t, concat_ws('|', {found}) AS e FROM documents) SELECT doc_id, event_type, e AS entities FROM ({types}) WHERE e <> ''"


@query(_rules_sql())
def extract_by_rules(spark, d):
    return ne.extract_by_rules(table(spark, d, "documents"), "doc_id", "text", _RULES, _NAMES)


@query("""SELECT doc_id, 'Document ' || doc_id || ' (' || lang || ')' AS title, CASE WHEN length(text) > 100 THEN replace(text, chr(10), ' ')[1:100] || '...' ELSE replace(text, chr(10), ' ') END AS line,
    CASE WHEN regexp_matches(trim(n_chars::VARCHAR), '^[-+]?[0-9]*\\.?[0-9]+$') THEN true ELSE false END AS numeric_size FROM documents""")
def render_templates(spark, d):
    docs = table(spark, d, "documents")
    title = tx.render("Document {id} ({lang})", {"id": F.col("doc_id"), "lang": F.col("lang")})
    return docs.select("doc_id", title.alias("title"), tx.cut_description(F.col("text")).alias("line"), tx.is_number(F.col("n_chars").cast("string")).alias("numeric_size"))
