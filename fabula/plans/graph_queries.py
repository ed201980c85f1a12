"""Queries for graph access, paths, centralities and n-ary relations: users who follow each other, and events in a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.operators import graph as gr

from .analysis_queries import PEERS, _peers
from .binding import FOLLOWS, events, follows, table
from .registry import query

DEEPEST = 6


def _levels() -> str:
    """WITH list: u(a, b) and all(s, v, d, n), distances and numbers of shortest paths by unrolled rounds."""
    parts = [f"u AS (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS})", "l0 AS (SELECT DISTINCT a AS s, a AS v, 0 AS d, 1.0::DOUBLE AS n FROM u)"]
    for i in range(1, DEEPEST + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM l{j}" for j in range(i))
        parts.append(f"l{i} AS (SELECT l.s, u.b AS v, {i} AS d, sum(n) AS n FROM l{i - 1} l JOIN u ON l.v = u.a WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.s = l.s AND x.v = u.b) GROUP BY 1, 2)")
    return "WITH " + ", ".join(parts) + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(DEEPEST + 1)) + ")"


@query(_levels() + " SELECT s, v, d, n FROM every")
def shortest_distances(spark, d):
    return gr.distances(_peers(spark, d))


@query(_levels() + " SELECT s AS id, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM l0) - 1) ELSE 0 END, 9) AS closeness FROM every GROUP BY s")
def closeness_centrality(spark, d):
    return gr.closeness(_peers(spark, d)).withColumn("closeness", F.round("closeness", 9))


@query(_levels() + """ , k AS (SELECT count(*) AS c FROM l0), p AS (SELECT a.v AS id, sum(a.n * b.n / c.n) AS b FROM every a JOIN every b ON a.v = b.s JOIN every c ON c.s = a.s AND c.v = b.v
    WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = c.d GROUP BY 1) SELECT l0.s AS id, round(coalesce(b, 0) / ((SELECT c FROM k) - 1) / ((SELECT c FROM k) - 2), 9) AS betweenness FROM l0 LEFT JOIN p ON p.id = l0.s""")
def betweenness_centrality(spark, d):
    return gr.betweenness(_peers(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query(_levels() + """ SELECT count(*) = (SELECT count(*) FROM l0) * (SELECT count(*) FROM l0) AS connected, CASE WHEN count(*) = (SELECT count(*) FROM l0) * (SELECT count(*) FROM l0) THEN round(sum(d) / ((SELECT count(*) FROM l0) * ((SELECT count(*) FROM l0) - 1)), 9) END AS mean_length,
    CASE WHEN count(*) = (SELECT count(*) FROM l0) * (SELECT count(*) FROM l0) THEN max(d) END AS diameter FROM every""")
def path_lengths(spark, d):
    return gr.path_lengths(_peers(spark, d)).withColumn("mean_length", F.round("mean_length", 9))


_PATHS = f"""f AS {FOLLOWS}, p AS (SELECT [source_event_id, target_event_id] AS path, [relation_type] AS kinds, [confidence] AS sure, 1 AS length FROM f
    UNION ALL SELECT [x.source_event_id, y.source_event_id, y.target_event_id], [x.relation_type, y.relation_type], [x.confidence, y.confidence], 2 FROM f x JOIN f y ON x.target_event_id = y.source_event_id)"""


def _paths(spark, d):
    edges = follows(spark, d).select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"), F.col("relation_type").alias("kind"), "confidence")
    return gr.typed_paths(edges, events(spark, d).select(F.col("event_id").alias("id")), 2)


@query(f"""WITH {_PATHS} SELECT array_to_string(path, '-') AS path, length, CASE WHEN len(list_filter(kinds, lambda k: contains(k, 'causal'))) = length THEN 'causal' WHEN len(list_filter(kinds, lambda k: contains(k, 'temporal'))) = length THEN 'temporal' ELSE 'mixed' END AS path_kind,
    round(list_sum(sure) / length, 9) AS confidence, round(list_sum(sure), 9) AS weight FROM p""")
def typed_paths(spark, d):
    out = gr.path_scores(_paths(spark, d))
    return out.select(F.array_join("path", "-").alias("path"), "length", "path_kind", F.round("confidence", 9).alias("confidence"), F.round("weight", 9).alias("weight"))


@query(f"""WITH {_PATHS} SELECT array_to_string(path, '-') AS path, round(list_sum(sure) / 2, 9) AS confidence FROM p WHERE length = 2 AND kinds[1] = 'causal' AND kinds[2] = 'causal' ORDER BY 2 DESC, 1 LIMIT 10""")
def causal_chains(spark, d):
    return gr.causal_chains(_paths(spark, d)).select(F.array_join("path", "-").alias("path"), F.round("confidence", 9).alias("confidence"))


@query(f"""SELECT c_custkey AS id, c_custkey IN (SELECT src FROM {PEERS} UNION SELECT dst FROM {PEERS}) AS found FROM customer""")
def has_nodes(spark, d):
    return gr.has_nodes(_peers(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query(f"""WITH q AS (SELECT DISTINCT user_id AS a, user_id + event_id % 3 AS b FROM events) SELECT a, b, (SELECT count(*) FROM {PEERS} WHERE src = a AND dst = b OR a <> b AND src = b AND dst = a) AS n FROM q""")
def edges_between(spark, d):
    asked = events(spark, d).select(F.col("user_id").alias("a"), (F.col("user_id") + F.col("event_id") % 3).alias("b")).distinct()
    return gr.edges_between(_peers(spark, d), asked)


@query(f"SELECT src, dst FROM {PEERS} WHERE src % 5 = 1 OR dst % 5 = 1")
def node_edges(spark, d):
    return gr.node_edges(_peers(spark, d), events(spark, d).where("user_id % 5 = 1").select(F.col("user_id").alias("id")))


@query(f"""WITH p AS {PEERS}, u AS (SELECT src AS a, dst AS b FROM p UNION SELECT dst, src FROM p), s AS (SELECT 1 AS id UNION SELECT b FROM u WHERE a = 1) SELECT src, dst FROM p WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")
def depth_subgraph(spark, d):
    return gr.subgraph(_peers(spark, d), spark.createDataFrame([(1,)], "id long"), 1).select("src", "dst")


@query(f"""WITH p AS (SELECT src, dst, (src * 7 + dst) % 13 AS weight FROM {PEERS}), g AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p) GROUP BY 1),
    e AS (SELECT src AS seed, src, dst, weight FROM p UNION ALL SELECT dst, src, dst, weight FROM p WHERE src <> dst)
    SELECT seed, src, dst, x.d + y.d AS degree, weight, row_number() OVER (PARTITION BY seed ORDER BY x.d + y.d DESC, weight DESC, src, dst) AS rank FROM e JOIN g x ON x.id = src JOIN g y ON y.id = dst QUALIFY rank <= 5""")
def related_edges(spark, d):
    edges = _peers(spark, d).withColumn("weight", (F.col("src") * 7 + F.col("dst")) % 13)
    return gr.related_edges(edges, events(spark, d).select(F.col("user_id").alias("id")), 5)


@query(f"""SELECT src, dst, 1.0 AS weight, 'users' AS layer FROM {PEERS} UNION ALL SELECT source_event_id, target_event_id, confidence, 'events' FROM {FOLLOWS} UNION ALL SELECT c_custkey, c_nationkey, 0.5, 'mapping' FROM customer""")
def unified_graph(spark, d):
    peers = _peers(spark, d).withColumn("weight", F.lit(1.0))
    rows = follows(spark, d).select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"), F.col("confidence").alias("weight"))
    mapped = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit(0.5).alias("weight"))
    return gr.unified({"users": peers, "events": rows, "mapping": mapped})


@query("""SELECT l_orderkey * 10 + l_linenumber AS relation, 's' || l_suppkey AS id, 'subject' AS role, 0 AS place FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'p' || l_partkey, 'object', 1 FROM lineitem
    UNION ALL SELECT l_orderkey * 10 + l_linenumber, unnest(['f' || l_returnflag, 'm' || l_quantity::INT % 3]), 'aux_1', 2 FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'x' || l_linenumber, 'line', 3 FROM lineitem""")
def hyper_relations(spark, d):
    lines = table(spark, d, "lineitem")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    more = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.array(text("f", F.col("l_returnflag")), text("m", F.col("l_quantity").cast("int") % 3)).alias("ids")), F.struct(F.lit("line").alias("role"), F.array(text("x", F.col("l_linenumber"))).alias("ids")))
    facts = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), text("s", F.col("l_suppkey")).alias("s"), text("p", F.col("l_partkey")).alias("o"), more.alias("more"))
    return gr.hyper_relations(facts, "k", "s", "o", "more")


@query("""WITH f AS (SELECT event_type, 'u' || user_id AS name, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT event_type, name, event_type || '_' || (row_number() OVER (PARTITION BY event_type ORDER BY first, name) - 1) AS id FROM f""")
def create_or_get(spark, d):
    rows = events(spark, d).withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return gr.create_or_get(rows, "event_type", "name", "event_id")


@query()
def louvain_communities(spark, d):
    return gr.louvain(_peers(spark, d))


@query()
def node_vectors(spark, d):
    return gr.node_vectors(_peers(spark, d))
