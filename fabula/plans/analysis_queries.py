"""Queries for graphs, vectors, clusters, entities, quality, text, retrieval, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import scores, text as tx
from fabula.operators import clustering as cl
from fabula.operators import entities as er
from fabula.operators import graph as gr
from fabula.operators import mining as mn
from fabula.operators import quality as dq
from fabula.operators import relational as rel
from fabula.operators import retrieval as rt
from fabula.operators import sequences as seq
from fabula.operators import vectors as ve
from fabula.sources import readers, sinks
from fabula.sources.scratch import materialize, new_path
from fabula.streaming import micro_batch as mb

from .binding import EVENTS, FOLLOWS, STATES, events, follows, order_events, states, table
from .registry import query

# -- graphs: users whose events follow each other, over every event; suppliers by shared orders ---------------

PEERS = """(SELECT DISTINCT user_id AS src, other AS dst FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS other FROM events) WHERE other IS NOT NULL AND other <> user_id)"""


def _peers(spark, d):
    """Users whose events follow each other within a type; types are few, so events are numbered over ranges."""
    rows = seq.following(events(spark, d).select("event_type", "ts", "event_id", "user_id"), ["event_type"], ["ts", "event_id"], ["user_id"])
    return materialize(rows.select(F.col("user_id").alias("src"), F.col("next_user_id").alias("dst")).where("src <> dst").distinct(), "peers")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS s FROM lineitem), h0 AS (SELECT 1 AS id), h1 AS (SELECT DISTINCT m2.s AS id FROM m JOIN m m2 USING (e) WHERE m.s IN (SELECT id FROM h0)),
    h2 AS (SELECT DISTINCT m2.s AS id FROM m JOIN m m2 USING (e) WHERE m.s IN (SELECT id FROM h1))
    SELECT id, min(h) AS hops FROM (SELECT id, 0 AS h FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1""")
def hypergraph_bfs(spark, d):
    return gr.hyper_bfs(order_events(spark, d), spark.createDataFrame([(1,)], "id long"), 2)


@query(f"""WITH u AS (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS}), deg AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1),
    t AS (SELECT x.a AS id, count(*) / 2 AS t FROM u x JOIN u y ON x.a = y.a AND x.b <> y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1)
    SELECT id, degree, coalesce(t, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 9) AS coefficient FROM deg LEFT JOIN t USING (id)""")
def triangles_clustering(spark, d):
    return gr.clustering(_peers(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


COPIES = "(SELECT min(doc_id) OVER (PARTITION BY text) AS src, doc_id AS dst FROM documents)"


@query(f"""WITH RECURSIVE t AS {PEERS}, u AS (SELECT src AS a, dst AS b FROM t UNION SELECT dst, src FROM t), r(x, y) AS (SELECT a, a FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
    SELECT x AS id, min(y) AS component FROM r GROUP BY 1""")
def connected_components(spark, d):
    return gr.components(_peers(spark, d))


def _rank_sql(rounds: int) -> str:
    step = lambda i: f"""r{i} AS MATERIALIZED (SELECT n.id, .15 / c + .85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM t)) / c + .85 * coalesce(f, 0) AS r
        FROM n CROSS JOIN k LEFT JOIN (SELECT dst, sum(r / o) AS f FROM t JOIN r{i - 1} ON r{i - 1}.id = src JOIN o USING (src) GROUP BY 1) ON dst = n.id)"""  # noqa: E731
    head = f"""WITH t AS MATERIALIZED {PEERS}, n AS MATERIALIZED (SELECT src AS id FROM t UNION SELECT dst FROM t), k AS MATERIALIZED (SELECT count(*) AS c FROM n),
        o AS MATERIALIZED (SELECT src, count(*) AS o FROM t GROUP BY 1), r0 AS MATERIALIZED (SELECT id, 1 / c AS r FROM n CROSS JOIN k)"""
    return ", ".join([head, *(step(i) for i in range(1, rounds + 1))]) + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


@query(_rank_sql(10))
def page_rank(spark, d):
    return gr.page_rank(_peers(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(f"SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {PEERS} UNION ALL SELECT dst, 0, 1 FROM {PEERS}) GROUP BY 1")
def node_degree(spark, d):
    return gr.degrees(_peers(spark, d))


@query(f"""WITH e AS (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS}),
    h1 AS (SELECT b AS id, 1 AS h FROM e WHERE a = 3), h2 AS (SELECT DISTINCT e.b, 2 FROM e JOIN h1 ON e.a = h1.id)
    SELECT 3 AS seed, id, min(h) AS hops FROM (SELECT 3 AS id, 0 AS h UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id""")
def khop_bfs(spark, d):
    return gr.k_hop(_peers(spark, d), spark.createDataFrame([(3,)], "seed long"), 2)


@query(f"""WITH t AS {PEERS}, a AS (SELECT [src, dst] AS path FROM t WHERE src = 3), b AS (SELECT list_append(path, dst) AS path FROM a JOIN t ON src = path[2] WHERE NOT list_contains(path, dst))
    SELECT array_to_string(path, '-') AS path, len(path) - 1 AS length FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def simple_paths(spark, d):
    out = gr.simple_paths(_peers(spark, d), spark.createDataFrame([(3,)], "id long"), 2)
    return out.select(F.array_join("path", "-").alias("path"), "length")


@query(f"""WITH t AS {PEERS} SELECT a.src::VARCHAR || '-' || a.dst AS path, 2 AS length FROM t a JOIN t b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
    UNION ALL SELECT a.src || '-' || a.dst || '-' || b.dst, 3 FROM t a JOIN t b ON a.dst = b.src JOIN t c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def cycle_detection(spark, d):
    return gr.cycles(_peers(spark, d), 3).select(F.array_join("path", "-").alias("path"), "length")


@query(f"""WITH t AS {PEERS} SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM t x JOIN t y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM t z WHERE z.src = x.src AND z.dst = y.dst)""")
def transitivity_gaps(spark, d):
    return gr.open_triples(_peers(spark, d).withColumn("kind", F.lit("follows"))).select("a", "b", "c")


@query(f"SELECT src, dst FROM {PEERS} WHERE src IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND dst IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def induced_subgraph(spark, d):
    return gr.induced(_peers(spark, d), events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("id"))).select("src", "dst")


@query(f"WITH t AS {PEERS} SELECT src AS id FROM t UNION SELECT dst FROM t")
def graphml_round_trip(spark, d):
    edges = _peers(spark, d)
    nodes = gr.undirected(edges).select(F.col("a").alias("id"), F.col("a").cast("string").alias("name")).distinct()
    path = new_path(spark, "graphml")
    sinks.graphml_elements(nodes, edges, "id", "src", "dst").write.text(path)
    return readers.graph_elements(spark, path, "node", "_id long, data struct<_VALUE: string, _key: string>").select(F.col("_id").alias("id"))


@query(f"""WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS}), deg AS (SELECT a AS id, count(*) AS d FROM u GROUP BY 1),
    t AS (SELECT x.a AS id, count(*) / 2 AS t FROM u x JOIN u y ON x.a = y.a AND x.b <> y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1),
    c AS (SELECT avg(CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) / 2) ELSE 0 END) AS c FROM deg LEFT JOIN t USING (id)), n AS (SELECT count(DISTINCT a) AS n, count(*) // 2 AS m FROM u), r(x, y) AS (SELECT a, a FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y), z AS (SELECT count(*) AS components, max(k) AS largest FROM (SELECT c, count(*) AS k FROM (SELECT x, min(y) AS c FROM r GROUP BY 1) GROUP BY 1))
    SELECT n AS nodes, m AS edges, round(2 * m / (n * (n - 1)), 9) AS density, round(c, 9) AS avg_clustering, components, largest FROM n CROSS JOIN c CROSS JOIN z""")
def graph_metrics(spark, d):
    out = gr.metrics(_peers(spark, d))
    return out.select("nodes", "edges", F.round("density", 9).alias("density"), F.round("avg_clustering", 9).alias("avg_clustering"), "components", "largest")


# -- vectors and clusters ---------------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
    FROM (SELECT * FROM embeddings WHERE label = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 10""")
def knn_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    return ve.knn(rows, rows.where("label = 0"), "vec_id", "embedding", 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
    FROM (SELECT * FROM embeddings WHERE label = 1) a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 5) WHERE similarity >= .2""")
def knn_overfetch(spark, d):
    rows = table(spark, d, "embeddings")
    return ve.knn(rows, rows.where("label = 1"), "vec_id", "embedding", 5, 0.2, overfetch=2).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= .25")
def cosine_pairs(spark, d):
    return ve.within_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.25).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= .25")
def cosine_pairs_all(spark, d):
    return ve.all_within_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", 0.25).withColumn("similarity", F.round("similarity", 6))


@query("SELECT label, i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def cluster_centroids(spark, d):
    means = ve.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("""WITH q AS (SELECT vec_id, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, list_sum(list_transform(v, lambda x: floor((x - lo) / ((hi - lo) / 255) + .5)))::BIGINT AS code_sum, array_to_string(list_transform(v[1:4], lambda x: floor((x - lo) / ((hi - lo) / 255) + .5)::INT), ',') AS codes,
    round(lo + floor((v[5] - lo) / ((hi - lo) / 255) + .5) * (hi - lo) / 255, 6) AS fifth, true AS near FROM q""")
def quantise_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("q", scores.quantise(F.col("v"))).withColumn("back", scores.dequantise(F.col("q")))
    off = F.array_max(F.zip_with("v", "back", lambda x, y: F.abs(x - y)))
    return rows.select(
        "vec_id", F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.array_join(F.slice("q.codes", 1, 4), ",").alias("codes"),
        F.round(F.col("back")[4], 6).alias("fifth"), (off <= (F.col("q.hi") - F.col("q.lo")) / 509).alias("near"),
    )


@query(f"""WITH RECURSIVE n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS} >= .3),
    core AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) + 1 >= 3), i AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    r(x, y) AS (SELECT id, id FROM core UNION SELECT r.x, i.b FROM r JOIN i ON i.a = r.y), c AS (SELECT x AS id, min(y) AS cluster FROM r GROUP BY 1),
    e AS (SELECT a AS id, min(cluster) AS near FROM n JOIN c ON c.id = n.b GROUP BY 1)
    SELECT vec_id AS id, coalesce(cluster, near, -1) AS cluster FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN e ON e.id = vec_id""")
def dbscan_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    return cl.dbscan(ve.within_cosine(rows, "vec_id", "embedding", "label", 0.3), rows.select(F.col("vec_id").alias("id")), 3)


@query(f"""WITH RECURSIVE n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= .3),
    core AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) + 1 >= 3), i AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    r(x, y) AS (SELECT id, id FROM core UNION SELECT r.x, i.b FROM r JOIN i ON i.a = r.y), c AS (SELECT x AS id, min(y) AS cluster FROM r GROUP BY 1),
    e AS (SELECT a AS id, min(cluster) AS near FROM n JOIN c ON c.id = n.b GROUP BY 1)
    SELECT vec_id AS id, coalesce(cluster, near, -1) AS cluster FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN e ON e.id = vec_id""")
def dbscan_cosine_all(spark, d):
    rows = table(spark, d, "embeddings")
    near = ve.all_within_cosine(rows, "vec_id", "embedding", 0.3)
    return cl.dbscan(materialize(near, "cosine-pairs"), rows.select(F.col("vec_id").alias("id")), 3)


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, count(*) AS size, avg(value) AS mean, stddev_pop(value) AS deviation FROM events GROUP BY 1)
    SELECT user_id, size, arg_min(event_type, (-n, event_type)) AS main_kind, round(any_value(mean), 6) AS mean, round(any_value(deviation), 6) AS deviation FROM s JOIN m USING (user_id) GROUP BY ALL""")
def cluster_profile(spark, d):
    out = cl.profile(events(spark, d), "user_id", "event_type", "value")
    return out.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 10 AS slice FROM events")
def batch_slices(spark, d):
    return cl.slices(events(spark, d), "event_type", ["ts", "event_id"], 10).select("event_id", "event_type", "slice")


@query("""WITH w AS (SELECT doc_id, source, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents), tf AS (SELECT doc_id, source, w, count(*) AS tf FROM w WHERE length(w) > 1 GROUP BY ALL),
    idf AS (SELECT w, ln((SELECT 1.0 + count(DISTINCT doc_id) FROM documents) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), x AS (SELECT *, tf * idf AS x FROM tf JOIN idf USING (w)),
    u AS (SELECT doc_id, source, w, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM x), s AS (SELECT source, w, sum(x) AS s FROM u GROUP BY ALL), l AS (SELECT source, sqrt(sum(s * s)) AS l FROM s GROUP BY 1)
    SELECT source, size, round(l / size, 6) AS cohesion FROM l JOIN (SELECT source, count(DISTINCT doc_id) AS size FROM u GROUP BY 1) USING (source)""")
def tfidf_cohesion(spark, d):
    return cl.tfidf_cohesion(table(spark, d, "documents"), "doc_id", "source", "text").withColumn("cohesion", F.round("cohesion", 6))


@query(None)
def kmeans_clusters(spark, d):
    return cl.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


# -- patterns and relations -------------------------------------------------------------------------------


@query(f"SELECT * FROM {FOLLOWS}")
def rule_relation_inference(spark, d):
    return follows(spark, d)


@query(f"""WITH t AS (SELECT a.event_type || '-' || relation_type || '-' || b.event_type AS pattern, confidence FROM {FOLLOWS} f JOIN events a ON a.event_id = source_event_id JOIN events b ON b.event_id = target_event_id)
    SELECT pattern, count(*) AS frequency, round(count(*) / (SELECT count(*) FROM t), 9) AS support, round(sum(confidence), 6) AS total_confidence FROM t GROUP BY 1""")
def edge_patterns(spark, d):
    out = mn.edge_patterns(follows(spark, d), events(spark, d), "source_event_id", "target_event_id", "relation_type", "confidence", "event_id", "event_type")
    total = F.round(F.col("confidence") * F.col("frequency"), 6)  # a sum of six-place numbers; a mean may lie between two
    return out.select("pattern", "frequency", F.round("support", 9).alias("support"), total.alias("total_confidence"))


@query("""WITH p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), q AS (SELECT * FROM p WHERE b IS NOT NULL), n AS (SELECT a, count(*) AS n FROM q GROUP BY 1)
    SELECT a AS event_type, b AS next_event_type, count(*) AS support, round(count(*) / n, 9) AS confidence FROM q JOIN n USING (a) WHERE (a, b) IN (('view', 'click'), ('click', 'purchase'), ('signup', 'purchase')) GROUP BY a, b, n HAVING count(*) >= 5""")
def causal_patterns(spark, d):
    pairs = seq.consecutive_pairs(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type"])
    out = mn.causal_pairs(pairs, "event_type", "next_event_type", [("view", "click"), ("click", "purchase"), ("signup", "purchase")], 5)
    return out.withColumn("confidence", F.round("confidence", 9))


@query("""WITH p AS (SELECT user_id AS k, list(DISTINCT k) AS s, count(*) AS support FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1 HAVING count(*) >= 40)
    SELECT k AS user_id, support FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k <> p.k AND (q.support > p.support OR q.support = p.support AND q.k < p.k)
     AND len(list_intersect(p.s, q.s)) >= .5 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s))))""")
def prune_similar_patterns(spark, d):
    p = events(spark, d).groupBy("user_id").agg(F.collect_set("k").alias("s"), F.count(F.lit(1)).alias("support"))
    return mn.prune_patterns(p, "user_id", "s", "support", 40, 0.5).select("user_id", "support")


# -- entities and quality -----------------------------------------------------------------------------------

_BASE_NAME = r"""replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s-]', '', 'g'), '\s+', ' ', 'g')), '\s(incorporated|corporation|limited|company|group|corp|inc|ltd|llc|co)$', ''), '-', '')"""


@query(f"SELECT p_partkey, {_BASE_NAME} AS base, upper(p_brand) || '_' || replace(lower(p_type), ' ', '_') AS context_id FROM part")
def normalise_names(spark, d):
    part = table(spark, d, "part")
    context = F.concat(F.upper("p_brand"), F.lit("_"), tx.context_id(F.col("p_type")))
    return part.select("p_partkey", tx.company_base(F.col("p_name")).alias("base"), context.alias("context_id"))


@query("""WITH p AS (SELECT c_custkey AS id, 'alpha' || (c_custkey // 2 % 50) || ' beta' || (c_custkey // 6) AS n, c_custkey // 2 % 2 AS k FROM customer), e AS (SELECT a.id AS a, b.id AS b, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 9) AS s, a.n AS x, b.n AS y FROM p a JOIN p b ON a.k = b.k AND a.id < b.id)
    SELECT a, b, CASE WHEN x = y THEN 1.0 ELSE s END AS score, CASE WHEN x = y OR s >= .95 THEN 'merge' ELSE 'review' END AS decision FROM e WHERE list_has_any(string_split(x, ' '), string_split(y, ' ')) AND (x = y OR s >= .7)""")
def entity_duplicates(spark, d):
    key = F.col("c_custkey")
    part = lambda n, m=None: (F.floor(key / n) if m is None else F.floor(key / n) % m).cast("string")
    suffix = F.when(key % 2 == 0, " Inc.").otherwise(" Co")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Alpha"), part(2, 50), F.lit(" Beta"), part(6), suffix).alias("name"), (F.floor(key / 2) % 2).alias("kind"))
    return er.decide(er.duplicate_pairs(rows, "c_custkey", "name", "kind", digits=9))


@query("""WITH p AS (SELECT o_custkey AS id, o_orderstatus || '-' || o_orderpriority AS name, o_orderkey AS k FROM orders), g AS (SELECT id, name, count(*) AS events FROM p GROUP BY ALL), e AS (SELECT name, min(id) AS entity FROM g GROUP BY 1)
    SELECT entity, name, name AS aliases, (SELECT sum(events) FROM g WHERE g.name = e.name)::BIGINT AS events, (SELECT count(*) FROM g WHERE g.name = e.name) AS merged FROM e""")
def entity_merge(spark, d):
    rows = table(spark, d, "orders").groupBy(F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("name"), F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("events"))
    rows = rows.withColumn("id", F.struct("c", "name"))
    low = rows.groupBy("name").agg(F.min("c").alias("b"))
    pairs = rows.join(low, "name").where("c > b").select(F.struct(F.col("b").alias("c"), "name").alias("a"), F.col("id").alias("b"))
    return er.merge(rows, pairs, "id", "name", "events").select(F.col("entity.c").alias("entity"), "name", "aliases", "events", "merged")


@query(r"""WITH c AS (SELECT o_orderkey AS id, 'the ' || lower(n_name) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' || lower(split_part(c_mktsegment, ' ', 1)) END AS n, lower(n_name) AS al FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT min(kb) AS kb, m FROM (SELECT n_nationkey AS kb, 'the ' || lower(n_name) AS m FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation UNION ALL SELECT r_regionkey + 200, lower(r_name) || ' region' FROM region) GROUP BY m),
    s AS (SELECT id, kb, round(least(1, .6 * (1 - levenshtein(n, m) / greatest(length(n), length(m))) + CASE WHEN n = m THEN .2 ELSE 0 END + CASE WHEN id % 2 = 0 AND m = al THEN .15 ELSE 0 END + CASE WHEN split_part(n, ' ', 1) = string_split_regex(m, '[^\w]+')[1] THEN .1 ELSE 0 END), 12) AS s
        FROM c JOIN k ON list_has_any(list_concat(string_split_regex(n, '[^\w]+'), CASE WHEN id % 2 = 0 THEN string_split_regex(al, '[^\w]+') ELSE [] END), string_split_regex(m, '[^\w]+')))
    SELECT id, arg_min(kb, (-s, kb)) AS kb, round(max(s), 9) AS confidence FROM s GROUP BY 1 HAVING max(s) >= .7""".replace("\\\\", "\\"))
def entity_linking(spark, d):
    nation = table(spark, d, "nation")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.split("c_mktsegment", " ")[0]))
    rows = rows.select("o_orderkey", F.concat(F.lit("The "), "n_name", segment).alias("label"), F.when(F.col("o_orderkey") % 2 == 0, F.array("n_name")).alias("also"))
    base = nation.select(F.col("n_nationkey").cast("long").alias("kb"), F.concat(F.lit("the "), "n_name").alias("m")).unionByName(nation.select((F.col("n_nationkey") + 100).cast("long").alias("kb"), F.col("n_name").alias("m")))
    base = base.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 200).cast("long").alias("kb"), F.concat("r_name", F.lit(" region")).alias("m")))
    return er.link(rows, base, "o_orderkey", "label", "kb", "m", aliases="also").withColumn("confidence", F.round("confidence", 9))


@query("""SELECT doc_id AS id, 'empty_text' AS rule, 'error' AS severity FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT doc_id, 'short_text', 'warning' FROM documents WHERE length(text) < 50
    UNION ALL SELECT doc_id, 'length_mismatch', 'error' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'special_signs', 'info' FROM documents WHERE regexp_matches(text, '[#$%&*]{3}')""")
def quality_rules(spark, d):
    t = F.col("text")
    rules = [
        ("empty_text", "error", F.trim(F.coalesce(t, F.lit(""))) == ""), ("short_text", "warning", F.length(t) < 50),
        ("length_mismatch", "error", F.col("n_chars") != F.length(t)), ("special_signs", "info", F.rlike(t, F.lit("[#$%&*]{3}"))),
    ]
    return dq.violations(table(spark, d, "documents"), "doc_id", rules)


@query("SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def uniqueness(spark, d):
    return dq.duplicates(table(spark, d, "documents"), ["text"])


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def referential_integrity(spark, d):
    return dq.dangling(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 5"), "l_partkey", "p_partkey")


@query(f"""WITH t AS (SELECT f.*, (epoch_us(b.ts) - epoch_us(a.ts)) / 86400e6 AS days FROM {FOLLOWS} f JOIN events a ON a.event_id = source_event_id JOIN events b ON b.event_id = target_event_id)
    SELECT source_event_id, target_event_id, CASE WHEN relation_type = 'causal' AND days < 0 OR NOT confidence BETWEEN 0 AND 1 THEN 0
     ELSE round(greatest(0, confidence - .1 * ((relation_type = 'causal' AND days > 30)::INT + (confidence < .3)::INT)), 6) END AS score FROM t""")
def relation_validation(spark, d):
    return dq.relation_checks(follows(spark, d), events(spark, d)).select("source_event_id", "target_event_id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT source, count(*) * 100 AS n, count(*) FILTER (length(text) < 50) AS e, count(*) FILTER (regexp_matches(text, '[#$%&*]{3}')) AS w FROM documents GROUP BY 1)
    SELECT source, CASE WHEN 10 * e + 2 * w >= n THEN 0 ELSE round(100 - 100 * (10 * e + 2 * w) / n, 2) END AS score FROM e""")
def kg_quality_score(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg((F.count(F.lit(1)) * 100).alias("n"), F.count_if(F.length("text") < 50).alias("e"), F.count_if(F.rlike("text", F.lit("[#$%&*]{3}"))).alias("w"))
    return g.select("source", scores.quality_score(F.col("n"), F.col("e"), F.col("w")).alias("score"))


# -- text ----------------------------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, (i // 80)::INT AS chunk_order, len(w[i + 1:i + 100]) AS tokens, md5(array_to_string(w[i + 1:i + 100], ' ')) AS chunk_id FROM w, unnest(range(0, greatest(len(w), 1), 80)) AS r(i) WHERE len(w) > 0""")
def chunk_windows(spark, d):
    words = table(spark, d, "documents").select("doc_id", tx.word_list(F.col("text")).alias("w"))
    rows = words.select("doc_id", F.explode(tx.chunk_windows(F.col("w"), 100, 20)).alias("c"))
    return rows.select("doc_id", "c.chunk_order", "c.tokens", F.md5(F.col("c.content").cast("binary")).alias("chunk_id"))


@query(r"""SELECT page_id, length(regexp_replace(replace(replace(replace(replace(replace(trim(html), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS n,
    len(list_filter(list_transform(string_split_regex(html, '<p>|</p>'), lambda x: trim(x)), lambda x: x <> '')) AS parts FROM pages""")
def clean_and_split(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.length(tx.clean(F.col("html"))).alias("n"), F.size(tx.split_markers(F.col("html"), ["<p>", "</p>"])).alias("parts"))


@query(r"""WITH a AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS s, source FROM documents), b AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM a)
    SELECT doc_id, round(len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t))), 9) AS jaccard FROM b WHERE t IS NOT NULL""")
def word_set_jaccard(spark, d):
    docs = table(spark, d, "documents")
    pairs = seq.following(docs.select("source", "doc_id"), ["source"], ["doc_id"], ["doc_id"])  # ids only; words join later
    sets = docs.select("doc_id", tx.word_set(F.col("text")).alias("s"))
    after = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("next_doc_id"), F.col("s").alias("t")), "next_doc_id")
    return after.select("doc_id", F.round(tx.set_jaccard(F.col("s"), F.col("t")), 9).alias("jaccard"))


_DATES = ["2023-H2", "2023-H1", "2023-Q3", "2023", "", "2024-02-29 noon", "2024-3", "in spring of 1999", "2024-13-01", None]


@query("SELECT * FROM (VALUES (0, DATE '2023-06-01'), (1, DATE '2023-01-01'), (2, DATE '2023-07-01'), (3, DATE '2023-01-01'), (4, DATE '2023-01-01'), (5, DATE '2024-02-29'), (6, DATE '2024-03-01'), (7, DATE '1999-01-01'), (8, DATE '2023-01-01'), (9, DATE '2023-01-01')) t(i, parsed)")
def fuzzy_dates(spark, d):
    return spark.createDataFrame(list(enumerate(_DATES)), "i int, t string").select("i", scores.fuzzy_date(F.col("t")).alias("parsed"))


@query("""SELECT event_id, round(exp(-abs(floor((epoch_us(nt) - epoch_us(ts)) / 86400000000)) / 30), 9) AS similarity FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events) WHERE nt IS NOT NULL""")
def time_similarity(spark, d):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events(spark, d).withColumn("nt", before).where("nt IS NOT NULL")
    return rows.select("event_id", F.round(scores.time_similarity(F.col("ts"), F.col("nt")), 9).alias("similarity"))


# -- retrieval -----------------------------------------------------------------------------------------------


@query(r"""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))) AS w FROM documents),
    h AS (SELECT item_id, doc_id, count(*) AS hits FROM d JOIN (SELECT item_id, unnest(w) AS w FROM q) USING (w) GROUP BY ALL)
    SELECT item_id, doc_id, hits, round(least(.3 * hits, 1), 6) AS relevance, row_number() OVER (PARTITION BY item_id ORDER BY least(.3 * hits, 1) DESC, hits DESC, doc_id) AS rank FROM h QUALIFY rank <= 10""")
def keyword_retrieval(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", tx.word_set(F.col("text")).alias("words"))
    out = rt.keyword_hits(table(spark, d, "documents"), asked, "doc_id", "text", "item_id", "words", 10)
    return out.withColumn("relevance", F.round("relevance", 6))


@query(f"""WITH u AS (SELECT src AS a, dst AS b FROM {PEERS} UNION SELECT dst, src FROM {PEERS})
    SELECT a AS id, count(*) AS relations, count(DISTINCT b) AS nodes, round(.4 * least(count(*) / 10, 1) + .4 * least(count(DISTINCT b) / 20, 1) + .18, 9) AS score FROM u GROUP BY 1""")
def structural_scores(spark, d):
    near = gr.undirected(_peers(spark, d))
    out = rt.structural_scores(near, near.select(F.col("a").alias("id")).distinct())
    return out.select("id", "relations", "nodes", F.round("score", 9).alias("score"))


# -- sources, sinks and streams ------------------------------------------------------------------------------


@query(f"SELECT data_type, count(*) AS n FROM (SELECT 'event' AS data_type FROM {EVENTS} UNION ALL SELECT 'relation' FROM {FOLLOWS}) GROUP BY 1")
def tagged_json_round_trip(spark, d):
    both = sinks.tagged(events(spark, d), follows(spark, d))
    path = new_path(spark, "tagged-json")
    sinks.json_lines(both, path)
    kinds = [readers.json_lines(spark, path, both.schema, tag) for tag in ("event", "relation")]
    return kinds[0].unionByName(kinds[1]).groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, 'unknown' AS human_decision, '' AS human_notes FROM {STATES} WHERE current_status = 'pending_review'")
def review_sheet_round_trip(spark, d):
    state = states(spark, d).where("current_status = 'pending_review'").select("id", "source", F.length("source_text").alias("triage_confidence"))
    path = new_path(spark, "review")
    sinks.review_sheet(state, "id", "source", "triage_confidence").write.option("header", True).csv(path)
    return readers.review_sheet(spark, path).select(F.col("id").cast("long").alias("id"), "human_decision", "human_notes")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_keyed_merge(spark, d):
    like = table(spark, d, "events")
    path = new_path(spark, "stream-in")
    like.select("event_id", "event_type", "user_id").repartitionByRange(3, "event_id").write.parquet(path)
    stream = mb.file_stream(spark, path, spark.read.parquet(path))
    state = new_path(spark, "stream-state")
    mb.run_available(stream, mb.merge_into(state, "user_id", "event_id"), new_path(spark, "stream-checkpoint"))
    return mb.latest(spark, state).select("user_id", "event_id", "event_type")


@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL""")
def stream_tumbling_window(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    path = new_path(spark, "stream-in")
    rows.write.parquet(path)
    stream = mb.file_stream(spark, path, spark.read.parquet(path))
    out = mb.drain(mb.windowed_counts(stream, "ts", "event_type", "value", late="400 days"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = mb.session_counts(rows, "ts", "user_id", "6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority = '2-HIGH' GROUP BY 1")
def sql_with_arguments(spark, d):
    text = "SELECT o_orderstatus, count(*) AS n FROM fabula_orders WHERE o_totalprice >= :least AND o_orderpriority = :priority GROUP BY 1"
    return readers.sql(spark, text, {"fabula_orders": table(spark, d, "orders")}, least=100_000, priority="2-HIGH")
