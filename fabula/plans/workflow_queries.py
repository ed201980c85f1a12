"""Queries for ingestion, stories, clusters, states, streams and the smaller readers and writers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import nested as ne
from fabula.functions import scores
from fabula.functions import text as tx
from fabula.operators import clustering as cl
from fabula.operators import graph as gr
from fabula.operators import ingestion as ing
from fabula.operators import prediction as pr
from fabula.operators import quality as dq
from fabula.operators import relational as rel
from fabula.operators import state as st
from fabula.sources import readers, sinks
from fabula.sources.scratch import new_path
from fabula.streaming import micro_batch as mb

from .analysis_queries import _peers
from .binding import FOLLOWS, NEWS, STATES, events, follows, news, states, table
from .registry import query

# -- ingestion and stories -----------------------------------------------------------------------------------


_W = r"list_filter(string_split_regex(trim(content), '\s+'), lambda x: x <> '')"


@query(rf"""WITH n AS (SELECT DISTINCT trim(content) AS content FROM {NEWS} WHERE trim(content) <> ''), d AS (SELECT 'doc-' || md5(content) AS id, {_W} AS w FROM n WHERE content NOT LIKE 'plain%'),
    c AS (SELECT id AS doc, s // 3 AS chunk_order, array_to_string(w[s + 1:s + 5], ' ') AS content FROM d, unnest(range(0, len(w), 3)) AS r(s)) SELECT 'chunk-' || md5(content) AS id, min(doc) AS doc FROM c GROUP BY content""")
def document_insert(spark, d):
    texts = news(spark, d)
    old = texts.where("content LIKE 'plain%'").select(F.concat(F.lit("doc-"), F.md5(F.col("content").cast("binary"))).alias("id")).distinct()
    _, chunks = ing.insert_documents(texts, old, spark.createDataFrame([], "id string"), "content", 5, 2)
    return chunks.select("id", "doc")


@query("""WITH e AS (SELECT '"' || upper(c_name) || '"' AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS kind, CASE WHEN c_nationkey < 20 THEN 'chunk' || c_nationkey ELSE 'UNKNOWN' END AS chunk FROM customer),
    r AS (SELECT '"' || upper(c_name) || '"' AS src, '"CLERK ' || (o_orderkey % 30) || '"' AS dst, CASE WHEN o_orderkey % 30 < 20 THEN 'chunk' || (o_orderkey % 30) ELSE 'UNKNOWN' END AS chunk FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT name, kind, chunk FROM e UNION ALL SELECT dst, 'UNKNOWN', min(chunk) FROM r GROUP BY dst""")
def graph_insert(spark, d):
    c = table(spark, d, "customer")
    entities = c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("kind"), F.col("c_nationkey").cast("long").alias("source"))
    orders = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    relations = orders.select(F.col("c_name").alias("src"), F.concat(F.lit("clerk "), (F.col("o_orderkey") % 30).cast("string")).alias("dst"), F.lit(1.0).alias("weight"), (F.col("o_orderkey") % 30).alias("source"))
    sources = spark.range(20).select(F.col("id").alias("source"), F.concat(F.lit("chunk"), F.col("id").cast("string")).alias("chunk"))
    return ing.insert_graph(entities, relations, sources)[0]


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'ma' ELSE 'general' END || '_' || event_id AS id, event_type || ' by ' || user_id AS content, CASE event_id % 3 WHEN 0 THEN '公司并购' ELSE event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS roles, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS arity FROM events""")
def event_contexts(spark, d):
    rows = events(spark, d).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "公司并购").otherwise(F.col("event_type")))
    base = F.create_map(F.lit("who"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("all")))
    roles = F.when(F.col("event_id") % 2 == 0, F.map_concat(base, F.create_map(F.lit("what"), F.array(F.lit("all"), F.lit("thing"))))).otherwise(base)
    out = ing.contexts(rows, "event_id", "kind", F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")), roles)
    return out.select("id", "content", F.col("metadata.event_type").alias("kind"), "metadata.roles", "hyperedge.arity")


@query("""WITH p AS (SELECT event_id AS o, 'type' AS kind, event_type AS name FROM events UNION ALL SELECT event_id, 'user', user_id::VARCHAR FROM events), f AS (SELECT kind, name, min(o) AS o FROM p GROUP BY 1, 2),
    i AS (SELECT kind, name, kind || '_' || (row_number() OVER (PARTITION BY kind ORDER BY o, name) - 1) AS id FROM f) SELECT i.id AS node, p.kind AS role, count(*) AS edges FROM p JOIN i USING (kind, name) GROUP BY 1, 2""")
def hypergraph_build(spark, d):
    _, edges = ing.hypergraph(events(spark, d), "event_id", "event_type", {"event_type": "type", "user_id": "user"}, "event_id")
    path = new_path(spark, "hypergraph")  # save and load
    edges.write.json(path)
    again = spark.read.schema(edges.schema).json(path)
    return again.groupBy("node", F.when(F.col("role") == "event_type", "type").otherwise("user").alias("role")).agg(F.count(F.lit(1)).alias("edges"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_id % 5 ELSE 1 END AS n, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS kind FROM events WHERE event_id % 5 IN (1, 2, 3)""")
def model_extraction(spark, d):
    """An injected extractor whose answer is a JSON array for each event, or a lone object, or nothing; it fails on some."""

    def answer(texts):
        if any(t.startswith("4") for t in texts):
            raise RuntimeError("the model is down")
        made = []
        for t in texts:
            n, kind = t.split("|")
            one = '{"kind": "%s"}' % kind
            made.append(one if n == "3" else "[" + ", ".join([one] * int(n)) + "]")
        return made

    rows = table(spark, d, "events").select("event_id", F.concat((F.col("event_id") % 5).cast("string"), F.lit("|"), "event_type").alias("t"))
    found = ing.answered_rows(ing.call(rows, "event_id", "t", answer, batch=1), "event_id", "answer", "kind string")
    return found.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("kind").alias("kind"))


@query("""WITH r AS (SELECT user_id, content, id, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS size FROM """ + NEWS + """)
    SELECT CASE WHEN size > 20 THEN user_id || '_batch' || (pos // 20 + 1) ELSE user_id::VARCHAR END AS story, count(*) AS n, string_agg(left(content, 100), ' | ' ORDER BY pos) FILTER (WHERE pos % 20 < 3) AS summary FROM r GROUP BY 1""")
def story_batches(spark, d):
    return ing.stories(news(spark, d), "user_id", "id", "content")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT user_id, n, CASE WHEN n > 20 THEN pos // 15 ELSE 0 END AS part, min_by(event_type, pos) AS t FROM r GROUP BY 1, 2, 3)
    SELECT user_id, n, count(*) AS chunks, string_agg(t, ' / ' ORDER BY part) AS summary FROM f GROUP BY 1, 2""")
def two_level_summaries(spark, d):
    return ing.two_level_summary(events(spark, d), "user_id", "event_id", "event_type")


@query('SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -event_id - 1 ELSE least(event_id % 7, event_id % 5) END AS "group" FROM events')
def completed_groups(spark, d):
    e = events(spark, d)
    some = e.where("event_id % 3 <> 0")
    groups = some.select((F.col("event_id") % 7).alias("group"), "event_id").unionByName(some.select((F.col("event_id") % 5).alias("group"), "event_id"))
    return ing.complete_groups(e, groups, "event_id")


# -- clusters -------------------------------------------------------------------------------------------------


_UNIT = r"""docs AS (SELECT doc_id, source, text FROM documents), w AS (SELECT doc_id, source, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM docs), tf AS (SELECT doc_id, source, w, count(*) AS tf FROM w GROUP BY ALL),
    idf AS (SELECT w, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), x AS (SELECT doc_id, source, w, tf * idf AS x FROM tf JOIN idf USING (w)), u AS (SELECT x.doc_id, source, w, x / n AS x FROM x JOIN (SELECT doc_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1) USING (doc_id)),
    s AS (SELECT source, w, sum(x) AS s FROM u GROUP BY 1, 2), z AS (SELECT source, count(DISTINCT doc_id) AS size FROM u GROUP BY 1), l AS (SELECT source, sqrt(sum(s * s)) AS length FROM s GROUP BY 1)"""


@query(rf"""WITH {_UNIT}, dots AS (SELECT u.doc_id, s.source AS c, sum(x * s) AS dot FROM u JOIN s USING (w) GROUP BY 1, 2), m AS (SELECT d.doc_id, d.source, z.source AS c, size, coalesce(dot, 0) AS dot FROM (SELECT DISTINCT doc_id, source FROM u) d CROSS JOIN z LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.c = z.source),
    ab AS (SELECT doc_id, source, max(CASE WHEN c = source AND size > 1 THEN (size - dot) / (size - 1) END) AS a, min(CASE WHEN c <> source THEN 1 - dot / size END) AS b FROM m GROUP BY 1, 2), sil AS (SELECT source, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY 1),
    inter AS (SELECT a.source, avg(c) AS inter FROM (SELECT a.source, b.source AS o, sum(a.s * b.s) / any_value(la.length) / any_value(lb.length) AS c FROM s a JOIN s b USING (w) JOIN l la ON la.source = a.source JOIN l lb ON lb.source = b.source WHERE a.source <> b.source GROUP BY 1, 2) a GROUP BY 1)
    SELECT source, size, round(length / size, 6) AS cohesion, round(silhouette, 6) AS silhouette, round(inter, 6) AS inter FROM z JOIN l USING (source) JOIN sil USING (source) JOIN inter USING (source)""")
def cluster_evaluation(spark, d):
    out = cl.evaluate(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")
    return out.select("source", "size", *[F.round(c, 6).alias(c) for c in ("cohesion", "silhouette", "inter")])


_THEME = "CASE id % 12 WHEN 0 THEN '产能扩张' WHEN 1 THEN '芯片短缺' WHEN 2 THEN '业绩发布' WHEN 4 THEN '政策影响' WHEN 5 THEN '价格波动' WHEN 6 THEN '技术突破' WHEN 7 THEN '市场变化' WHEN 8 THEN '新产品发布' WHEN 11 THEN '市场变化' END"
_FIRM = "CASE id % 12 WHEN 0 THEN '中芯科技公司' WHEN 2 THEN '华微电子' WHEN 3 THEN 'Apple Inc' WHEN 4 THEN '政府出台半导体' WHEN 6 THEN '与长江存储集团' END"


@query(f"""WITH n AS (SELECT *, {_THEME} AS theme, {_FIRM} AS firm FROM {NEWS}) SELECT id, coalesce(firm, '其他公司') AS company, coalesce(theme, '其他_' || event_type) AS theme, CASE WHEN firm IS NOT NULL THEN firm || '_' || coalesce(theme, '综合事件') WHEN theme IS NOT NULL THEN '行业_' || theme ELSE '其他_' || event_type END AS hybrid FROM n""")
def rule_clusters(spark, d):
    rows = news(spark, d)
    parts = [cl.rule_clusters(rows, "id", "content", "event_type", m).withColumnRenamed("cluster", m) for m in ("company", "theme", "hybrid")]
    return parts[0].join(parts[1], "id").join(parts[2], "id")


@query("""SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) * .5, 6) AS a, round((user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_pop(user_id) FROM events) * .5, 6) AS b, 0.0 AS c FROM events""")
def scaled_features(spark, d):
    out = cl.scaled(events(spark, d).withColumn("one", F.lit(1.0)), "event_id", ["value", "user_id", "one"], 0.5)
    return out.select("event_id", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("b"), F.col("v")[2].alias("c"))


@query("SELECT CASE WHEN user_id = 3 THEN 1 ELSE user_id END AS cluster, count(*) AS n FROM events GROUP BY 1")
def merged_clusters(spark, d):
    return cl.relabelled(events(spark, d).select(F.col("user_id").alias("cluster")), "cluster", 3, 1).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS cluster, 4 AS n, 4 AS distinct_rows FROM events GROUP BY 1 HAVING count(*) >= 4")
def cluster_samples(spark, d):
    picked = cl.sample_each(events(spark, d).select(F.col("event_type").alias("cluster"), "event_id"), "cluster", "event_id", 4)
    return picked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("distinct_rows"))


@query()
def best_number_of_clusters(spark, d):
    return cl.best_k(table(spark, d, "embeddings"), "vec_id", "embedding", 2, 6)


@query("""WITH c AS (SELECT user_id AS id, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id % 3 END AS cluster FROM (SELECT DISTINCT user_id FROM events)), o AS (SELECT a.id AS a, b.id AS b, ((a.id * b.id) % 8) / 8::DOUBLE AS j FROM c a JOIN c b ON a.id <> b.id),
    m AS (SELECT a, cluster, sum(j) / (SELECT count(*) FROM c x WHERE x.cluster = c.cluster) AS m FROM o JOIN c ON c.id = b WHERE cluster <> -1 AND a IN (SELECT id FROM c WHERE cluster = -1) GROUP BY 1, 2)
    SELECT id, CASE WHEN cluster <> -1 THEN cluster ELSE coalesce((SELECT cluster FROM m WHERE m.a = c.id AND m > .1 ORDER BY m DESC, cluster LIMIT 1), id) END AS cluster FROM c""")
def noise_reattached(spark, d):
    ids = events(spark, d).select(F.col("user_id").alias("id")).distinct()
    clusters = ids.withColumn("cluster", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 3))
    overlap = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") != F.col("b")).withColumn("jaccard", ((F.col("a") * F.col("b")) % 8).cast("double") / 8)
    return cl.reattach_noise(clusters, overlap, 0.1)


# -- states, filters, readers ----------------------------------------------------------------------------------


@query(f"SELECT id, CASE WHEN id % 10 = 0 THEN 'story-1' END AS story_id, CASE WHEN current_status = 'completed' THEN 'pending_clustering' ELSE current_status END AS current_status FROM {STATES}")
def story_assignment(spark, d):
    s = st.evolve_schema(states(spark, d), {"story_id": "string", "lang": "string"})
    s = st.update_where(s, F.col("id") % 10 == 0, {"story_id": F.lit("story-1")})
    return st.update_where(s, F.col("current_status") == "completed", {"current_status": F.lit("pending_clustering")}).select("id", "story_id", "current_status")


@query("""SELECT event_id, pattern, score FROM (SELECT event_id, 'p' || (event_id % 3) AS pattern, .5 AS score FROM events UNION ALL SELECT event_id, 'p1', .9 FROM events WHERE event_id % 3 <> 1) WHERE event_id % 10 > 0 AND score >= .4""")
def mappings_added_and_queried(spark, d):
    old = events(spark, d).select("event_id", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("pattern"), F.lit(0.5).alias("score"))
    all_ = pr.add_mappings(old, events(spark, d).select("event_id", F.lit("p1").alias("pattern"), F.lit(0.9).alias("score")), "event_id", "pattern")
    gone = events(spark, d).where("event_id % 10 = 0").select("event_id")
    return all_.join(gone, "event_id", "left_anti").where(rel.conjunction({"score": (">=", 0.4)})).select("event_id", "pattern", "score")


@query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2', 'Brand#3') AND p_size >= 10 AND p_size <= 40 AND (p_type LIKE '%A%' OR p_size % 2 = 0)""")
def pattern_filter(spark, d):
    parts = table(spark, d, "part").withColumn("kinds", F.array_compact(F.array(F.when(F.contains("p_type", F.lit("A")), "a"), F.when(F.col("p_size") % 2 == 0, "even"))))
    wanted = {"p_brand": ("in", ["Brand#11", "Brand#12", "Brand#1", "Brand#2", "Brand#3"]), "p_size": (">=", 10)}
    return parts.where(rel.conjunction(wanted) & rel.conjunction({"p_size": ("<=", 40), "kinds": ("overlaps", ["a", "even"])})).select("p_partkey")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events UNION ALL SELECT -event_id - 1, NULL FROM events WHERE event_id % 9 = 0")
def keyed_lookup(spark, d):
    e = events(spark, d)
    keys = e.select("event_id").unionByName(e.where("event_id % 9 = 0").select((-F.col("event_id") - 1).alias("event_id")))
    return readers.lookup(e.where("event_id % 2 = 0").select("event_id", F.col("event_type").alias("kind")), keys, "event_id")


@query("SELECT event_id FROM events WHERE event_id % 4 = 3")
def missing_keys(spark, d):
    e = events(spark, d).select("event_id")
    return readers.missing_keys(e.where("event_id % 4 <> 3"), e, "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 > 0 ORDER BY event_id LIMIT 50")
def bounded_lines(spark, d):
    good = F.to_json(F.struct("event_id", "event_type"))
    lines = events(spark, d).select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": 1, ')).otherwise(good).alias("value"))
    path = new_path(spark, "lines")
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return readers.first_lines(spark, path, "event_id long, event_type string", 50)


@query("SELECT c_custkey AS id, c_name AS name, 'csv' AS how FROM customer UNION ALL SELECT c_custkey, c_name, 'json' FROM customer UNION ALL SELECT c_custkey, c_name, 'appended' FROM customer UNION ALL SELECT c_custkey, c_name, 'appended' FROM customer")
def written_and_read(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    edges = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    csv, lines = new_path(spark, "csv"), new_path(spark, "json")
    sinks.csv_pair(nodes, edges, csv)
    sinks.json_lines(nodes, lines)
    sinks.json_lines(nodes, lines, "append")
    back = spark.read.schema("id long, name string").option("header", True).csv(f"{csv}_nodes").withColumn("how", F.lit("csv"))
    as_json = sinks.graph_json(nodes, edges).where("kind = 'node'").select(F.from_json("value", "id long, name string").alias("v")).select("v.*", F.lit("json").alias("how"))
    return back.unionByName(as_json).unionByName(spark.read.schema("id long, name string").json(lines).withColumn("how", F.lit("appended")))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 ELSE 2 END AS n, round((value / 400 + least(user_id / 10, 1) + .5 + .25) / 4, 9) AS confidence, 3 + event_id % 2 AS complexity, CASE event_id % 3 WHEN 0 THEN 0 ELSE 1 END AS alike FROM events""")
def decoded_entities(spark, d):
    text = F.element_at(F.array(F.lit("broken ["), F.lit('["a","b"]'), F.lit('["b","a"]')), (F.col("event_id") % 3 + 1).cast("int"))
    items = ne.parse_or_default(text, "array<string>", "[]")
    sequence = F.array(F.lit("x"), F.lit("y"))
    conditions = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("c"), F.lit("d")))
    return events(spark, d).select(
        "event_id", F.size(items).alias("n"), F.round(scores.mapping_confidence(F.col("value") / 400, F.col("user_id"), F.lit(0.5), F.lit(0.25)), 9).alias("confidence"), scores.complexity(sequence, conditions).alias("complexity"),
        F.round(tx.char_similarity(F.array_join(items, ""), F.lit("ab")), 9).cast("int").alias("alike"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '企业|公司|集团|有限公司|股份公司' WHEN 1 THEN 'x|合作|协作|联合|合伙|联盟' ELSE 'x' END AS words, CASE c_custkey % 2 WHEN 0 THEN 'acme corp' ELSE 'acme ltd x' END AS plain FROM customer""")
def expanded_words(spark, d):
    from fabula.operators.consistency import plain_name

    words = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("公司"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("x"), F.lit("联盟"))).otherwise(F.array(F.lit("x")))
    ordered = F.concat(F.filter(tx.expand_synonyms(words), lambda w: w == "x"), F.filter(tx.expand_synonyms(words), lambda w: w != "x"))
    groups = [["企业", "公司", "集团", "有限公司", "股份公司"], ["合作", "协作", "联合", "合伙", "联盟"]]
    place = F.array(*[F.lit(w) for g in groups for w in g])
    sorted_ = F.concat(F.filter(ordered, lambda w: w == "x"), F.filter(place, lambda w: F.array_contains(ordered, w)))
    name = F.when(F.col("c_custkey") % 2 == 0, "ACME, Corp. Ltd").otherwise("Acme Ltd  X Inc.")
    return table(spark, d, "customer").select("c_custkey", F.array_join(sorted_, "|").alias("words"), plain_name(name).alias("plain"))


@query(f"SELECT 'pending_extraction' AS step_status, 'extraction' AS step, (SELECT count(*) FROM {STATES} WHERE current_status = 'pending_extraction') >= 5 AS due")
def next_step(spark, d):
    s = states(spark, d)
    return spark.createDataFrame([("pending_extraction", mb.recommend(s), mb.due(s, "current_status", "pending_extraction", 5))], "step_status string, step string, due boolean")


@query(f"""WITH s AS {STATES} SELECT id, CASE WHEN id % 3 = 0 AND current_status = 'pending_triage' THEN 'pending_review' WHEN id % 3 = 1 AND current_status = 'pending_extraction' THEN 'pending_clustering' ELSE current_status END AS current_status,
    coalesce(id % 3 = 0 AND current_status = 'pending_triage' OR id % 3 = 1 AND current_status = 'pending_extraction', false) AS moved FROM s""")
def status_moves(spark, d):
    s = states(spark, d)
    wanted = s.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "pending_review").otherwise("pending_clustering").alias("to"))
    return mb.moves(s, wanted, "id", "current_status")


@query(f"""SELECT (SELECT count(*) FROM {STATES} WHERE current_status = 'pending_triage') AS rows_kept, 'one:done,two:done,three:ZeroDivisionError' AS log""")
def staged_run(spark, d):
    def fails(df):
        raise ZeroDivisionError

    kept, log = mb.run_stages(states(spark, d), [("one", lambda x: x.where("current_status = 'pending_triage'")), ("two", lambda x: x.select("id")), ("three", fails), ("four", lambda x: x.limit(0))])
    return kept.agg(F.count(F.lit(1)).alias("rows_kept")).withColumn("log", F.lit(",".join(f"{a}:{b}" for a, b in log)))


@query(f"""WITH u AS (SELECT src AS a, dst AS b FROM (SELECT DISTINCT user_id AS src, other AS dst FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS other FROM events) WHERE other <> user_id)) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM u""")
def largest_component(spark, d):
    edges = _peers(spark, d)
    return gr.largest_component(edges, gr.components(edges))


@query(f"""WITH f AS {FOLLOWS} SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0) AS valid, 0 AS errors, count(*) FILTER (WHERE relation_type = 'causal' AND gap_hours / 24 > 30) + count(*) FILTER (WHERE confidence < .3) AS warnings, round(avg(confidence), 6) AS mean_confidence FROM f""")
def validation_summary(spark, d):
    checked = dq.relation_checks(follows(spark, d), events(spark, d))
    return checked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") == 0).alias("valid"), F.sum(F.size("errors")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query("SELECT 'big' AS rule, 'error' AS severity, count(*) AS n FROM events WHERE value > 100 UNION ALL SELECT 'error type', 'warning', count(*) FROM events WHERE event_type = 'error'")
def rule_report(spark, d):
    return dq.report(dq.violations(events(spark, d), "event_id", [("big", "error", F.col("value") > 100), ("error type", "warning", F.col("event_type") == "error")]))


# -- streams and grouping sets ----------------------------------------------------------------------------------


def _late_stream(spark, d, files):
    """Events as parquet files of one table each, in that order of arrival."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "user_id", "value")
    path = new_path(spark, "late-in")
    for condition in files:
        rows.where(condition).coalesce(1).write.mode("append").parquet(path)
    return mb.file_stream(spark, path, spark.read.parquet(path), files=1)


#: The watermark that a batch drops late rows by is the one before the last batch, so a third batch brings them.
_ARRIVALS = ["ts >= '2024-01-10' AND ts < '2024-01-30'", "ts >= '2024-01-30'", "ts < '2024-01-10'"]


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events, m
    WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL HAVING time_bucket(INTERVAL 6 HOURS, any_value(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS <= any_value(mark)""")
def stream_late_rows(spark, d):
    """Rows that come after the watermark has passed them are left out; windows that it has not passed are not out yet."""
    out = mb.drain(mb.windowed_counts(_late_stream(spark, d, _ARRIVALS), "ts", "event_type", "value", late="1 day"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOURS * s AS window_start, event_type, value FROM events, unnest([0, 1]) AS r(s))
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM w, m WHERE window_start + INTERVAL 6 HOURS <= mark GROUP BY 1, 2""")
def stream_sliding_window(spark, d):
    out = mb.drain(mb.windowed_counts(_late_stream(spark, d, ["true"]), "ts", "event_type", "value", late="1 day", slide="3 hours"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_session_window(spark, d):
    out = mb.drain(mb.session_counts(_late_stream(spark, d, ["true"]), "ts", "user_id", "6 hours", late="1 day"))
    return out.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")


@query("SELECT event_type, user_id % 3 AS third, ts::DATE AS day, count(*) AS n, grouping_id(event_type, user_id % 3, ts::DATE) AS level FROM events GROUP BY CUBE (event_type, user_id % 3, ts::DATE)")
def cube_counts(spark, d):
    rows = events(spark, d).select("event_type", (F.col("user_id") % 3).alias("third"), F.to_date("ts").alias("day"))
    return rows.cube("event_type", "third", "day").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("event_type", "third", "day").alias("level"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def grouping_sets(spark, d):
    return events(spark, d).groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, '>' ORDER BY ts, event_id) AS path FROM events WHERE event_type = 'purchase' GROUP BY 1")
def temporal_path(spark, d):
    rows = events(spark, d).where("event_type = 'purchase'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("p"))
    return rows.select("user_id", F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ">").alias("path"))


@query("SELECT a.event_id AS source, b.event_id AS target, 'temporal_sequence' AS kind, .5 AS confidence, .4 AS strength FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) a JOIN events b ON b.event_id = a.n")
def fallback_chain(spark, d):
    from fabula.operators.sequences import consecutive_pairs

    pairs = consecutive_pairs(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_id"])
    return pairs.select(F.col("event_id").alias("source"), F.col("next_event_id").alias("target"), F.lit("temporal_sequence").alias("kind"), F.lit(0.5).alias("confidence"), F.lit(0.4).alias("strength"))


@query("""WITH k AS (SELECT DISTINCT event_type AS kind FROM events), same AS (SELECT event_type AS kind, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
    SELECT kind, event_id, 'same' AS tier FROM same WHERE r <= 200 UNION ALL SELECT 'view', event_id, 'related' FROM same WHERE kind IN ('click', 'purchase') AND r <= 50 AND (SELECT count(*) FROM same WHERE kind = 'view') < 5000""")
def candidate_tiers(spark, d):
    from fabula.operators import retrieval as rt

    related = spark.createDataFrame([("view", "click"), ("view", "purchase")], "kind string, other string")
    e = events(spark, d).select(F.col("event_type").alias("kind"), "event_id")
    return rt.candidate_tiers(e, e.select("kind").distinct(), related, "kind", "event_id", 200, 5000, 50)


@query("""SELECT kind, 'p' || p_partkey AS pattern FROM (SELECT unnest([p_brand, p_type]) AS kind, p_partkey FROM part)""")
def pattern_index(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pattern"), F.array("p_brand", "p_type").alias("sequence"))
    path = new_path(spark, "patterns")  # export, import, index
    sinks.json_lines(parts, path)
    again = spark.read.schema(parts.schema).json(path)
    return again.select(F.explode("sequence").alias("kind"), "pattern")


@query("SELECT o_custkey, o_orderkey, c_name AS customer, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_custkey, o_orderkey LIMIT 1000")
def default_graph(spark, d):
    nodes = table(spark, d, "customer").select("c_custkey", "c_name").unionByName(table(spark, d, "orders").select((F.col("o_orderkey") + 10**9).alias("c_custkey"), F.lit("order").alias("c_name")))
    edges = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") + 10**9).alias("target"))
    joined = readers.default_graph(spark, nodes, edges, "c_custkey", "o_custkey", "target")
    return joined.select("o_custkey", "o_orderkey", F.col("n.c_name").alias("customer"), "o_totalprice")


@query("""SELECT source_text_hash, min(doc_id) AS doc_id FROM (SELECT md5(text) AS source_text_hash, doc_id FROM documents) GROUP BY 1""")
def lifecycle_rows(spark, d):
    rows = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("source_text_hash"), "doc_id")
    return rel.first_wins(rows, [F.col("source_text_hash")], ["doc_id"]).select("source_text_hash", "doc_id")


@query("""SELECT 'status' AS rule, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0))""")
def table_constraints(spark, d):
    """A CHECK and a foreign key as rules: rows that break them are counted."""
    check = dq.violations(events(spark, d), "event_id", [("status", "error", ~F.col("event_type").isin("view", "click", "purchase", "signup"))]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, d, "customer").where("c_custkey % 5 > 0")
    foreign = dq.dangling(table(spark, d, "orders"), known, "o_custkey", "c_custkey").agg(F.lit("customer").alias("rule"), F.sum("n").alias("n"))
    return check.unionByName(foreign)


@query("SELECT event_id, rank, weight, row_number() OVER (ORDER BY rank DESC, weight DESC, event_id) AS place FROM (SELECT event_id, user_id AS rank, value AS weight FROM events) QUALIFY place <= 50")
def rank_and_weight(spark, d):
    top = events(spark, d).select("event_id", F.col("user_id").alias("rank"), F.col("value").alias("weight")).orderBy(F.desc("rank"), F.desc("weight"), "event_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), F.desc("weight"), "event_id")))
