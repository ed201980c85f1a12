"""Queries for retrieval composites, caches, exports and inferred relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import text as tx
from fabula.operators import relations as rl
from fabula.operators import retrieval as rt
from fabula.sources import sinks
from fabula.sources.scratch import new_path

from .binding import FOLLOWS, HEADLINES, NEWS, QUESTIONS, events, follows, news, table
from .registry import query

_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"
_NEAR = f"""q AS (SELECT vec_id AS query_id, v, n FROM {_UNIT} WHERE vec_id % 20 = 0), s AS (SELECT query_id, e.vec_id AS id, e.label, list_dot_product(q.v, e.v) / (q.n * e.n) AS similarity FROM q JOIN {_UNIT} e ON e.vec_id <> query_id)"""


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 20 = 0")


@query(f"""WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM s QUALIFY r <= 10), f AS {FOLLOWS}, e AS (SELECT source_event_id AS a, target_event_id AS b FROM f UNION ALL SELECT target_event_id, source_event_id FROM f),
    g AS (SELECT id, count(b) AS m, count(DISTINCT b) AS c FROM (SELECT DISTINCT id FROM k WHERE similarity >= .1) LEFT JOIN e ON a = id GROUP BY 1), z AS (SELECT id, .4 * least(m / 10, 1) + .4 * least(c / 20, 1) + .2 * (1 - .1) AS structure FROM g)
    SELECT query_id, id, round(.6 * similarity + .4 * structure, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY .6 * similarity + .4 * structure DESC, id) AS rank FROM k JOIN z USING (id) WHERE similarity >= .1""")
def hybrid_search(spark, d):
    f = follows(spark, d).select(F.col("source_event_id").alias("a"), F.col("target_event_id").alias("b"))
    both = f.unionByName(f.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = rt.hybrid_search(*_vectors(spark, d), both, "vec_id", "embedding", 10, 0.1)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, id) AS r FROM s QUALIFY r <= 3) SELECT DISTINCT query_id, 'doc ' || (id % 50) AS body FROM k""")
def collection_union(spark, d):
    v, asked = _vectors(spark, d)
    return rt.union_of_collections(v.withColumn("body", F.concat(F.lit("doc "), (F.col("vec_id") % 50).cast("string"))), asked, "vec_id", "embedding", "label", "body")


@query(f"""WITH u AS {_UNIT}, c AS (SELECT * FROM u WHERE vec_id % 2 = 0), s AS (SELECT u.vec_id AS id, c.vec_id AS other, list_dot_product(u.v, c.v) / (u.n * c.n) AS s FROM u JOIN c ON true WHERE u.vec_id % 3 > 0),
    b AS (SELECT id, other FROM s WHERE s >= .3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other DESC) = 1)
    SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'answer 0' ELSE 'answer ' || other END AS answer, CASE WHEN vec_id % 3 = 0 THEN 'exact' WHEN other IS NOT NULL THEN 'similar' ELSE 'none' END AS how FROM u LEFT JOIN b ON b.id = vec_id""")
def answer_cache(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("local").alias("mode"))
    cache = v.where("id % 2 = 0").withColumns({"query": F.when(F.col("id") == 0, "q0").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))), "answer": F.concat(F.lit("answer "), F.col("id").cast("string"))})
    asked = v.withColumn("query", F.when(F.col("id") % 3 == 0, "q0").otherwise(F.concat(F.lit("new"), F.col("id").cast("string"))))
    return rt.cached(asked, cache, "mode", "query", "embedding", "answer", 0.3)


@query("""WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS kinds FROM h GROUP BY 1)
    SELECT user_id, 'events: ' || count(*) || '; types: ' || any_value(kinds) || '; from ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS summary FROM events JOIN t USING (user_id) GROUP BY 1""")
def subgraph_summary(spark, d):
    return rt.subgraph_summary(events(spark, d), "user_id", "event_type", "ts")


def _asked(spark):
    """The questions, with intent and pairs of characters as their words."""
    rows = spark.createDataFrame(list(enumerate(QUESTIONS + HEADLINES[:3])), "query int, text string")
    return rows.select("query", "text", tx.intent(F.col("text"))["intent"].alias("intent"), F.array_distinct(tx.mixed_tokens(F.col("text"))).alias("words"))


_TOKENS = "list_distinct(list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+') || flatten(list_transform(regexp_extract_all({0}, '[一-鿿]+'), lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))), lambda x: length(x) > 1))"
_QUESTIONS = "(VALUES " + ", ".join(f"({i}, '{t}', '{k}')" for i, (t, k) in enumerate(zip(QUESTIONS + HEADLINES[:3], ["event_search", "causal_analysis", "temporal_analysis", "event_search", "event_search", "event_search", "general_qa", "general_qa", "event_search", "causal_analysis", "temporal_analysis"]))) + ") q(query, text, intent)"
_HITS = f"""h AS (SELECT query, intent, id, count(*) AS n FROM (SELECT query, intent, unnest({_TOKENS.format('text')}) AS w FROM {_QUESTIONS}) JOIN (SELECT id, unnest({_TOKENS.format('content')}) AS w FROM {NEWS}) USING (w) GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, id) AS r FROM h QUALIFY r <= 100)"""


@query(f"""WITH {_HITS}, f AS {FOLLOWS}, e AS (SELECT source_event_id AS a, target_event_id AS b FROM f UNION SELECT target_event_id, source_event_id FROM f)
    SELECT query, id, 'word' AS why FROM r UNION ALL SELECT DISTINCT query, b, 'relation' FROM r JOIN e ON a = id WHERE intent IN ('causal_analysis', 'relation_query') AND NOT EXISTS (SELECT 1 FROM r x WHERE x.query = r.query AND x.id = b)""")
def retrieval_routes(spark, d):
    docs = news(spark, d).select("id", tx.mixed_tokens(F.col("content")).alias("tokens"))
    edges = follows(spark, d).select(F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"))
    return rt.route(_asked(spark), docs, edges, "intent", "words")


@query(f"""WITH h AS (SELECT query, id, count(*) AS n FROM (SELECT query, unnest({_TOKENS.format('text')}) AS w FROM {_QUESTIONS}) JOIN (SELECT id, unnest({_TOKENS.format('content')}) AS w FROM {NEWS}) USING (w) GROUP BY 1, 2),
    r AS (SELECT *, least(1, .3 * n) AS rel, row_number() OVER (PARTITION BY query ORDER BY least(1, .3 * n) DESC, n DESC, id) AS rank FROM h QUALIFY rank <= 5),
    g AS (SELECT query, count(*) AS n, avg(rel) AS rel, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS sources FROM r GROUP BY 1)
    SELECT query, coalesce(sources, '') AS sources, round(CASE WHEN n IS NULL THEN 0 ELSE least(1, .3 * least(n / 10, 1) + .5 * rel) END, 6) AS quality, n IS NULL AS empty FROM {_QUESTIONS} LEFT JOIN g USING (query)""")
def question_answers(spark, d):
    asked = _asked(spark)
    docs = news(spark, d).select("id", "content", tx.mixed_tokens(F.col("content")).alias("tokens"))
    hits = rt.keyword_hits(docs, asked, "id", "content", "query", "words", 5, tokens="tokens")
    out = rt.answer(asked, hits, docs, "query", "words", "intent", "id", "content")
    return out.select("query", "sources", F.round("quality", 6).alias("quality"), F.startswith("answer", F.lit("No relevant")).alias("empty"))


@query("""WITH f AS (SELECT user_id, string_agg(l, chr(10) ORDER BY l) AS f FROM (SELECT DISTINCT user_id, '- ' || event_type AS l FROM events WHERE user_id % 3 > 0) GROUP BY 1), i AS (SELECT user_id, string_agg(l, chr(10) ORDER BY l) AS i FROM (SELECT DISTINCT user_id, '- k' || (event_id % 4) AS l FROM events WHERE user_id % 2 = 0) GROUP BY 1)
    SELECT user_id, concat_ws(chr(10), 'Facts from the graph:' || chr(10) || f, 'Similar texts:' || chr(10) || i) AS summary FROM f FULL JOIN i USING (user_id)""")
def context_summary(spark, d):
    e = events(spark, d)
    facts = e.where("user_id % 3 > 0").select("user_id", F.col("event_type").alias("line"))
    return rt.facts_and_insights(facts, e.where("user_id % 2 = 0").select("user_id", F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")).alias("line")), "user_id")


_TYPED = "(SELECT event_id, user_id, date_trunc('hour', ts) AS ts, CASE event_type WHEN 'view' THEN 'investment' WHEN 'click' THEN 'business_cooperation' WHEN 'error' THEN 'PRODUCT_LAUNCH' WHEN 'signup' THEN 'market_expansion' ELSE 'other' END AS kind FROM events)"


@query(f"""WITH e AS {_TYPED}, p AS (SELECT a.event_id AS s, b.event_id AS t, a.ts = b.ts AS tie, lower(a.kind) || '>' || lower(b.kind) AS k FROM e a JOIN e b USING (user_id) WHERE a.event_id <> b.event_id AND b.ts >= a.ts AND epoch(b.ts) - epoch(a.ts) <= 21600),
    c AS (SELECT *, CASE k WHEN 'investment>business_cooperation' THEN .7 WHEN 'product_launch>market_expansion' THEN .8 END AS c FROM p)
    SELECT s AS source, t AS target, CASE WHEN NOT tie THEN 'temporal_before' WHEN c IS NULL THEN 'correlation' ELSE 'causal' END AS relation, CASE WHEN NOT tie THEN .8 ELSE coalesce(c, .5) END AS confidence, round(CASE WHEN NOT tie THEN .6 ELSE coalesce(c * .8, .4) END, 9) AS strength FROM c""")
def inferred_relations(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "investment", "click", "business_cooperation", "error", "PRODUCT_LAUNCH", "signup", "market_expansion", "purchase", "other")]), F.col("event_type"))
    rows = events(spark, d).select("event_id", "user_id", F.date_trunc("hour", "ts").alias("ts"), kind.alias("kind"))
    return rl.infer(rows, ["user_id"], "event_id", "ts", "kind", 21_600).withColumn("strength", F.round("strength", 9))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'causal' WHEN 'click' THEN 'sequential' WHEN 'error' THEN 'conditional' ELSE 'associative' END AS kind, 'fallback_' || event_id AS id, left(repeat(event_type, 60), 200) AS description FROM events")
def pattern_kinds(spark, d):
    name = F.when(F.col("event_type") == "view", "A-Causal-B").when(F.col("event_type") == "click", "x-BEFORE-y").when(F.col("event_type") == "error", "conditional").otherwise("link")
    event = rl.fallback_event(F.repeat("event_type", F.lit(60)), F.col("event_id"))
    return events(spark, d).select("event_id", rl.pattern_kind(name).alias("kind"), event.alias("e")).select("event_id", "kind", "e.id", "e.description")


@query("""SELECT name, min(kind) AS kind, count(DISTINCT event_id || edge) AS edges FROM (SELECT event_id, 'u' || user_id AS name, 'ENTITY' AS kind, 'SUBJECT' AS edge FROM events UNION ALL SELECT event_id, event_type, 'ENTITY', 'OBJECT' FROM events WHERE event_id % 3 > 0
    UNION ALL SELECT event_id, unnest(['u' || (user_id + 1), 'p' || (event_id % 10)]), 'PERSON', 'PARTICIPANT' FROM events) GROUP BY 1""")
def event_graph_write(spark, d):
    u = lambda n: F.concat(F.lit("u"), (F.col("user_id") + n).cast("string"))
    rows = events(spark, d).select("event_id", u(0).alias("s"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("o"), F.array(u(1), F.concat(F.lit("p"), (F.col("event_id") % 10).cast("string"))).alias("p"))
    entities, edges = sinks.event_graph(rows, "event_id", "s", "o", "p")
    return entities.join(edges.groupBy("name").agg(F.count(F.lit(1)).alias("edges")), "name")


@query(f"SELECT 'gexf' AS kind, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'graphml', c_custkey, c_name FROM customer")
def graph_documents(spark, d):
    """Writes both documents, reads the files back and finds every node again."""
    nodes = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    edges = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("to"), "o_totalprice")
    a, b = new_path(spark, "gexf"), new_path(spark, "graphml")
    sinks.document(sinks.gexf_lines(nodes, edges, "c_custkey", "c_name", "o_custkey", "to"), a)
    sinks.document(sinks.graphml_lines(nodes, edges, "c_custkey", "o_custkey", "to"), b)
    number = lambda p: F.regexp_extract("value", p, 1)
    lines = lambda path: spark.read.text(path).where(F.startswith("value", F.lit("<node ")))
    one = lines(a).select(F.lit("gexf").alias("kind"), number('id="([0-9]+)"').cast("long").alias("id"), number('label="([^"]*)"').alias("label"))
    return one.unionByName(lines(b).select(F.lit("graphml").alias("kind"), number('id="([0-9]+)"').cast("long").alias("id"), number('<data key="c_name">([^<]*)<').alias("label")))


@query("""SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events QUALIFY rank <= 100""")
def recent_events(spark, d):
    top = events(spark, d).orderBy(F.desc("ts"), "event_id").limit(100)
    return top.select("event_id", "user_id", "event_type", F.row_number().over(Window.orderBy(F.desc("ts"), "event_id")).alias("rank"))


@query("""SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) <= 2""")
def entities_per_event(spark, d):
    from fabula.operators import relational as rel

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return rel.top_k(rows, ["l_orderkey"], ["l_suppkey"], 2).drop("rank")
