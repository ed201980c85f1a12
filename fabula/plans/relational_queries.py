"""Queries over documents, states and orders: joins, sets, top-k, state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.operators import aggregates as agg
from fabula.operators import relational as rel
from fabula.operators import state as st

from .binding import EVENTS, FOLLOWS, STATES, events, follows, order_events, states, table
from .registry import query


@query(f"SELECT id, source FROM {STATES} WHERE current_status = 'completed' ORDER BY id DESC LIMIT 20 OFFSET 20")
def paginate_states(spark, d):
    return rel.page(states(spark, d).where("current_status = 'completed'"), [F.desc("id")], 2, 20).select("id", "source")


@query("SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topk_events_per_type(spark, d):
    return rel.top_k(events(spark, d), ["event_type"], [F.desc("value"), "event_id"], 5).select("event_type", "event_id", "value", "rank")


@query("""SELECT source, doc_id, n_chars, running::BIGINT AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 12000""")
def token_budget_prefix(spark, d):
    return rel.budget_prefix(table(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", 12_000).select("source", "doc_id", "n_chars", "running")


@query("SELECT min(doc_id) AS doc_id, md5(trim(text)) AS hash FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY 2")
def hash_dedup(spark, d):
    docs = table(spark, d, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.md5(F.trim("text").cast("binary")).alias("hash"))
    return rel.first_wins(docs, [F.col("hash")], ["doc_id"])


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1")
def first_wins_dedup(spark, d):
    return rel.first_wins(events(spark, d), [F.col("user_id")], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query("""SELECT signature, unnest(min({'user_id': user_id, 'day': day})) FROM (SELECT user_id, ts::DATE AS day, string_agg(DISTINCT event_type, '_' ORDER BY event_type) AS signature FROM events GROUP BY 1, 2) GROUP BY 1""")
def signature_dedup(spark, d):
    types = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "_").alias("signature"))
    return rel.first_wins(types, [F.col("signature")], ["user_id", "day"])


@query("""SELECT s.id, s.source FROM (SELECT * FROM """ + STATES + """ WHERE current_status = 'completed') s WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.id AND l.quality = 1 AND l.doc_id % 3 > 0)""")
def anti_join_orphans(spark, d):
    done = table(spark, d, "labels").where("quality = 1 AND doc_id % 3 > 0").select(F.col("doc_id").alias("id"))
    return rel.orphans(states(spark, d).where("current_status = 'completed'"), done, "id").select("id", "source")


@query("""SELECT doc_id AS id, 'graph' AS source FROM labels UNION ALL SELECT doc_id, 'vector' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def union_prefer_left(spark, d):
    left = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return rel.prefer_left(left, table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


@query("""SELECT coalesce(a.id, b.id) AS id, round(.6 * coalesce(v, 0) + .4 * coalesce(g, 0), 9) AS score FROM
    (SELECT vec_id AS id, abs(embedding[1]::DOUBLE) AS v FROM embeddings WHERE label >= 3) a FULL JOIN (SELECT doc_id AS id, least(n_chars, 5000) / 5000 AS g FROM documents WHERE lang = 'en') b ON a.id = b.id""")
def hybrid_fusion(spark, d):
    v = table(spark, d, "embeddings").where("label >= 3").select(F.col("vec_id").alias("id"), F.abs(F.col("embedding")[0].cast("double")).alias("v"))
    g = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("g"))
    return rel.fuse_scores(v, g, "id", "v", "g").select("id", F.round("score", 9).alias("score"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y ON x.i = y.i AND x.k < y.k GROUP BY ALL)
    SELECT a, b, round(c / (x.n + y.n - c), 9) AS jaccard FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c >= .75 * (x.n + y.n - c)""")
def set_jaccard_pairs(spark, d):
    lines = table(spark, d, "lineitem")
    sets = lines.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return rel.set_jaccard(sets, "l_orderkey", "items", 0.75).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("""WITH u AS (SELECT source, lang, 0 AS p FROM documents WHERE n_chars > 2000 UNION ALL SELECT source, lang, 1 FROM documents), g AS (SELECT source, lang, min(p) AS p FROM u GROUP BY ALL)
    SELECT source, lang, p AS part, row_number() OVER (PARTITION BY p ORDER BY source, lang) AS position FROM g""")
def context_union_renumber(spark, d):
    docs = table(spark, d, "documents")
    out = rel.renumbered_union([docs.where("n_chars > 2000"), docs], ["source", "lang"])
    return out.select("source", "lang", F.col("__part").alias("part"), "position")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def intersect_except(spark, d):
    of = lambda c: events(spark, d).where(c).select("user_id")
    return of("event_type = 'click'").intersect(of("event_type = 'purchase'")).subtract(of("event_type = 'error' AND value > 90"))


@query("""WITH r AS (SELECT p_brand AS b, p_type AS t FROM part), c AS (SELECT t AS term, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT b, count(*) FROM r GROUP BY 1),
    k AS (SELECT term, sum(n) AS n FROM c GROUP BY 1 HAVING sum(n) >= 2)
    SELECT x.term AS short_term, y.term AS long_term, (x.n + y.n)::BIGINT AS n FROM k x JOIN k y ON x.term <> y.term AND contains(y.term, x.term) WHERE length(y.term) <= 64 ORDER BY n DESC, short_term, long_term LIMIT 20""")
def substring_self_join(spark, d):
    part = table(spark, d, "part")
    return rel.contained_terms(part.select(F.explode(F.array("p_type", "p_brand")).alias("term")), "term", "term")


@query(f"SELECT * FROM (SELECT source_event_id AS event_id, target_event_id AS other, relation_type FROM {FOLLOWS} UNION ALL SELECT target_event_id, source_event_id, relation_type FROM {FOLLOWS})")
def undirected_relations(spark, d):
    r = follows(spark, d)
    ends = F.array(F.struct(F.col("source_event_id").alias("event_id"), F.col("target_event_id").alias("other")), F.struct(F.col("target_event_id").alias("event_id"), F.col("source_event_id").alias("other")))
    return r.select(F.explode(ends).alias("e"), "relation_type").select("e.event_id", "e.other", "relation_type")


@query("""SELECT o_custkey, string_agg(o_orderstatus, '<SEP>' ORDER BY o_orderkey) AS statuses, count(*) AS n FROM orders GROUP BY 1""")
def listagg_per_customer(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("fabula_orders")
    return spark.sql("SELECT o_custkey, listagg(o_orderstatus, '<SEP>') WITHIN GROUP (ORDER BY o_orderkey) AS statuses, count(*) AS n FROM fabula_orders GROUP BY 1")


@query("""WITH e AS (SELECT l_suppkey AS k, l_quantity AS w, l_returnflag || '<SEP>' || l_linestatus AS s FROM lineitem)
    SELECT k AS entity_id, w AS weight, string_agg(DISTINCT x, '<SEP>' ORDER BY x) AS source_id FROM (SELECT k, sum(w) AS w FROM e GROUP BY 1) JOIN (SELECT k, unnest(string_split(s, '<SEP>')) AS x FROM e) USING (k) GROUP BY ALL""")
def hyperedge_merge(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_quantity").alias("weight"), F.concat_ws("<SEP>", "l_returnflag", "l_linestatus").alias("source_id"))
    return agg.hyperedge_merge(e, "entity_id", "weight", "source_id")


@query("""WITH e AS (SELECT c_nationkey AS k, c_mktsegment AS kind, round(c_acctbal / 1000)::INT::VARCHAR AS d, (c_custkey % 7)::VARCHAR AS s FROM customer), m AS (SELECT k, kind, count(*) AS n FROM e GROUP BY ALL)
    SELECT k AS nation, arg_min(kind, (-n, kind)) AS kind, (SELECT string_agg(DISTINCT d, '<SEP>' ORDER BY d) FROM e WHERE e.k = m.k) AS description, (SELECT string_agg(DISTINCT s, '<SEP>' ORDER BY s) FROM e WHERE e.k = m.k) AS source FROM m GROUP BY k""")
def entity_mode_merge(spark, d):
    e = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"),
        F.round(F.col("c_acctbal") / 1000).cast("int").cast("string").alias("description"), (F.col("c_custkey") % 7).cast("string").alias("source"),
    )
    return agg.mode_merge(e, ["nation"], "kind", "description", "source")


_BASE = "(SELECT doc_id AS id, source, 'completed' AS current_status FROM documents WHERE n_chars > 1500)"
_NEW = "(SELECT doc_id AS id, lang AS source, 'pending_clustering' AS current_status FROM documents WHERE lang <> 'en')"


def _base(spark, d):
    return table(spark, d, "documents").where("n_chars > 1500").select(F.col("doc_id").alias("id"), "source", F.lit("completed").alias("current_status"))


def _new(spark, d):
    return table(spark, d, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("id"), F.col("lang").alias("source"), F.lit("pending_clustering").alias("current_status"))


@query(f"SELECT * FROM {_BASE} UNION ALL SELECT * FROM {_NEW} WHERE id NOT IN (SELECT id FROM {_BASE})")
def upsert_ignore(spark, d):
    return st.insert_ignore(_base(spark, d), _new(spark, d), "id")


@query(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_BASE} WHERE id NOT IN (SELECT id FROM {_NEW})")
def upsert_replace(spark, d):
    return st.upsert(_base(spark, d), _new(spark, d), "id")


@query(f"SELECT b.id, coalesce(n.source, b.source) AS source, coalesce(n.current_status, b.current_status) AS current_status FROM {_BASE} b LEFT JOIN {_NEW} n USING (id)")
def update_join(spark, d):
    return st.update(_base(spark, d), _new(spark, d), "id", ["source", "current_status"])


@query(f"SELECT id, CASE WHEN id IN (SELECT id FROM {STATES} WHERE current_status = 'completed' ORDER BY id LIMIT 25) THEN 'pending_clustering' ELSE current_status END AS current_status FROM {STATES}")
def promote_first(spark, d):
    return st.promote(states(spark, d).select("id", "current_status"), "id", "current_status", "completed", "pending_clustering", 25)


@query(f"""WITH s AS (SELECT id, current_status, lang FROM {STATES}), r AS (SELECT *, CASE id % 3 WHEN 0 THEN ' Known ' WHEN 1 THEN 'known' ELSE 'unknown' END AS h FROM s WHERE current_status = 'pending_review')
    SELECT s.id, CASE WHEN r.id IS NULL THEN s.current_status WHEN lower(trim(h)) = 'known' AND r.lang IN ('en', 'de') THEN 'pending_extraction' ELSE 'pending_learning' END AS current_status,
     CASE WHEN lower(trim(h)) = 'known' AND r.lang IN ('en', 'de') THEN r.lang END AS assigned_event_type, CASE WHEN lower(trim(h)) = 'known' AND r.lang NOT IN ('en', 'de') THEN 'unregistered type' END AS notes FROM s LEFT JOIN r ON r.id = s.id""")
def review_decisions(spark, d):
    state = states(spark, d).select("id", "current_status", F.lit(None).cast("string").alias("assigned_event_type"), F.lit(None).cast("string").alias("notes"))
    said = F.when(F.col("id") % 3 == 0, " Known ").when(F.col("id") % 3 == 1, "known").otherwise("unknown")
    decisions = states(spark, d).where("current_status = 'pending_review'").select("id", said.alias("human_decision"), F.col("lang").alias("human_event_type"))
    return st.review(state, decisions, "id", ["en", "de"])


@query("""SELECT 'node' AS kind, s_suppkey AS a, s_nationkey::BIGINT AS b FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT 'edge', a, b FROM (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) WHERE a <> 3 AND b <> 3""")
def cascade_delete(spark, d):
    m = order_events(spark, d)
    e = m.join(m.select("event_id", F.col("entity_id").alias("b")), "event_id").where("entity_id < b").select(F.col("entity_id").alias("a"), "b").distinct()
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    n, e = st.delete_entity(nodes, e, F.lit(3), "a", "a", "b")
    return n.select(F.lit("node").alias("kind"), "a", "b").unionByName(e.select(F.lit("edge").alias("kind"), "a", "b"))


@query(f"SELECT e.event_id, count(f.source_event_id) AS n_following, round(coalesce(avg(f.confidence), 0), 9) AS mean_confidence FROM {EVENTS} e LEFT JOIN {FOLLOWS} f ON f.source_event_id = e.event_id GROUP BY 1")
def events_with_relations(spark, d):
    r = follows(spark, d).groupBy(F.col("source_event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n_following"), F.avg("confidence").alias("c"))
    out = events(spark, d).join(r, "event_id", "left")
    return out.select("event_id", F.coalesce("n_following", F.lit(0)).alias("n_following"), F.round(F.coalesce("c", F.lit(0.0)), 9).alias("mean_confidence"))


@query(r"""WITH b AS (SELECT item_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS t FROM benchmark), d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS x FROM documents)
    SELECT doc_id, item_id FROM d JOIN b ON contains(x, t) WHERE len(string_split(trim(t), ' ')) >= 6""")
def chunk_lookup_join(spark, d):
    """Documents that hold a whole benchmark passage as a run of words."""
    return rel.contained_passages(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", 6)
