"""Queries for injected models, validators, caches, near-copy filters and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import text as tx
from fabula.operators import clustering as cl
from fabula.operators import consistency as co
from fabula.operators import ingestion as ing
from fabula.operators import mining as mn
from fabula.operators import nearby as nb
from fabula.operators import relations as rl
from fabula.operators import retrieval as rt
from fabula.operators import sequences as seq
from fabula.operators import state as st
from fabula.operators import vectors as ve
from fabula.sources import readers, sinks
from fabula.sources.scratch import materialize, new_path
from fabula.streaming import micro_batch as mb

from .binding import EVENTS, FOLLOWS, NEWS, STATES, events, follows, news, states, table
from .registry import query
from .retrieval_queries import _NEAR, _vectors


# -- models that come in as functions --------------------------------------------------------------------------


@query(f"SELECT id, upper(content) || '!' AS answer FROM {NEWS}")
def model_called_once(spark, d):
    return ing.called_once(news(spark, d), "id", "content", lambda texts: [t.upper() + "!" for t in texts])


@query(f"SELECT id, CASE WHEN content = '' THEN 0 ELSE length(content) END::DOUBLE AS a, CASE WHEN content = '' THEN 0 ELSE 1 END::DOUBLE AS b FROM {NEWS}")
def embedded_texts(spark, d):
    out = ing.embed(news(spark, d), "id", "content", lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    return out.select("id", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


@query("SELECT event_id % 2 AS side, event_id % 3 AS third, count(*) AS n FROM events GROUP BY 1, 2")
def dealt_models(spark, d):
    """The same row always goes to the same model: counts of pairs of calls agree with counts of rows."""
    rows = events(spark, d).select((F.col("event_id") % 2).alias("side"), (F.col("event_id") % 3).alias("third"), ing.model_for(F.col("event_id"), ["a", "b", "c"]).alias("m"), ing.model_for(F.col("event_id"), ["a", "b", "c"]).alias("again"))
    return rows.where("m = again AND m IN ('a', 'b', 'c')").groupBy("side", "third").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, unnest(CASE WHEN event_type IN ('view', 'click') THEN ['k', 'name'] ELSE ['k'] END) AS field, unnest(CASE WHEN event_type IN ('view', 'click') THEN ['int', 'string'] ELSE ['int'] END) AS type, 1.0 AS share, true AS required FROM events GROUP BY 1""")
def learnt_schemas(spark, d):
    text = F.when(F.col("event_type").isin("view", "click"), '{"k": 3, "name": "x"}').when(F.col("event_id") < 0, '{"rare": 1}').otherwise('{"k": 7}')
    return ing.learn_schema(events(spark, d).withColumn("j", text), "event_type", "j")


@query("""SELECT upper(event_type) AS name, 'thing' AS type, 'about ' || event_type AS description, count(DISTINCT 'rel ' || (event_id % 5)) AS relations, count(*) AS weight FROM events GROUP BY 1, 3""")
def model_extracted_graph(spark, d):
    def answer(texts):
        return ['("hyper-relation"<|>"rel %s"<|>7)##("entity"<|>"%s"<|>"thing"<|>"about %s")<|COMPLETE|>' % (t.split("|")[0], t.split("|")[1], t.split("|")[1]) for t in texts]

    rows = events(spark, d).select("event_id", F.concat((F.col("event_id") % 5).cast("string"), F.lit("|"), "event_type").alias("t"))
    entities, edges = ing.extracted_graph(materialize(ing.call(rows, "event_id", "t", answer), "answers"), "event_id", "answer")
    sums = edges.groupBy("name").agg(F.count(F.lit(1)).alias("relations"), F.sum("weight").alias("weight"))
    return entities.join(sums, "name").select("name", "type", "description", "relations", "weight")


# -- vectors joined with what they stand for --------------------------------------------------------------------


@query(f"""WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM s QUALIFY r <= 5) SELECT query_id, p_partkey, p_brand, round(similarity, 6) AS similarity FROM k JOIN part ON p_partkey = id""")
def semantic_pattern_search(spark, d):
    found = ve.knn(*_vectors(spark, d), "vec_id", "embedding", 5)
    return found.join(table(spark, d, "part"), F.col("id") == F.col("p_partkey")).select("query_id", "p_partkey", "p_brand", F.round("similarity", 6).alias("similarity"))


@query("""WITH v AS (SELECT event_id, [(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), (user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_pop(user_id) FROM events)] AS v FROM events)
    SELECT a.event_id AS a, b.event_id AS b FROM v a JOIN v b ON a.event_id < b.event_id AND power(a.v[1] - b.v[1], 2) + power(a.v[2] - b.v[2], 2) <= .0004""")
def near_features(spark, d):
    points = cl.scaled(events(spark, d), "event_id", ["value", "user_id"])
    return nb.within_distance(points, "event_id", "v", 0.02)


@query()
def feature_clusters(spark, d):
    """Density clusters of events by their scaled features."""
    points = materialize(cl.scaled(events(spark, d), "event_id", ["value", "user_id"]), "points")
    return cl.density(points, "event_id", "v", 0.05, 3)


# -- near copies one by one ---------------------------------------------------------------------------------------


@query()
def first_unlike_texts(spark, d):
    """Part descriptions in order, each dropped that is like one that stayed."""
    text = F.concat(F.lit("item "), F.lpad((F.col("p_partkey") * 7919 % 100000).cast("string"), 5, "0"), F.when(F.col("p_partkey") % 5 == 0, " of the winter range").otherwise(F.repeat(F.chr(97 + F.col("p_partkey") % 23), F.lit(20))))
    return nb.first_unlike(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t", 0.6)


# -- validators, files, caches --------------------------------------------------------------------------------------


@query("""SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 5 = 0) AS blank, count(*) FILTER (WHERE event_id % 5 = 1) AS broken, count(*) FILTER (WHERE event_id % 5 = 2) AS lacking, count(*) FILTER (WHERE event_id % 5 > 2) AS good FROM events""")
def checked_lines(spark, d):
    m = F.col("event_id") % 5
    line = F.when(m == 0, " ").when(m == 1, '{"id": 1,').when(m == 2, '{"id": 1}').otherwise('{"id": 2, "kind": "x"}')
    path = new_path(spark, "lines")
    events(spark, d).select(line.alias("value")).write.text(path)
    return readers.checked_lines(spark, path, ["id", "kind"])


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 6 = 0) AS ragged FROM events")
def checked_sheet(spark, d):
    line = F.when(F.col("event_id") % 6 == 0, "1,2").when(F.col("event_id") % 6 == 1, '"a, ""b""",2,3').otherwise("1,2,3")
    path = new_path(spark, "sheet")
    events(spark, d).select(line.alias("value")).write.text(path)
    return readers.checked_sheet(spark, path, ["a", "b", "c"])


@query("SELECT (SELECT count(*) FROM customer) AS nodes, 0 AS repeated, count(*) AS edges, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS loose FROM orders")
def checked_graph(spark, d):
    nodes = table(spark, d, "customer").select("c_custkey", "c_name")
    edges = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(F.col("o_custkey")).alias("to"))
    path = new_path(spark, "graph")
    sinks.document(sinks.gexf_lines(nodes, edges, "c_custkey", "c_name", "o_custkey", "to"), path)
    return readers.checked_graph(spark, path)


@query("SELECT 5 AS k, true AS latest, 5 AS reports")
def newest_report(spark, d):
    path = new_path(spark, "reports")
    for k in range(1, 6):
        spark.range(1).select(F.lit(k).alias("k")).coalesce(1).write.mode("append").json(path)
    found = readers.latest_report(spark, path, "k int")
    return found.where("latest").select("k", "latest").withColumn("reports", F.lit(found.count()))


@query("""SELECT 'c' || event_id AS key FROM events WHERE event_id % 100 <= 60 ORDER BY event_id % 37, 'c' || event_id LIMIT 40""")
def cache_entries(spark, d):
    cache = events(spark, d).select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("key"), (F.col("event_id") % 100).alias("age"), (F.col("event_id") % 37).alias("used"))
    return ing.kept_entries(cache, "age", "used", 60, 40).select("key")


@query("SELECT md5(lower(c_name) || '_' || c_mktsegment) AS key, c_custkey % 2 = 0 AS cached FROM customer")
def linking_cache(spark, d):
    key = F.md5(F.concat_ws("_", F.lower("c_name"), "c_mktsegment").cast("binary")).alias("key")
    rows = table(spark, d, "customer").select("c_custkey", key)
    known = rows.where("c_custkey % 2 = 0").select("key", F.lit(True).alias("cached"))
    return readers.lookup(known, rows.select("key"), "key").fillna(False, ["cached"])


@query("SELECT (SELECT count(*) FROM events) AS good, -1 AS bad, (SELECT count(*) FROM events) AS read_again")
def dual_write(spark, d):
    path = new_path(spark, "store")

    def broken(df):
        raise OSError("no such store")

    done = sinks.write_both(events(spark, d), {"good": lambda df: df.write.parquet(path), "bad": broken}, "event_id")
    again = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("read_again"))
    return again.select(F.lit(done["good"]).alias("good"), F.lit(done["bad"]).alias("bad"), "read_again")


# -- the smaller rows -------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, user_id FROM events")
def serialised_events(spark, d):
    """To JSON as it is exported, and back."""
    rows = events(spark, d).select(F.to_json(F.struct("event_id", F.struct("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at")).alias("data"), F.array("user_id").alias("entities"))).alias("j"))
    back = rows.select(F.from_json("j", "event_id long, data struct<event_type: string, at: string>, entities array<long>").alias("v"))
    return back.select("v.event_id", "v.data.event_type", "v.data.at", F.col("v.entities")[0].alias("user_id"))


@query("SELECT DISTINCT o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_name LIKE '%7' OR l_suppkey = 3")
def events_of_entity(spark, d):
    o = table(spark, d, "orders")
    ends = o.join(table(spark, d, "customer").where("c_name LIKE '%7'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    ends = ends.unionByName(table(spark, d, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))).distinct()
    return o.join(ends, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT label::VARCHAR AS grp, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'NaN'::DOUBLE ELSE user_id::DOUBLE END AS label FROM events) WHERE label IS NOT NULL AND NOT isnan(label) GROUP BY 1")
def labelled_groups(spark, d):
    label = F.when(F.col("event_id") % 4 == 1, float("nan")).when(F.col("event_id") % 4 > 1, F.col("user_id").cast("double"))
    rows = events(spark, d).select(label.alias("label")).where(F.col("label").isNotNull() & ~F.isnan("label"))
    return rows.groupBy(F.col("label").cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN o_custkey END) AS urgent, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM orders")
def distinct_when(spark, d):
    return table(spark, d, "orders").agg(F.count_distinct(F.when(F.startswith("o_orderpriority", F.lit("1")), F.col("o_custkey"))).alias("urgent"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS temporal FROM events GROUP BY 1")
def type_frequency(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("view", "click")).alias("temporal"))


@query("SELECT DISTINCT user_id % 9 - 1 AS cluster FROM events WHERE user_id % 9 - 1 <> -1")
def cluster_ids(spark, d):
    return events(spark, d).select((F.col("user_id") % 9 - 1).alias("cluster")).where("cluster <> -1").distinct().orderBy("cluster")


@query("SELECT cluster, doc, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT user_id % 4 AS cluster, user_id AS doc, event_type AS kind FROM events WHERE user_id % 4 = 2) GROUP BY 1, 2")
def cluster_drill_down(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 4).alias("cluster"), F.col("user_id").alias("doc"), F.col("event_type").alias("kind")).where("cluster = 2")
    return rows.groupBy("cluster", "doc").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("SELECT md5(event_id::VARCHAR) AS id, content AS source_text, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'pending_clustering' END AS current_status FROM (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'x' END AS content FROM events)")
def seeded_states(spark, d):
    rows = events(spark, d).withColumn("content", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("x"))
    return rows.select(F.md5(F.col("event_id").cast("string").cast("binary")).alias("id"), F.col("content").alias("source_text"), F.when(F.col("event_type") == "purchase", "completed").otherwise("pending_clustering").alias("current_status"))


@query(f"SELECT n.event_type AS kind, f.relation_type AS relation, m.event_type AS other, count(*) AS n FROM {FOLLOWS} f JOIN events n ON n.event_id = source_event_id JOIN events m ON m.event_id = target_event_id WHERE f.confidence >= .5 GROUP BY 1, 2, 3")
def graph_sql(spark, d):
    """SQL with arguments over the property graph's views."""
    views = {"nodes": events(spark, d).select("event_id", "event_type"), "edges": follows(spark, d)}
    text = """SELECT n.event_type AS kind, relation_type AS relation, m.event_type AS other, count(*) AS n FROM edges JOIN nodes n ON n.event_id = source_event_id
        JOIN nodes m ON m.event_id = target_event_id WHERE confidence >= :least GROUP BY 1, 2, 3"""
    return readers.sql(spark, text, views, least=0.5)


# -- whole runs ----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT event_type || '>' || b AS name FROM e WHERE b IS NOT NULL UNION ALL SELECT event_type || '>' || b || '>' || c FROM e WHERE c IS NOT NULL), t AS (SELECT name, count(*) AS support FROM g GROUP BY 1 HAVING count(*) >= 2),
    h AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT a.event_type || '+' || b.event_type AS name, count(*) AS support FROM h a JOIN h b USING (user_id) WHERE a.event_type < b.event_type GROUP BY 1)
    SELECT 'sequence' AS kind, name, support FROM t UNION ALL SELECT 'together', name, support FROM p""")
def extracted_patterns(spark, d):
    """All miners over one table, each pattern once."""
    e = events(spark, d)
    sequences = seq.mine_sequences(e, ["user_id"], ["ts", "event_id"], "event_type", lengths=(2, 3)).select(F.lit("sequence").alias("kind"), F.col("gram").alias("name"), F.col("frequency").alias("support"))
    together = mn.type_combinations(e, "user_id", "event_type", 2).select(F.lit("together").alias("kind"), F.col("combo").alias("name"), F.col("together").alias("support"))
    return sequences.unionByName(together).distinct()


@query("""WITH c AS (SELECT user_id % 6 AS cluster, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT cluster, sum(n) AS size, max(n) AS top, count(*) AS kinds FROM c GROUP BY 1)
    SELECT cluster, size, round(top / size, 9) AS confidence, round(size / (SELECT count(*) FROM events), 9) AS support, round(.6 * least(size / 20, 1) + .4 * least(kinds / 5, 1), 9) AS general FROM s WHERE size / (SELECT count(*) FROM events) >= .1""")
def abstracted_patterns(spark, d):
    """Clusters become patterns where their support reaches a tenth."""
    from fabula.functions import scores

    rows = events(spark, d).withColumn("cluster", F.col("user_id") % 6)
    n = rows.count()
    kinds = rows.groupBy("cluster", "event_type").agg(F.count(F.lit(1)).alias("n"))
    sums = kinds.groupBy("cluster").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.count(F.lit(1)).alias("kinds"))
    out = sums.select("cluster", "size", F.round(F.col("top") / F.col("size"), 9).alias("confidence"), F.round(F.col("size") / n, 9).alias("support"), F.round(scores.generality(F.col("size"), F.col("kinds")), 9).alias("general"))
    return out.where(F.col("support") >= 0.1)


@query("""SELECT user_id, 'k' AS attribute, count(*) FILTER (WHERE event_id % 3 = 0) AS passed, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) >= .3 * count(*) AS consistent FROM events GROUP BY 1""")
def attribute_validation(spark, d):
    rows = events(spark, d).select("user_id", F.when(F.col("event_id") % 3 == 0, "12").when(F.col("event_id") % 3 == 1, "x").otherwise("-5").alias("k"), "event_id")
    bad = co.typed_rows(rows, "event_id", {"k": ("int", True, F.col("k").try_cast("int") >= 0)})
    checked = rows.join(bad.select(F.col("id").alias("event_id"), "problem"), "event_id", "left")
    out = checked.groupBy("user_id").agg(F.count_if(F.col("problem").isNull()).alias("passed"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.lit("k").alias("attribute"), "passed", "n", (F.col("passed") >= 0.3 * F.col("n")).alias("consistent"))


@query(f"""WITH s AS {STATES}, c AS (SELECT id, 'c' || (id % 7) AS cluster FROM s WHERE current_status = 'completed'), n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY cluster) AS size FROM c)
    SELECT s.id, CASE WHEN n.id IS NULL THEN NULL WHEN size > 20 THEN cluster || '_batch' || (pos // 20 + 1) ELSE cluster END AS story_id, CASE WHEN n.id IS NULL THEN current_status ELSE 'pending_relationship' END AS current_status FROM s LEFT JOIN n ON n.id = s.id""")
def cluster_story_state(spark, d):
    """A run from clusters to stories to states: stages over one table, each written before the next."""
    from pyspark.sql import Window

    def to_clusters(df):
        return df.withColumn("cluster", F.when(F.col("current_status") == "completed", F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))))

    def to_stories(df):
        w = Window.partitionBy("cluster")
        pos, size = F.row_number().over(w.orderBy("id")) - 1, F.count(F.lit(1)).over(w)
        rows = df.where("cluster IS NOT NULL").withColumns({"pos": pos, "size": size})
        name = F.when(F.col("size") > 20, F.concat("cluster", F.lit("_batch"), (F.floor(F.col("pos") / 20) + 1).cast("string"))).otherwise(F.col("cluster"))
        changes = rows.select("id", name.alias("story_id"), F.lit("pending_relationship").alias("current_status"))
        return st.update(st.evolve_schema(df, {"story_id": "string"}), changes, "id", ["story_id", "current_status"])

    done, _ = mb.run_stages(states(spark, d).select("id", "current_status"), [("clusters", to_clusters), ("stories", to_stories)])
    return done.select("id", "story_id", "current_status")


@query(f"""SELECT story, kind, confidence FROM (SELECT user_id AS story, CASE WHEN user_id % 2 = 0 THEN 'causal' ELSE 'correlation' END AS kind, CASE WHEN user_id % 2 = 0 THEN .9 ELSE .5 END AS confidence FROM (SELECT DISTINCT user_id FROM events))""")
def story_relations(spark, d):
    """An injected relation model, asked once for each story with its events in order."""
    from fabula.functions import nested as ne

    def answer(texts):
        return ["so {'relation_type': '%s'%s}" % (("因果", ", 'confidence': 0.9") if int(t.split("|")[0]) % 2 == 0 else ("相关", "")) for t in texts]

    texts = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("e"))
    asked = texts.select("user_id", F.concat_ws("|", F.col("user_id").cast("string"), F.array_join(F.transform(F.slice("e", 1, 5), lambda x: x["event_type"]), ",")).alias("t"))
    told = ing.call(asked, "user_id", "t", answer).select("user_id", ne.relation_from_answer(F.col("answer")).alias("r"))
    return told.select(F.col("user_id").alias("story"), "r.kind", "r.confidence")


@query(f"SELECT count(*) AS n, 3 AS tries FROM events")
def retried_work(spark, d):
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("not yet")
        return events(spark, d)

    return ing.with_retries(work, 3, 0.01).agg(F.count(F.lit(1)).alias("n")).withColumn("tries", F.lit(len(tries)))


# -- schemas, sheets, stores, one entry to all ------------------------------------------------------------------------------


_GOOD = '{"source": "s", "publish_date": "2024-01-01", "company": "c", "executive_name": "n", "position": "p", "change_type": "上任", "change_date": "2024-02-02"}'


@query("""SELECT event_id AS id, unnest(CASE event_id % 6 WHEN 1 THEN ['change_date', 'change_type'] WHEN 2 THEN [''] WHEN 3 THEN [''] WHEN 4 THEN ['confidence_score', 'arguments', 'publish_date'] WHEN 5 THEN ['partners'] END) AS field,
    unnest(CASE event_id % 6 WHEN 1 THEN ['missing', 'pattern'] WHEN 2 THEN ['unknown kind'] WHEN 3 THEN ['broken'] WHEN 4 THEN ['range', 'type', 'type'] WHEN 5 THEN ['type'] END) AS problem FROM events WHERE event_id % 6 > 0""")
def registered_schemas(spark, d):
    from fabula.sources import schemas

    texts = [_GOOD, _GOOD.replace("上任", "升职").replace(', "change_date": "2024-02-02"', ""), "{}", '{"source": ', '{"source": "s", "publish_date": "soon", "event_id": "e", "event_type": "t", "arguments": "none", "timestamp": "2024-01-01", "confidence_score": 1.5}', '{"source": "s", "publish_date": "2024-01-01", "partners": "a and b", "domain": "d"}']
    kinds = ["Executive_Change", "executive_change", "weather", "legal_proceeding", "domain_event", "collaboration"]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = events(spark, d).select("event_id", pick(kinds).alias("kind"), pick(texts).alias("j"))
    return schemas.violations(rows, "event_id", "kind", "j")


@query("SELECT 'book' || b || '.xlsx' AS file, r AS row, 'text ' || b || ' ' || r AS value FROM unnest([1, 2]) AS x(b), unnest([1, 2, 3]) AS y(r)")
def spreadsheet_column(spark, d):
    """Two small sheets, written cell by cell, and one without the column."""
    import io
    import zipfile

    path, jvm = new_path(spark, "sheets"), spark.sparkContext._jvm
    for book in (1, 2, 3):
        head = "text" if book < 3 else "other"
        rows = [("no", head), *[(str(r), f"text {book} {r}") for r in (1, 2, 3)]]
        cell = lambda at, column, text: f'<c r="{column}{at}" t="inlineStr"><is><t>{text}</t></is></c>'
        sheet = "".join(f'<row r="{at}">{cell(at, "A", a)}{cell(at, "B", b)}</row>' for at, (a, b) in enumerate(rows, 1))
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/book{book}.xlsx")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(made.getvalue()))
        out.close()
    return readers.spreadsheet_column(spark, path, "text")


@query("SELECT (SELECT count(*) FROM events) AS kept, 0 AS left_over, (SELECT count(*) FROM events) AS in_backup")
def reset_with_backup(spark, d):
    path, backup = new_path(spark, "table"), new_path(spark, "backup")
    events(spark, d).select("event_id", "event_type").write.parquet(path)
    kept = sinks.reset(spark, path, backup, "event_id long, event_type string")
    n = lambda p: spark.read.schema("event_id long, event_type string").parquet(p).count()
    return spark.createDataFrame([(kept, n(path), n(backup))], "kept long, left_over long, in_backup long")


@query("SELECT event_type, count(*) AS n, 2 AS samples FROM events GROUP BY 1 HAVING count(*) >= 2")
def exported_report(spark, d):
    """A report and its samples written, read back and put side by side."""
    prefix = new_path(spark, "report")
    e = events(spark, d)
    samples = cl.sample_each(e.select("event_type", "event_id"), "event_type", "event_id", 2)
    sinks.report(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), samples, prefix)
    told = spark.read.schema("event_type string, n long").json(f"{prefix}_report")
    back = spark.read.schema("event_type string, event_id long, rank int").option("header", True).csv(f"{prefix}_samples")
    return told.join(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples")), "event_type")


@query("SELECT 'ctx_' || event_id AS id, event_type AS kind, 'he_' || event_id AS edge, 'u' || user_id AS node FROM events")
def written_contexts(spark, d):
    path = new_path(spark, "contexts")
    edge = F.struct(F.concat(F.lit("he_"), F.col("event_id").cast("string")).alias("id"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("nodes"))
    sinks.contexts(events(spark, d).select(F.concat(F.lit("ctx_"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), edge.alias("hyperedge")), path)
    back = spark.read.schema("id string, kind string, hyperedge struct<id: string, nodes: array<string>>").json(path)
    return back.select("id", "kind", F.col("hyperedge.id").alias("edge"), F.col("hyperedge.nodes")[0].alias("node"))


@query(f"""WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM s QUALIFY r <= 10) SELECT query_id, event_id, event_type, round(similarity, 6) AS similarity FROM k JOIN events ON event_id = id WHERE similarity >= .2""")
def semantic_event_search(spark, d):
    from fabula.layers import Layers

    e = events(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = Layers(e, e.limit(0), vectors).similar_events(vectors.where("id % 20 = 0").select("id"), 10, 0.2)
    return found.join(e, F.col("id") == F.col("event_id")).select("query_id", "event_id", "event_type", F.round("similarity", 6).alias("similarity"))


@query("""WITH m AS (SELECT event_id, least(5, count(*)) AS c FROM events, nation WHERE event_type = 'view' AND .4 + .3 * least(n_nationkey / 10, 1) + .3 * .9 >= .8 GROUP BY 1)
    SELECT 'events' AS what, count(*) AS n FROM (SELECT * FROM events WHERE event_type = 'view' AND value >= 50 ORDER BY event_id LIMIT 100) UNION ALL SELECT 'patterns', count(*) FROM nation WHERE n_nationkey >= 5
    UNION ALL SELECT 'chains', count(DISTINCT user_id) FROM events UNION ALL SELECT 'comprehensive', sum(c)::BIGINT FROM m""")
def layer_requests(spark, d):
    """The same requests through the one entry; each answer is counted."""
    from fabula.layers import Layers

    patterns = table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("pattern"), F.array(F.lit("view")).alias("sequence"), F.col("n_nationkey").alias("support"), F.lit(0.9).alias("confidence"))
    layers = Layers(events(spark, d), patterns)
    parts = {
        "events": layers.process("retrieval", conditions={"event_type": ("=", "view"), "value": (">=", 50)}), "patterns": layers.query_patterns({"support": (">=", 5)}),
        "chains": layers.chains(), "comprehensive": layers.process("comprehensive").select(F.explode(F.array_repeat(F.lit(1), F.col("events").cast("int")))),
    }
    rows = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": 1}' WHEN 1 THEN '["a", "b"]' WHEN 2 THEN '["new plant","price up"]' END AS json, 'type: ' || event_type || CASE WHEN event_id % 2 = 0 THEN '; sequence: a > b' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '; conditions: x, y' ELSE '' END AS text FROM events""")
def answers_and_pattern_texts(spark, d):
    from fabula.functions import nested as ne

    answer = F.element_at(F.array(*map(F.lit, ['```json\n{"k": 1}\n```', "['a', 'b']", "Summary: [new plant, price up]", "nothing"])), (F.col("event_id") % 4 + 1).cast("int"))
    none = F.array().cast("array<string>")
    sequence = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    conditions = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("y"), F.lit("x"))).otherwise(none)
    return events(spark, d).select("event_id", ne.json_or_list(answer).alias("json"), tx.pattern_text(F.col("event_type"), sequence, F.lit(""), conditions).alias("text"))


@query("""WITH l AS (SELECT c_nationkey, c_custkey, c_custkey || ',' || CASE WHEN c_custkey % 2 = 0 THEN '"a,b"' ELSE c_mktsegment END AS line FROM customer), r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM l)
    SELECT c_nationkey, 'c_custkey,segment' || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey) AS context FROM r WHERE r <= 60 GROUP BY 1""")
def csv_contexts(spark, d):
    rows = table(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, "a,b").otherwise(F.col("c_mktsegment")))
    return rt.csv_context(rows, "c_nationkey", "c_custkey", ["c_custkey", "segment"], 60)


_COMBINED = """(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"""


@query(f"""WITH e AS {_COMBINED}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s, CASE WHEN a.label = b.label THEN 1 ELSE 1 / 3 END AS j FROM e a JOIN e b ON a.vec_id < b.vec_id) SELECT a, b FROM p WHERE .7 * (1 - s) + .3 * (1 - j) <= .55""")
def combined_distance_pairs(spark, d):
    rows = table(spark, d, "embeddings").withColumn("items", F.array(F.col("label").cast("string"), F.lit("common")))
    return cl.combined_neighbours(rows, "vec_id", "embedding", "items", 0.55)


@query()
def combined_distance_clusters(spark, d):
    rows = table(spark, d, "embeddings").withColumn("items", F.array(F.col("label").cast("string"), F.lit("common")))
    near = materialize(cl.combined_neighbours(rows, "vec_id", "embedding", "items", 0.5), "combined")
    return cl.dbscan(near, rows.select(F.col("vec_id").alias("id")), 2)


@query("""SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN 's' || e.user_id END AS subject, CASE WHEN e.event_id % 3 = 0 THEN 'o' || e.user_id END AS object, CASE WHEN e.event_id % 5 > 0 THEN (CASE e.event_id % 5 WHEN 1 THEN 'p0' WHEN 2 THEN 'p0,p1' WHEN 3 THEN 'p0,p1,p2' ELSE 'p0,p1,p2,p3' END) END AS participants FROM events e""")
def event_star(spark, d):
    """Events with their subject, object and participants: three left outer joins, one row for each event."""
    e = events(spark, d)
    side = lambda n, prefix, name: e.where(F.col("event_id") % n == 0).select("event_id", F.concat(F.lit(prefix), F.col("user_id").cast("string")).alias(name))
    people = e.select("event_id", F.explode(F.sequence(F.lit(1), F.greatest(F.col("event_id") % 5, F.lit(1)))).alias("i"), (F.col("event_id") % 5 > 0).alias("any")).where("any")
    people = people.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("p"), (F.col("i") - 1).cast("string")))), ",").alias("participants"))
    return e.select("event_id").join(side(2, "s", "subject"), "event_id", "left").join(side(3, "o", "object"), "event_id", "left").join(people, "event_id", "left")


@query(f"SELECT source_event_id, target_event_id FROM {FOLLOWS} WHERE source_event_id % 4 > 0 AND target_event_id % 4 > 0")
def relations_with_both_ends(spark, d):
    """Only relations go in whose ends are both there."""
    from fabula.operators import graph as gr

    there = events(spark, d).where("event_id % 4 > 0").select(F.col("event_id").alias("id"))
    return gr.induced(follows(spark, d), there, "source_event_id", "target_event_id").select("source_event_id", "target_event_id")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(2 * 5 / 17.0, 9) ELSE round(2 * 3 / 7.0, 9) END AS ratio, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 1.0 END AS partial, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(2 * 5 / 17.0, 9) ELSE round(2 * 3 / 7.0, 9) END AS sorted_words, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE round(2 * 3 / 7.0, 9) END AS word_sets FROM events""")
def name_ratios(spark, d):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 3 + 1).cast("int"))
    rows = events(spark, d).select("event_id", pick(["same", "acme", "abc"]).alias("a"), pick(["same", "acme of london", "abcd"]).alias("b"))
    rows = rows.withColumns({"a": F.when(F.col("a") == "acme", "alpha").otherwise(F.col("a")), "b": F.when(F.col("a") == "acme", "of alpha ltd").otherwise(F.col("b"))})
    return nb.name_ratios(rows, "event_id", "a", "b").select("event_id", *[F.round(c, 9).alias(c) for c in ("ratio", "partial", "sorted_words", "word_sets")])
