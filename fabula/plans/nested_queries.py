"""Queries for nested and broken inputs: answers of models, delimited records, maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import nested as ne
from fabula.functions import scores
from fabula.functions import text as tx

from .binding import NEWS, events, news, table
from .registry import query

_ANSWERS = [
    '{"k": %s, "z": [1, 2]}', 'Sure:\n```json\n{"k": %s}\n```\nDone.', 'I think {"k": %s} fits, or not.', 'Result: [%s, 2]', "well {k: %s, 'a': 'b',} ok",
    'Kind: Big deal\nIs new: true\nk: %s\nratio: 0.5', '{"k": %s, "cut', "no data here", "",
]


def _answer():
    """An answer for each event, by its id, with its number in it."""
    picked = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    return F.replace(picked, F.lit("%s"), F.col("event_id").cast("string"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"k": ' || event_id || ', "z": [1, 2]}' WHEN 1 THEN '{"k": ' || event_id || '}' WHEN 2 THEN '{"k": ' || event_id || '}' WHEN 3 THEN '[' || event_id || ', 2]' WHEN 4 THEN '{"k": ' || event_id || ', "a": "b"}'
    WHEN 5 THEN '{"kind":"Big deal","is_new":true,"k":' || event_id || ',"ratio":0.5}' END AS json, list_extract(['direct', 'fenced', 'braces', 'cleaned', 'mended', 'lines', 'failed', 'failed', 'failed'], event_id % 9 + 1) AS method,
    round(CASE event_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN .9 WHEN 3 THEN .5 WHEN 4 THEN .7 WHEN 5 THEN .6 ELSE 0 END, 9) AS confidence FROM events""")
def tolerant_json(spark, d):
    found = table(spark, d, "events").select("event_id", ne.tolerant_json(_answer()).alias("j"))
    fits = F.get_json_object("j.json", "$.k").isNotNull()
    return found.select("event_id", "j.json", "j.method", F.round(F.when(F.col("j.method") == "failed", 0.0).otherwise(ne.schema_adjusted(F.col("j.confidence"), fits)), 9).alias("confidence"))


@query("SELECT event_id, event_id % 9 = 6 AS obvious, event_id % 9 = 6 AS looks, list_extract(['object', 'object', 'object', 'none', 'none', 'none', 'none', 'none', 'none'], event_id % 9 + 1) AS body FROM events")
def incomplete_answers(spark, d):
    rows = table(spark, d, "events").withColumn("t", _answer())
    body = F.when(ne.json_body(F.col("t")).isNotNull(), "object").otherwise("none")
    return rows.select("event_id", ne.obviously_incomplete(F.col("t")).alias("obvious"), ne.looks_incomplete(F.col("t")).alias("looks"), body.alias("body"))


@query("""WITH r AS (SELECT event_id AS id, unnest([0, 1, 2, 3]) AS position, event_id AS e, event_type AS t FROM events)
    SELECT id, position, CASE position % 2 WHEN 0 THEN 'hyper-relation' ELSE 'entity' END AS kind, CASE position % 2 WHEN 0 THEN 'rel ' || (e + position) ELSE t || position END AS name, 'rel ' || (e + position - position % 2) AS relation FROM r""")
def delimited_records(spark, d):
    e, t = F.col("event_id").cast("string"), F.col("event_type")
    relation = lambda n: F.concat(F.lit('("hyper-relation"<|>"rel '), n, F.lit('"<|>7)##'))
    entity = lambda n: F.concat(F.lit('("entity"<|>"'), t, F.lit(f'{n}"<|>"thing"<|>"a, b")'))
    text = F.concat(relation(e), entity(1), F.lit("##"), relation((F.col("event_id") + 2).cast("string")), entity(3), F.lit("<|COMPLETE|>trailing"))
    out = ne.delimited_records(table(spark, d, "events").select("event_id", text.alias("t")), "event_id", "t")
    return out.select(F.col("event_id").alias("id"), "position", "kind", F.col("fields")[1].alias("name"), "relation")


@query("""SELECT event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'none') AS first, array_to_string(CASE WHEN event_id % 2 = 0 THEN [event_type, 'x', 'y'] ELSE ['x', 'y'] END, '|') AS everything, CASE WHEN event_id % 3 = 0 THEN '交易金额,发生时间' ELSE '发生时间' END AS noted,
    CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 2 THEN 'boolean' ELSE 'string' END AS kind FROM events""")
def maps_of_lists(spark, d):
    roles = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.array(F.lit("x"), F.lit("y")), F.lit("a"), F.array("event_type"))).otherwise(F.create_map(F.lit("b"), F.array(F.lit("x"), F.lit("y"))))
    details = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("发生时间"), F.lit("1"), F.lit("交易金额"), F.lit("2"), F.lit("z"), F.lit("3"))).otherwise(F.create_map(F.lit("发生时间"), F.lit("1"), F.lit("q"), F.lit("3")))
    value = F.element_at(F.array(*map(F.lit, ["-12", "0.5", "True", "1e"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), ne.get_or(roles, "a", F.array(F.lit("none")))[0].alias("first"), F.array_join(ne.flat_distinct(roles), "|").alias("everything"),
        F.array_join(F.array_sort(F.map_keys(ne.keys_like(details, ["时间", "金额", "地点"]))), ",").alias("noted"), ne.value_type(value).alias("kind"),
    )


@query("""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'e' || event_id WHEN 1 THEN 'n' || event_id ELSE md5('{"x": ' || event_id || '}') END AS key, CASE WHEN event_id % 3 = 2 THEN 'other' ELSE event_type END AS kind, CASE event_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'inner' ELSE '' END AS title, CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS people,
    CASE event_id % 4 WHEN 0 THEN 'causal' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE 'temporal' END AS relation, CASE event_id % 4 WHEN 0 THEN .2 WHEN 1 THEN .9 WHEN 3 THEN .5 END AS sure FROM events""")
def rows_from_json(spark, d):
    e, t = F.col("event_id").cast("string"), F.col("event_type")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"id": "e'), e, F.lit('", "event_type": "'), t, F.lit('", "title": "top", "participants": []}')))
    text = text.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"event_id": "n'), e, F.lit('", "event_data": {"event_type": "'), t, F.lit('", "title": "inner", "participants": ["a", "b"]}}'))).otherwise(F.concat(F.lit('{"x": '), e, F.lit("}")))
    answers = ["so: {'relation_type': '因果', 'confidence': 0.2}", '{"relation_type": "odd", "confidence": 0.9}', '{"relation_type": "odd", "confidence": 0.2}', '{"relation_type": "Temporal"}']
    answer = F.element_at(F.array(*map(F.lit, answers)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), ne.event_from_json(text).alias("j"), ne.relation_from_answer(answer).alias("r"))
    return rows.select("id", F.col("j.id").alias("key"), "j.kind", "j.title", F.size("j.participants").alias("people"), F.col("r.kind").alias("relation"), F.col("r.confidence").alias("sure"))


@query(f"""WITH s AS (SELECT id, event_type, ts, content, category, user_id, lead(id) OVER w AS o, lead(event_type) OVER w AS ot, lead(ts) OVER w AS ots, lead(content) OVER w AS oc, lead(category) OVER w AS og FROM {NEWS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
    p AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(content), ' +'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(oc), ' +'), lambda x: x <> '')) AS b FROM s WHERE o IS NOT NULL)
    SELECT id, o AS other, round(least(1, .3 * CASE WHEN event_type = ot THEN 1 ELSE .3 END + .25 * CASE WHEN event_type = ot THEN 1 ELSE 1 / 3 END + .2 * CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END
    + .1 * exp(-abs(floor((epoch_us(ots) - epoch_us(ts)) / 86400000000)) / 30) + .1 * CASE WHEN category = '' OR og = '' THEN .5 WHEN category = og THEN 1 ELSE 0 END + .05 * CASE WHEN id % 2 = o % 2 THEN 1 ELSE 0 END), 9) AS similarity FROM p""")
def event_similarity(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    rows = news(spark, d).withColumns({f"o_{c}": F.lead(c).over(w) for c in ("id", "event_type", "ts", "content", "category")}).where("o_id IS NOT NULL")
    people = lambda kind: F.array(kind, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    side = lambda key: F.create_map(F.lit("odd"), key % 2)
    score = scores.event_similarity(
        F.when(F.col("event_type") == F.col("o_event_type"), 1.0).otherwise(0.3), tx.set_jaccard(people(F.col("event_type")), people(F.col("o_event_type"))), tx.set_jaccard(tx.word_set(F.col("content")), tx.word_set(F.col("o_content"))),
        scores.time_similarity(F.col("ts"), F.col("o_ts")), scores.place_similarity(F.col("category"), F.col("o_category")), scores.attribute_similarity(side(F.col("id")), side(F.col("o_id"))),
    )
    return rows.select("id", F.col("o_id").alias("other"), F.round(score, 9).alias("similarity"))
