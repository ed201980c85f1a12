"""Queries over events: filters, buckets, trends, sequences, look-ahead."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.operators import aggregates as agg
from fabula.operators import sequences as seq

from .binding import EVENTS, FOLLOWS, STATES, events, follows, order_events, states, table
from .registry import query


@query(f"SELECT current_status, count(*) AS n FROM {STATES} GROUP BY 1")
def status_histogram(spark, d):
    return states(spark, d).groupBy("current_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, source_text FROM {STATES} WHERE current_status = 'pending_review'")
def status_scan(spark, d):
    return states(spark, d).where("current_status = 'pending_review'").select("id", "source_text")


def _frequency_sql(key: str) -> str:
    return f"SELECT {key} AS bucket, count(*) AS n FROM events GROUP BY 1"


@query(_frequency_sql("strftime(ts, '%Y-%m-%d')"))
def event_freq_day(spark, d):
    return agg.frequency(events(spark, d), "ts", "day")


@query(_frequency_sql("year(ts) || '-W' || weekofyear(ts)"))
def event_freq_week(spark, d):
    return agg.frequency(events(spark, d), "ts", "week")


@query(_frequency_sql("strftime(ts, '%Y-%m')"))
def event_freq_month(spark, d):
    return agg.frequency(events(spark, d), "ts", "month")


@query("""SELECT event_type, n_events, n_participants, n_participants / n_events AS avg_participants, months
    FROM (SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_participants FROM events GROUP BY 1)
    JOIN (SELECT event_type, string_agg(m || ':' || n, ',' ORDER BY m) AS months
          FROM (SELECT event_type, strftime(ts, '%Y-%m') AS m, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1) USING (event_type)""")
def agg_by_type(spark, d):
    return agg.by_type(events(spark, d), "event_type", "user_id", "ts")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS entity_id FROM lineitem),
    p AS (SELECT a.entity_id, b.entity_id AS o, count(*) AS shared FROM m a JOIN m b ON a.e = b.e AND a.entity_id <> b.entity_id GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY shared DESC, o) AS r FROM p)
    SELECT c.entity_id, n_events, top_co FROM (SELECT entity_id, count(*) AS n_events FROM m GROUP BY 1) c
    LEFT JOIN (SELECT entity_id, string_agg(o, ',' ORDER BY r) AS top_co FROM t WHERE r <= 5 GROUP BY 1) USING (entity_id)""")
def agg_by_participant_top5(spark, d):
    return agg.co_participants(order_events(spark, d), "event_id", "entity_id")


@query("""WITH c AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS b, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b DESC) AS pos FROM c),
    s AS (SELECT event_type, count(*) AS n_buckets, coalesce(sum(n) FILTER (pos <= 3), 0) AS recent, coalesce(sum(n) FILTER (pos > 3), 0) AS earlier FROM r GROUP BY 1)
    SELECT *, recent / nullif(earlier, 0) AS ratio, CASE WHEN n_buckets < 2 THEN 'insufficient_data' WHEN earlier = 0 THEN 'new_activity'
      WHEN recent / earlier > 1.2 THEN 'increasing' WHEN recent / earlier < 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def event_trend(spark, d):
    return agg.trend(events(spark, d), ["event_type"], agg.bucket_key(F.col("ts"), "day"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts IS NOT NULL AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def timeline(spark, d):
    buyers = events(spark, d).where("event_type = 'purchase' AND value > 95").select("user_id").distinct()
    wanted = events(spark, d).join(buyers, "user_id", "left_semi").select("event_id")
    return seq.timeline(events(spark, d), "ts", wanted).select("event_id", "ts", "event_type")


@query("SELECT event_id, event_type, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08 12:00:00'")
def time_range_filter(spark, d):
    inside = F.col("ts").between(F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-08 12:00:00")))
    return events(spark, d).where(inside).select("event_id", "event_type", "ts")


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10'
    AND user_id IN (1, 2, 3, 5, 8, 13) AND value >= 10 ORDER BY ts DESC, event_id LIMIT 100""")
def conjunctive_filter(spark, d):
    from fabula.operators.relational import conjunction

    wanted = {"event_type": ("=", "purchase"), "ts": (">=", F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))), "user_id": ("in", [1, 2, 3, 5, 8, 13]), "value": (">=", 10)}
    return events(spark, d).where(conjunction(wanted)).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "value")


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id LIMIT 10")
def latest_by_type(spark, d):
    return events(spark, d).where("event_type = 'signup'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "ts", "value")


@query("""SELECT a.event_id AS event_id, b.event_type AS next_type, count(*) AS n FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'purchase' GROUP BY ALL""")
def events_after_window(spark, d):
    rows = events(spark, d)
    focus = rows.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("t0"))
    later = rows.select("user_id", F.col("event_type").alias("next_type"), "ts")
    near = seq.range_join(focus, later, ["user_id"], "t0", "ts", 86_400)
    return near.groupBy("event_id", "next_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    rules(event_type, next_event_type) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('signup', 'purchase'), ('error', 'view'))
    SELECT a.event_id, b.event_id AS next_event_id, a.event_type, b.event_type AS next_event_type, b.p - a.p AS step
    FROM r a JOIN r b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 3
    JOIN rules ON rules.event_type = a.event_type AND rules.next_event_type = b.event_type""")
def lookahead_pairs(spark, d):
    pairs = seq.lookahead_pairs(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])
    rules = F.struct("event_type", "next_event_type").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in (("view", "click"), ("click", "purchase"), ("signup", "purchase"), ("error", "view"))])
    return pairs.where(rules).select("event_id", "next_event_id", "event_type", "next_event_type", "step")


@query("""WITH g AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s FROM events),
    m AS (SELECT *, avg(gap_s) OVER (PARTITION BY user_id) AS mean_gap_s, count(*) OVER (PARTITION BY user_id) AS n FROM g)
    SELECT event_id, user_id, gap_s, round(mean_gap_s, 4) AS mean_gap_s FROM m WHERE n > 2 AND gap_s > 2 * mean_gap_s""")
def chain_gap_anomaly(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    found = seq.gap_anomalies(events(spark, d), ["user_id"], ["ts", "event_id"], seconds)
    return found.select("event_id", "user_id", "gap_s", F.round("mean_gap_s", 4).alias("mean_gap_s"))


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(ts) AS n_events,
    CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days FROM events GROUP BY 1""")
def temporal_span(spark, d):
    return seq.temporal_span(events(spark, d), ["user_id"], "ts")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    g AS (SELECT 2 AS length, a.event_type || '>' || b.event_type AS gram FROM r a JOIN r b ON b.user_id = a.user_id AND b.p = a.p + 1
     UNION ALL SELECT 3, a.event_type || '>' || b.event_type || '>' || c.event_type FROM r a JOIN r b ON b.user_id = a.user_id AND b.p = a.p + 1 JOIN r c ON c.user_id = a.user_id AND c.p = a.p + 2),
    n AS (SELECT length, gram, count(*) AS frequency FROM g GROUP BY ALL)
    SELECT length, gram, frequency, round(support, 9) AS support FROM (SELECT *, frequency / sum(frequency) OVER (PARTITION BY length) AS support FROM n) WHERE frequency >= 2""")
def ngram_sequences(spark, d):
    found = seq.mine_sequences(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", lengths=(2, 3))
    return found.select("length", "gram", "frequency", F.round("support", 9).alias("support"))


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events), a AS (SELECT DISTINCT event_type AS x FROM events),
    c AS (SELECT p.x AS a, q.x AS b FROM a p JOIN a q ON p.x < q.x)
    SELECT a || '+' || b AS combo, (SELECT count(*) FROM events WHERE event_type IN (a, b)) AS member_rows,
      (SELECT count(*) FROM (SELECT user_id FROM t WHERE event_type IN (a, b) GROUP BY 1 HAVING count(*) = 2)) AS together FROM c""")
def cooccurrence_combos(spark, d):
    from fabula.operators.mining import type_combinations

    return type_combinations(events(spark, d), "user_id", "event_type", 2)


@query("""WITH p AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events),
    c AS (SELECT event_type, next_type, count(*) AS n FROM p WHERE next_type IS NOT NULL GROUP BY ALL)
    SELECT event_type, next_type, n, round(n / sum(n) OVER (PARTITION BY event_type), 9) AS probability FROM c""")
def next_type_distribution(spark, d):
    pairs = seq.consecutive_pairs(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type"])
    counts = pairs.groupBy("event_type", F.col("next_event_type").alias("next_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 9))


@query("""WITH c AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
    SELECT * FROM c WHERE n = (SELECT max(n) FROM c x WHERE x.event_type = c.event_type)""")
def peak_hours(spark, d):
    return agg.peak_hours(events(spark, d), ["event_type"], "ts")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, max(value) FILTER (r = n // 2 + 1) AS upper_median FROM r GROUP BY 1""")
def upper_median_stats(spark, d):
    return agg.upper_median(events(spark, d), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query(f"""SELECT relation_type, CASE WHEN confidence >= .8 THEN 'high' WHEN confidence >= .5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n
    FROM {FOLLOWS} GROUP BY ALL""")
def confidence_buckets(spark, d):
    rel = follows(spark, d)
    return rel.groupBy("relation_type", agg.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT count(*) AS n, sum((trim(coalesce(text, '')) = '')::INT) AS t, sum((l.quality IS NULL)::INT) AS q, sum((trim(coalesce(source, '')) = '')::INT) AS s
      FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'text' AS field, t AS missing, round(100 * t / n, 2) AS missing_pct FROM n UNION ALL SELECT 'quality', q, round(100 * q / n, 2) FROM n
    UNION ALL SELECT 'source', s, round(100 * s / n, 2) FROM n""")
def field_missing_profile(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return agg.field_missing(rows, ["text", "quality", "source"])


@query("""SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS older,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-20') / greatest(count(*) FILTER (ts < TIMESTAMP '2024-01-20'), 1) AS growth FROM events GROUP BY 1""")
def pattern_growth(spark, d):
    return agg.growth(events(spark, d), ["event_type"], F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))


@query("""SELECT user_id, event_id, session, count(*) OVER (PARTITION BY user_id, session) AS in_session FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
    SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600 THEN 0 ELSE 1 END AS fresh FROM events))""")
def user_sessions(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = seq.sessions(events(spark, d), ["user_id"], ["ts", "event_id"], seconds, 21_600)
    return rows.select("user_id", "event_id", "session", F.count(F.lit(1)).over(Window.partitionBy("user_id", "session")).alias("in_session"))


@query("""SELECT e.event_id, e.ts, p.event_id AS asof_purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e
    LEFT JOIN LATERAL (SELECT event_id FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts
    ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) p ON true""")
def asof_last_purchase(spark, d):
    rows = events(spark, d)
    errors = rows.where("event_type = 'error'").select("user_id", "event_id", "ts")
    bought = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return seq.asof_join(errors, bought, ["user_id"], "ts", ["purchase_id"]).select("event_id", "ts", "asof_purchase_id")


@query("""SELECT window_start, event_type, n, v FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL)""")
def tumbling_window(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "v")


@query("""SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS w FROM events) GROUP BY 1""")
def sliding_window(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id, -1) AS user_id, count(*) AS n, round(sum(value), 4) AS v
    FROM events GROUP BY ROLLUP (event_type, user_id)""")
def rollup_type_user(spark, d):
    out = events(spark, d).rollup("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("user_id", F.lit(-1)).cast("long").alias("user_id"), "n", "v")
