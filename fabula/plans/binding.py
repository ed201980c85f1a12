"""The given tables as events, states, entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, ts, user_id, value, k (from the JSON properties)."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", "value", k)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_text, current_status, source, lang: documents with a status from their labels."""
    status = (
        F.when(F.col("l.doc_id").isNull(), "pending_triage")
        .when(F.col("toxic") == 1, "pending_review")
        .when(F.col("quality") == 1, "completed")
        .otherwise("pending_extraction")
    )
    docs, labels = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    joined = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return joined.select(F.col("d.doc_id").alias("id"), F.col("text").alias("source_text"), status.alias("current_status"), "source", "lang")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events with their participants: one row for each (order, supplier)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    return lines


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_event_id, target_event_id, relation_type, confidence: consecutive events of a user."""
    from fabula.operators.sequences import consecutive_pairs

    pairs = consecutive_pairs(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "ts"])
    gap = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3600e6)
    kind = F.when(F.col("event_type") == F.col("next_event_type"), "correlation").when(gap <= 24, "causal").otherwise("temporal_sequence")
    return pairs.select(
        F.col("event_id").alias("source_event_id"), F.col("next_event_id").alias("target_event_id"), kind.alias("relation_type"),
        F.round(1 / (1 + gap / 24), 6).alias("confidence"), F.round(gap, 6).alias("gap_hours"),
    )


#: Short news and questions in two scripts: input data for the text functions, one for each event by its id.
HEADLINES = [
    "中芯科技公司宣布扩产，产能增长15%，投资20.5亿美元，2023年投产", "缺芯危机导致供应链风险，订单下降8.5%，比2022年少3%", "华微电子（600360）发布业绩，净利润增长，市场改善", "Apple Inc and Foxconn Technology announce cooperation in Shanghai",
    "政府出台半导体补贴政策，行业监管加强", "由于原材料涨价，成本上升，企业困难，前景黯淡", "与长江存储集团合作，合资建设工艺研发中心", "市场需求衰退，库存失败，冲突不断，军队介入",
    "新品发布，解决方案推出", "plain text without any signal", "", "价格维持，库存稳定，2021年下跌有限",
]
QUESTIONS = [
    "2023年5月  发生了什么事件？", "为什么 价格上涨，原因是什么", "2024-01-15之后的趋势！", "最近7天公司的投资", "最近2个月的情况。", "去年的收购关系", "who knows", "2024-13-45 无效",
]


def _pick(texts: list[str]) -> str:
    """A text for each event, in words that both engines read alike."""
    return "CASE " + " ".join(f"WHEN event_id % {len(texts)} = {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


#: id, event_type, ts, user_id, value, k, content, question, category ('' where unknown).
NEWS = f"""(SELECT event_id AS id, event_type, ts, user_id, value, {_pick(HEADLINES)} AS content, {_pick(QUESTIONS)} AS question,
    CASE event_type WHEN 'purchase' THEN '经济' WHEN 'signup' THEN '科技' WHEN 'view' THEN '体育' ELSE '' END AS category FROM events)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.selectExpr(
        "event_id AS id", "event_type", "ts", "user_id", "value", f"{_pick(HEADLINES)} AS content", f"{_pick(QUESTIONS)} AS question",
        "CASE event_type WHEN 'purchase' THEN '经济' WHEN 'signup' THEN '科技' WHEN 'view' THEN '体育' ELSE '' END AS category",
    )


#: The same bindings as SQL.
EVENTS = "(SELECT event_id, event_type, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
STATES = """(SELECT d.doc_id AS id, text AS source_text, CASE WHEN l.doc_id IS NULL THEN 'pending_triage'
    WHEN toxic = 1 THEN 'pending_review' WHEN quality = 1 THEN 'completed' ELSE 'pending_extraction' END AS current_status,
    source, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
FOLLOWS = """(SELECT event_id AS source_event_id, next_event_id AS target_event_id,
    CASE WHEN event_type = next_event_type THEN 'correlation' WHEN gap <= 24 THEN 'causal' ELSE 'temporal_sequence' END AS relation_type,
    round(1 / (1 + gap / 24), 6) AS confidence, round(gap, 6) AS gap_hours
    FROM (SELECT *, (epoch_us(next_ts) - epoch_us(ts)) / 3600e6 AS gap FROM (
        SELECT event_id, event_type, ts, lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS next_event_type,
               lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE next_event_id IS NOT NULL))"""
