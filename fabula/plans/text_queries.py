"""Queries for text functions, scores and dates. Lists in the SQL are typed anew, not taken from the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.functions import scores
from fabula.functions import text as tx

from .binding import NEWS, news, table
from .registry import query


def _hits(text: str, words: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words.split()) + ")"


_UP, _DOWN = _hits("content", "增长 发展 成功 突破 创新 合作 提升 改善"), _hits("content", "下降 危机 冲突 失败 问题 困难 风险 衰退")


@query(f"SELECT id, CASE WHEN {_UP} > {_DOWN} THEN 'positive' WHEN {_UP} < {_DOWN} THEN 'negative' ELSE 'neutral' END AS sentiment FROM {NEWS}")
def sentiment_lexicon(spark, d):
    return news(spark, d).select("id", tx.sentiment(F.col("content")).alias("sentiment"))


_ASKED = [
    ("event_search", "事件 发生 什么事 事情 情况 活动 查找 搜索 收购 合并 投资 融资"), ("relation_query", "关系 关联 联系 相关 关于"),
    ("causal_analysis", "原因 导致 因为 由于 造成 引起 为什么 影响 分析 对 的影响"), ("temporal_analysis", "时间 何时 什么时候 之前 之后 期间 顺序 趋势 发展 变化"),
    ("entity_query", "公司 企业 人员 组织 机构 个人"),
]


@query("WITH s AS (SELECT id, unnest([" + ", ".join(f"{{'h': {_hits('question', w)}, 'o': {i}, 'name': '{n}', 'n': {len(w.split())}}}" for i, (n, w) in enumerate(_ASKED)) + f"""]) AS s FROM {NEWS}),
    b AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s.h DESC, s.o) AS r FROM s)
    SELECT id, CASE WHEN s.h = 0 THEN 'general_qa' ELSE s.name END AS intent, round(CASE WHEN s.h = 0 THEN .5 ELSE greatest(.6, least(1, s.h / s.n)) END, 9) AS confidence FROM b WHERE r = 1""")
def intent_classification(spark, d):
    return news(spark, d).withColumn("i", tx.intent(F.col("question"))).select("id", "i.intent", F.round("i.confidence", 9).alias("confidence"))


@query(rf"""SELECT id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(content, '[一-龥]{{2,10}}(?:公司|集团|股份|有限公司|科技|电子|半导体|微电子|实业|控股|投资|发展)')
    || regexp_extract_all(content, '[A-Z][A-Za-z\s]{{2,20}}(?:国际|技术|工业|制造|Corp|Inc|Ltd|Technology|Electronics|Semiconductor)') || regexp_extract_all(content, '([一-龥A-Za-z]{{2,10}})[（(][0-9]{{6}}[）)]', 1)),
    lambda x: length(x) >= 2 AND x NOT IN ('中国', '全球', '国内', '海外', '市场', '行业', '产业'))), '|') AS firms FROM {NEWS}""".replace("\\\\s", "\\s"))
def firm_extraction(spark, d):
    return news(spark, d).select("id", F.array_join(tx.firms(F.col("content")), "|").alias("firms"))


_THEMES = """芯片短缺=芯片短缺 缺芯 芯片供应 芯片紧张 半导体短缺;产能扩张=扩产 产能 新建产线 投产 量产 开工建设;价格波动=涨价 降价 价格上涨 价格下跌 价格波动 成本上升;
    业绩发布=净利润 营收 财报 业绩 年报 季报 半年报;技术突破=突破 创新 研发 技术 专利 工艺 制程;合作并购=合作 并购 收购 投资 战略合作 合资;政策影响=政策 监管 政府 补贴 税收 法规;
    供应链=供应链 上游 下游 供应商 客户 订单;新产品发布=发布 推出 上市 新品 产品 解决方案;市场变化=市场 需求 销售 出货 库存 渠道"""
_THEME_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_hits('content', t.split('=')[1])} > 0 THEN '{t.split('=')[0].strip()}' END" for t in _THEMES.split(";")) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT id, array_to_string({_THEME_LIST}, '|') AS themes FROM {NEWS}")
def theme_extraction(spark, d):
    return news(spark, d).select("id", F.array_join(tx.themes(F.col("content")), "|").alias("themes"))


@query(f"""SELECT id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(content, '[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)*') || regexp_extract_all(content, '[一-鿿]{{2,}}'))), 1, 5), '|') AS entities FROM {NEWS}""")
def named_runs(spark, d):
    return news(spark, d).select("id", F.array_join(tx.named_runs(F.col("content")), "|").alias("entities"))


@query(f"""SELECT id, round(least(1, CASE category WHEN '经济' THEN .8 WHEN '科技' THEN .7 ELSE .5 END + CASE WHEN id % 8 > 5 THEN .1 WHEN id % 8 > 3 THEN .05 ELSE 0 END + CASE WHEN length(repeat(content, 6)) > 200 THEN .1 ELSE 0 END), 9) AS importance FROM {NEWS}""")
def importance_score(spark, d):
    return news(spark, d).select("id", F.round(tx.importance(F.col("category"), F.col("id") % 8, F.repeat("content", F.lit(6))), 9).alias("importance"))


@query(f"""SELECT id, CASE WHEN category <> '' THEN category WHEN {_hits('content', '政府 选举 政策 总统 议会')} > 0 THEN '政治' WHEN {_hits('content', '经济 市场 投资 贸易 金融')} > 0 THEN '经济'
    WHEN {_hits('content', '技术 创新 研发 人工智能 芯片')} > 0 THEN '科技' WHEN {_hits('content', '军事 战争 冲突 军队 武器')} > 0 THEN '军事' WHEN {_hits('content', '社会 民众 公众 社区 文化')} > 0 THEN '社会' ELSE 'unknown' END AS kind FROM {NEWS}""")
def event_class(spark, d):
    return news(spark, d).select("id", tx.event_class(F.col("category"), F.col("content")).alias("kind"))


@query(rf"SELECT id, regexp_replace(regexp_replace(trim(question), '\s+', ' ', 'g'), '[？?！!。.，,；;：:]', '', 'g') AS plain, question || '的原因是什么？|' || question || '相关的事件有哪些？|' || question || '的影响是什么？' AS suggested FROM {NEWS}")
def query_text(spark, d):
    return news(spark, d).select("id", tx.plain_query(F.col("question")).alias("plain"), F.array_join(tx.suggestions(F.col("question")), "|").alias("suggested"))


@query(f"""WITH t AS (SELECT id, regexp_extract_all(content, '[A-Za-z0-9]+') AS w, regexp_extract_all(content, '[一-鿿]+') AS r FROM {NEWS})
    SELECT id, array_to_string(list_filter(w || flatten(list_transform(r, lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))), lambda x: length(x) > 1), ' ') AS tokens FROM t""")
def mixed_tokens(spark, d):
    return news(spark, d).select("id", F.array_join(tx.mixed_tokens(F.col("content")), " ").alias("tokens"))


@query(rf"""SELECT id, array_to_string(regexp_extract_all(content, '([0-9]+(?:\.[0-9]+)?)%', 1), ' ') AS percentages, round(coalesce(list_sum(list_transform(regexp_extract_all(content, '([0-9]+(?:\.[0-9]+)?)亿美元', 1), lambda x: x::DOUBLE)), 0), 6) AS amount,
    coalesce(list_max(list_transform(regexp_extract_all(content, '(20[0-9][0-9])年', 1), lambda x: x::INT)), 0) AS last_year,
    CASE WHEN {_hits('content', '增长 上涨 复苏 反弹 改善 乐观')} > {_hits('content', '下降 降价 黯淡 冲击 不容乐观 保守')} THEN '积极' WHEN {_hits('content', '增长 上涨 复苏 反弹 改善 乐观')} < {_hits('content', '下降 降价 黯淡 冲击 不容乐观 保守')} THEN '消极' ELSE '中性' END AS impact,
    CASE WHEN {_hits('content', '上涨 增长 反弹 复苏')} > 0 THEN '上升' WHEN {_hits('content', '下降 降价 下跌 衰退')} > 0 THEN '下降' WHEN {_hits('content', '稳定 持平 维持')} > 0 THEN '稳定' ELSE '未知' END AS trend FROM {NEWS}""")
def text_metrics(spark, d):
    m = news(spark, d).withColumn("m", tx.metrics(F.col("content")))
    return m.select(
        "id", F.array_join(F.regexp_extract_all("content", F.lit(r"([0-9]+(?:\.[0-9]+)?)%"), 1), " ").alias("percentages"), F.round(F.aggregate("m.amounts", F.lit(0.0), lambda s, x: s + x), 6).alias("amount"),
        F.coalesce(F.array_max("m.years"), F.lit(0)).alias("last_year"), tx.impact(F.col("content")).alias("impact"), tx.trend_word(F.col("content")).alias("trend"),
    )


@query(f"""SELECT id, CASE id % 4 WHEN 0 THEN 'ma' WHEN 1 THEN 'reg' WHEN 2 THEN 'general' ELSE 'tech' END AS short,
    content || CASE WHEN id % 3 > 0 THEN ' 实体: ' || CASE WHEN id % 3 = 1 THEN event_type || '(kind)' ELSE event_type || '(kind), u' || user_id || '(user)' END ELSE '' END || ' 类型: ' || event_type AS embedded FROM {NEWS}""")
def event_text_for_embedding(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["公司并购", "监管政策", "别的", "技术创新"])), (F.col("id") % 4 + 1).cast("int"))
    n = (F.col("id") % 3).cast("int")
    names, kinds = F.array("event_type", F.concat(F.lit("u"), F.col("user_id"))), F.array(F.lit("kind"), F.lit("user"))
    text = tx.event_text(F.col("content"), F.slice(names, F.lit(1), n), F.slice(kinds, F.lit(1), n), F.col("event_type"))
    return news(spark, d).select("id", tx.type_abbreviation(kind).alias("short"), text.alias("embedded"))


@query(f"""SELECT id, CASE id % 3 WHEN 0 THEN 'A中' WHEN 1 THEN 'say "hi" é' ELSE 'plain' END AS decoded, event_type || ',' || CASE WHEN id % 2 = 0 THEN '"a,b ' || '""c""' || '"' ELSE 'x' END || ',' || user_id AS line FROM {NEWS}""")
def escapes_and_csv(spark, d):
    raw = F.element_at(F.array(*map(F.lit, [r"\u0041\u4e2d", r'say "hi" \u00e9', "plain"])), (F.col("id") % 3 + 1).cast("int"))
    odd = F.when(F.col("id") % 2 == 0, 'a,b "c"').otherwise("x")
    line = F.to_csv(F.struct("event_type", odd.alias("odd"), "user_id"), {"escape": '"'})
    return news(spark, d).select("id", tx.decode_escapes(raw).alias("decoded"), line.alias("line"))


@query(f"""SELECT id, round(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 1 / 3 ELSE 0 END, 9) AS kinds, CASE WHEN id % 3 = 0 THEN '检查数据源，确认 ''size'' 的正确值：a vs ' || event_type ELSE '多个 ''size'' 值冲突，需要人工审核：a, b, ' || event_type END AS advice FROM {NEWS}""")
def type_token_jaccard(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "Big_Trade").when(F.col("event_type") == "signup", "big_win").otherwise("other")
    values = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.col("event_type"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.col("event_type")))
    return news(spark, d).select("id", F.round(tx.token_jaccard(kind, F.lit("big_trade")), 9).alias("kinds"), tx.value_conflict_advice(F.lit("size"), values).alias("advice"))


@query(f"""SELECT id, CASE id % 8 WHEN 0 THEN DATE '2023-01-01' WHEN 2 THEN DATE '2024-01-15' WHEN 3 THEN ts::DATE - 7 WHEN 4 THEN ts::DATE - 60 WHEN 5 THEN make_date(year(ts) - 1, 1, 1) END AS begins,
    CASE id % 8 WHEN 0 THEN DATE '2023-01-02' WHEN 2 THEN DATE '2024-01-16' WHEN 3 THEN ts::DATE WHEN 4 THEN ts::DATE WHEN 5 THEN make_date(year(ts) - 1, 12, 31) END AS ends,
    id % 8 IN (2, 7) AS date_like FROM {NEWS}""")
def query_time_ranges(spark, d):
    found = news(spark, d).withColumn("r", scores.query_time_range(F.col("question"), F.to_date("ts")))
    return found.select("id", F.col("r.start").alias("begins"), F.col("r.end").alias("ends"), scores.date_like(F.col("question")).alias("date_like"))


@query(f"""SELECT id, round(CASE WHEN id % 7 = 0 THEN .5 WHEN lower(event_type) = CASE WHEN id % 2 = 0 THEN 'view' ELSE 'click' END THEN 1 ELSE 0 END, 9) AS place,
    CASE WHEN id % 5 = 0 THEN .5 WHEN id % 5 = 1 THEN 0 WHEN event_type = 'view' THEN 1 ELSE .5 END AS attributes,
    round(least(1, .4 * (event_type IN ('view', 'click'))::INT + .15 + .2 * CASE WHEN id % 2 = 0 THEN 1 ELSE .5 END + .1 * CASE WHEN category = '经济' THEN 1 ELSE .5 END), 9) AS matched,
    round(CASE WHEN value / 400 * .05 > .01 THEN value / 400 * .95 ELSE value / 400 END, 9) AS decayed FROM {NEWS}""")
def similarity_parts(spark, d):
    place = F.when(F.col("id") % 7 == 0, F.lit("")).when(F.col("id") % 2 == 0, F.lit("VIEW")).otherwise(F.lit("Click"))
    mine = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("z"), F.lit("1"))
    theirs = F.when(F.col("id") % 5 == 0, F.create_map().cast("map<string,string>")).when(F.col("id") % 5 == 1, F.create_map(F.lit("q"), F.lit("1"))).otherwise(F.create_map(F.lit("kind"), F.lit("view"), F.lit("z"), F.lit("1")))
    matched = scores.pattern_match(F.col("event_type").isin("view", "click"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5), F.col("category") == "经济")
    return news(spark, d).select(
        "id", scores.place_similarity(F.col("event_type"), place).alias("place"), scores.attribute_similarity(mine, theirs).alias("attributes"),
        F.round(matched, 9).alias("matched"), F.round(scores.decayed(F.col("value") / 400), 9).alias("decayed"),
    )


@query("""WITH c AS (SELECT c_custkey, c_name, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    r AS (SELECT *, least(1, CASE WHEN length(c_name) > 2 THEN .2 ELSE 0 END + least((c_custkey % 6) * .1, .3) + least(n * .1, .3) + least(n * .05, .2)) AS rich FROM c)
    SELECT c_custkey, round(rich, 9) AS rich, round(least(1, .9 * CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN .95 WHEN 2 THEN .8 ELSE .7 END * (.8 + .2 * least(rich, .6))), 9) AS matched,
    round(least(1, .6 * ((c_custkey % 11) / 10) + CASE WHEN c_custkey % 11 = 10 THEN .2 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN .15 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN .1 ELSE 0 END), 9) AS linked,
    round(.6 * least(n / 20, 1) + .4 * least((c_custkey % 7) / 5, 1), 9) AS general,
    round(least(1, .5 + .1 * (n >= 5)::INT + .1 * (c_custkey % 10 >= 2)::INT + .1 * (c_custkey % 10 >= 7)::INT + .1 * (c_custkey % 7 BETWEEN 2 AND 5)::INT + .1 * (n > 0)::INT), 9) AS valid,
    round(CASE WHEN n = 0 THEN 0 ELSE least(1, .3 * least(n / 10, 1) + .2 * least((c_custkey % 30) / 20, 1) + .5 * (c_custkey % 11) / 10) END, 9) AS quality,
    round(least(1, .8 + CASE WHEN n * 300 BETWEEN 1400 AND 2800 THEN .1 WHEN n * 300 > 2800 THEN -.1 ELSE 0 END + .1 * (c_custkey % 3)), 9) AS relevant,
    round(CASE c_custkey % 4 WHEN 0 THEN (.4 * .5 + .3 * .2 + .3 * .9) WHEN 1 THEN (.4 * .5 + .3 * .9) / .7 WHEN 2 THEN .2 ELSE 0 END, 9) AS overall,
    round(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE greatest(0, least(1, (c_custkey % 11) / 10 - .1 * (c_custkey % 3))) END, 9) AS relation,
    round(CASE WHEN n = 0 THEN 100 ELSE greatest(0, 100 - 100 * (10 * (c_custkey % 2) + 5 * (c_custkey % 3) + (c_custkey % 4) + .5 * (c_custkey % 5)) / (10 * n)) END, 2) AS consistent FROM r""")
def confidence_scores(spark, d):
    n_orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").join(n_orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = F.col("c_custkey")
    tenth, m = (key % 11) / 10, lambda k: key % k
    rich = scores.richness(F.col("c_name"), m(6), F.col("n"), F.col("n"))
    kind = F.element_at(F.array(*map(F.lit, ["exact", "alias", "fuzzy", "semantic"])), (m(4) + 1).cast("int"))
    some = lambda x, on: F.when(m(4).isin(*on), x)
    out = {
        "rich": rich, "matched": scores.match_confidence(F.lit(0.9), kind, rich, F.lit(0.6)), "linked": scores.link_confidence(tenth, m(11) == 10, m(3) == 0, m(2) == 0),
        "general": scores.generality(F.col("n"), m(7)), "valid": scores.rule_validation(F.col("n"), m(10) / 10, m(10) / 10, m(7), F.col("n") > 0), "quality": scores.retrieval_quality(F.col("n"), m(30), tenth),
        "relevant": scores.context_relevance(F.col("n") * 300, m(3)), "overall": scores.overall_confidence(some(0.5, (0, 1)), some(0.2, (0, 2)), some(0.9, (0, 1))),
        "relation": scores.relation_consistency((m(5) == 0).cast("int"), m(3), tenth),
    }
    issues = {"critical": m(2), "major": m(3), "minor": m(4), "info": m(5)}
    return c.select("c_custkey", *[F.round(x, 9).alias(name) for name, x in out.items()], scores.consistency(F.col("n"), issues).alias("consistent"))


@query("""SELECT c_custkey, 'company' AS field, CASE WHEN regexp_matches(c_name, '#0+[0-9]*5$') THEN .9 ELSE .6 END AS accuracy FROM customer
    UNION ALL SELECT c_custkey, 'amount', CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE .5 END FROM customer UNION ALL SELECT c_custkey, 'segment', .8 FROM customer""")
def field_accuracy(spark, d):
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in (("company", "c_name"), ("amount", "c_acctbal"), ("segment", "c_mktsegment"))])
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.explode(parts).alias("p"))
    return rows.select("c_custkey", "p.field", scores.field_accuracy(F.col("p.field"), F.col("p.value"), F.col("c_acctbal"), "#0+[0-9]*5$").alias("accuracy"))
