"""String functions as Column expressions: cleaning, names, tokens, lexicons, rendering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide results. All of them are defaults; functions take others.
COMPANY_SUFFIXES = ["incorporated", "corporation", "limited", "company", "group", "corp", "inc", "ltd", "llc", "co"]
POSITIVE = ["增长", "发展", "成功", "突破", "创新", "合作", "提升", "改善"]
NEGATIVE = ["下降", "危机", "冲突", "失败", "问题", "困难", "风险", "衰退"]
INTENTS = {
    "event_search": ["事件", "发生", "什么事", "事情", "情况", "活动", "查找", "搜索", "收购", "合并", "投资", "融资"],
    "relation_query": ["关系", "关联", "联系", "相关", "关于"],
    "causal_analysis": ["原因", "导致", "因为", "由于", "造成", "引起", "为什么", "影响", "分析", "对", "的影响"],
    "temporal_analysis": ["时间", "何时", "什么时候", "之前", "之后", "期间", "顺序", "趋势", "发展", "变化"],
    "entity_query": ["公司", "企业", "人员", "组织", "机构", "个人"],
}
SYNONYMS = [
    ["企业", "公司", "集团", "有限公司", "股份公司"], ["合作", "协作", "联合", "合伙", "联盟"],
    ["投资", "融资", "注资", "入股", "参股"], ["收购", "并购", "兼并", "购买", "收买"],
]
FIRM_ENDINGS_CJK = ["公司", "集团", "股份", "有限公司", "科技", "电子", "半导体", "微电子", "实业", "控股", "投资", "发展"]
FIRM_ENDINGS_LATIN = ["国际", "技术", "工业", "制造", "Corp", "Inc", "Ltd", "Technology", "Electronics", "Semiconductor"]
NO_FIRMS = ["中国", "全球", "国内", "海外", "市场", "行业", "产业"]
THEMES = {
    "芯片短缺": ["芯片短缺", "缺芯", "芯片供应", "芯片紧张", "半导体短缺"],
    "产能扩张": ["扩产", "产能", "新建产线", "投产", "量产", "开工建设"],
    "价格波动": ["涨价", "降价", "价格上涨", "价格下跌", "价格波动", "成本上升"],
    "业绩发布": ["净利润", "营收", "财报", "业绩", "年报", "季报", "半年报"],
    "技术突破": ["突破", "创新", "研发", "技术", "专利", "工艺", "制程"],
    "合作并购": ["合作", "并购", "收购", "投资", "战略合作", "合资"],
    "政策影响": ["政策", "监管", "政府", "补贴", "税收", "法规"],
    "供应链": ["供应链", "上游", "下游", "供应商", "客户", "订单"],
    "新产品发布": ["发布", "推出", "上市", "新品", "产品", "解决方案"],
    "市场变化": ["市场", "需求", "销售", "出货", "库存", "渠道"],
}
CATEGORY_WEIGHTS = {"政治": 0.9, "经济": 0.8, "军事": 0.9, "国际": 0.8, "科技": 0.7, "社会": 0.6, "环境": 0.7, "金融": 0.8}
TYPE_WORDS = {
    "政治": ["政府", "选举", "政策", "总统", "议会"],
    "经济": ["经济", "市场", "投资", "贸易", "金融"],
    "科技": ["技术", "创新", "研发", "人工智能", "芯片"],
    "军事": ["军事", "战争", "冲突", "军队", "武器"],
    "社会": ["社会", "民众", "公众", "社区", "文化"],
}
STOPWORDS = ["的", "了", "在", "是", "有", "和", "与", "或", "但", "而", "等"]
IMPACT_UP = ["增长", "上涨", "复苏", "反弹", "改善", "乐观"]
IMPACT_DOWN = ["下降", "降价", "黯淡", "冲击", "不容乐观", "保守"]
TRENDS = {"上升": ["上涨", "增长", "反弹", "复苏"], "下降": ["下降", "降价", "下跌", "衰退"], "稳定": ["稳定", "持平", "维持"]}
TYPE_SHORT = {
    "公司并购": "ma", "投融资": "inv", "高管变动": "exec", "业务合作": "coop", "产品发布": "prod",
    "财务报告": "fin", "法律诉讼": "legal", "监管政策": "reg", "市场动态": "market", "技术创新": "tech",
}
QUESTION_ENDS = ["的原因是什么？", "相关的事件有哪些？", "的影响是什么？"]


def clean(text: Column) -> Column:
    """Unescapes the five common entities, removes control characters, trims."""
    out = F.trim(text)
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def split_markers(text: Column, markers: Sequence[str]) -> Column:
    """Non-blank trimmed pieces between any of the markers."""
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def is_number(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^[-+]?[0-9]*\.?[0-9]+$")), F.lit(False))


def company_base(name: Column) -> Column:
    """Lower case, without punctuation but hyphens, spaces collapsed, the longest known suffix and then hyphens removed."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\w\s-]", ""), r"\s+", " "))
    suffix = "|".join(sorted(COMPANY_SUFFIXES, key=len, reverse=True))
    return F.replace(F.regexp_replace(out, rf"\s({suffix})$", ""), F.lit("-"), F.lit(""))


def strip_parentheses(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[(（][^()（）]*[)）]", ""))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_similarity(a: Column, b: Column) -> Column:
    """Distinct shared characters over the longer length; 1 for equal, 0 against an empty text."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    common = F.size(F.filter(F.array_intersect(chars(a), chars(b)), lambda x: x != ""))
    return F.when(a == b, 1.0).otherwise(F.coalesce(common / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0)))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def lexicon_score(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains."""
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))


def sentiment(text: Column, up: Sequence[str] = POSITIVE, down: Sequence[str] = NEGATIVE, names: Sequence[str] = ("positive", "negative", "neutral")) -> Column:
    """Which list more words are contained of."""
    more, less = lexicon_score(text, up), lexicon_score(text, down)
    return F.when(more > less, names[0]).when(less > more, names[1]).otherwise(names[2])


def first_keyword_class(text: Column, classes: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first class of which a keyword is contained."""
    out = F.lit(default)
    for name, words in reversed(classes.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def intent(text: Column, intents: Mapping[str, Sequence[str]] = INTENTS) -> Column:
    """struct(intent, confidence): most keywords contained (first on ties), their share of the intent's keywords kept in
    [0.6, 1]; none gives general_qa with 0.5."""
    hits = [(lexicon_score(text, words), len(words)) for words in intents.values()]
    scores = [F.struct(h.alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"), (h / n).alias("share")) for i, (name, (h, n)) in enumerate(zip(intents, hits))]
    best = F.array_max(F.array(*scores))
    none = best["hits"] == 0
    sure = F.greatest(F.least(best["share"], F.lit(1.0)), F.lit(0.6))
    return F.struct(F.when(none, "general_qa").otherwise(best["name"]).alias("intent"), F.when(none, 0.5).otherwise(sure).alias("confidence"))


def expand_synonyms(words: Column, groups: Sequence[Sequence[str]] = SYNONYMS) -> Column:
    """The words and every group that shares one with them, distinct."""
    out = words
    for group in groups:
        g = F.array(*[F.lit(w) for w in group])
        out = F.when(F.arrays_overlap(words, g), F.array_union(out, g)).otherwise(out)
    return F.array_distinct(out)


def chunk_windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_order, tokens, content>> of windows over an array of tokens; the stride is size - overlap.

    Give a column that holds the array, not the expression that makes it: every window reads it again.
    """
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(stride))
    window = lambda s: F.struct((s / stride).cast("int").alias("chunk_order"), F.least(F.lit(size), F.size(tokens) - s).alias("tokens"), F.array_join(F.slice(tokens, s + 1, size), " ").alias("content"))
    return F.when(F.size(tokens) > 0, F.transform(starts, window)).otherwise(F.array().cast("array<struct<chunk_order:int,tokens:int,content:string>>"))


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def percentages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)%"), 1)


def render(template: str, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by values; a null counts as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def cut_description(text: Column, n: int = 100) -> Column:
    """One line of at most n characters; an ellipsis tells that more followed."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def context_id(*parts: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat_ws("_", *parts), r"[\s-]", "_"))


def firms(text: Column) -> Column:
    """Sorted distinct firm names: words with a firm's ending in either script, and names before a six-digit code."""
    cjk = F.regexp_extract_all(text, F.lit("([一-龥]{2,10}(?:" + "|".join(FIRM_ENDINGS_CJK) + "))"), 1)
    latin = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z\s]{2,20}(?:" + "|".join(FIRM_ENDINGS_LATIN) + "))"), 1)
    coded = F.regexp_extract_all(text, F.lit(r"([一-龥A-Za-z]{2,10})[（(][0-9]{6}[）)]"), 1)
    found = F.array_distinct(F.concat(cjk, latin, coded))
    return F.array_sort(F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(NO_FIRMS) & ~F.rlike(x, F.lit("^[0-9]+$"))))


def themes(text: Column, lists: Mapping[str, Sequence[str]] = THEMES) -> Column:
    """Themes of which a word is contained, in the order of the lists."""
    hit = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return F.array_compact(F.array(*[F.when(hit(words), F.lit(name)) for name, words in lists.items()]))


def named_runs(text: Column, k: int = 5) -> Column:
    """The first k, in code-point order, of runs of capitalised words and runs of two or more Han characters."""
    latin = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"), 1)
    han = F.regexp_extract_all(text, F.lit("([一-鿿]{2,})"), 1)
    return F.slice(F.array_sort(F.array_distinct(F.concat(latin, han))), 1, k)


def importance(category: Column, n_entities: Column, content: Column) -> Column:
    """A category's weight (0.5 for others), more for many entities and for long contents, at most 1."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHTS.items() for x in pair]), F.coalesce(category, F.lit(""))), F.lit(0.5))
    many = F.when(n_entities > 5, 0.1).when(n_entities > 3, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), weight + many + F.when(F.length(content) > 200, 0.1).otherwise(0.0))


def event_class(category: Column, text: Column) -> Column:
    """The category where there is one, else the first class with a word in the text, else ``unknown``."""
    return F.coalesce(F.nullif(category, F.lit("")), first_keyword_class(text, TYPE_WORDS, "unknown"))


def plain_query(query: Column) -> Column:
    """Spaces collapsed, punctuation of both scripts removed."""
    return F.regexp_replace(F.regexp_replace(F.trim(query), r"\s+", " "), "[？?！!。.，,；;：:]", "")


def mixed_tokens(text: Column) -> Column:
    """Words of letters and digits, and pairs of neighbouring Han characters; single characters and stop words left out.

    Pairs stand in for dictionary segmentation, which needs a dictionary.
    """
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.filter(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(2))), lambda x: F.length(x) == 2)))
    stops = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.concat(words, pairs), lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def token_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the parts of two type names, split at underscores."""
    parts = lambda c: F.array_distinct(F.split(F.lower(c), "_"))
    return set_jaccard(parts(a), parts(b))


def decode_escapes(text: Column) -> Column:
    r"""``\uXXXX`` as the characters they stand for; texts that are not valid that way stay as they are."""
    body = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"a":"'), body, F.lit('"}')), "$.a"), text)


def metrics(text: Column) -> Column:
    """struct(percentages, amounts, years): numbers before a percent sign, before 亿美元, and years before 年."""
    numbers = lambda p, t: F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda x: x.cast(t))
    return F.struct(
        numbers(r"([0-9]+(?:\.[0-9]+)?)%", "double").alias("percentages"),
        numbers(r"([0-9]+(?:\.[0-9]+)?)亿美元", "double").alias("amounts"), numbers("(20[0-9]{2})年", "int").alias("years"),
    )


def impact(text: Column) -> Column:
    return sentiment(text, IMPACT_UP, IMPACT_DOWN, ("积极", "消极", "中性"))


def trend_word(text: Column) -> Column:
    return first_keyword_class(text, TRENDS, "未知")


def type_abbreviation(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_SHORT.items() for x in pair]), kind), F.lit("general"))


def suggestions(query: Column) -> Column:
    return F.array(*[F.concat(query, F.lit(end)) for end in QUESTION_ENDS])


def event_text(text: Column, names: Column, kinds: Column, kind: Column) -> Column:
    """The text an event is embedded by: its own, its entities with their types, its type."""
    listed = F.array_join(F.zip_with(names, kinds, lambda n, k: F.concat(n, F.lit("("), k, F.lit(")"))), ", ")
    return F.concat(text, F.when(F.size(names) > 0, F.concat(F.lit(" 实体: "), listed)).otherwise(F.lit("")), F.coalesce(F.concat(F.lit(" 类型: "), kind), F.lit("")))


def value_conflict_advice(attribute: Column, values: Column) -> Column:
    """Two values are put side by side, more are listed for review."""
    two = F.concat(F.lit("检查数据源，确认 '"), attribute, F.lit("' 的正确值："), F.array_join(values, " vs "))
    return F.when(F.size(values) == 2, two).otherwise(F.concat(F.lit("多个 '"), attribute, F.lit("' 值冲突，需要人工审核："), F.array_join(values, ", ")))


def pattern_text(kind: Column, sequence: Column, domain: Column, conditions: Column) -> Column:
    """The text a pattern is embedded by: its labelled parts, those that are there."""
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    return F.concat_ws("; ", part("type: ", kind), part("sequence: ", F.array_join(sequence, " > ")), part("domain: ", domain), part("conditions: ", F.array_join(F.array_sort(conditions), ", ")))
