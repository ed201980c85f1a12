"""The pipeline's stages over the smallest tables, each against brute force on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
from tests.conftest import SF


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        kept[name] = (before, docs.collect())

    before, after = kept["quality"]
    stay = {r["doc_id"] for r in after}
    assert sum(labels[r["doc_id"]] == (r["doc_id"] in stay) for r in before if r["doc_id"] in labels) >= 0.97 * sum(r["doc_id"] in labels for r in before)

    before, after = kept["exact_dedup"]
    best = {}
    for r in before:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())

    before, after = kept["near_dedup"]
    sets, parent = {}, {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[r["doc_id"]] = r["doc_id"]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in sets})

    before, after = kept["mix"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in before}
    assert abs(sum(map(size, after)) - 1.5 * sum(map(size, before))) <= 20 * max(map(size, before)) * 0.5

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= 1.02 * sum(fill.values()) / 2048 + 2
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, columns with names that operators use, and no rows at all."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "de", None, 3), (3, "some words that are there " * 9, None, "s", 1), (3, "some words that are there " * 9, None, "s", 1), (None, "x", "en", "", 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.selectExpr("*", "1 AS id", "2 AS score", "'n' AS node", "'u' AS uid", "3 AS copies", "'k' AS kept", "4 AS size", "'t' AS tag", "5 AS run")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name != "pack":
            assert out.columns == odd.columns
        assert out.count() <= 2 * len(rows)
        assert stage(spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.STAGES[1][1](spark, odd, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "x"), (2, ""), (3, rows[4][1])]
