"""The thin queries ``opN_<name>`` over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, jaccard_join, lm, mixing, packing, quality, substring_dedup, token_counts, url_filter

#: The rules of the URL filter.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return found.withColumnRenamed("id", "doc_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after redaction of personal data."""
    counts = token_counts.redaction_counts(table(spark, sf_dir, "documents"), TOKENIZER)
    return counts.withColumnRenamed("id", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return placed.withColumnRenamed("id", "doc_id").drop("copy")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100, with_bytes=False)
    return cut.withColumnRenamed("id", "doc_id").drop("kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, threshold="0.85")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_mix_sources": op6_mix_sources,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_lm_scoring": op10_lm_scoring,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op6_mix_sources": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
                   coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                   md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS tag
            FROM documents),
        per AS (
            SELECT src, sum(size)::BIGINT AS source_size,
                   list_extract([5.0, 2.0, 1.0]::DOUBLE[], (row_number() OVER (ORDER BY src) - 1) % 3 + 1) AS w
            FROM docs GROUP BY src),
        shared AS (  -- water level: sources by ceiling over weight; the first whose ceiling is above its share ends it
            SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, src) AS k,
                   (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER tight, 0))
                   / (sum(w) OVER () - coalesce(sum(w) OVER tight, 0)) AS level
            FROM per
            WINDOW tight AS (ORDER BY 2.0 * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        ends AS (SELECT k, level FROM shared WHERE 2.0 * source_size > level * w ORDER BY k LIMIT 1),
        targets AS (
            SELECT src, source_size,
                   CASE WHEN ends.k IS NULL OR shared.k < ends.k THEN 2.0 * source_size ELSE ends.level * w END AS target
            FROM shared LEFT JOIN ends ON true),
        ranked AS (
            SELECT docs.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   ('0x' || substr(md5('0/' || docs.src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
                   row_number() OVER (PARTITION BY docs.src ORDER BY
                       CASE WHEN size < 16 THEN size
                            ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)::BIGINT) & 7) END,
                       ('0x' || substr(tag, 1, 4))::BIGINT % 64, size, tag, doc_id) AS r
            FROM docs JOIN targets USING (src))
        SELECT doc_id, size, source_size, target,
               ((floor(r * rate + u) - floor((r - 1) * rate + u)) * size)::BIGINT AS taken
        FROM ranked""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(l) < 4 THEN array_to_string(l, ' ')
                   ELSE array_to_string(l[i:i + 3], ' ') END AS g
            FROM w, unnest(range(1, greatest(len(l) - 3, CASE WHEN len(l) > 0 THEN 1 ELSE 0 END) + 1)) AS r(i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
            WHERE 100 * c >= 85 * (p.n + q.n - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) m USING (doc_id)""",
}
