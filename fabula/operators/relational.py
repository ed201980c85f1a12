"""Filters from data, top-k, pagination, set operations and the less usual joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.sources.scratch import materialize


def conjunction(conditions: Mapping[str, tuple[str, Any]]) -> Column:
    """A predicate from ``column -> (operator, value)``; an unknown operator raises, none is dropped."""
    made = F.lit(True)
    for name, (op, value) in conditions.items():
        c = F.col(name)
        match op:
            case "=":
                made &= c == value
            case ">=":
                made &= c >= value
            case "<=":
                made &= c <= value
            case "in":
                made &= c.isin(list(value))
            case "overlaps":
                made &= F.arrays_overlap(c, F.array(*[F.lit(v) for v in value]))
            case _:
                raise ValueError(f"unknown operator {op}")
    return made


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered; Spark cuts groups before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def page(df: DataFrame, order: Sequence[Column | str], page_no: int, size: int) -> DataFrame:
    """Page ``page_no`` (from 1) in the given total order."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def budget_prefix(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], size: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes add up to at most ``budget``; none if that is not positive."""
    running = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).where((F.col("running") <= budget) & (F.lit(budget) > 0))


def first_wins(df: DataFrame, key: Sequence[Column], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in the given order. A map-side minimum, not a sort of all rows."""
    names = [f"__k{i}" for i in range(len(key))]
    ranked = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *[F.col(c).alias(f"__v_{c}") for c in df.columns])
    best = df.groupBy(*[k.alias(n) for k, n in zip(key, names)]).agg(F.min(ranked).alias("__best"))
    return best.select(*[F.col(f"__best.__v_{c}").alias(c) for c in df.columns])


def orphans(df: DataFrame, known: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(known, key, "left_anti")


def prefer_left(left: DataFrame, right: DataFrame, key: str, tags: tuple[str, str] = ("graph", "vector")) -> DataFrame:
    """All left rows, and right rows with another key; ``source`` says where a row is from."""
    extra = right.join(left.select(key), key, "left_anti")
    return left.withColumn("source", F.lit(tags[0])).unionByName(extra.withColumn("source", F.lit(tags[1])))


def fuse_scores(left: DataFrame, right: DataFrame, key: str, a: str, b: str, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Weighted sum over the union of keys; a missing score counts 0."""
    both = left.join(right, key, "full_outer")
    score = weights[0] * F.coalesce(a, F.lit(0.0)) + weights[1] * F.coalesce(b, F.lit(0.0))
    return both.withColumn("score", score)


def renumbered_union(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct rows of all parts, numbered from 1 in order of their first part and then their values.

    Numbers come from ranges and their counts, so no task sorts everything.
    """
    tagged = [p.select(*columns).withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy(*columns).agg(F.min("__part").alias("__part"))
    return numbered(rows, ["__part"], list(columns), "position")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds each row's place (from 1) in its group: rows are sorted in ranges, a range's rows are numbered where they lie,
    and a group's earlier ranges are added from their counts. A group of any size is spread over as many tasks."""
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order]
    sorted_ = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    sorted_ = materialize(sorted_.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    parts = sorted_.groupBy(*by, "__range").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), "__low", "__before")
    on = " AND ".join(["__range = __r", *(f"`{c}` <=> __k{i}" for i, c in enumerate(by))])
    return sorted_.join(parts, F.expr(on)).select(*df.columns, (F.col("__at") - F.col("__low") + F.col("__before") + 1).alias(name))


def set_jaccard(df: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of distinct-item sets with Jaccard similarity of at least ``threshold``.

    Equal sets are one class; classes meet by ``similar_sets`` and are spread to their rows at the end.
    """
    sets = materialize(df.select(F.col(key).alias("k"), F.sort_array(F.array_distinct(items)).alias("s")).where(F.size("s") > 0), "jaccard-sets")
    classes = materialize(sets.groupBy("s").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("rows")), "jaccard-classes")
    pairs = similar_sets(classes.select("k", "s"), threshold)
    if threshold > 1 or classes.where("rows > 1").isEmpty():
        return pairs
    copied = classes.where("rows > 1").select(F.col("k").alias("c"), "s")
    members = materialize(sets.join(copied, "s").select("c", "k"), "jaccard-members")
    within = members.alias("x").join(members.alias("y"), F.expr("x.c = y.c AND x.k < y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.lit(1.0).alias("jaccard"))
    for side in ("a", "b"):
        rows = members.select(F.col("c").alias(side), F.col("k").alias("m"))
        pairs = pairs.join(rows, side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").unionByName(within)


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """sets(k, s) of distinct items -> (a < b, jaccard) of those with at least ``threshold``.

    Sets meet on their prefix of rarest items only: of two sets that similar, the first
    size - ceil(threshold * size) + 1 items in a common order share one. A row of the prefix holds its set, so a pair is
    decided where it meets, on the first item that both have; what does not pass is never written.
    """
    counts = sets.select(F.explode("s").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    ranked = sets.select("k", F.explode("s").alias("i")).join(counts, "i").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("c", "i")))["i"].alias("s"))
    # a bit for each item, by its hash: items whose bit the other set lacks are not in it
    bits = F.aggregate("s", F.lit(0).cast("long"), lambda x, i: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(i), F.lit(64)).cast("int"))))
    n = F.size("s")
    prefix = ranked.select("k", "s", n.alias("n"), bits.alias("bits"), F.posexplode(F.slice("s", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("at", "i"))
    prefix = materialize(prefix, "jaccard-prefix")
    a, b = (prefix.select(*[F.col(c).alias(f"{c}{x}") for c in ("k", "s", "n", "bits", "at", "i")]) for x in "ab")
    need = F.expr(f"{threshold}D * (na + nb) - 1e-9D")
    # a common item at places x and y (from 0) leaves at most min(n - 1 - place) more in common
    reach = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    lacking = lambda n, x, y: F.col(n) - F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    likely = (F.col("ka") < F.col("kb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (reach * (1 + threshold) >= need)
    likely &= (lacking("na", "bitsa", "bitsb") * (1 + threshold) >= need) & (lacking("nb", "bitsb", "bitsa") * (1 + threshold) >= need)
    common = F.array_intersect("sa", "sb")
    first = F.get(common, F.lit(0)) == F.col("ia")
    score = F.size(common) / (F.col("na") + F.col("nb") - F.size(common))
    met = a.join(b, (F.col("ia") == F.col("ib")) & likely & (score >= threshold) & first)
    return met.select(F.col("ka").alias("a"), F.col("kb").alias("b"), score.alias("jaccard"))


def contained_terms(df: DataFrame, key: str, text: str, min_count: int = 2, k: int = 20) -> DataFrame:
    """Terms of which one is part of another, both occurring often enough; the k most frequent pairs.

    A term's first characters, eight at most, meet all runs of up to eight characters of the other terms; what meets is
    compared whole. Rows grow with a term's length, not its square.
    """
    counts = df.groupBy(F.col(text).alias("term")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    runs = F.expr("array_distinct(flatten(transform(sequence(1, greatest(length(term), 1)), i -> transform(sequence(0, least(8, length(term) - i + 1)), n -> substring(term, i, n)))))")
    longer = counts.where(F.col("term").isNotNull()).select(F.col("term").alias("long_term"), F.col("n").alias("n_long"), F.explode(runs).alias("run"))
    shorter = counts.withColumn("run", F.substring("term", 1, 8))
    pairs = longer.join(shorter, "run").where((F.col("term") != F.col("long_term")) & F.contains("long_term", "term"))
    pairs = pairs.select(F.col("term").alias("short_term"), "long_term", (F.col("n") + F.col("n_long")).alias("n"))
    return pairs.orderBy(F.desc("n"), "short_term", "long_term").limit(k)


def contained_passages(docs: DataFrame, passages: DataFrame, doc_key: str, passage_key: str, text: str, words: int) -> DataFrame:
    """(doc, passage) where the document holds the passage's words in a row, for passages of ``words`` words or more.

    A passage's first words meet the documents' runs of as many words by hash; what meets is compared whole.
    """
    clean = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    p = passages.select(passage_key, clean.alias("__t"), F.split(clean, " ").alias("__w")).where(F.size("__w") >= words)
    p = p.select(passage_key, "__t", F.xxhash64(F.array_join(F.slice("__w", 1, words), " ")).alias("__h"))
    d = docs.select(doc_key, clean.alias("__x")).where(F.length("__x") > 0).withColumn("__w", F.split("__x", " "))
    runs = F.expr(f"array_distinct(transform(sequence(1, greatest(size(__w) - {words - 1}, 1)), i -> xxhash64(array_join(slice(__w, i, {words}), ' '))))")
    met = d.select(doc_key, F.explode(runs).alias("__h")).join(p, "__h").select(doc_key, passage_key, "__t")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return met.join(d.select(doc_key, "__x"), doc_key).where(F.contains(padded("__x"), padded("__t"))).select(doc_key, passage_key).distinct()
