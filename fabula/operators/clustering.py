"""Density, K-means and slice clustering, and what is said of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as tx
from fabula.sources.scratch import materialize

from .graph import components
from .nearby import density_cells
from .relational import numbered


def dbscan(neighbours: DataFrame, points: DataFrame, min_points: int) -> DataFrame:
    """(id, cluster): neighbours(a, b) within reach, each pair once; points(id).

    Core points have ``min_points`` points in reach, themselves included. Clusters are components of
    core points, named by their least one; a border point joins the least cluster in reach; the rest
    is noise, -1. Groups without core points never meet.
    """
    both = neighbours.select("a", "b").unionByName(neighbours.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_points).select("id")
    if min_points <= 1:
        core = points.select("id")
    inner = both.join(core, both["a"] == core["id"], "left_semi").join(core.select(F.col("id").alias("c")), F.col("b") == F.col("c"), "left_semi")
    linked = components(inner, "a", "b")
    named = core.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = both.join(named.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    out = points.select("id").join(named, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def density(points: DataFrame, key: str, vector: str, most: float, min_points: int) -> DataFrame:
    """(id, cluster): ``dbscan`` of points by their distance. Cells of core points are linked, not the points."""
    found = materialize(density_cells(points, key, vector, most, min_points), "density")
    links = found.where("id IS NULL").select(F.col("near")[0].alias("src"), F.col("near")[1].alias("dst"))
    linked = components(links).select(F.col("id").alias("cell"), "component")
    near = found.where("id IS NOT NULL").select("id", F.explode("near").alias("cell"))
    named = near.join(linked, "cell", "left").groupBy("id").agg(F.min(F.coalesce("component", "cell")).alias("cluster"))
    return points.select(F.col(key).cast("long").alias("id")).join(named, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def reattach_noise(clusters: DataFrame, overlap: DataFrame, threshold: float) -> DataFrame:
    """Noise joins the cluster with the largest mean overlap above the threshold (ties to the least), else itself.

    overlap(a, b, jaccard) in both directions; all noise points see the clusters as they were.
    """
    sizes = clusters.where("cluster <> -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    noise = clusters.where("cluster = -1").select(F.col("id").alias("a"))
    members = clusters.where("cluster <> -1").select(F.col("id").alias("b"), "cluster")
    sums = overlap.join(noise, "a").join(members, "b").groupBy("a", "cluster").agg(F.sum("jaccard").alias("total"))
    mean = sums.join(sizes, "cluster").select("a", "cluster", (F.col("total") / F.col("size")).alias("mean")).where(F.col("mean") > threshold)
    best = mean.groupBy("a").agg(F.min(F.struct((-F.col("mean")).alias("m"), "cluster")).alias("best"))
    joined = clusters.join(best, clusters["id"] == best["a"], "left")
    return joined.select("id", F.when(F.col("cluster") == -1, F.coalesce("best.cluster", "id")).otherwise(F.col("cluster")).alias("cluster"))


def profile(df: DataFrame, cluster: str, kind: str, value: str) -> DataFrame:
    """Size, most frequent kind (ties to the smaller), mean and population deviation of a value; noise (-1) left out."""
    rows = df.where(F.col(cluster) != -1)
    kinds = rows.groupBy(cluster, kind).agg(F.count(F.lit(1)).alias("n"))
    mode = kinds.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(kind).alias("k"))).alias("m"))
    stats = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return stats.join(mode, cluster).select(cluster, "size", F.col("m.k").alias("main_kind"), "mean", "deviation")


def slices(df: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Contiguous slices of ``size`` rows within each group, numbered from 0; a group may be of any size."""
    return numbered(df, [by], order, "__at").withColumn("slice", F.floor((F.col("__at") - 1) / size)).drop("__at")


def tfidf(df: DataFrame, doc: str, text: str, pattern: str = "[^a-z0-9]+") -> DataFrame:
    """(doc, w, x): unit tf-idf vectors with smoothed idf, as rows; written once, for whoever reads them again."""
    words = df.select(doc, F.explode(F.filter(F.split(F.lower(text), pattern), lambda x: F.length(x) > 1)).alias("w"))
    tf = materialize(words.groupBy(doc, "w").agg(F.count(F.lit(1)).alias("tf")), "tfidf-counts")
    n = df.select(doc).distinct().count()
    idf = tf.groupBy("w").agg((F.log(F.lit(1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weights = materialize(tf.join(idf, "w").select(doc, "w", (F.col("tf") * F.col("idf")).alias("x")), "tfidf-weights")
    norm = weights.groupBy(doc).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weights.join(norm, doc).select(doc, "w", (F.col("x") / F.col("norm")).alias("x"))


def _sums(df: DataFrame, doc: str, cluster: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unit vectors with their cluster, each cluster's vector sum, and the clusters' sizes."""
    unit = materialize(tfidf(df, doc, text).join(df.select(doc, cluster), doc), "tfidf-unit")
    sums = materialize(unit.groupBy(cluster, "w").agg(F.sum("x").alias("s")), "tfidf-sums")
    return unit, sums, unit.groupBy(cluster).agg(F.count_distinct(doc).alias("size"))


def tfidf_cohesion(df: DataFrame, doc: str, cluster: str, text: str) -> DataFrame:
    """Mean similarity of a cluster's documents to its centre.

    For unit vectors that is the length of their sum over their number: sum |sum_d w|^2 = n^2 * cohesion^2.
    """
    _, sums, sizes = _sums(df, doc, cluster, text)
    length = sums.groupBy(cluster).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    return length.join(sizes, cluster).select(cluster, "size", (F.col("length") / F.col("size")).alias("cohesion"))


def evaluate(df: DataFrame, doc: str, cluster: str, text: str) -> DataFrame:
    """For each cluster: size, cohesion, exact mean cosine silhouette of its documents, and mean similarity of its centre
    to the others'.

    Distances of unit vectors to a whole cluster follow from its vector sum, so a document meets clusters, never documents.
    """
    unit, sums, sizes = _sums(df, doc, cluster, text)
    other = sums.select(F.col(cluster).alias("__c"), "w", "s")
    dots = unit.join(other, "w").groupBy(doc, cluster, "__c").agg(F.sum(F.col("x") * F.col("s")).alias("dot"))
    every = unit.select(doc, cluster).distinct().join(F.broadcast(sizes.select(F.col(cluster).alias("__c"), "size")))  # clusters are few
    far = every.join(dots, [doc, cluster, "__c"], "left").fillna(0.0, ["dot"])
    own = F.col("__c") == F.col(cluster)
    mean = F.when(own, F.when(F.col("size") > 1, (F.col("size") - F.col("dot")) / (F.col("size") - 1))).otherwise(1 - F.col("dot") / F.col("size"))
    sides = far.withColumn("mean", mean).groupBy(doc, cluster).agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    top = F.greatest("a", "b")
    width = F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    widths = sides.groupBy(cluster).agg(F.avg(width).alias("silhouette"))
    length = materialize(sums.groupBy(cluster).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length")), "tfidf-lengths")
    total = sums.join(length, cluster).groupBy("w").agg(F.sum(F.col("s") / F.col("length")).alias("t"))
    toward = sums.join(length, cluster).join(total, "w").groupBy(cluster).agg(F.sum(F.col("s") / F.col("length") * F.col("t")).alias("toward"))
    k = length.agg(F.count(F.lit(1)).alias("k"))
    out = sizes.join(length, cluster).join(widths, cluster).join(toward, cluster).join(F.broadcast(k))  # one row
    inter = F.when(F.col("k") > 1, (F.col("toward") - 1) / (F.col("k") - 1)).otherwise(0.0)
    return out.select(cluster, "size", (F.col("length") / F.col("size")).alias("cohesion"), "silhouette", inter.alias("inter"))


def rule_clusters(df: DataFrame, key: str, text: str, kind: str, mode: str = "hybrid") -> DataFrame:
    """(key, cluster): by the first firm named (in code-point order), the first theme, or both; rows without any by kind."""
    firm, theme = F.get(tx.firms(F.col(text)), F.lit(0)), F.get(tx.themes(F.col(text)), F.lit(0))
    other = F.concat(F.lit("其他_"), F.coalesce(kind, F.lit("其他")))
    if mode == "company":
        cluster = F.coalesce(firm, F.lit("其他公司"))
    elif mode == "theme":
        cluster = F.coalesce(theme, other)
    elif mode == "hybrid":
        cluster = F.coalesce(F.when(firm.isNotNull(), F.concat(firm, F.lit("_"), F.coalesce(theme, F.lit("综合事件")))), F.concat(F.lit("行业_"), theme), other)
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.select(key, cluster.alias("cluster"))


def relabelled(clusters: DataFrame, cluster: str, old: int, new: int) -> DataFrame:
    return clusters.withColumn(cluster, F.when(F.col(cluster) == old, new).otherwise(F.col(cluster)))


def sample_each(df: DataFrame, cluster: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each cluster, those of least hash: the same ones each time."""
    at = F.row_number().over(Window.partitionBy(cluster).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return df.withColumn("rank", at).where(F.col("rank") <= k)


def scaled(df: DataFrame, key: str, columns: list[str], weight: float = 1.0) -> DataFrame:
    """(key, v): columns less their mean over their population deviation (0 where that is 0), times a weight."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    rows = df.join(F.broadcast(stats))  # one row
    parts = [F.when(F.col(f"__d_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__d_{c}") * weight).otherwise(0.0) for c in columns]
    return rows.select(key, F.array(*parts).alias("v"))


def best_k(df: DataFrame, key: str, vector: str, least: int = 2, most: int = 20, seed: int = 42) -> DataFrame:
    """(k, silhouette, best): K-means for each k up to ``most`` and half the rows, and the one of largest silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = materialize(df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")), "kmeans-rows").select(key, array_to_vector("v").alias("features"))
    top = max(least, min(most, rows.count() // 2))
    tried = []
    for k in range(least, top + 1):
        placed = KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows)
        tried.append((k, float(ClusteringEvaluator(featuresCol="features").evaluate(placed)) if placed.select("prediction").distinct().count() > 1 else -1.0))
    best = max(tried, key=lambda t: (t[1], -t[0]))[0]
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in tried], "k int, silhouette double, best boolean")


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(key, cluster) by the built-in K-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))


def combined_neighbours(df: DataFrame, key: str, vector: str, items: str, eps: float, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(a, b) with a < b whose distance, .7 of the cosine's and .3 of the Jaccard distance of their items, is at most eps.

    Even with equal items a pair needs a cosine of 1 - eps / .7, so only such pairs are looked up.
    """
    from .vectors import all_within_cosine

    least = 1 - eps / weights[0]
    pairs = all_within_cosine(df, key, vector, least)
    sides = [df.select(F.col(key).cast("long").alias(n), F.array_distinct(F.coalesce(items, F.array().cast("array<string>"))).alias(f"__{n}")) for n in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    far = weights[0] * (1 - F.col("similarity")) + weights[1] * (1 - tx.set_jaccard(F.col("__a"), F.col("__b")))
    return both.where(far <= eps).select("a", "b")


def cluster(df: DataFrame, mode: str, key: str = "id", **how) -> DataFrame:
    """(key, cluster) by the named way: company, theme, hybrid (rules over a text) or kmeans (over a vector)."""
    if mode in ("company", "theme", "hybrid"):
        return rule_clusters(df, key, mode=mode, **how)
    if mode == "kmeans":
        return kmeans(df, key, **how)
    raise ValueError(f"unknown mode {mode}")
