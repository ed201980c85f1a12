"""Property graphs as node and edge tables: traversal, paths, components, ranks and metrics.

Iterative operators write each round to the shared folder, so plans stay short and lost executors
cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.sources.scratch import drop, materialize

from . import reach


def undirected(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(a, b) in both directions, distinct, without loops."""
    a = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    return a.unionByName(a.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def degrees(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """In-, out- and total degree; a loop counts at both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(source).alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    out = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, source: str = "src", target: str = "dst") -> DataFrame:
    """(seed, id, hops): everything within k undirected steps of each seed (column ``seed``), at its least distance."""
    near = undirected(edges, source, target)
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, k + 1):
        step = frontier.join(near, frontier["id"] == near["a"]).select("seed", F.col("b").alias("id")).distinct()
        frontier = materialize(step.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)), "graph-hop")
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, longest: int, source: str = "src", target: str = "dst", weight: str | None = None) -> DataFrame:
    """(path, length, score): directed paths without repeated nodes from each start (column ``id``), up to ``longest`` edges."""
    e = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"))
    paths = starts.select(F.array("id").alias("path"), F.lit(0.0).alias("total"))
    out = None
    for n in range(1, longest + 1):
        grown = paths.join(e, F.element_at("path", -1) == F.col("__s")).where(~F.array_contains("path", F.col("__t")))
        paths = grown.select(F.array_append("path", F.col("__t")).alias("path"), (F.col("total") + F.col("__w")).alias("total"))
        level = paths.select("path", F.lit(n).alias("length"), (F.col("total") / n).alias("score"))
        out = level if out is None else out.unionByName(level)
    return out


def components(edges: DataFrame, source: str = "src", target: str = "dst", limit: int = 60) -> DataFrame:
    """(id, component): the least id reachable, by alternating neighbour minima and pointer jumps."""
    near = materialize(undirected(edges, source, target), "graph-near")
    labels = near.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = materialize(labels, "graph-labels")
    for _ in range(limit):
        seen = near.join(labels, near["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(seen, labels["id"] == seen["a"], "left").select("id", F.least("component", "m").alias("component"))
        hop = low.select(F.col("id").alias("p"), F.col("component").alias("pc"))
        jumped = low.join(hop, F.col("component") == F.col("p"), "left").select("id", F.least("component", "pc").alias("component"))
        new = materialize(jumped, "graph-labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, rank) after a fixed number of rounds; nodes without out-edges give their rank to all."""
    links = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    out = links.groupBy("s").agg(F.count(F.lit(1)).alias("out"))
    links = materialize(links.join(out, "s"), "rank-links")
    nodes = links.select(F.col("s").alias("id")).union(links.select("t")).distinct().join(out.withColumnRenamed("s", "id"), "id", "left")
    nodes = materialize(nodes, "rank-nodes")
    n, ending = nodes.agg(F.count(F.lit(1)), F.count_if(F.col("out").isNull())).first()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        flow = links.join(ranks.select(F.col("id").alias("s"), "rank"), "s").groupBy("t").agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        loose = ranks.where("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if ending else 0.0
        base = (1 - damping) / n + damping * loose / n
        new = nodes.join(flow, nodes["id"] == flow["t"], "left")
        old = ranks
        ranks = materialize(new.select("id", "out", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")), "rank-round")
        drop(old)
    return ranks.select("id", "rank")


def clustering(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, degree, triangles, coefficient). Edges point from lower to higher degree, so hubs emit few pairs."""
    near = undirected(edges, source, target)
    degree = near.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    d = near.join(degree.select(F.col("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    up = materialize(d.where((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))).select("a", "b"), "graph-up")
    x, y = up.alias("x"), up.alias("y")
    wedges = x.join(y, F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), F.col("x.b").alias("m"))
    closed = wedges.join(up, ["a", "b"])
    corners = closed.select(F.explode(F.array("a", "b", "m")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    out = degree.select(F.col("a").alias("id"), F.col("d").alias("degree")).join(corners, "id", "left")
    t = F.coalesce("triangles", F.lit(0))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select("id", "degree", t.alias("triangles"), F.when(pairs > 0, t / pairs).otherwise(F.lit(0.0)).alias("coefficient"))


def cycles(edges: DataFrame, longest: int, source: str = "src", target: str = "dst") -> DataFrame:
    """Directed cycles of up to ``longest`` edges, each once, starting at its least node."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s <> t").distinct()
    paths = e.select(F.array("s", "t").alias("path"))
    found = None
    for n in range(2, longest + 1):
        back = paths.join(e, (F.element_at("path", -1) == F.col("s")) & (F.col("path")[0] == F.col("t"))).select("path", F.lit(n).alias("length"))
        found = back if found is None else found.unionByName(back)
        if n < longest:
            grown = paths.join(e, F.element_at("path", -1) == F.col("s")).where((F.col("t") > F.col("path")[0]) & ~F.array_contains("path", F.col("t")))
            paths = grown.select(F.array_append("path", F.col("t")).alias("path"))
    return found.where(F.col("path")[0] == F.array_min("path"))


def open_triples(edges: DataFrame, source: str = "src", target: str = "dst", kind: str = "kind") -> DataFrame:
    """a -> b -> c of one kind without a -> c of that kind."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(kind).alias("k")).distinct()
    n = e.select(F.col("a").alias("b"), F.col("b").alias("c"), "k")
    two = e.join(n, ["b", "k"]).where("a <> c").select("a", "b", "c", "k")
    return two.join(e.select("a", F.col("b").alias("c"), "k"), ["a", "c", "k"], "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges with both ends among the nodes (column ``id``)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges[source] == ids["id"], "left_semi").join(ids.select(F.col("id").alias("__d")), F.col(target) == F.col("__d"), "left_semi")


def largest_component(edges: DataFrame, labels: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges of the component with most nodes (ties to the least label), in stable order of their ends."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    inside = labels.join(top, "component", "left_semi").select("id")
    e = undirected(edges, source, target).where("a < b")
    return e.join(inside, e["a"] == inside["id"], "left_semi").orderBy("a", "b")


def hyper_bfs(members: DataFrame, seeds: DataFrame, rounds: int, event: str = "event_id", entity: str = "entity_id") -> DataFrame:
    """(id, hops): entities reached by alternating entity -> events -> entities, ``rounds`` times."""
    seen = seeds.select(F.col("id"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, rounds + 1):
        touched = members.join(frontier, members[entity] == frontier["id"], "left_semi").select(event).distinct()
        reached = members.join(touched, event, "left_semi").select(F.col(entity).alias("id")).distinct()
        frontier = materialize(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)), "graph-bfs")
        seen = seen.unionByName(frontier)
    return seen


def metrics(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """One row: nodes, edges, density, mean clustering, components and the size of the largest."""
    near = undirected(edges, source, target)
    basic = near.agg(F.count_distinct("a").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    labels = components(edges, source, target)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    mean = clustering(edges, source, target).agg(F.avg("coefficient").alias("avg_clustering"))
    density = 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))
    return basic.withColumn("density", density).join(F.broadcast(sizes)).join(F.broadcast(mean))  # one row each




def communities(edges: DataFrame, rounds: int = 5, smallest: int = 3, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, community) after a fixed number of synchronous label rounds: the most frequent label among the neighbours
    and the node itself, ties to the least; communities below ``smallest`` nodes are left out."""
    near = undirected(edges, source, target)
    near = materialize(near.unionByName(near.select("a", F.col("a").alias("b")).distinct()), "graph-near")
    labels = near.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct()
    for _ in range(rounds):
        old = labels
        votes = near.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m"))
        labels = materialize(best.select(F.col("a").alias("id"), F.col("m.community").alias("community")), "graph-labels")
        drop(old)
    large = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= smallest).select("community")
    return labels.join(large, "community", "left_semi").select("id", "community")


def eigenvector(edges: DataFrame, rounds: int = 10, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, score): a fixed number of power rounds on the undirected graph with loops, each scaled to unit length."""
    near = materialize(undirected(edges, source, target), "graph-near")
    scores = near.select(F.col("a").alias("id")).distinct().withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        sums = near.join(scores.select(F.col("id").alias("b"), "score"), "b").groupBy("a").agg(F.sum("score").alias("s"))
        raw = materialize(scores.join(sums, scores["id"] == sums["a"]).select("id", (F.col("score") + F.col("s")).alias("score")), "graph-scores")
        norm = raw.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
        scores = raw.withColumn("score", F.col("score") / F.lit(norm))
    return scores


def shortest_hops(edges: DataFrame, pairs: DataFrame, longest: int = 3, source: str = "src", target: str = "dst") -> DataFrame:
    """(a, b, hops): least number of undirected steps between given ends (columns a, b), up to ``longest``.

    Both ends of a pair walk towards each other, and only pairs that are still open go on: two steps need the neighbours of
    one end, three or four those two steps away, never all that lies within ``longest`` steps of a seed.
    """
    near = materialize(undirected(edges, source, target).select(F.col("a").alias("seed"), F.col("b").alias("id")), "graph-near")
    asked = materialize(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "hops-open")
    found, left = asked.where("a = b").withColumn("hops", F.lit(0)), asked.where("a <> b")
    walks, step = [None, near], near.select(F.col("seed").alias("id"), F.col("id").alias("next"))
    for hop in range(1, longest + 1):
        ahead, back = (hop + 1) // 2, hop // 2
        if ahead == len(walks):
            seeds = left.select(F.col("a").alias("seed")).union(left.select("b")).distinct()
            grown = walks[-1].join(seeds, "seed", "left_semi").join(step, "id").select("seed", F.col("next").alias("id")).distinct()
            walks.append(materialize(grown, "hops-walk"))
        over = left.join(walks[ahead].select(F.col("seed").alias("a"), F.col("id").alias("m")), "a")
        if back:
            met = over.join(walks[back].select(F.col("seed").alias("b"), F.col("id").alias("m")), ["b", "m"], "left_semi").select("a", "b").distinct()
        else:
            met = over.where("b = m").select("a", "b")
        met = materialize(met, "hops-met")
        found = found.unionByName(met.withColumn("hops", F.lit(hop)))
        left = left.join(met, ["a", "b"], "left_anti")
        if hop < longest:
            left = materialize(left, "hops-open")
    return pairs.join(found, ["a", "b"])


def unified(layers: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, weight, layer) of several edge tables, each of columns src, dst, weight; an edge's ends belong to its layer."""
    rows = None
    for name, df in layers.items():
        one = df.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(name).alias("layer"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def has_nodes(edges: DataFrame, asked: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """asked(id) -> (id, found)."""
    known = edges.select(F.col(source).alias("id")).union(edges.select(target)).distinct().withColumn("found", F.lit(True))
    return asked.select("id").join(known, "id", "left").fillna(False, ["found"])


def edges_between(edges: DataFrame, asked: DataFrame, directed: bool = False, source: str = "src", target: str = "dst") -> DataFrame:
    """asked(a, b) -> (a, b, n): how many edges join them, in either direction unless ``directed``."""
    counts = edges.groupBy(F.col(source).alias("a"), F.col(target).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if not directed:
        back = counts.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
        counts = counts.unionByName(back).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return asked.select("a", "b").join(counts, ["a", "b"], "left").fillna(0, ["n"])


def node_edges(edges: DataFrame, asked: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges that begin or end at one of the asked ids, each once."""
    ids = asked.select("id").distinct()
    out = edges.join(ids, edges[source] == ids["id"], "left_semi")
    into = edges.join(ids, edges[target] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "__a"), F.col(source) == F.col("__a"), "left_anti")
    return out.unionByName(into)


def typed_paths(edges: DataFrame, starts: DataFrame, longest: int, source: str = "src", target: str = "dst", kind: str = "kind", confidence: str = "confidence") -> DataFrame:
    """(path, kinds, sure, length) of directed paths without repeated nodes; each length is written before the next grows."""
    e = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t"), F.col(kind).alias("__k"), F.col(confidence).cast("double").alias("__c"))
    paths = starts.select(F.array("id").alias("path"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<double>").alias("sure"))
    out = None
    for n in range(1, longest + 1):
        grown = paths.join(e, F.element_at("path", -1) == F.col("__s")).where(~F.array_contains("path", F.col("__t")))
        paths = grown.select(F.array_append("path", F.col("__t")).alias("path"), F.array_append("kinds", F.col("__k")).alias("kinds"), F.array_append("sure", F.col("__c")).alias("sure"))
        paths = materialize(paths, "graph-paths")
        level = paths.withColumn("length", F.lit(n))
        out = level if out is None else out.unionByName(level)
    return out


def path_scores(paths: DataFrame) -> DataFrame:
    """Adds what typed paths are: ``causal`` or ``temporal`` where every edge is, else ``mixed``; mean confidence and summed weight."""
    every = lambda word: F.forall("kinds", lambda k: F.contains(k, F.lit(word)))
    total = F.aggregate("sure", F.lit(0.0), lambda s, x: s + x)
    kind = F.when(every("causal"), "causal").when(every("temporal"), "temporal").otherwise("mixed")
    return paths.withColumns({"path_kind": kind, "confidence": total / F.size("sure"), "weight": total})


def causal_chains(paths: DataFrame, k: int = 10) -> DataFrame:
    """The k surest causal paths of three nodes or more, ties to the path that sorts first."""
    return path_scores(paths).where("path_kind = 'causal' AND length >= 2").orderBy(F.desc(F.round("confidence", 9)), F.array_join("path", "-")).limit(k)


def distances(edges: DataFrame, sources: DataFrame | None = None, source: str = "src", target: str = "dst") -> DataFrame:
    """(s, v, d, n): undirected distance from each source (all nodes without a table of ids) and the number of shortest
    paths; the result has a row for each pair that is connected. From all nodes, blocks of sources are searched in tasks;
    from given ones, or beyond the bound of ``reach``, by one round for each distance, on the frontier only."""
    near = materialize(undirected(edges, source, target), "graph-near")
    if sources is None and (whole := reach.all_distances(near)) is not None:
        return whole
    ids = near.select(F.col("a").alias("id")).distinct() if sources is None else sources.select("id")
    seen = materialize(ids.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1).cast("double").alias("n")), "graph-front")
    frontier, d = seen, 0
    while True:
        d += 1
        step = frontier.join(near, frontier["v"] == near["a"]).groupBy("s", F.col("b").alias("v")).agg(F.sum("n").alias("n"))
        frontier = materialize(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "n"), "graph-front")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def _spreads(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(id, r, far, most): how many others each node reaches, their summed distance and the largest."""
    found = reach.all_spreads(materialize(undirected(edges, source, target), "graph-near"))
    if found is None:
        found = distances(edges, None, source, target).groupBy(F.col("s").alias("id")).agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("d").alias("far"), F.max("d").cast("long").alias("most"))
    return materialize(found, "graph-spreads")


def closeness(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, closeness): reached nodes over their summed distance, scaled by the share of all nodes that is reached."""
    sums = _spreads(edges, source, target)
    n = sums.count()
    return sums.select("id", F.when(F.col("far") > 0, F.col("r") / F.col("far") * F.col("r") / F.lit(max(n - 1, 1))).otherwise(0.0).alias("closeness"))


def betweenness(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, betweenness): the share of shortest paths between others that pass, normalised. Distances and path numbers
    first, then dependencies from the farthest level back (linear in sources times edges): blocks of sources in tasks, or
    beyond the bound of ``reach`` one round a level."""
    near = materialize(undirected(edges, source, target), "graph-near")
    if (whole := reach.all_passed(near)) is not None:
        sums, n = whole
        return sums.select("id", (F.col("sum") * (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0)).alias("betweenness"))
    found = materialize(distances(edges, None, source, target), "graph-distances")
    n, far = found.select("v").distinct().count(), found.agg(F.max("d")).first()[0] or 0
    total, behind = None, None
    for d in range(far, 0, -1):
        level = found.where(F.col("d") == d)
        if behind is not None:
            level = level.join(behind.select("s", "v", "delta"), ["s", "v"], "left")
        else:
            level = level.withColumn("delta", F.lit(0.0))
        share = level.select("s", F.col("v").alias("w"), ((1 + F.coalesce("delta", F.lit(0.0))) / F.col("n")).alias("share"))
        above = found.where(F.col("d") == d - 1).select("s", "v", "n")
        passed = share.join(near, share["w"] == near["a"]).select("s", F.col("b").alias("v"), "share").join(above, ["s", "v"])
        behind = materialize(passed.groupBy("s", "v").agg(F.sum(F.col("share") * F.col("n")).alias("delta")), "graph-delta")
        total = behind if total is None else total.unionByName(behind)
    ids = found.select(F.col("v").alias("id")).distinct()
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    sums = total.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("sum"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return ids.join(sums, "id", "left").select("id", (F.coalesce("sum", F.lit(0.0)) * scale).alias("betweenness"))


def path_lengths(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """One row: whether the graph hangs together, and if so mean path length and diameter."""
    out = _spreads(edges, source, target).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") + 1).alias("pairs"), F.sum("far").alias("far"), F.max("most").cast("int").alias("most"))
    whole = F.col("pairs") == F.col("n") * F.col("n")
    return out.select(whole.alias("connected"), F.when(whole & (F.col("n") > 1), F.col("far") / (F.col("n") * (F.col("n") - 1))).alias("mean_length"), F.when(whole, F.col("most")).alias("diameter"))


def louvain(edges: DataFrame, levels: int = 3, sweeps: int = 3, parts: int = 2, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, community) by modularity: nodes move to the neighbouring community of largest gain, a hash part of them at a
    time so that neighbours do not swap; then communities become nodes. Ties go to the least community."""
    near = materialize(undirected(edges, source, target).withColumn("w", F.lit(1.0)), "louvain-near")
    home = materialize(near.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct(), "louvain-home")
    for _ in range(levels):
        degree = materialize(near.groupBy("a").agg(F.sum("w").alias("k")), "louvain-degree")
        m2 = degree.agg(F.sum("k")).first()[0] or 1.0
        labels, moved = degree.select("a", "k", F.col("a").alias("c")), 0
        for turn in range(sweeps * parts):
            tied = near.where("a <> b").join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            mass = labels.groupBy("c").agg(F.sum("k").alias("mass"))
            own = labels.select("a", "k", F.col("c").alias("own"))
            options = tied.unionByName(labels.select("a", "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w")).join(own, "a").join(mass, "c")
            gain = F.col("w") - F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(m2)
            best = options.groupBy("a", "k", "own").agg(F.min(F.struct((-F.round(gain, 12)).alias("g"), (F.col("c") != F.col("own")).alias("other"), "c")).alias("m"))
            mine = F.pmod(F.xxhash64("a", F.lit(7)), F.lit(parts)) == turn % parts
            new = best.select("a", "k", F.when(mine, F.col("m.c")).otherwise(F.col("own")).alias("c"), "own")
            new = materialize(new, "louvain-labels")
            moved += new.where("c <> own").count()
            if turn:
                drop(written)
            written, labels = new, new.drop("own")
        if not moved:
            break
        to = labels.select(F.col("a").alias("from"), "c")
        home = materialize(home.join(to, home["community"] == to["from"]).select("id", F.col("c").alias("community")), "louvain-home")
        ends = near.join(labels.select("a", F.col("c").alias("ca")), "a").join(labels.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b")
        near = materialize(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "louvain-near")
    names = home.groupBy("community").agg(F.min("id").alias("name"))
    return home.join(names, "community").select("id", F.col("name").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """One row: modularity of labels(id, community) on the undirected graph."""
    near = undirected(edges, source, target)
    a, b = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    ends = near.join(a, "a").join(b, "b")
    inside = ends.agg(F.count(F.lit(1)).alias("m2"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    squares = ends.groupBy("ca").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inside.join(F.broadcast(squares)).select((F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))  # one row each


def hyper_relations(facts: DataFrame, key: str, subject: str, object_: str, auxiliary: str) -> DataFrame:
    """(relation, id, role, place): ends of n-ary facts; ``auxiliary`` is an array of (role, ids), roles may be null."""
    ends = F.array(F.struct(F.lit("subject").alias("role"), F.array(subject).alias("ids")), F.struct(F.lit("object").alias("role"), F.array(object_).alias("ids")))
    more = F.transform(auxiliary, lambda x, i: F.struct(F.coalesce(x["role"], F.concat(F.lit("aux_"), (i + 1).cast("string"))).alias("role"), x["ids"].alias("ids")))
    rows = facts.select(F.col(key).alias("relation"), F.posexplode(F.concat(ends, more)).alias("place", "end"))
    return rows.select("relation", F.explode("end.ids").alias("id"), "end.role", "place").where("id IS NOT NULL")


def create_or_get(df: DataFrame, kind: str, name: str, order: str) -> DataFrame:
    """(kind, name, id): each distinct pair once, with id ``kind_n`` numbered from 0 as it first appears within its kind."""
    from pyspark.sql import Window

    first = df.groupBy(kind, name).agg(F.min(order).alias("__first"))
    at = F.row_number().over(Window.partitionBy(kind).orderBy("__first", name)) - 1
    return first.select(kind, name, F.concat(F.col(kind), F.lit("_"), at.cast("string")).alias("id"))


def related_edges(edges: DataFrame, seeds: DataFrame, budget: int, weight: str = "weight", source: str = "src", target: str = "dst") -> DataFrame:
    """(seed, src, dst, degree, weight, rank): each seed's edges, those of the best connected ends first, then the heaviest,
    as many as the budget allows."""
    from pyspark.sql import Window

    ranks = degrees(edges, source, target).select("id", "degree")
    ends = edges.select(F.col(source).alias("seed"), source, target, weight).unionByName(edges.where(F.col(source) != F.col(target)).select(F.col(target).alias("seed"), source, target, weight))
    mine = ends.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    scored = mine.join(ranks.select(F.col("id").alias(source), F.col("degree").alias("__d1")), source).join(ranks.select(F.col("id").alias(target), F.col("degree").alias("__d2")), target)
    scored = scored.withColumn("degree", F.col("__d1") + F.col("__d2"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("degree"), F.desc(weight), source, target))
    return scored.withColumn("rank", rank).where(F.col("rank") <= budget).select("seed", source, target, "degree", weight, "rank")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges among all nodes within ``depth`` steps of any seed (column ``id``)."""
    reached = k_hop(edges, seeds.select(F.col("id").alias("seed")), depth, source, target)
    return induced(edges, reached.select("id").distinct(), source, target)


def random_walks(edges: DataFrame, length: int, walks: int, seed: int = 0, source: str = "src", target: str = "dst") -> DataFrame:
    """(start, walk, path): uniform walks from every node; steps are drawn by hash, so reruns agree."""
    near = materialize(undirected(edges, source, target), "walk-near")
    lists = materialize(near.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("next")), "walk-lists")
    rows = lists.select(F.col("a").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")).withColumn("path", F.array("start"))
    for step in range(length - 1):
        here = rows.join(lists, F.element_at("path", -1) == F.col("a"))
        at = F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.size("next")).cast("int")
        rows = materialize(here.select("start", "walk", F.array_append("path", F.get("next", at)).alias("path")), "walk-rows")
    return rows


def node_vectors(edges: DataFrame, size: int = 16, length: int = 10, walks: int = 5, seed: int = 0, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, vector): skip-gram vectors of nodes over random walks, by the built-in Word2Vec."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths = random_walks(edges, length, walks, seed, source, target).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, minCount=0, seed=seed, inputCol="path", outputCol="v", windowSize=3).fit(paths)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vector"))
