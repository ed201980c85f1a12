"""Small cases with results worked out by hand."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fabula.functions import scores
from fabula.functions import text as tx
from fabula.operators import aggregates as agg
from fabula.operators import clustering as cl
from fabula.operators import graph as gr
from fabula.operators import ingestion as ing
from fabula.operators import nearby as nb
from fabula.operators import relational as rel
from fabula.operators import sequences as seq
from fabula.operators import state as st
from fabula.operators import vectors as ve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_week_key_joins_calendar_year_and_iso_week(spark):
    assert one(spark, agg.bucket_key(F.lit(dt.datetime(2024, 12, 30)), "week")) == "2024-W1"


def test_time_similarity_floors_days(spark):
    t, h = dt.datetime(2024, 1, 2, 12), dt.timedelta(hours=1)
    assert one(spark, scores.time_similarity(F.lit(t), F.lit(t + h))) == 1.0
    assert one(spark, scores.time_similarity(F.lit(t), F.lit(t - h))) == pytest.approx(0.9672161)
    assert one(spark, scores.time_similarity(F.lit(t), F.lit(None).cast("timestamp"))) == 0.5


def test_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)], "k string, v int")
    assert agg.upper_median(df, ["k"], "v").first()["upper_median"] == 3


def test_jaccard_of_empty_sets_is_zero(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, tx.set_jaccard(empty, empty)) == 0.0


def test_scores_worked_out_by_hand(spark):
    assert one(spark, scores.structural(F.lit(0), F.lit(0), F.lit(2))) == pytest.approx(0.18)
    assert one(spark, scores.fusion(F.lit(0.9), F.lit(None).cast("double"))) == pytest.approx(0.54)
    assert one(spark, scores.fusion(F.lit(0.9), F.lit(0.18))) == pytest.approx(0.612)


def test_budget_prefix(spark):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate((3, 4, 5))], "q string, i int, s int")
    assert rel.budget_prefix(df, ["q"], ["i"], "s", 7).count() == 2
    assert rel.budget_prefix(df, ["q"], ["i"], "s", 0).count() == 0


def test_quantise_round_trip(spark):
    v = F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)])
    assert one(spark, scores.dequantise(scores.quantise(v))) == pytest.approx([0.0, 0.5, 1.0], abs=1 / 255)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string")
    assert sorted(map(tuple, st.insert_ignore(old, new, "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, st.upsert(old, new.where("v <> 'e'"), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_range_join_meets_only_near_rows(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, t)], "u int, t0 timestamp")
    b = spark.createDataFrame([(1, t + dt.timedelta(seconds=s)) for s in (0, 1, 60, 61)], "u int, ts timestamp")
    assert seq.range_join(a, b, ["u"], "t0", "ts", 60).count() == 2


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src int, dst int")
    got = {(r["id"], r["component"]) for r in gr.components(df).collect()}
    assert got == {(i, 0) for i in range(21)} | {(50, 50), (51, 50)}


def test_dbscan_core_border_and_noise(spark):
    near = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    points = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    got = {r["id"]: r["cluster"] for r in cl.dbscan(near, points, 3).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: -1}


def test_triangle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = {r["id"]: (r["triangles"], round(r["coefficient"], 4)) for r in gr.clustering(df).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 0.3333), 4: (0, 0.0)}


def test_unknown_operator_raises():
    with pytest.raises(ValueError):
        rel.conjunction({"a": ("like", "x")})


def test_cosine_neighbours_cross_labels(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 2, [1.0, 0.1]), (4, 0, [0.0, 1.0]), (5, 0, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    near = ve.all_within_cosine(df, "vec_id", "embedding", 0.9)
    assert sorted((r["a"], r["b"]) for r in near.collect()) == [(1, 2), (1, 3), (2, 3)]
    found = cl.dbscan(near, df.select(F.col("vec_id").alias("id")), 3)
    assert {r["id"]: r["cluster"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: -1, 5: -1}


def test_graph_queries_see_every_event(spark, sf_dir):
    """Brute force over all events, for the queries that have no SQL."""
    import collections

    from fabula.plans.catalog import QUERIES

    by = collections.defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "user_id").collect(), key=lambda r: (r["ts"], r["event_id"])):
        by[r["event_type"]].append(r["user_id"])
    edges = {(a, b) for users in by.values() for a, b in zip(users, users[1:]) if a != b}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    least = {i: i for i in near}
    for _ in near:
        least = {i: min([least[i], *(least[j] for j in near[i])]) for i in near}
    assert {r["id"]: r["component"] for r in QUERIES["connected_components"](spark, sf_dir).collect()} == least
    out = collections.Counter(a for a, _ in edges)
    rank = {i: 1 / len(near) for i in near}
    for _ in range(10):
        loose = sum(r for i, r in rank.items() if not out[i])
        rank = {i: (0.15 + 0.85 * loose) / len(near) + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == i) for i in near}
    assert {r["id"]: r["rank"] for r in QUERIES["page_rank"](spark, sf_dir).collect()} == pytest.approx(rank)
    score = {i: 1.0 for i in near}
    for _ in range(10):
        score = {i: score[i] + sum(score[j] for j in near[i]) for i in near}
        norm = sum(s * s for s in score.values()) ** 0.5
        score = {i: s / norm for i, s in score.items()}
    assert {r["id"]: r["score"] for r in QUERIES["eigenvector_centrality"](spark, sf_dir).collect()} == pytest.approx(score)
    label = {i: i for i in near}
    for _ in range(5):
        votes = {i: collections.Counter([label[i], *(label[j] for j in near[i])]) for i in near}
        label = {i: min(v, key=lambda c: (-v[c], c)) for i, v in votes.items()}
    sizes = collections.Counter(label.values())
    want = {i: c for i, c in label.items() if sizes[c] >= 3}
    assert {r["id"]: r["community"] for r in QUERIES["communities"](spark, sf_dir).collect()} == want


def test_contained_terms_of_any_length(spark):
    long = "x" * 70 + "needle in a haystack" + "y" * 70
    terms = [long, "needle in a haystack", "needle in", "needle on a haystack", "y" * 70, "q", "", None]
    df = spark.createDataFrame([(t,) for t in terms for _ in range(2)], "term string")
    known = [t for t in terms if t is not None]
    want = {(a, b, 4) for a in known for b in known if a != b and a in b}
    assert {tuple(r) for r in rel.contained_terms(df, "term", "term").collect()} == want


def _shortest(adjacent, s):
    """Distances and numbers of shortest paths from one node, breadth first."""
    far, ways, front = {s: 0}, {s: 1}, [s]
    while front:
        step = []
        for v in front:
            for w in adjacent[v]:
                if w not in far:
                    far[w], ways[w] = far[v] + 1, 0
                    step.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
        front = step
    return far, ways


def test_centralities_equal_brute_force(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(18), 2))) for _ in range(24)} | {(30, 31), (31, 32)})
    adjacent = defaultdict(set)
    for a, b in edges:
        adjacent[a].add(b)
        adjacent[b].add(a)
    table = spark.createDataFrame(edges, "src long, dst long")
    n, found = len(adjacent), {s: _shortest(adjacent, s) for s in adjacent}
    got = {(r["s"], r["v"]): (r["d"], r["n"]) for r in gr.distances(table).collect()}
    assert got == {(s, v): (d, found[s][1][v]) for s in found for v, d in found[s][0].items()}
    close = {r["id"]: r["closeness"] for r in gr.closeness(table).collect()}
    passed = {r["id"]: r["betweenness"] for r in gr.betweenness(table).collect()}
    for v in adjacent:
        far = found[v][0]
        assert close[v] == pytest.approx((len(far) - 1) / sum(far.values()) * (len(far) - 1) / (n - 1))
        share = sum(
            found[s][1][v] * found[v][1][t] / found[s][1][t] for s in found for t in found[s][0]
            if v not in (s, t) and s != t and v in found[s][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]
        )
        assert passed[v] == pytest.approx(share / ((n - 1) * (n - 2)))
    assert not gr.path_lengths(table).first()["connected"]


def test_communities_by_modularity(spark):
    cliques = [(c * 10 + i, c * 10 + j) for c in range(4) for i in range(6) for j in range(i)] + [(0, 10), (10, 20), (20, 30)]
    table = spark.createDataFrame(cliques, "src long, dst long")
    found = {r["id"]: r["community"] for r in gr.louvain(table).collect()}
    assert found == {c * 10 + i: c * 10 for c in range(4) for i in range(6)}
    whole = gr.modularity(table, gr.louvain(table)).first()[0]
    assert whole > 0.65 > gr.modularity(table, gr.undirected(table).select(F.col("a").alias("id"), F.lit(1).alias("community")).distinct()).first()[0]


def test_walks_follow_edges(spark):
    table = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)], "src long, dst long")
    rows = gr.random_walks(table, 5, 3).collect()
    assert len(rows) == 21 and all(abs(a - b) in (1, 6) for r in rows for a, b in zip(r["path"], r["path"][1:]))
    assert {(r["start"], r["walk"]): r["path"] for r in rows} == {(r["start"], r["walk"]): r["path"] for r in gr.random_walks(table, 5, 3).collect()}


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_first_unlike_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé", k=rng.randint(0, 14))) for _ in range(25)]
    texts = [t if rng.random() < 0.4 else t[:4] + rng.choice("xyz") + t[5:] for t in base * 3] + ["", None, ""]
    for a, b in zip(texts[:40], texts[7:47]):
        assert nb.common_length(a or "", b or "") == _common(a or "", b or "")
    kept = []
    for i, t in enumerate(texts):
        t = t or ""
        if not any((2 * _common(t, texts[j] or "") / (len(t) + len(texts[j] or "")) if t or texts[j] else 1.0) > 0.6 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert sorted(r["k"] for r in nb.first_unlike(df, "k", "t", 0.6).collect()) == kept
    assert nb.first_unlike(df.limit(0), "k", "t").count() == 0


def test_blocks_meet_every_pair_once(spark, monkeypatch):
    rng = random.Random(1)
    points = [(i, [rng.random(), rng.random()]) for i in range(120)]
    df = spark.createDataFrame(points, "k long, v array<double>")
    near = lambda most: {(a, b) for a, x in points for b, y in points if a < b and (x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 <= most * most}
    for block in (4096, 17):
        monkeypatch.setattr(ve, "BLOCK", block)
        got = [tuple(r) for r in nb.within_distance(df, "k", "v", 0.2).collect()]
        assert len(got) == len(set(got)) and set(got) == near(0.2)
        top = ve.knn(df, df.where("k < 5"), "k", "v", 4).collect()
        assert len(top) == 20 and all(r["query_id"] != r["id"] for r in top)


def test_models_that_fail_leave_rows(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "k long, t string")

    def answer(texts):
        if "bad" in texts:
            raise RuntimeError
        return [f"<{t}>" for t in texts]

    assert {r["k"]: r["answer"] for r in ing.call(df, "k", "t", answer, batch=1).collect()} == {1: "<good>", 2: None, 3: "<>"}
    assert {r["k"]: r["vector"] for r in ing.embed(df, "k", "t", lambda texts: [[1.0, 2.0] for _ in answer(texts)], 2, batch=1).collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_numbering_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "a", "b"]) if i % 3 else "hot", rng.randint(0, 50), i) for i in range(500)]
    out = rel.numbered(spark.createDataFrame(rows, "g string, o int, i int"), ["g"], ["o", "i"], "n").collect()
    for g in {r[0] for r in rows}:
        own = sorted((o, i) for x, o, i in rows if x == g)
        assert {(r["o"], r["i"]): r["n"] for r in out if r["g"] == g} == {key: at + 1 for at, key in enumerate(own)}
