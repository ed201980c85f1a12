"""What queries write between their steps grows with their input and result, not with what they rule out."""

import pytest

from fabula.operators import graph as gr
from fabula.sources.scratch import materialize as rel_materialize


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that graph operators write."""
    rows: list[int] = []

    def counted(df, label, write=gr.materialize):
        out = write(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(gr, "materialize", counted)
    return rows


def test_pairs_of_a_hub_do_not_list_its_leaves(spark, written):
    n = 400
    edges = spark.range(1, n + 1).selectExpr("0L AS src", "id AS dst")
    pairs = spark.range(1, n).selectExpr("id AS a", "id + 1 AS b")
    assert {(r["hops"]) for r in gr.shortest_hops(edges, pairs, 2).collect()} == {2}
    assert sum(written) < 10 * n


def test_hops_of_pairs_equal_plain_search(spark):
    links = [(i, (i * i + 3) % 23) for i in range(23)] + [(30, 31)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    pairs = [(a, b) for a in range(23) for b in range(23)] + [(30, 31), (30, 1), (99, 99), (1, 1)]
    want = []
    for a, b in pairs:
        seen, front = {a}, {a}
        for hop in range(5):
            if b in front:
                want.append((a, b, hop))
                break
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
    got = gr.shortest_hops(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(pairs, "a long, b long"), 4)
    assert sorted(tuple(r) for r in got.select("a", "b", "hops").collect()) == sorted(want)


def some_edges(spark):
    """Two parts, a long arm and a hub: many levels, several shortest paths, pairs that are not connected."""
    links = [(i, (i * i + 3) % 23) for i in range(23)] + [(40 + i, 41 + i) for i in range(12)] + [(100, 100 + i) for i in range(1, 90)] + [(100, 3)]
    return spark.createDataFrame(links, "src long, dst long")


def plain(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("name", ["distances", "closeness", "path_lengths", "betweenness"])
def test_searches_in_tasks_equal_rounds_of_joins(spark, written, monkeypatch, name):
    """All pairs of nodes are found in tasks without being written between rounds; beyond the bound by rounds, with equal results."""
    edges = some_edges(spark)
    inside = plain(getattr(gr, name)(edges))
    n = edges.select("src").union(edges.select("dst")).distinct().count()
    assert sum(written) < 10 * n
    monkeypatch.setattr(gr.reach, "MOST_ENDS", 0)
    assert plain(getattr(gr, name)(edges)) == inside


def test_points_meet_on_tiles_and_crowds_are_dealt(spark, monkeypatch):
    import numpy as np

    from fabula.operators import nearby as nb

    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(-3, 3, (500, 3)), np.round(rng.uniform(-0.4, 0.4, (300, 3)), 1), np.full((40, 3), 0.2)])
    sent = []
    monkeypatch.setattr(nb, "CROWD", 60)
    monkeypatch.setattr(nb, "materialize", lambda df, label, write=nb.materialize: sent.append(write(df, label)) or sent[-1])
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(9000, None)], "k long, v array<double>")
    got = [tuple(r) for r in nb.within_distance(df, "k", "v", 0.3).collect()]
    i, j = np.nonzero(((v[:, None] - v) ** 2).sum(axis=2) <= 0.09 + 2e-12)
    assert sorted(got) == sorted((int(a), int(b)) for a, b in zip(i, j) if a < b)
    assert sum(t.count() for t in sent) < 2 * len(v)


def test_names_meet_once_for_all_their_rows(spark, monkeypatch):
    from fabula.operators import entities as er

    scored = []
    monkeypatch.setattr(er, "materialize", lambda df, label, write=er.materialize: scored.append(write(df, label)) or scored[-1])
    names = ["Alpha Beta Inc.", "alpha beta", "Alpha Betas", "Gamma", None, "Alpha Beta Alpha"]
    df = spark.createDataFrame([(i, names[i % 6], i % 6 // 5) for i in range(60)], "id long, name string, kind int")
    got = {(r["a"], r["b"]): r["score"] for r in er.duplicate_pairs(df, "id", "name", "kind").collect()}
    text = {0: "alpha beta", 1: "alpha beta", 2: "alpha betas", 3: "gamma", 5: "alpha beta alpha"}
    want = {}
    for a in range(60):
        for b in range(a + 1, 60):
            x, y = text.get(a % 6), text.get(b % 6)
            if x and y and a % 6 // 5 == b % 6 // 5 and (x == y or {x, y} == {"alpha beta", "alpha betas"}):
                want[a, b] = 1.0 if x == y else 1 - 1 / 11
    assert got == pytest.approx(want)
    assert scored[0].count() == 4  # distinct names of a kind


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0])
def test_sets_that_only_meet_are_not_written(spark, monkeypatch, threshold):
    """Every set holds the same rare item, few are similar; equal sets, one item and empty sets too."""
    import random

    from fabula.operators import relational as rel

    rng, wrote = random.Random(3), []
    monkeypatch.setattr(rel, "materialize", lambda df, label, write=rel.materialize: wrote.append(write(df, label)) or wrote[-1])
    sets = {i: {f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))} for i in range(60)}
    sets |= {60 + i: {"x", *(f"y{i}-{j}" for j in range(3))} for i in range(200)} | {300: set()}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "k long, s array<string>")
    got = {(r["a"], r["b"]): r["jaccard"] for r in rel.set_jaccard(df, "k", "s", threshold).collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert got == pytest.approx(want)
    shuffled = rel.similar_sets(df.where("k < 300").dropDuplicates(["s"]), threshold)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in shuffled  # pairs that meet are decided where they meet
    assert sum(t.count() for t in wrote) < 10 * len(sets)


@pytest.mark.parametrize("dense", [1024, 3])
@pytest.mark.parametrize("similarity", [0.0, 0.4, 0.5, 1.0])
def test_patterns_meet_once_for_all_equal_sets(spark, monkeypatch, dense, similarity):
    """Many patterns of few sets, ties of support and empty sets; nothing is written for pairs."""
    import random

    from fabula.operators import mining as mn

    rng, wrote = random.Random(5), []
    monkeypatch.setattr(mn, "DENSE", dense)
    for module in (mn, mn.similar_sets.__globals__):
        put = monkeypatch.setitem if isinstance(module, dict) else monkeypatch.setattr
        put(module, "materialize", lambda df, label, write=rel_materialize: wrote.append(write(df, label)) or wrote[-1])
    kinds = [sorted(f"w{c}" for c in rng.sample(range(12), rng.randrange(1, 8))) for _ in range(60)] + [[]]
    rows = [(i, rng.choice(kinds), rng.randrange(8)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, s array<string>, n int")
    got = sorted(r["k"] for r in mn.prune_patterns(df, "k", "s", "n", 2, similarity).collect())
    strong = [(k, set(s), n) for k, s, n in rows if n >= 2]
    beats = lambda q, p: (-q[2], q[0]) < (-p[2], p[0]) and q[1] and p[1] and len(q[1] & p[1]) / len(q[1] | p[1]) >= similarity
    assert got == sorted(p[0] for p in strong if not any(beats(q, p) for q in strong))
    assert sum(t.count() for t in wrote) < 4 * len(rows)


@pytest.mark.parametrize("front", [5, 2048])
def test_like_texts_are_not_linked_with_each_other(spark, monkeypatch, front):
    """600 texts that are all like the first of their kind: what is written follows texts, not pairs."""
    from fabula.operators import nearby as nb

    wrote = []
    monkeypatch.setattr(nb, "FRONT", front, raising=False)
    monkeypatch.setattr(nb, "materialize", lambda df, label, write=nb.materialize: wrote.append(write(df, label).count()) or write(df, label))
    texts = {i: f"{i:03d}" + "abc"[i % 3] * 20 for i in range(600)} | {600 + i: chr(200 + i) * 9 for i in range(12)} | {700: None, 701: "", 702: "000" + "a" * 20}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = sorted(r["k"] for r in nb.first_unlike(df.repartition(5), "k", "t", 0.6).collect())
    assert got == [0, 1, 2, *range(600, 612), 700]
    assert sum(wrote) < 3 * len(texts)


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("min_points", [1, 3, 12])
def test_density_clusters_link_cells(spark, monkeypatch, dims, min_points):
    """Clumps, lattices on the bound, copies, a sparse field and a null, against clusters of all pairs."""
    import numpy as np

    from fabula.operators import clustering as cl

    wrote, rng = [], np.random.default_rng(dims)
    for module in (cl, gr):
        monkeypatch.setattr(module, "materialize", lambda df, label, write=module.materialize: wrote.append(write(df, label)) or wrote[-1])
    counted = wrote.__len__
    v = np.concatenate([rng.normal(0, 0.1, (400, dims)), rng.uniform(-4, 4, (300 if dims < 3 else 900, dims)), np.arange(60)[:, None] % 8 * 0.2 + np.zeros(dims), np.full((200, dims), 3.3)])
    v = v[rng.permutation(len(v))]
    n, near = len(v), ((v[:, None] - v) ** 2).sum(axis=2) <= 0.04 + 2e-12
    core = near.sum(axis=1) >= min_points
    label = np.where(core, np.arange(n), n)
    while True:
        new = np.where(core, np.where(near & core, label, n).min(axis=1), n)
        if (new == label).all():
            break
        label = new
    want = {i: int(c) if c < n else -1 for i, c in enumerate(np.where(near & core, label, n).min(axis=1))} | {9000: -1}
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(9000, None)], "k long, v array<double>")
    out = cl.density(df, "k", "v", 0.2, min_points)
    assert {r["id"]: r["cluster"] for r in out.collect()} == want
    assert counted() and wrote[0].count() < 8 * n  # points and links of cells; pairs within clumps and copies are many more
    assert near.sum() > 20 * n


def packed_graph(links):
    import numpy as np
    import pyarrow as pa

    from fabula.operators import reach

    both = np.unique(np.array([*links, *((b, a) for a, b in links)]), axis=0)
    counts = np.bincount(both[:, 0]).astype(np.int32)
    return reach.Graph([{"counts": counts.tobytes(), "ends": both[:, 1].astype(np.int32).tobytes()}], pa.array(np.arange(len(counts))))


def test_searches_look_at_the_front_only(monkeypatch):
    """On a long path a block of sources sums rows near its fronts, not every open row at every distance."""
    import numpy as np
    import pytest as pt

    from fabula.operators import reach

    n, looked = 600, []
    monkeypatch.setattr(reach.Graph, "sums", lambda self, rows, *rest, plain=reach.Graph.sums: looked.append(len(rows)) or plain(self, rows, *rest))
    g = packed_graph([(i, i + 1) for i in range(n - 1)])
    total = sum(g.passed(np.arange(at, at + 30)) for at in range(0, n, 30))
    assert total == pt.approx([2.0 * i * (n - 1 - i) for i in range(n)])
    assert sum(looked) < (n // 30) * 100 * n


@pytest.mark.parametrize("small", [False, True])
def test_searches_count_paths_exactly(monkeypatch, small):
    """Whole layers linked with the next: numbers of paths pass every integer's width; also with tiny stretches and hubs."""
    import numpy as np

    from fabula.operators import reach

    if small:
        monkeypatch.setattr(reach, "STRETCH", 7)
        monkeypatch.setattr(reach, "CACHED", 16)
    wide, layers = 9, 14
    links = [(i * wide + a, (i + 1) * wide + b) for i in range(layers - 1) for a in range(wide) for b in range(wide)]
    g = packed_graph(links)
    for _ in range(2):  # the second time, sizes of components are known
        d, number, fronts = g.search(np.array([0, 5]))
        assert (d[wide:, 0] == np.repeat(np.arange(1, layers), wide)).all() and d[1, 0] == 2
        assert (number[wide:, 0] == np.repeat(float(wide) ** np.arange(layers - 1), wide)).all()
        assert len(fronts) == layers
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = np.zeros(wide * layers)
    for s in (0, 5):  # Brandes, one source at a time
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
        for v in order[1:]:
            want[v] += delta[v]
    assert np.allclose(g.passed(np.array([0, 5])), want, rtol=1e-12)


def test_names_of_a_common_word_are_scored_in_blocks(spark, monkeypatch):
    """One word in every name: scores leave in lists, no row is made for a pair before it has passed."""
    import random

    from fabula.operators import entities as er

    rng, out = random.Random(2), []
    monkeypatch.setattr(er, "BLOCK", 60)
    monkeypatch.setattr(er, "CROWD", 9)
    monkeypatch.setattr(er, "TILE", 50)
    monkeypatch.setattr(er, "_crowds", lambda *args, plain=er._crowds: out.append(plain(*args)) or out[-1])
    words = ["tower", "beton", "x", "zz", "longer word", "towers"]
    rows = [(i, "all " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), i % 2, [["p", "q"], ["q"], [], None, ["z"]][rng.randrange(5)]) for i in range(160)]
    rows += [(200 + i, f"all n{i:03d}", 0, []) for i in range(90)] + [(300, "all", 0, None), (301, "", 1, []), (302, "", 1, ["p"]), (303, None, 1, [])]
    df = spark.createDataFrame(rows, "id long, name string, kind int, al array<string>")
    for aliases in (None, "al"):
        got = sorted((r["a"], r["b"], round(r["score"], 9)) for r in er.duplicate_pairs(df, "id", "name", "kind", aliases, 0.6).collect())
        want = []
        for a, x, k, s in rows:
            for b, y, other, t in rows:
                if a < b and k == other and x is not None and y is not None and set(x.split(" ")) & set(y.split(" ")):
                    line = list(range(len(y) + 1))
                    for i, c in enumerate(x):
                        line = _next(line, i, c, y)
                    score = 1 - line[-1] / max(len(x), len(y)) if x or y else 1.0
                    if aliases and s and t:
                        score = max(score, len(set(s) & set(t)) / len(set(s) | set(t)))
                    if score >= 0.6:
                        want.append((a, b, round(score, 9)))
        assert got == sorted(want)
        assert out[-1].count() < len(want) / 2


def _next(line, i, c, y):
    new = [i + 1]
    for j, e in enumerate(y):
        new.append(min(line[j] + (c != e), line[j + 1] + 1, new[j] + 1))
    return new


def test_distances_come_by_node_for_a_block_of_sources(spark):
    """Files of the result hold runs of one node with the same sources over and over, so they take few bytes a row."""
    edges = spark.range(600).selectExpr("id AS src", "(id * 7 + 3) % 600 AS dst").union(spark.range(600).selectExpr("id", "(id + 1) % 600"))
    rows = gr.distances(edges).select("v").toPandas()["v"].to_numpy()
    assert len(rows) == 600 * 600
    assert (rows[1:] != rows[:-1]).sum() < len(rows) / 20
