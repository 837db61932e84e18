import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import components as N
from quillgraph.operators import graph as G
from quillgraph.operators import graph_rounds as R
from quillgraph.plans import rounds

PAIRS = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


@pytest.fixture(scope="module")
def bridge(spark):
    """Two triangles joined by one edge."""
    nodes = spark.range(1, 7)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in PAIRS], "src bigint, dst bigint, weight double")
    return nodes, edges


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_bridge_measures(bridge):
    nodes, edges = bridge
    links = G.adjacency(edges)
    assert G.graph_size(nodes, edges).first()["density"] == pytest.approx(0.466667, abs=1e-6)
    dist = R.distances(links, nodes)
    stats = R.path_stats(dist).first()
    assert (stats["diameter"], stats["mean_path"]) == (3, 1.8)
    cc = by_id(G.clustering_coefficient(nodes, edges), "coefficient")
    assert cc[3] == cc[4] == pytest.approx(1 / 3) and cc[1] == 1
    for measure in (R.betweenness, R.weighted_betweenness):
        b = by_id(measure(nodes, links, nodes), "betweenness")
        assert b[3] == b[4] == pytest.approx(0.6) and b[1] == pytest.approx(0)
    close = by_id(R.closeness(dist, nodes), "closeness")
    assert close[3] == pytest.approx(0.714286, abs=1e-6) and close[1] == pytest.approx(0.5)
    rank = by_id(R.pagerank(nodes, links, 20, 0), "rank")
    assert rank[3] == pytest.approx(0.208029, abs=1e-6) and rank[1] == pytest.approx(0.145985, abs=1e-6)
    halves = nodes.withColumn("cluster", (F.col("id") > 3).cast("int"))
    assert G.modularity(G.Graph(nodes, edges), halves).first()[0] == pytest.approx(0.357143, abs=1e-6)


def test_closeness_and_rank_only_where_computed(spark, bridge):
    nodes, edges = bridge
    links = G.adjacency(edges)
    few = R.distances(links, nodes.where("id IN (1, 3)"))
    assert set(by_id(R.closeness(few, nodes), "closeness")) == {1, 3}
    assert set(by_id(R.closeness(few, nodes.where("id > 3")), "closeness").values()) == {0.0}
    with pytest.raises(RuntimeError):
        R.pagerank(nodes, links, 2, 1e-12)
    assert R.sampled_sources(nodes, 4).count() == 4 and R.sampled_sources(nodes, 100).count() == 6


def test_weighted_paths_move_by_node_and_not_by_edge(spark, monkeypatch):
    """Pieces, text ids, equal and parallel lengths, groups of sources and blocks of nodes; against paths listed one by one."""
    monkeypatch.setattr(R, "AT_ONCE", 5)
    monkeypatch.setattr(R.factors, "AT_ONCE", 3)
    joined = []
    monkeypatch.setattr(R.factors, "least", lambda *a, run=R.factors.least: joined.append(a[2]) or run(*a))
    rng = random.Random(8)
    lines = [(a, b, rng.choice([0.1, 0.2, 0.3])) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.5]
    lines += [(*lines[0][:2], lines[0][2]), (8, 9, 0.1), (9, 10, 2.5)]  # a line twice, and a piece of its own
    name = "n{:02}".format
    both = [(name(x), name(y), w) for a, b, w in lines for x, y in ((a, b), (b, a))]
    links = spark.createDataFrame(both, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(name(i),) for i in range(12)], "id string")

    def paths(a):
        found, front = {}, [([a], 0.0)]
        while front:
            front = [([*p, y], d + w) for p, d in front for x, y, w in both if x == p[-1] and y not in p]
            for p, d in front:
                found.setdefault(p[-1], []).append((round(d, 9), p))
        return {b: [p for d, p in every if d == min(every)[0]] for b, every in found.items()}, {b: min(every)[0] for b, every in found.items()}

    want, far = dict.fromkeys(map(name, range(12)), 0.0), {}
    for a in want:
        short, length = paths(a)
        far |= {(a, b): d for b, d in length.items()} | {(a, a): 0.0}
        for every in short.values():
            for p in every:
                for between in p[1:-1]:
                    want[between] += 1 / len(every) / (11 * 10)
    got = by_id(R.weighted_betweenness(nodes, links, nodes), "betweenness")
    assert got == pytest.approx(want, abs=1e-9) and max(want.values()) > 0
    assert joined and max(joined) <= 8
    dist = {(r["source"], r["id"]): r["dist"] for r in R.weighted_distances(links, nodes).collect()}
    assert dist == pytest.approx(far)
    still = links.withColumn("weight", F.when(F.col("weight") < 0.15, 0.0).otherwise(F.col("weight")))
    assert R.weighted_distances(still, nodes).count() == len(far)  # lengths of zero end too


def test_weighted_betweenness_starts_from_every_part(spark, monkeypatch):
    """All parts are sources, in groups side by side; a turn of one group after the other gives the same."""
    asked = []
    monkeypatch.setattr(R, "weighted_betweenness", lambda nodes, links, sources, run=R.weighted_betweenness: asked.append(
        (nodes.count(), sources.count())) or run(nodes, links, sources))
    monkeypatch.setattr(R, "AT_ONCE", 20)
    side = by_id(rounds.weighted_betweenness(spark, "/root/testdata/sf0.001"), "betweenness")
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert asked == [(n, n)] and len(side) == n > R.AT_ONCE
    turns = []
    monkeypatch.setattr(R, "HELD", 1)
    monkeypatch.setattr(R, "_weighted_dependencies", lambda *a, run=R._weighted_dependencies: turns.append(a[2]) or run(*a))
    monkeypatch.setattr(R, "AT_ONCE", 80)
    assert by_id(rounds.weighted_betweenness(spark, "/root/testdata/sf0.001"), "betweenness") == pytest.approx(side)
    assert len(turns) == -(-n // 80)


def test_path_counts_move_by_node_and_not_by_edge(spark, monkeypatch):
    """A graph in two pieces, text ids, sources in groups, one of them without edges; against paths counted one by one."""
    monkeypatch.setattr(R, "AT_ONCE", 6)
    joined = []
    monkeypatch.setattr(R.factors, "times", lambda *a, run=R.factors.times: joined.append(a[2]) or run(*a))
    rng = random.Random(5)
    pairs = [p for p in itertools.combinations(range(9), 2) if rng.random() < 0.35] + [(9, 10), (10, 11)]
    name = "n{:02}".format
    edges = spark.createDataFrame([(name(a), name(b), 1.0) for a, b in pairs], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(name(i),) for i in range(13)], "id string")
    got = by_id(R.betweenness(nodes, G.adjacency(edges), nodes), "betweenness")
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(13)}

    def paths(a, b):
        front = [[a]]
        while front and not any(p[-1] == b for p in front):
            front = [p + [x] for p in front for x in near[p[-1]] if x not in p]
        return [p for p in front if p[-1] == b]

    want = dict.fromkeys(range(13), 0.0)
    for a, b in itertools.permutations(range(13), 2):
        found = paths(a, b)
        for p in found:
            for x in p[1:-1]:
                want[x] += 1 / len(found) / (12 * 11)
    assert got == {name(i): pytest.approx(want[i]) for i in want} and max(want.values()) > 0 and 2 < max(joined) < 13


def test_distances_from_more_sources_than_bits(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "src bigint, dst bigint, weight double")
    found = R.distances(G.adjacency(chain), spark.range(200)).collect()
    got = {(r["source"], r["id"]): r["dist"] for r in found}
    want = {(a, b): abs(a - b) for a in range(10) for b in range(10)} | {(a, a): 0 for a in range(10, 200)}
    assert len(found) == len(got) and got == want
    assert R.distances(G.adjacency(chain), spark.range(0)).count() == 0


def test_weighted_distances_on_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src bigint, dst bigint, weight double")
    far = R.weighted_distances(G.adjacency(chain), spark.range(1))
    assert by_id(far, "dist") == {i: float(i) for i in range(13)}


def test_louvain_on_text_ids(spark):
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in PAIRS], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(1, 7)], "id string")
    labels = by_id(R.louvain(nodes, edges), "cluster")
    assert labels["n1"] == labels["n2"] == labels["n3"] != labels["n4"] == labels["n5"] == labels["n6"]


def test_louvain_finds_the_triangles(bridge):
    nodes, edges = bridge
    labels = by_id(R.louvain(nodes, edges), "cluster")
    assert labels[1] == labels[2] == labels[3] != labels[4] == labels[5] == labels[6]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 51)], "src bigint, dst bigint")
    stars = spark.createDataFrame([("h", 51), ("h", 60), ("h", 61)], "hub string, id bigint")
    found = by_id(N.components(spark.range(70), edges, stars), "component")
    assert {found[i] for i in range(41)} == {0} and found[61] == found[50] == 50 and found[45] == 45
    none = edges.where("src < 0")
    assert by_id(N.components(spark.range(3), none), "component") == {0: 0, 1: 1, 2: 2}


@pytest.fixture(scope="module")
def articles(spark):
    data = [(1, ["a", "b"], [2, 100, 101], "V"), (2, ["b"], [1, 100, 101], "V"), (3, ["c"], [100], ""), (4, None, None, None)]
    return spark.createDataFrame(data, "id bigint, authors array<string>, references array<bigint>, venue string")


def test_article_graphs(articles, spark):
    assert [tuple(r) for r in G.coupling_edges(articles, 2).collect()] == [(1, 2, 2.0)]
    graph = G.combined_graph(articles)
    listed = {(r["src"], r["dst"]): r["weight"] for r in G.edges_among(graph, articles.select("id"), 10).collect()}
    assert listed == {(1, 2): 2.5, (1, 3): 0.1, (2, 3): 0.1}
    degree = by_id(G.weighted_degrees(graph), "degree")
    assert degree[1] == pytest.approx(2.6) and degree[3] == pytest.approx(0.2) and degree[4] == 0
    with pytest.raises(ValueError):
        G.edges_among(graph, articles.select("id"), 2)


def brute_shared(sets, least):
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n >= least:
            out[(a, b)] = n
    return out


def test_shared_pairs_against_all_pairs_with_a_hot_hub(spark):
    sets = {i: {"hot"} | {f"h{(i * k) % 7}" for k in range(1, 4)} for i in range(60)}
    members = spark.createDataFrame([(h, i) for i, s in sets.items() for h in s], "hub string, id bigint")
    for least in (2, 3, 4):
        got = {(r["src"], r["dst"]): r["shared"] for r in G.shared_pairs(members, least).collect()}
        assert got == brute_shared(sets, least)


def test_combined_graph_caps_shared_references(spark):
    refs = list(range(100, 108))
    data = [(1, [], refs, None), (2, [], refs, None), (3, [], refs[:2], None)]
    df = spark.createDataFrame(data, "id bigint, authors array<string>, references array<bigint>, venue string")
    degree = by_id(G.weighted_degrees(G.combined_graph(df)), "degree")
    assert degree[1] == pytest.approx(0.5 + 0.2) and degree[3] == pytest.approx(0.4)


def test_walks_follow_edges_and_do_not_depend_on_partitions(bridge):
    nodes, edges = bridge
    links = G.adjacency(edges)
    walks = R.random_walks(nodes, links, 5, 6).collect()
    known = {(a, b) for a, b in PAIRS} | {(b, a) for a, b in PAIRS}
    assert len(walks) == 30 and all(len(w["path"]) == 6 for w in walks)
    assert all(step in known for w in walks for step in zip(w["path"], w["path"][1:]))
    again = R.random_walks(nodes.repartition(3), links.repartition(5), 5, 6).collect()
    assert sorted(map(tuple, [(w["start"], w["walk"], tuple(w["path"])) for w in walks])) == sorted(
        (w["start"], w["walk"], tuple(w["path"])) for w in again)


def test_dead_ends_and_embeddings(spark):
    nodes = spark.range(4)
    links = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src bigint, dst bigint, weight double")
    walks = R.random_walks(nodes, links, 2, 5)
    paths = {tuple(w["path"]) for w in walks.collect()}
    assert paths == {(0, 1, 2), (1, 2), (2,), (3,)}
    known = spark.createDataFrame([(1, [2.0, 4.0])], "id bigint, vec array<double>")
    got = by_id(R.neighbour_means(nodes, G.adjacency(links), known, 2), "vec")
    assert got[0] == [2.0, 4.0] and got[2] == [2.0, 4.0] and max(map(abs, got[3])) <= 0.1


def test_prune(spark):
    edges = spark.createDataFrame([(i, i + 1, float(i)) for i in range(11)], "src bigint, dst bigint, weight double")
    assert G.prune_edges(edges, 0.0).count() == 11
    assert G.prune_edges(edges, 0.8).count() == 3


def test_heavy_keys_are_split_and_others_are_not_copied(spark):
    from quillgraph.operators import scale

    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("key"), "id")
    small = spark.createDataFrame([(-1, "hot"), (1, "one"), (3, "three"), (999, "none")], "key bigint, name string")
    dealt = scale.deal(rows, "key", "id", least=100)
    assert [(r["key"], r["_salts"]) for r in dealt.heavy.collect()] == [(-1, 20)]
    sizes = dealt.rows.where("key = -1").groupBy("_salt").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 200
    got = dealt.meet(small).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"hot": 2000, "one": 8, "three": 8}
    assert dealt.meet(small, "left").count() == 4000
    assert scale.deal(rows.where("key >= 0"), "key", "id", least=100).heavy.isEmpty()


def test_diameter_is_exact(spark):
    rng = np.random.default_rng(21)
    for n, extra in ((40, 0), (60, 25), (30, 200)):
        pairs = {(i, int(rng.integers(max(0, i - 4), i))) for i in range(1, n)} | {tuple(sorted(map(int, p), reverse=True)) for p in rng.integers(0, n, (extra, 2)) if p[0] != p[1]}
        far = np.where(np.eye(n, dtype=bool), 0, n)
        for a, b in pairs:
            far[a, b] = far[b, a] = 1
        for k in range(n):
            far = np.minimum(far, far[:, k, None] + far[None, k, :])
        edges = spark.createDataFrame([(b, a, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")
        assert R.diameter(spark.range(n), G.adjacency(edges), at_once=6) == far.max()
    assert R.diameter(spark.range(1), G.adjacency(edges.where("false"))) == 0


def test_structure_stats(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)], "src bigint, dst bigint, weight double")
    groups = spark.createDataFrame([(i, int(i > 3)) for i in range(8)], "id bigint, cluster int")
    got = {r["metric"]: r["value"] for r in R.structure_stats(spark.range(8), edges, groups).collect()}
    assert got == {"components": 4, "largest": 4, "share": 0.5, "diameter": 2, "communities": 2, "largest_community": 4, "modularity": 0.32}


def test_centralities(spark):
    """A path 0-1-2-3 with a triangle at its end, and a node alone; all nodes are sources."""
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0)], "src bigint, dst bigint, weight double")
    got = {r["id"]: r for r in R.centralities(spark.range(6), edges).collect()}
    assert got[5]["closeness"] == got[5]["betweenness"] == got[5]["coefficient"] == 0
    assert got[2]["betweenness"] == pytest.approx(2 * 4 / (5 * 4)) and got[1]["betweenness"] == pytest.approx(2 * 3 / (5 * 4))
    assert got[0]["closeness"] == pytest.approx(4 / (1 + 3 + 4 + 4)) and got[2]["centrality"] == pytest.approx(3 / 5)
    assert got[3]["coefficient"] == pytest.approx((1 * 1 * 1 / 8) ** (1 / 3))


def test_no_nodes_give_no_ranks(spark):
    none = spark.range(0)
    assert R.pagerank(none, G.adjacency(spark.createDataFrame([], "src bigint, dst bigint, weight double"))).isEmpty()


@pytest.mark.parametrize("name", [lambda i: i, lambda i: i + 2**40, str])
def test_triangles_move_a_row_per_edge(spark, name):
    """A dense random graph against brute force; the only join is that of tails with lists."""
    rng = random.Random(4)
    weights = {(i, j): rng.choice([0.5, 1.0, 2.0]) for i, j in itertools.combinations(range(24), 2) if rng.random() < 0.4}
    rows = [(name(i), name(j), w) for (i, j), w in weights.items()]
    edges = spark.createDataFrame(rows, f"src {'string' if name is str else 'long'}, dst {'string' if name is str else 'long'}, weight double")
    found = G.triangles(edges)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    want = {frozenset(map(name, t)): weights[t[0], t[1]] * weights[t[0], t[2]] * weights[t[1], t[2]]
            for t in itertools.combinations(range(24), 3) if all(p in weights for p in itertools.combinations(t, 2))}
    got = found.collect()
    assert len(got) == len(want) > 50
    assert {frozenset((r.a, r.b, r.c)): r["product"] for r in got} == want
    none = spark.createDataFrame([], edges.schema)
    assert G.triangles(none).count() == 0
