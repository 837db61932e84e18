"""Embeddings, factors, spectral vectors and linkage trained block by block, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import cells as B
from quillgraph.operators import clustering as C
from quillgraph.operators import embeddings as E
from quillgraph.operators import factors as X
from quillgraph.operators import graph as G
from quillgraph.operators import graph_rounds as R
from quillgraph.operators import linkage as L
from quillgraph.operators import vectors as V


def points(spark, data, names=None):
    names = names or list(range(len(data)))
    kind = "string" if isinstance(names[0], str) else "bigint"
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, data)], f"id {kind}, vec array<double>")


def found(df):
    return {r["id"]: np.array(r["vec"]) for r in df.collect()}


def planted(blocks, size, rng, inside=0.5, outside=0.02):
    """Edges of a graph of dense blocks."""
    n = blocks * size
    near = np.arange(n)[:, None] // size == np.arange(n)[None, :] // size
    link = np.triu(rng.random((n, n)) < np.where(near, inside, outside), 1)
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(link))]


def edges_of(spark, pairs, kind="bigint"):
    return spark.createDataFrame([(*p, 1.0) for p in pairs], f"src {kind}, dst {kind}, weight double")


# -- embeddings -----------------------------------------------------------------


def test_a_pass_visits_every_pair_as_often_as_it_counts(monkeypatch):
    seen = []
    monkeypatch.setattr(E, "_added", lambda into, at, grads, rate: seen.append(at.tolist()))
    u, v = np.zeros((3, 2), np.float32), np.zeros((4, 2), np.float32)
    n = np.array([5, 1, 3000, 2])
    E.descend(u, v, np.array([0, 1, 2, 2]), np.array([0, 3, 1, 2]), n, np.ones(4), 0.1, 5, np.random.default_rng(0))
    sides = [np.bincount(np.concatenate(seen[i::2]).astype(int), minlength=4).tolist() for i in (0, 1)]
    assert sides == [[5, 1, 3002, 0], [5, 3000, 2, 1]]


def test_window_pairs(spark):
    paths = [list(range(7)), [1, 1, 2], [5], []]
    got = {(r["src"], r["dst"]): r["n"] for r in E.window_pairs(spark.createDataFrame([(p,) for p in paths], "path array<bigint>"), 2).collect()}
    want = {}
    for p in paths:
        for i, a in enumerate(p):
            for j, b in enumerate(p):
                if i != j and abs(i - j) <= 2:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_node_embeddings_tell_held_out_links(spark):
    rng = np.random.default_rng(3)
    pairs = planted(4, 30, rng)
    held = [pairs[i] for i in rng.choice(len(pairs), 60, replace=False)]
    kept = edges_of(spark, [p for p in pairs if p not in held])
    nodes = spark.range(121).select("id")  # node 120 has no edge
    vec = found(R.node_embeddings(nodes, R.random_walks(nodes, G.adjacency(kept), 20, 10), 16, 4))
    assert len(vec) == 121 and not vec[120].any()
    score = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    linked = {frozenset(p) for p in pairs}
    apart = [p for p in rng.integers(0, 120, (400, 2)).tolist() if p[0] != p[1] and frozenset(p) not in linked][:200]
    good, bad = np.array([score(*p) for p in held]), np.array([score(*p) for p in apart])
    assert (good[:, None] > bad[None, :]).mean() > 0.8


def test_blocks_of_any_number_learn_the_same_kind_of_thing(spark):
    """Names may be text; blocks of one side may be fewer; a null end counts for nothing; no pairs, no rows."""
    rng = np.random.default_rng(4)
    rows = [(f"d{d}", f"w{3 * (d % 3) + int(w)}", 4) for d in range(30) for w in rng.integers(0, 3, 2)] + [(None, "w0", 3), ("d0", None, 3)]
    pairs = spark.createDataFrame(rows, "src string, dst string, n int")
    for block in (5, 10):  # six blocks of documents and four of words, then four of both
        ours, theirs = E.train(pairs, 8, 12, rate=0.3, block=block)
        vec = found(ours)
        assert set(vec) == {f"d{d}" for d in range(30)} and set(found(theirs)) <= {f"w{i}" for i in range(9)}
        unit = np.array([vec[f"d{d}"] / np.linalg.norm(vec[f"d{d}"]) for d in range(30)])
        same = np.arange(30)[:, None] % 3 == np.arange(30)[None, :] % 3
        assert (unit @ unit.T)[same].mean() > (unit @ unit.T)[~same].mean() + 0.3
    again, _ = E.train(pairs, 8, 12, rate=0.3, block=10)
    assert all((found(again)[k] == v).all() for k, v in vec.items())
    assert E.train(pairs.where("false"), 8, 2)[0].isEmpty()


def test_paragraph_vectors_put_near_copies_together(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    texts = [rng.choice(words, 40).tolist() for _ in range(24)]
    copies = [[w if rng.random() > 0.1 else str(rng.choice(words)) for w in t] for t in texts]
    bags = spark.createDataFrame([(i, t) for i, t in enumerate(texts + copies)] + [(99, []), (98, ["once"])], "doc_id bigint, words array<string>")
    vec = found(V.doc_vectors(bags, 24, 2, epochs=20))
    assert not vec[99].any() and not vec[98].any()
    unit = np.array([vec[i] / np.linalg.norm(vec[i]) for i in range(48)])
    near = unit @ unit.T - 2 * np.eye(48)
    assert (near.argmax(axis=1) == (np.arange(48) + 24) % 48).mean() > 0.9


# -- factors --------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 20_000])
def test_svd_against_numpy(spark, block):
    rng = np.random.default_rng(6)
    dense = rng.normal(size=(60, 40)) * (rng.random((60, 40)) < 0.2)
    dense[5] = 0
    cells = [(f"r{i:02}", int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    table = spark.createDataFrame(cells + [(None, 1, 2.0), ("r01", None, 2.0), ("r05", 3, 0.0)], "r string, c int, x double")
    vectors, sigma, explained = X.svd(table, 6, rounds=8, block=block)
    u, s, _ = np.linalg.svd(dense)
    assert sigma == pytest.approx(s[:6], rel=1e-3)
    vec = found(vectors)
    assert set(vec) == {f"r{i:02}" for i in range(60) if i != 5}
    got = np.array([vec.get(f"r{i:02}", np.zeros(6)) for i in range(60)])
    assert np.abs(got.T @ got - np.diag(s[:6] ** 2)).max() < 0.05 * s[0] ** 2
    assert np.abs(np.abs(np.einsum("ij,ij->j", got, u[:, :6])) - s[:6]).max() < 0.05 * s[0]
    assert all(c[np.abs(c).argmax()] > 0 for c in got.T)
    shares = {r["component"]: r["variance"] for r in explained.collect()}
    rows = np.delete(got, 5, axis=0)
    assert [shares[i] for i in range(6)] == pytest.approx(rows.var(axis=0))


def test_svd_of_low_rank_and_none(spark):
    table = spark.createDataFrame([(i, j, float((i + 1) * (j + 1))) for i in range(5) for j in range(4)], "r int, c int, x double")
    vectors, sigma, _ = X.svd(table, 3)
    assert len(sigma) == 1 and sigma[0] == pytest.approx(np.sqrt(55 * 30)) and vectors.count() == 5
    vectors, sigma, explained = X.svd(table.where("false"), 3)
    assert sigma == [] and vectors.isEmpty() and explained.isEmpty()


def test_products_copy_a_factor_to_few_blocks(spark):
    """1.2 million nodes of 110 components were cut into 60 x 60 blocks, and every row moved 60 times either way."""
    assert X.parts(1_200_000, 110) <= 3 and X.parts(20, 5) == 8 and X.parts(1, 5) == X.parts(0, 5) == 1
    rng = np.random.default_rng(11)
    dense = rng.normal(size=(30, 25)) * (rng.random((30, 25)) < 0.3)
    dense[:, 3] = 1.0  # a column in every row
    cells = [(f"r{i:02}", int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    a = X.blocked(spark.createDataFrame(cells, "r string, c int, x double"), 4, 7)
    factor = {True: rng.normal(size=(30, 4)), False: rng.normal(size=(25, 4))}
    for transposed, own, other in ((False, a.r, a.c), (True, a.c, a.r)):
        place = {n: int(str(n).strip("r")) for n in (r["name"] for r in other.names.collect())}
        known = [(r["id"], factor[transposed][place[r["name"]]].tolist()) for r in other.names.collect()]
        rows = X.times(a, spark.createDataFrame(known, "id bigint, vec array<double>"), 4, transposed).join(own.names, "id").collect()
        assert len(own.sizes) > 1 and len(rows) == sum(own.sizes) == len({r["id"] for r in rows})
        want = (dense.T if transposed else dense) @ factor[transposed]
        for r in rows:
            assert r["vec"] == pytest.approx(want[int(str(r["name"]).strip("r"))].tolist(), abs=1e-9)


def test_triangles_are_joined_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(X, "FAN", 2)
    rng = np.random.default_rng(7)
    data = rng.normal(size=(70, 5))
    r = X.triangle(points(spark, data).repartition(9), 5)
    assert np.abs(r.T @ r - data.T @ data).max() < 1e-9


def clusters_of(df):
    return {r["id"]: r["cluster"] for r in df.collect()}


def partition(labels, names):
    groups = {}
    for n in names:
        groups.setdefault(labels[n], set()).add(n)
    return {frozenset(g) for g in groups.values()}


def test_spectral_recovers_blocks_and_rings(spark):
    rng = np.random.default_rng(8)
    pairs = planted(4, 25, rng, 0.5, 0.01)
    nodes = spark.range(102).select("id")
    got = clusters_of(C.spectral(nodes, edges_of(spark, pairs), 4, n_init=3))
    assert got[100] == got[101] == -1
    assert partition(got, range(100)) == {frozenset(range(25 * b, 25 * b + 25)) for b in range(4)}
    # Two rings with one bridge; ids are text.
    ring = [(f"n{30 * r + i:02}", f"n{30 * r + (i + 1) % 30:02}") for r in range(2) for i in range(30)] + [("n00", "n30")]
    named = spark.createDataFrame([(f"n{i:02}",) for i in range(60)], "id string")
    got = clusters_of(C.spectral(named, edges_of(spark, ring, "string"), 2, n_init=3))
    assert partition(got, got) == {frozenset(f"n{30 * r + i:02}" for i in range(30)) for r in range(2)}
    assert set(clusters_of(C.spectral(nodes, edges_of(spark, []), 3)).values()) == {-1}


def test_structure_clusters(spark):
    rng = np.random.default_rng(9)
    nodes = spark.range(61).select("id")
    got = clusters_of(C.structure_clusters(nodes, edges_of(spark, planted(3, 20, rng, 0.6, 0.01)), 3, 3, n_init=3))
    assert got[60] == -1 and partition(got, range(60)) == {frozenset(range(20 * b, 20 * b + 20)) for b in range(3)}
    assert set(clusters_of(C.structure_clusters(nodes, edges_of(spark, []), 3, 3)).values()) == {-1}


def test_sparse_rows_are_vectors_and_cluster(spark):
    index = spark.createDataFrame([(d, f"t{3 * (d % 2) + j}", 1.0 + d / 100) for d in range(20) for j in range(3)], "doc_id bigint, term string, w double")
    numbers = V.term_numbers(index.select("term"))
    rows = V.sparse_rows(index, numbers)
    first = rows.where("doc_id = 3").first()["features"]
    assert first.size == 6 and first.indices.tolist() == [3, 4, 5] and first.values.tolist() == [1.03] * 3
    got = clusters_of(C.kmeans(rows.withColumnRenamed("doc_id", "id"), 2, n_init=2))
    assert partition(got, got) == {frozenset(range(0, 20, 2)), frozenset(range(1, 20, 2))}


# -- cells and linkage ----------------------------------------------------------


@pytest.mark.parametrize("one_level", [4, 1024])
def test_cells_hold_every_point_once_and_bound_distances(spark, monkeypatch, one_level):
    monkeypatch.setattr(B, "ONE_LEVEL", one_level)
    rng = np.random.default_rng(10)
    data = rng.normal(size=(300, 3))
    cells = B.plant(points(spark, data), 12)
    rows = {r["id"]: (r["cell"], r["gap"]) for r in cells.rows.collect()}
    leaves = {r["id"]: r for r in cells.leaves.collect()}
    assert len(rows) == 300 and len(leaves) > 8 and sum(r["n"] for r in leaves.values()) == 300
    for i, (cell, gap) in rows.items():
        real = np.linalg.norm(data[i] - data[cell])
        assert abs(gap - real) < 1e-6 and real <= leaves[cell]["radius"]
    for r in B.cell_bounds(cells).collect():
        a, b = ([i for i, (c, _) in rows.items() if c == r[x]] for x in ("a", "b"))
        gaps = np.linalg.norm(data[a][:, None] - data[b][None, :], axis=2)
        assert r["low"] <= gaps.min() + 1e-9 and gaps.max() <= r["high"] + 1e-9


@pytest.mark.parametrize("metric", ["cosine", "minkowski"])
def test_nearest_by_cells_is_exact_and_visits_few(spark, metric):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(15, 4)) * 5
    data = np.round(centres[rng.integers(0, 15, 500)] + 0.2 * rng.normal(size=(500, 4)), 1)  # some are equal
    data[7] = 0
    ask = np.concatenate([centres[:6], np.zeros((1, 4))])
    names = [f"q{i}" for i in range(7)]
    rows, asked = points(spark, data), points(spark, ask, names)
    seen = {}
    got = {tuple(r) for r in B.nearest(rows, asked, 9, metric, size=25, counted=seen).collect()}
    assert got == {tuple(r) for r in B.all_nearest(rows, asked, 9, metric).collect()}
    assert seen["visited"] < 0.7 * seen["possible"]


def slow_forest(data, names):
    """Kruskal's edges in order of length, then of ids."""
    every = sorted((float(np.sqrt(((data[i] - data[j]) ** 2).sum())), *sorted((names[i], names[j]))) for i in range(len(data)) for j in range(i))
    root = {n: n for n in names}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    out = []
    for d, a, b in every:
        if top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
            out.append((round(d, 9), a, b))
    return out


def test_linkage_against_brute_force(spark):
    rng = np.random.default_rng(11)
    grid = rng.integers(0, 5, (40, 2)).astype(float)  # many ties, many equal points
    loose = rng.normal(size=(40, 4)) * 2
    for data, names, size in ((grid, list(range(40)), 2000), (loose, [f"p{i:02}" for i in range(40)], 8)):
        real = slow_forest(data, names)
        got = [(round(r["height"], 9), r["src"], r["dst"]) for r in L.merges(L.spanning_forest(points(spark, data, names), size)).orderBy("step").collect()]
        assert [h for h, _, _ in got] == [h for h, _, _ in real]
        if names[0] == "p00":
            assert got == real
        labels = clusters_of(L.linkage(points(spark, data, names), 5, size))
        kept = [(a, b) for _, a, b in (got if names[0] != "p00" else real)[:-4]]
        root = {n: n for n in names}
        for a, b in kept:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {n: new if r == old else r for n, r in root.items()}
        order = {r: i for i, r in enumerate(sorted(set(root.values())))}
        assert labels == {n: order[r] for n, r in root.items()}


def test_linkage_edges(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 1.0]), (4, [5.0, 1.0])], "id bigint, vec array<double>")
    assert clusters_of(L.linkage(few, 2)) == {1: 0, 3: 0, 4: 1, 2: -1}
    assert clusters_of(L.linkage(few, 10)) == {1: 0, 3: 1, 4: 2, 2: -1}
    assert L.linkage(few.where("false"), 3).isEmpty() and L.spanning_forest(few.where("false")).isEmpty()
