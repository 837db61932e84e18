import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import cells as B
from quillgraph.operators import classify as M
from quillgraph.operators import clustering as C
from quillgraph.operators import quality as U
from quillgraph.operators import vectors as V
from quillgraph.operators.blocks import nearest


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, cluster int")


def test_agreement(spark):
    row = U.compare_labels(labels(spark, [0, 0, 0, 1, 1, 1]), labels(spark, [0, 0, 1, 1, 2, 2])).first()
    assert (row["ari"], row["nmi"]) == (0.242424, 0.515804)


def test_adjusted_mutual_information(spark):
    same = labels(spark, [0, 0, 1, 1, 2, 2])
    row = U.evaluate_labels(same, same).first()
    assert (row["ari"], row["ami"]) == (1.0, 1.0)
    # Expected information by enumeration of all labellings with the same margins.
    a, b = [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2]
    from itertools import permutations
    from math import log

    def mutual(x, y):
        n = len(x)
        return sum(
            (c / n) * log(n * c / (x.count(i) * y.count(j)))
            for i in set(x) for j in set(y) for c in [sum(p == i and q == j for p, q in zip(x, y))] if c)

    def entropy(x):
        return -sum(x.count(i) / len(x) * log(x.count(i) / len(x)) for i in set(x))

    every = [mutual(a, list(p)) for p in permutations(b)]
    expected = sum(every) / len(every)
    ami = (mutual(a, b) - expected) / ((entropy(a) + entropy(b)) / 2 - expected)
    assert U.evaluate_labels(labels(spark, a), labels(spark, b)).first()["ami"] == pytest.approx(ami, abs=1e-6)


def points(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id bigint, vec array<double>")


def brute_dbscan(matrix, eps, least):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= eps
    core = near.sum(1) >= least
    label = np.full(len(matrix), -1)
    for i in range(len(matrix)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = i
                    stack += [k for k in np.nonzero(near[j] & core)[0] if label[k] < 0]
    for i in range(len(matrix)):
        if not core[i]:
            own = [label[k] for k in np.nonzero(near[i] & core)[0]]
            label[i] = min(own) if own else -1
    return label.tolist()


@pytest.mark.parametrize("block", [60, 2000])
def test_dbscan_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    data = np.concatenate([c + 0.25 * rng.normal(size=(30, 6)) for c in centres] + [rng.normal(size=(25, 6)), np.ones((15, 6))])
    got = {r["id"]: r["cluster"] for r in C.dbscan(points(spark, data), 0.05, 4, block=block).collect()}
    assert [got[i] for i in range(len(data))] == brute_dbscan(data, 0.05, 4)


@pytest.mark.parametrize("eps,block", [(0.9, 20), (0.3, 8), (1.2, 30)])
def test_dbscan_with_wide_reach(spark, eps, block):
    """Cells wholly within reach are counted and linked without their points; rows of zeros and nulls are noise."""
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.normal(size=(3, 5))[rng.integers(0, 3, 90)] + 0.05 * rng.normal(size=(90, 5)), rng.normal(size=(10, 5)), np.zeros((2, 5))])
    unit = np.divide(data, np.linalg.norm(data, axis=1, keepdims=True), out=np.zeros_like(data), where=data.any(axis=1, keepdims=True))
    near = 1 - unit @ unit.T <= eps
    core = near.sum(1) >= 4
    label = np.full(len(data), -1)
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = i
                todo += np.flatnonzero(near[j] & core).tolist()
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core].tolist(), default=-1)
    rows = points(spark, data).unionByName(spark.createDataFrame([(500, None)], "id bigint, vec array<double>"))
    got = {r["id"]: r["cluster"] for r in C.dbscan(rows, eps, 4, block=block).collect()}
    assert [got[i] for i in range(len(data))] == label.tolist() and got[500] == -1


@pytest.mark.parametrize("held", [64 << 20, 500])
def test_cells_meet_in_groups(spark, monkeypatch, held):
    """Where a cell meets most others, a point moves and is counted once a group, not once a cell; same clusters, text ids too."""
    monkeypatch.setattr(B, "GROUPS", 2)
    monkeypatch.setattr(B, "HELD", held)
    monkeypatch.setattr(B, "FOUND", 10)
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.normal(size=(3, 5)).repeat(30, axis=0) + 0.3 * rng.normal(size=(90, 5)), rng.normal(size=(20, 5))])
    met, before = [], B.meet
    monkeypatch.setattr(B, "meet", lambda *a: met.append(C.cut(before(*a))) or met[-1])
    for eps in (0.05, 0.6):
        got = {r["id"]: r["cluster"] for r in C.dbscan(points(spark, data), eps, 4, block=6).collect()}
        assert [got[i] for i in range(len(data))] == brute_dbscan(data, eps, 4)
    groups = 2 if held > 500 else 9  # 110 points of 40 bytes in groups of 500
    assert met[3].count() <= len(data) * groups  # counts at the wider reach
    want = brute_dbscan(data, 0.6, 4)
    text = {r["id"]: r["cluster"] for r in C.dbscan(named(points(spark, data)), 0.6, 4, block=6).collect()}
    assert [text[f"n{i:04d}"] for i in range(len(data))] == ["-1" if c < 0 else f"n{c:04d}" for c in want]


def test_nearest_in_several_blocks(spark):
    rng = np.random.default_rng(1)
    data, ask = rng.normal(size=(200, 4)), rng.normal(size=(30, 4))
    whole = sorted(map(tuple, nearest(points(spark, data), points(spark, ask), 3).collect()))
    assert sorted(map(tuple, nearest(points(spark, data), points(spark, ask), 3, block=13).collect())) == whole
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = (unit(ask) @ unit(data).T).argmax(axis=1)
    assert [r[2] for r in whole if r[1] == 1] == best.tolist()


def named(df):
    """The same rows under text ids, in the order of the numbers."""
    return df.withColumn("id", F.format_string("n%04d", F.col("id")))


def test_text_ids(spark):
    rng = np.random.default_rng(7)
    data = np.concatenate([c + 0.2 * rng.normal(size=(25, 5)) for c in rng.normal(size=(3, 5))])
    rows = points(spark, data)
    near = [(r[0], r[1], r[2]) for r in nearest(rows, rows, 3).collect()]
    assert sorted((f"n{a:04d}", r, f"n{b:04d}") for a, r, b in near) == sorted(
        (r[0], r[1], r[2]) for r in nearest(named(rows), named(rows), 3).collect())
    want = brute_dbscan(data, 0.05, 4)
    got = {r["id"]: r["cluster"] for r in C.dbscan(named(rows), 0.05, 4, block=20).collect()}
    assert [got[f"n{i:04d}"] for i in range(len(data))] == ["-1" if c < 0 else f"n{c:04d}" for c in want]


def brute_silhouette(data, label):
    gap = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(label):
        mean = {c: gap[i, label == c].sum() / max((label == c).sum() - (c == own), 1) for c in set(label)}
        outside = min(v for c, v in mean.items() if c != own)
        out.append((outside - mean[own]) / max(outside, mean[own]) if (label == own).sum() > 1 else 0.0)
    return np.mean(out)


def test_silhouette_of_all_points_in_blocks(spark):
    rng = np.random.default_rng(2)
    data, label = rng.normal(size=(90, 3)), np.arange(90) % 4
    label[0] = 9  # a cluster of one
    given = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id bigint, cluster int")
    for block in (17, 2000):
        got = U.silhouette(points(spark, data), given, block).first()[0]
        assert got == pytest.approx(brute_silhouette(data, label), abs=1e-6)
    assert U.sampled_silhouette(points(spark, data), given, 200).first()[0] == pytest.approx(brute_silhouette(data, label), abs=1e-6)
    one = given.withColumn("cluster", F.lit(1))
    assert U.silhouette(points(spark, data), one).first()[0] is None


def test_silhouettes_of_several_runs_meet_once(spark, monkeypatch):
    """Noise, text ids, many clusters and few; points move once a block for all runs, and no block holds too much."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 3))
    runs = {"few": np.arange(60) % 3, "many": np.arange(60) // 2, "noise": np.where(np.arange(60) < 20, -1, np.arange(60) % 4), "one": np.zeros(60, int)}
    rows = named(points(spark, data))
    tables = {n: named(spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id bigint, cluster int")) for n, label in runs.items()}
    for few, held in ((64, 64 << 20), (5, 300)):
        monkeypatch.setattr(U, "FEW", few)
        monkeypatch.setattr(U, "HELD", held)
        dealt, written = [], U.cut
        monkeypatch.setattr(U, "cut", lambda df: dealt.append(df) or written(df))
        got = {r["run"]: r["silhouette"] for r in U.compare_runs(rows, tables).collect()}
        monkeypatch.setattr(U, "cut", written)
        assert len(dealt) == 2  # the points with the labels of all runs, and a row a run
        for name, label in runs.items():
            kept = label >= 0
            want = None if name == "one" else pytest.approx(brute_silhouette(data[kept], label[kept]), abs=2e-6)
            assert got[name] == want, name


def test_models_split_well_separated_points(spark):
    data = np.concatenate([np.random.default_rng(i).normal(size=(20, 3)) * 0.1 + c for i, c in enumerate(([5, 0, 0], [0, 5, 0]))])
    rows = points(spark, data)
    assert {r["cluster"] for r in C.gmm(rows, 2, n_init=1).collect()} <= {0, 1}
    for found in (C.kmeans(rows, 2, n_init=2), C.hierarchical(rows, 2)):
        got = {r["id"]: r["cluster"] for r in found.collect()}
        assert len({got[i] for i in range(20)}) == 1 and len(set(got.values())) == 2


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    dense = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    index = spark.createDataFrame(
        [(int(i), f"t{j:02d}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], "doc_id bigint, term string, w double")
    vectors, sigma, _ = V.truncated_svd(index, 4)
    assert sigma == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:4].tolist(), rel=1e-6)
    lengths = np.sqrt(sum(np.array(r["vec"]) ** 2 for r in vectors.collect()))
    assert lengths.tolist() == pytest.approx(sigma, rel=1e-6)


def test_pca_is_centred_and_ordered(spark):
    data = np.random.default_rng(0).normal(size=(50, 3)) * np.array([5, 1, 0.1]) + 3
    out, explained = V.pca(points(spark, data), 2)
    got = np.array([r["vec"] for r in out.collect()])
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9) and explained[0] > explained[1]


def test_chi2(spark):
    index = spark.createDataFrame([(0, "t", 2.0), (1, "t", 1.0), (2, "t", 1.0)], "doc_id bigint, term string, w double")
    by_class = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "doc_id bigint, cluster string")
    assert {r["chi2"] for r in M.chi2_terms(index, by_class, 1).collect()} == {0.125}


def test_split_counts(spark):
    df = spark.range(103).withColumn("label", F.when(F.col("id") < 3, "rare").otherwise("often"))
    got = M.stratified_split(df, "label", 0.2).groupBy("label").agg(F.count_if("is_test").alias("t"))
    assert {r["label"]: r["t"] for r in got.collect()} == {"rare": 1, "often": 20}


def test_report(spark):
    pred = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b")], "id bigint, label string, prediction string")
    rows = {r["label"]: r for r in M.evaluate(pred).collect()}
    assert rows["accuracy"]["f1"] == 0.666667 and rows["a"]["recall"] == 0.5 and rows["b"]["precision"] == 0.5
    table = {r["label"]: (r["a"], r["b"]) for r in M.confusion(pred, ["a", "b"]).collect()}
    assert table == {"a": (0.5, 0.5), "b": (0.0, 1.0)}


def test_weighted_f1(spark):
    rows = [("r", "m", "a", "a"), ("r", "m", "a", "b"), ("r", "m", "b", "b"), ("r", "n", "a", "b")]
    pred = spark.createDataFrame(rows, "representation string, model string, label string, prediction string")
    got = {r["model"]: r["f1"] for r in M.weighted_f1(pred, ["representation", "model"]).collect()}
    assert got == {"m": 0.666667, "n": 0.0}


def test_feature_importance_has_the_whole_vocabulary(spark, monkeypatch):
    from quillgraph.plans import classes

    seen, train = [], classes.M.train

    def spied(df, kind, label, **options):
        seen.append((df.first()["features"].size, options))
        return train(df, kind, label, **options)

    monkeypatch.setattr(classes.M, "train", spied)
    folder = "/root/testdata/sf0.01"
    assert classes.feature_importance(spark, folder).count() > 0
    assert seen == [(classes.document_index(spark, folder)[1].count(), {})] and seen[0][0] > 1000
