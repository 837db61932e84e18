"""Judging clusterings: indices, agreement, and what a cluster is about."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, distance
from ..session import cut
from .blocks import BLOCK, id_type
from .embeddings import matrix as flat_matrix
from .index import cluster_sizes_of, with_labels
from .scale import deal_heavy, heavy_of, lowest_hashes, salted_join, top_k
from .vectors import centroids

DIGITS = 6


HELD = 64 << 20     # bytes of vectors in a block
BLOCKS = 16         # blocks that are worth copies of the points
TILE = 4_000_000    # distances that are held at a time
FEW = 64            # clusters of a block whose sums are added up by a product


def silhouette(vectors: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row, ``silhouette``: Euclidean, over all points; null with fewer than two clusters."""
    found = silhouettes(vectors, {"all": labels}, block)
    return found.agg(F.max("silhouette").alias("silhouette"))


def silhouettes(vectors: DataFrame, runs: dict[str, DataFrame], block: int = BLOCK) -> DataFrame:
    """``(run, silhouette)`` of several clusterings, as :func:`silhouette`; runs without labels have no row.

    Blocks of points meet once for all runs and both ways, and hand on one sum
    of distances per point and cluster, so distances never become rows.  Points
    are copied once a block: to few blocks, of at least ``block`` points, until a
    block would hold more than ``HELD`` bytes.  The work grows with the square
    of the points; ask for :func:`sampled_silhouette` to bound it.
    """
    points = vectors.select("id", "vec").where("vec IS NOT NULL")
    names = list(runs)
    for at, name in enumerate(names):
        own = runs[name].select("id", F.col("cluster").cast("string").alias(f"c{at}"))
        points = points.join(own, "id", "inner" if len(names) == 1 else "left")
    points = points.select("id", "vec", F.array(*[f"c{at}" for at in range(len(names))]).alias("own"))
    points = cut(points.where(F.exists("own", lambda c: c.isNotNull())))
    size = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    blocks = max(1, min(BLOCKS, math.ceil(size["n"] / block)), math.ceil(size["n"] * size["dim"] * 8 / HELD))
    low, high = F.least("h", "o"), F.greatest("h", "o")
    dealt = points.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("pair", (F.expr("greatest(h, o) * (greatest(h, o) + 1) div 2") + low).cast("int")).withColumn("last", F.col("h") == high)
    met = dealt.withColumn("own_block", F.col("h") == F.col("o")).select("pair", "last", "own_block", "id", "vec", "own")
    parts = met.repartitionById(blocks * (blocks + 1) // 2, "pair").mapInArrow(
        _sums, f"id {id_type(points)}, own array<string>, cells array<struct<run:int,cluster:string,s:double>>")
    # Dealt by point while cells are packed; counted where they lie.
    cells = parts.repartition("id").select("id", "own", F.explode("cells").alias("c")).select(
        "id", F.col("c.run").alias("at"), F.get("own", F.col("c.run")).alias("own"), F.col("c.cluster").alias("cluster"), F.col("c.s").alias("s"))
    far = cells.where("own IS NOT NULL").groupBy("id", "at", "own", "cluster").agg(F.sum("s").alias("s"))
    sizes = points.select(F.posexplode("own").alias("at", "cluster")).where("cluster IS NOT NULL").groupBy("at", "cluster").agg(F.count("*").alias("n"))
    mine = F.col("own") == F.col("cluster")
    each = salted_join(far, sizes, ["at", "cluster"], "id").groupBy("id", "at").agg(
        F.max(F.when(mine, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("inside"),
        F.max(F.when(mine, F.col("n"))).alias("n_own"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("outside"))
    value = (F.col("outside") - F.col("inside")) / F.greatest("inside", "outside", F.lit(1e-300))
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("at")).alias("run")
    return each.groupBy("at").agg(F.avg(F.when(F.col("outside").isNotNull(), F.when(F.col("n_own") > 1, value).otherwise(0.0))).alias("silhouette")).select(named, "silhouette")


class _Block:
    """Points of one block, with the clusters of each run that it holds."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.ids, self.own, n = rows.column("id"), rows.column("own"), rows.num_rows
        self.vec = flat_matrix(rows.column("vec"), len(pc.list_flatten(rows.column("vec"))) // max(n, 1))
        self.squares = (self.vec * self.vec).sum(1)
        flat = pc.list_flatten(self.own)
        runs = len(flat) // max(n, 1)
        self.runs, self.names, self.member = [], [], []
        for run in range(runs):
            label = flat.take(pa.array(np.arange(n) * runs + run))
            coded = pc.dictionary_encode(label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label)
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            self.names += coded.dictionary.to_pylist()
            self.runs += [run] * len(coded.dictionary)
            self.member.append((pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), len(coded.dictionary)))
        self.few = len(self.names) <= FEW
        if self.few:
            self.hot = np.concatenate([(code[:, None] == np.arange(k)).astype(float) for code, k in self.member], axis=1) if n else np.zeros((0, 0))

    def added(self, gaps: np.ndarray) -> np.ndarray:
        """Columns of distances to the points of this block, added up by cluster."""
        if self.few:
            return gaps @ self.hot
        out = []
        for code, k in self.member:
            order = np.argsort(code, kind="stable")
            order = order[np.searchsorted(code[order], 0):]
            if k:
                out.append(np.add.reduceat(gaps[:, order], np.searchsorted(code[order], np.arange(k)), axis=1))
        return np.concatenate(out, axis=1)

    def rows(self, low: int, sums: np.ndarray, other: "_Block") -> pa.RecordBatch:
        many, wide = sums.shape
        column = pa.array(np.tile(np.arange(wide), many))
        cells = pa.StructArray.from_arrays([
            pa.array(other.runs, pa.int32()).take(column), pa.array(other.names, pa.string()).take(column), pa.array(sums.ravel(), pa.float64())], names=["run", "cluster", "s"])
        one = lambda c: c.slice(low, many).combine_chunks()
        return pa.RecordBatch.from_arrays([
            one(self.ids), one(self.own), pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * wide, pa.int32()), cells)], names=["id", "own", "cells"])


def _toward(a: _Block, b: _Block, both: bool):
    """Sums of the distances from the points of ``a`` to the clusters of ``b``, and with ``both`` the other way too."""
    back = np.zeros((len(b.vec), len(a.names))) if both else None
    step = max(1, min(2000, TILE // max(len(b.vec), 1)))
    for low in range(0, len(a.vec), step):
        some = slice(low, low + step)
        gaps = a.squares[some, None] + b.squares[None, :] - 2 * a.vec[some] @ b.vec.T
        np.sqrt(np.maximum(gaps, 0, out=gaps), out=gaps)
        if a is b:
            gaps[np.arange(len(gaps)), np.arange(low, low + len(gaps))] = 0.0
        yield a.rows(low, b.added(gaps), b)
        if both:
            back += gaps.T @ a.hot[some]
    if both:
        for low in range(0, len(back), 2000):
            yield b.rows(low, back[low:low + 2000], a)


def _sums(batches):
    held = {}
    for batch in batches:
        for pair in pc.unique(batch.column(0)).to_pylist():
            held.setdefault(pair, []).append(batch.filter(pc.equal(batch.column(0), pair)))
    for every in held.values():
        rows = pa.Table.from_batches(every)
        alone = rows.filter(rows.column("own_block"))
        if alone.num_rows:
            a = _Block(alone)
            yield from _toward(a, a, False)
            continue
        a, b = _Block(rows.filter(pc.invert(rows.column("last")))), _Block(rows.filter(rows.column("last")))
        if len(a.ids) and len(b.ids):
            yield from _toward(a, b, a.few)
            if not a.few:
                yield from _toward(b, a, False)


def sampled_silhouette(vectors: DataFrame, labels: DataFrame, sample: int, seed: int = 42) -> DataFrame:
    """The silhouette of a seeded sample of exactly ``sample`` points (all, if there are fewer)."""
    quota = vectors.sparkSession.range(1).select(F.lit(sample).alias("take"))
    return silhouette(vectors, lowest_hashes(labels, "id", quota, seed))


def squared_silhouette(vectors: DataFrame, labels: DataFrame) -> float:
    """The linear-time variant of Spark ML, on *squared* distances; another number than the above."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.join(labels, "id").select(array_to_vector("vec").alias("features"), F.col("cluster").cast("int").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


def cluster_indices(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: clusters, ``davies_bouldin`` and ``calinski_harabasz``; noise (-1) left out."""
    kept = labels.where(F.col("cluster") != -1)
    centre = centroids(vectors, kept)
    points = salted_join(vectors.join(kept, "id"), centre, "cluster", "id")
    away = points.select("cluster", distance(F.col("vec"), F.col("centroid")).alias("d"))
    spread = away.groupBy("cluster").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    table = centre.join(spread, "cluster")
    # One row per cluster from here on; each meets the others as one packed array.
    packed = table.agg(F.collect_list(F.struct("cluster", "centroid", "s")).alias("all"))
    met = table.withColumn("o", F.explode(packed.scalar())).where(F.col("o.cluster") != F.col("cluster"))
    ratio = F.try_divide(F.col("s") + F.col("o.s"), distance(F.col("centroid"), F.col("o.centroid")))
    worst = met.groupBy("cluster").agg(F.max(ratio).alias("ratio"))
    parts = centre.select(F.posexplode("centroid").alias("i", "x"), "size")
    means = parts.groupBy("i").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("m")).agg(
        F.array_sort(F.collect_list(F.struct("i", "m"))).alias("r")).select(F.col("r.m").alias("mean"))
    scored = table.join(worst, "cluster", "left").withColumn("mean", means.scalar())
    scored = scored.withColumn("gap", distance(F.col("centroid"), F.col("mean")))
    row = scored.agg(
        F.count("*").alias("clusters"), F.sum("size").alias("n"), F.avg("ratio").alias("davies_bouldin"),
        F.sum(F.col("size") * F.col("gap") * F.col("gap")).alias("between"), F.sum("ss").alias("within"))
    k, n = F.col("clusters"), F.col("n")
    spread_ratio = F.try_divide(F.try_divide(F.col("between"), k - 1), F.try_divide(F.col("within"), n - k))
    return row.select("clusters", "davies_bouldin", spread_ratio.alias("calinski_harabasz"))


def compare_runs(vectors: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """``(run, clusters, silhouette, davies_bouldin, calinski_harabasz)``, best silhouette first."""
    runs = {name: labels.where(F.col("cluster") != -1) for name, labels in runs.items()}
    shape = cut(silhouettes(vectors, runs))  # a row a run
    out = None
    for name, kept in runs.items():
        row = cluster_indices(vectors, kept).withColumn("silhouette", shape.where(F.col("run") == name).agg(F.max("silhouette")).scalar())
        row = row.select(F.lit(name).alias("run"), "clusters", *[
            F.round(c, DIGITS).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")])
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("silhouette"), "run")


def attach(articles: DataFrame, labels: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """Articles with their cluster in column ``name``, -1 where they have none."""
    renamed = labels.select(key, F.col("cluster").alias(name))
    return articles.join(renamed, key, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def cluster_top_terms(index: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Terms of each cluster by total weight in the global index."""
    sums = with_labels(index, labels).groupBy("cluster", "term").agg(F.round(F.sum("w"), DIGITS).alias("weight"))
    return top_k(sums, ["cluster"], [F.desc("weight"), F.asc("term")], n).select("cluster", "rank", "term", "weight")


def cluster_topics(doc_topics: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cluster, topic, share)``: the topic with the largest mean probability in each cluster."""
    sums = with_labels(doc_topics, labels).groupBy("cluster", "topic").agg(F.sum("p").alias("s"))
    means = salted_join(sums, cluster_sizes_of(labels), "cluster", "topic").withColumn(
        "share", F.round(F.col("s") / F.col("size"), DIGITS))
    return means.groupBy("cluster").agg(
        F.max_by(F.struct("topic", "share"), F.struct(F.col("share"), -F.col("topic"))).alias("x")
    ).select("cluster", "x.topic", "x.share")


def cluster_topic_terms(doc_topics: DataFrame, topic_terms: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The words of each cluster's dominant topic; ``topic_terms(topic, rank, term)``."""
    best = cluster_topics(doc_topics, labels).select("cluster", "topic")
    return best.join(topic_terms.where(F.col("rank") <= n), "topic").select("cluster", "topic", "rank", "term")


def nearest_to_centroid(vectors: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Documents closest to the mean vector of their cluster, by cosine."""
    points = salted_join(vectors.join(labels, "id"), centroids(vectors, labels).drop("size"), "cluster", "id")
    scored = points.select("cluster", "id", F.round(cosine(F.col("vec"), F.col("centroid")), DIGITS).alias("similarity"))
    return top_k(scored, ["cluster"], [F.desc("similarity"), F.asc("id")], n).select("cluster", "rank", "id", "similarity")


def central_documents(index: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Documents closest to the mean index row of their cluster, by cosine.

    Index rows have length one, so the cosine is the dot product over the
    length of the mean row.  Rows with their cluster, and sums, are written once.
    """
    key = ["cluster", "term"]
    rows = cut(with_labels(index.select("doc_id", "term", "w"), labels))
    sums = cut(rows.groupBy(*key).agg(F.sum("w").alias("s"), F.count("*").alias("_n")))
    heavy = heavy_of(sums, sums.agg(F.sum("_n").alias("n")), key)
    lengths = sums.groupBy("cluster").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    centre = salted_join(sums, lengths, "cluster", "term").select("cluster", "term", (F.col("s") / F.col("length")).alias("c"))
    dots = deal_heavy(rows, heavy, key, "doc_id").meet(centre).groupBy("cluster", "doc_id").agg(
        F.round(F.sum(F.col("w") * F.col("c")), DIGITS).alias("similarity"))
    return top_k(dots, ["cluster"], [F.desc("similarity"), F.asc("doc_id")], n).select(
        "cluster", "rank", "doc_id", "similarity")


def refitted_index(counts: DataFrame, labels: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """Index rows weighted by a vocabulary fitted inside each document's cluster."""
    from .index import cluster_vocabulary

    vocab = cluster_vocabulary(counts, labels, min_df, max_df)
    idf = F.log((F.lit(1.0) + F.col("size")) / (F.lit(1.0) + F.col("df"))) + 1.0
    rows = salted_join(with_labels(counts, labels), vocab.select("cluster", "term", idf.alias("idf")),
                       ["cluster", "term"], "doc_id").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "term", "tf", (F.col("raw") / length).alias("w"))


def topic_central_documents(doc_topics: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Documents of each cluster with the highest probability of the cluster's dominant topic."""
    best = cluster_topics(doc_topics, labels).select("cluster", "topic")
    rows = salted_join(with_labels(doc_topics, labels), best, ["cluster", "topic"], "doc_id")
    rows = rows.select("cluster", "doc_id", "topic", F.round("p", DIGITS).alias("p"))
    return top_k(rows, ["cluster"], [F.desc("p"), F.asc("doc_id")], n)


# -- agreement of two clusterings ---------------------------------------------


def contingency(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(a, b, n)`` over the ids both clusterings know."""
    other = b.select(key, F.col("cluster").alias("b"))
    return a.select(key, F.col("cluster").alias("a")).join(other, key).groupBy("a", "b").agg(F.count("*").alias("n"))


def _agreement(cells: DataFrame) -> DataFrame:
    """Sums over cells and margins that both measures are made of, as one row."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2.0)
    plogp = lambda n: F.sum(F.col(n) * F.log(F.col(n).cast("double")))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n"))
    ra = rows.agg(F.struct(pairs("n").alias("p"), plogp("n").alias("h")).alias("x"))
    cb = cols.agg(F.struct(pairs("n").alias("p"), plogp("n").alias("h")).alias("x"))
    row = cells.agg(F.sum("n").cast("double").alias("n"), pairs("n").alias("p"), plogp("n").alias("h"))
    return row.withColumn("ra", ra.scalar()).withColumn("cb", cb.scalar())


def _ari():
    total = F.col("n") * (F.col("n") - 1) / 2.0
    expected = F.coalesce(F.try_divide(F.col("ra.p") * F.col("cb.p"), total), F.lit(0.0))
    top = (F.col("ra.p") + F.col("cb.p")) / 2.0
    return F.when(top == expected, 1.0).otherwise((F.col("p") - expected) / (top - expected))


def _entropies():
    n = F.col("n")
    h_a, h_b, h_ab = (F.log(n) - F.col(c) / n for c in ("ra.h", "cb.h", "h"))
    return h_a, h_b, h_a + h_b - h_ab


def compare_labels(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row, ``ari`` and ``nmi`` (arithmetic mean), over common ids."""
    h_a, h_b, mutual = _entropies()
    mean = (h_a + h_b) / 2.0
    return _agreement(contingency(a, b, key)).select(
        F.round(_ari(), DIGITS).alias("ari"),
        F.round(F.when(mean > 0, mutual / mean).otherwise(1.0), DIGITS).alias("nmi"))


def agreement_table(clusterings: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """``(a, b, ari, nmi)`` for each ordered pair of named clusterings."""
    out = None
    for x in clusterings:
        for y in clusterings:
            if x == y:
                continue
            row = compare_labels(clusterings[x], clusterings[y], key).select(
                F.lit(x).alias("a"), F.lit(y).alias("b"), "ari", "nmi")
            out = row if out is None else out.unionByName(row)
    return out


def _expected_mutual(a: float, b: float, n: float) -> float:
    """Expected contribution of one pair of margins under random labelling.

    The common count is hypergeometric.  The sum runs over all counts within
    40 deviations and 40 of its mean; by Bernstein's inequality the others have
    a probability below 2 exp(-60) together, less than the rounding of a double.
    """
    low, high = max(1.0, a + b - n), min(a, b)
    mean = a * b / n
    sigma = math.sqrt(max(mean * (1 - a / n) * (n - b) / max(n - 1, 1), 0.0))
    low, high = max(low, math.floor(mean - 40 * sigma - 40)), min(high, math.ceil(mean + 40 * sigma + 40))
    if high < low:
        return 0.0
    count = np.arange(low, high + 1)
    g = math.lgamma
    first = (g(a + 1) + g(b + 1) + g(n - a + 1) + g(n - b + 1) - g(n + 1) - g(low + 1)
             - g(a - low + 1) - g(b - low + 1) - g(n - a - b + low + 1))
    steps = np.log((a - count[:-1]) * (b - count[:-1])) - np.log((count[:-1] + 1) * (n - a - b + count[:-1] + 1))
    logp = first + np.concatenate([[0.0], np.cumsum(steps)])
    return float(np.sum(count / n * np.log(n * count / (a * b)) * np.exp(logp)))


def evaluate_labels(labels: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row, ``ari`` and ``ami`` (arithmetic mean) against the true classes.

    Expected information depends on the margins only through their sizes, so
    equal sizes are counted together before sizes meet.
    """
    @F.pandas_udf("double")
    def expected(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_expected_mutual(x, y, z) for x, y, z in zip(a, b, n)])

    cells = contingency(labels, truth, key)
    sizes = lambda side: cells.groupBy(side).agg(F.sum("n").cast("double").alias("s")).groupBy("s").agg(
        F.count("*").alias("times"))
    packed = sizes("b").agg(F.collect_list(F.struct("s", "times")).alias("x"))
    met = sizes("a").withColumn("o", F.explode(packed.scalar())).withColumn("n", cells.agg(F.sum("n").cast("double")).scalar())
    emi = met.agg(F.sum(expected("s", "o.s", "n") * F.col("times") * F.col("o.times")).alias("emi"))
    h_a, h_b, mutual = _entropies()
    row = _agreement(cells).withColumn("emi", emi.scalar())
    top = (h_a + h_b) / 2.0 - F.col("emi")
    ami = F.when(F.abs(top) < 1e-15, 1.0).otherwise((mutual - F.col("emi")) / top)
    return row.select(F.round(_ari(), DIGITS).alias("ari"), F.round(ami, DIGITS).alias("ami"))
