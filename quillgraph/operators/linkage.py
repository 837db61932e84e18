"""Single-linkage clustering by a minimum spanning forest.

Boruvka rounds: every component finds its shortest edge to another one, and all
these edges join the forest at once.  A component first looks inside the cells
of its own points; the shortest edge found there bounds which other cells can
hold a shorter one.  Edges are ordered by length, then by their ids, so that the
forest is the only one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import cells as B
from .blocks import id_type, matrix
from .components import components


def _shortest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Per component of ``a`` its shortest edge to a point of ``b`` in another component."""
    none = pd.DataFrame({"component": a["component"].iloc[:0], "d": np.array([], float), "lo": a["id"].iloc[:0], "hi": a["id"].iloc[:0]})
    if a.empty or b.empty:
        return none
    order, place = np.unique(np.concatenate([a["component"].to_numpy(), b["component"].to_numpy()]), return_inverse=True)
    own, theirs = place[:len(a)], place[len(a):]
    m, n = matrix(a), matrix(b)
    gap = B.distances(m, n)
    gap[own[:, None] == theirs[None, :]] = np.inf
    best = np.full(len(order), np.inf)
    np.minimum.at(best, own, gap.min(axis=1))
    i, j = np.nonzero((gap <= best[own][:, None] + B.SLACK) & np.isfinite(gap))
    if not len(i):
        return none
    ids, other = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
    swap = ids > other
    found = pd.DataFrame({
        "component": a["component"].to_numpy()[i], "d": np.sqrt(((m[i] - n[j]) ** 2).sum(axis=1)),  # the same from either end
        "lo": np.where(swap, other, ids), "hi": np.where(swap, ids, other)})
    return _best(found)


def _best(found: pd.DataFrame) -> pd.DataFrame:
    return found.sort_values(["component", "d", "lo", "hi"]).drop_duplicates("component")


def spanning_forest(vectors: DataFrame, size: int = B.CELL) -> DataFrame:
    """``(src, dst, height)``: the minimum spanning tree of ``vectors(id, vec)`` by Euclidean distance, ``src < dst``.

    Equal vectors are tied at height 0 to the smallest id among them.  Ids are
    distinct; rows without a vector are left out.  In order of ``(height, src,
    dst)`` the edges are the merges of the single-linkage dendrogram.
    """
    kind = id_type(vectors)
    vectors = vectors.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    points = cut(vectors.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    copies = vectors.join(points.withColumnRenamed("id", "first"), "vec").where("id <> first")
    forest = [cut(copies.select(F.col("first").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("height")))]
    cells = B.plant(points, size)
    labels = cut(points.select("id", F.col("id").alias("component")))
    schema = f"component {kind}, d double, lo {kind}, hi {kind}"
    shortest = lambda rows: rows.groupBy("component").agg(F.min(F.struct("d", "lo", "hi")).alias("e"))
    while labels.select("component").distinct().limit(2).count() > 1:
        rows = cut(cells.rows.select("id", "vec", "cell").join(labels, "id"))
        own = cells.leaves.select(F.col("id").alias("a"), F.col("id").alias("b"))
        inside = cut(shortest(B.meet(cells, rows, rows, own, _shortest, schema, size, _best)))
        # How far a cell has to look: as far as the worst component among its points.
        known = rows.select("component", "cell").distinct().join(inside.select("component", F.col("e.d").alias("d")), "component", "left")
        known = known.groupBy("cell").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("most"), F.count("*").alias("kinds"), F.min("component").alias("one"))
        known = cut(known)
        pairs = B.cell_bounds(cells, known.select(F.col("cell").alias("id"), "most")).where("a <> b")
        whole = known.where("kinds = 1")  # two cells of one and the same component have nothing to tell
        pairs = pairs.join(whole.select(F.col("cell").alias("a"), F.col("one").alias("one_a")), "a", "left").join(
            whole.select(F.col("cell").alias("b"), F.col("one").alias("one_b")), "b", "left").where("one_a IS NULL OR one_b IS NULL OR one_a <> one_b")
        outside = B.meet(cells, rows, rows, pairs, _shortest, schema, size, _best)
        every = inside.select("component", "e.*").unionByName(outside)
        edges = cut(shortest(every).select("e.*").distinct())
        forest.append(edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("d").alias("height")))
        joined = components(labels.select("id"), forest[-1].select("src", "dst").unionByName(labels.select(F.col("id").alias("src"), F.col("component").alias("dst"))))
        labels = cut(joined.select("id", "component"))
    out = forest[0]
    for part in forest[1:]:
        out = out.unionByName(part)
    return out


def merges(forest: DataFrame) -> DataFrame:
    """``(step, src, dst, height)``: the dendrogram, merges numbered from 1 by height, then by ids."""
    order = ["height", "src", "dst"]
    placed = cut(forest.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(before), "_part").select((F.col("_before") + inside).alias("step"), "src", "dst", "height")


def linkage(vectors: DataFrame, k: int, size: int = B.CELL) -> DataFrame:
    """``(id, cluster)``: single-linkage clusters, ``k`` of them, numbered from 0 in order of their smallest ids.

    The ``k - 1`` last merges are undone.  With fewer rows than ``k`` each is a
    cluster; rows without a vector get -1.
    """
    forest = cut(spanning_forest(vectors, size))
    last = forest.orderBy(F.desc("height"), F.desc("src"), F.desc("dst")).limit(max(k - 1, 0))
    rest = forest.join(last.select("src", "dst"), ["src", "dst"], "left_anti")
    found = cut(components(vectors.where("vec IS NOT NULL").select("id"), rest.select("src", "dst")))
    names = found.select("component").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("component")) - 1)  # k rows
    named = found.join(names, "component").select("id", "cluster")
    return vectors.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
