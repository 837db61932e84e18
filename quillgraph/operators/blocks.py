"""All against all in pairs of bounded blocks: nearest vectors and the like."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import salted_join, top_k

BLOCK = 2000  # rows of either side that one task compares at a time


def bounded_matrix(rows: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table that must not hold more than ``bound`` rows."""
    local = rows.select("id", "vec").limit(bound + 1).toPandas()
    if len(local) > bound:
        raise ValueError(f"more than {bound} vectors in one block")
    if local.empty:
        return np.array([], dtype=np.int64), np.zeros((0, 0))
    return local["id"].to_numpy(), matrix(local)


def matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["vec"].to_numpy()).astype(float)


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def id_type(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def _meet(a: DataFrame, b: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    names = b.columns
    b = b.toDF(*[f"o_{c}" for c in names])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(left, right.set_axis(names, axis=1))

    return a.groupBy(*keys).cogroup(b.groupBy(*[f"o_{c}" for c in keys])).applyInPandas(run, schema)


def _deal(n) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _spread(n) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def all_pairs(home: DataFrame, seen: DataFrame, fn: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """``fn(home_rows, seen_rows)`` on every pair of a block of ``home`` and a block of ``seen``.

    Blocks are hash buckets of ``id`` of about ``block`` rows.  A side is
    copied once per block of the other, so few queries cost few copies of them
    and none of the rows they are held against.  A pair of blocks is one task's
    work; nothing passes through the driver but two counts.
    """
    h, s = (max(1, math.ceil(df.count() / block)) for df in (home, seen))
    a = home.withColumn("hb", _deal(F.lit(h))).withColumn("sb", _spread(F.lit(s)))
    b = seen.withColumn("sb", _deal(F.lit(s))).withColumn("hb", _spread(F.lit(h)))
    return _meet(a, b, ["hb", "sb"], fn, schema)


def cell_pairs(home: DataFrame, seen: DataFrame, fn: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """As :func:`all_pairs`, but only inside the same ``cell``; both sides of a cell are cut into blocks."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    plan = parts(home, "h").join(parts(seen, "s"), "cell")
    planned_home, planned_seen = (salted_join(df, plan, "cell", "id") for df in (home, seen))
    a = planned_home.withColumn("hb", _deal(F.col("h"))).withColumn("sb", _spread(F.col("s"))).drop("h", "s")
    b = planned_seen.withColumn("sb", _deal(F.col("s"))).withColumn("hb", _spread(F.col("h"))).drop("h", "s")
    return _meet(a, b, ["cell", "hb", "sb"], fn, schema)


def best_of(k: int, metric: str, p: int):
    """The ``k`` best of the known rows for every asked row of a pair of blocks."""
    higher = metric == "cosine"

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            none = np.array([], dtype=float)
            return pd.DataFrame({"query_id": asked["id"].iloc[:0], "id": known["id"].iloc[:0], "score": none})
        known = known.sort_values("id")
        q, m = matrix(asked), matrix(known)
        score = np.round(unit_rows(q) @ unit_rows(m).T if higher else _minkowski(q, m, p), 6)
        pick = np.argsort(-score if higher else score, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({
            "query_id": np.repeat(asked["id"].to_numpy(), pick.shape[1]),
            "id": known["id"].to_numpy()[pick].ravel(),
            "score": np.take_along_axis(score, pick, axis=1).ravel(),
        })

    return best


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", p: int = 2, block: int = BLOCK
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest ``vectors(id, vec)`` of each query, exactly.

    Every pair of blocks hands on its best ``k`` per query.  ``score`` is the
    cosine, or the distance for ``minkowski``; ties go to the smaller id.  Tables
    of many blocks are better searched by ``cells.nearest``, which gives the
    same rows.
    """
    found = all_pairs(
        queries.select("id", "vec"), vectors.select("id", "vec"), best_of(k, metric, p),
        f"query_id {id_type(queries)}, id {id_type(vectors)}, score double", block)
    return ranked(found, k, metric)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return top_k(found, ["query_id"], [order, F.asc("id")], k).select("query_id", "rank", "id", "score")


def _minkowski(q: np.ndarray, m: np.ndarray, p: int) -> np.ndarray:
    out = np.empty((len(q), len(m)))
    for row in range(len(q)):
        gap = np.abs(m - q[row])
        out[row] = gap.sum(axis=1) if p == 1 else np.sqrt((gap * gap).sum(axis=1))
    return out
