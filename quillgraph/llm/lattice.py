"""Near-duplicate vectors by lattice hashing.

Each of several tables turns the unit vectors, takes three blocks of eight
coordinates, and decodes every block to the nearest point of the E8 lattice; the
points name a cell.  A vector also probes the cells that have the second
candidate point in one block.  Pairs that meet are verified by their cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .links import components
from .words import STEP, mixed, signed

TABLES = 14
BLOCKS = 3
SCALE = 28.0   # per square root of the dimension: 3.5 at 64
CHUNK = 4096


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the worst coordinate goes the other way."""
    point = np.rint(x)
    gap = x - point
    worst = np.abs(gap).argmax(axis=-1)[..., None]
    turn = np.where(np.take_along_axis(gap, worst, -1) >= 0, 1.0, -1.0) * (point.sum(axis=-1, keepdims=True) % 2)
    np.put_along_axis(point, worst, np.take_along_axis(point, worst, -1) + turn, -1)
    return point


def nearest_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 point of each row of 8, and the nearest one of the other coset (integers or halves)."""
    one, two = _even(x), _even(x - 0.5) + 0.5
    first = ((x - one) ** 2).sum(axis=-1) <= ((x - two) ** 2).sum(axis=-1)
    return np.where(first[..., None], one, two), np.where(first[..., None], two, one)


def rotations(dim: int, tables: int = TABLES) -> np.ndarray:
    """For each table an orthonormal set of directions, as many as its blocks need (at most ``dim``, filled up with zeros)."""
    width = 8 * BLOCKS
    out = np.zeros((tables, dim, width))
    for t in range(tables):
        turned = np.linalg.qr(np.random.default_rng([dim, t]).normal(size=(dim, dim)))[0]
        out[t, :, :min(dim, width)] = turned[:, :width]
    return out


def cells(unit: np.ndarray, turn: np.ndarray, table: int) -> np.ndarray:
    """Cell numbers of unit vectors in one table: the own cell, then a probed cell per block."""
    x = (unit @ turn * (SCALE / 8.0 * np.sqrt(unit.shape[1] / 64.0))).reshape(len(unit), BLOCKS, 8)
    best, other = nearest_points(x)
    def code(points):
        h = np.full(len(points), table + 1, np.uint64)
        for value in (2 * points).astype(np.int64).astype(np.uint64).reshape(len(points), -1).T:
            h = mixed(h * STEP + value)
        return h
    out = [code(best)]
    for b in range(BLOCKS):
        points = best.copy()
        points[:, b] = other[:, b]
        out.append(code(points))
    return np.array(out)


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two (exact, so that cosines stay) that bring the largest component near one: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _hashed(classes: DataFrame) -> DataFrame:
    """``(cell, id, own)`` of ``(id, vec)``."""
    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, begin = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes):
                some = np.flatnonzero(sizes == dim)
                turn = turns.setdefault(int(dim), rotations(int(dim)))
                for i in range(0, len(some), CHUNK):
                    at = some[i:i + CHUNK]
                    x = levelled(flat[begin[at][:, None] + np.arange(dim)])
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(len(turn)):
                        found = cells(unit, turn[t], t) ^ np.uint64(dim)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signed(found.ravel())), pa.array(np.tile(ids[at], len(found))),
                             pa.array(np.repeat(np.arange(len(found)) == 0, len(at)))], names=["cell", "id", "own"])

    return classes.select("id", "vec").mapInArrow(run, "cell bigint, id bigint, own boolean")


def _cosines(pairs: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of ``(a, b, va, vb)`` with a cosine of ``least`` or more."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(2), batch.column(3)
            close = np.zeros(batch.num_rows, bool)
            sizes = np.diff(a.offsets.to_numpy())
            same = sizes == np.diff(b.offsets.to_numpy())
            for dim in np.unique(sizes[same]):
                at = np.flatnonzero(same & (sizes == dim))
                x, y = (levelled(v.values.to_numpy()[v.offsets.to_numpy()[:-1][at][:, None] + np.arange(dim)]) for v in (a, b))
                dots = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                close[at] = dots >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(close)) for i in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def near_vectors(df: DataFrame, least: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Equal vectors are one class: they link to each other and share the links
    of their class, without being listed as pairs.  Null, empty and zero
    vectors, and those with a null or non-finite component, link with nothing.
    Vectors of different lengths never link.  Rows that repeat an id count as
    vectors of their own under the same id.
    """
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    code = F.sha2(F.concat_ws(",", F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    marked = rows.select("vec_id", F.when(usable, F.col("vec")).alias("vec"), F.when(usable, code).alias("code"))
    known = marked.where("code IS NOT NULL")
    classes = cut(known.groupBy("code").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.any_value("vec").alias("vec")))
    placed = cut(_hashed(classes))
    own, probing = placed.where("own").select("cell", F.col("id").alias("a")), placed.select("cell", F.col("id").alias("b"))
    met = own.join(probing, "cell").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with_a = met.join(classes.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    with_both = with_a.join(classes.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    linked = cut(_cosines(with_both.select("a", "b", "va", "vb"), least))
    roots = components(linked)
    sizes = classes.select(F.col("id").alias("b"), "m")
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, "b").groupBy(F.col("a").alias("id")).agg(F.sum("m").alias("others"))
    table = classes.select("code", "id", "m").join(others, "id", "left").join(roots, "id", "left").select(
        "code", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    found = marked.drop("vec").join(table, "code", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
