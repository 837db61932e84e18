"""Skip-gram with negative sampling, trained block by block.

Two tables of vectors, one for each end of a pair, are cut into blocks of
bounded size.  A round deals every block of the one table a single block of the
other, together with the pairs between the two, and the next round moves on by
one, so that an epoch meets all pairs once.  Neither the vectors nor the list of
names ever lie on the driver or in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 20_000          # vectors of one side that a task holds
PAIRS = 4_000_000       # distinct pairs that a task holds, on average
BATCH = 2048            # pairs whose gradients are taken at once, at most
EACH = 4                # and as many of them for each row of the smaller side
NEGATIVES = 128         # negatives that the pairs of a batch share
STEADY = 16.0           # gradients of one vector in a batch beyond which their sum grows no further


def _block(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def start(column: str, dim: int, seed: int) -> Column:
    """A small vector that depends on nothing but the name and the seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (
        (F.pmod(F.xxhash64(F.col(column), d, F.lit(seed)), F.lit(2_000_001)) - 1_000_000) / (2e6 * dim)).cast("float"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of an array of its own."""
    flat = pc.list_flatten(column)
    return flat.to_numpy().reshape(len(column), dim).copy()


def as_lists(rows: np.ndarray) -> pa.Array:
    many, dim = rows.shape
    kind = pa.float32() if rows.dtype == np.float32 else pa.float64()
    return pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * dim, pa.int32()), pa.array(rows.ravel(), kind))


def _added(into: np.ndarray, at: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Adds the sum of each row's gradients, damped where a row has very many of them."""
    order = np.argsort(at, kind="stable")
    rows, first, many = np.unique(at[order], return_index=True, return_counts=True)
    total = np.add.reduceat(grads[order], first, axis=0)
    into[rows] += rate * total * np.minimum(1.0, STEADY / many).astype(np.float32)[:, None]


def descend(u: np.ndarray, v: np.ndarray, src: np.ndarray, dst: np.ndarray, n: np.ndarray, share: np.ndarray,
            rate: float, negative: int, rng: np.random.Generator) -> None:
    """One pass over the pairs ``(src, dst)``, each ``n`` times, in mixed order; ``u`` and ``v`` are changed in place.

    ``share`` is how likely each row of ``v`` is to be a negative.
    """
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    if not total:
        return
    step = max(1, int(total * 0.6180339887)) % total or 1
    while math.gcd(step, total) > 1:  # then every visit comes once
        step += 1
    at = int(rng.integers(total))
    draws = np.cumsum(share / share.sum())
    batch = min(BATCH, max(32, EACH * min(len(u), len(v))))
    for low in range(0, total, batch):
        size = min(batch, total - low)
        visit = (at + step * np.arange(low, low + size)) % total
        pair = np.searchsorted(upto, visit, side="right")
        a, b = src[pair], dst[pair]
        noise = np.minimum(np.searchsorted(draws, rng.random(NEGATIVES)), len(v) - 1)
        x, y, z = u[a], v[b], v[noise]
        pull = 1.0 / (1.0 + np.exp(np.clip(np.einsum("ij,ij->i", x, y), -30, 30)))  # 1 - sigma
        push = (negative / NEGATIVES) / (1.0 + np.exp(-np.clip(x @ z.T, -30, 30)))
        push *= b[:, None] != noise[None, :]
        down = push.T @ x
        _added(u, a, pull[:, None] * y - push @ z, rate)
        _added(v, b, pull[:, None] * x, rate)
        weight = push.sum(0)
        np.subtract.at(v, noise, rate * down * np.minimum(1.0, STEADY / np.maximum(weight, 1e-9))[:, None])


def train(pairs: DataFrame, dim: int = 64, epochs: int = 5, negative: int = 5, rate: float = 0.05, seed: int = 42,
          blocks: int = 4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Vectors ``(id, vec)`` of both ends of ``pairs(src, dst, n)``, trained to tell the pairs from chance.

    There are at least ``blocks`` blocks of either side.  Where ``src`` needs
    more of them than ``dst``, as documents do against words, several tasks
    train on copies of a block, and the copies are averaged after the round.
    Results do not depend on the number of cores.  A null end leaves its pair
    out; no pairs give no rows.
    """
    pairs = cut(pairs.where("src IS NOT NULL AND dst IS NOT NULL AND n > 0").groupBy("src", "dst").agg(F.sum("n").cast("bigint").alias("n")))
    size = pairs.agg(F.count("*").alias("n"), F.count_distinct("src").alias("src"), F.count_distinct("dst").alias("dst")).first()
    least = max(blocks, math.ceil(math.sqrt(size["n"] / PAIRS)))
    p = max(least, math.ceil(size["src"] / block))
    q = max(least, math.ceil(size["dst"] / block))
    p = max(p, q)
    placed = pairs.withColumn("i", _block("src", p)).withColumn("turn", F.pmod(_block("dst", q) - F.col("i"), F.lit(q)).cast("int"))
    placed = cut(placed.repartition("turn", "i"))

    def side(c: str, own: int, first: Column) -> DataFrame:
        other = "dst" if c == "src" else "src"
        rows = pairs.groupBy(c).agg(F.sum("n").alias("n")).withColumn(other, F.lit(None).cast(pairs.schema[other].dataType))
        return rows.select("src", "dst", _block(c, own).alias("block"), "n", first.alias("vec"))

    state = cut(side("src", p, start("src", dim, seed)).unionByName(side("dst", q, F.array_repeat(F.lit(0.0).cast("float"), dim))))
    schema = state.schema
    names = schema.names

    def step_of(now: float, salt: tuple):
        def step(met: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.select(names)
            ours = pc.is_valid(rows.column("src"))
            a, b = rows.filter(ours).sort_by("src"), rows.filter(pc.invert(ours)).sort_by("dst")
            if not (len(met) and len(a) and len(b)):
                return rows
            met = met.sort_by([("src", "ascending"), ("dst", "ascending")])
            u, v = matrix(a.column("vec"), dim), matrix(b.column("vec"), dim)
            place = [pc.index_in(met.column(c), value_set=t.column(c).combine_chunks()).to_numpy() for c, t in (("src", a), ("dst", b))]
            share = b.column("n").to_numpy().astype(float) ** 0.75
            rng = np.random.default_rng([*salt, int(a.column("block")[0].as_py())])
            descend(u, v, *place, met.column("n").to_numpy(), share, now, negative, rng)
            at = names.index("vec")
            return pa.concat_tables([t.set_column(at, "vec", as_lists(m)) for t, m in zip((a, b), (u, v))])

        return step

    for done in range(epochs * q):
        turn = done % q
        met = placed.where(F.col("turn") == turn).select("src", "dst", "n", "i")
        ours = F.col("src").isNotNull()
        first = F.when(ours, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(q)).cast("int"))
        dealt = state.withColumn("key", F.explode(F.sequence(first, F.when(ours, F.col("block")).otherwise(p - 1), F.lit(q))))
        now = rate * max(1 - done / (epochs * q), 0.02)
        state = cut(met.groupBy("i").cogroup(dealt.groupBy("key")).applyInArrow(step_of(now, (seed, done)), schema))
        if p > q:
            copies = state.where("src IS NULL").withColumn("v", array_to_vector(F.col("vec").cast("array<double>")))
            copies = copies.groupBy("dst").agg(F.first("block").alias("block"), F.first("n").alias("n"), Summarizer.mean(F.col("v")).alias("v"))
            whole = copies.select(F.lit(None).cast(schema["src"].dataType).alias("src"), "dst", "block", "n", vector_to_array("v").cast("array<float>").alias("vec"))
            state = cut(state.where("src IS NOT NULL").unionByName(whole))
    vec = F.col("vec").cast("array<double>").alias("vec")
    return (state.where("src IS NOT NULL").select(F.col("src").alias("id"), vec),
            state.where("src IS NULL").select(F.col("dst").alias("id"), vec))


def window_pairs(walks: DataFrame, window: int, path: str = "path") -> DataFrame:
    """``(src, dst, n)``: how often two names of a path lie at most ``window`` steps apart."""
    at = walks.select(F.col(path).alias("path"), F.posexplode(path).alias("i", "src"))
    low = F.greatest(F.col("i") - window, F.lit(0))
    near = F.slice("path", low + 1, F.col("i") - low + window + 1)
    met = at.select("src", "i", low.alias("low"), F.posexplode(near).alias("k", "dst"))
    return met.where(F.col("low") + F.col("k") != F.col("i")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def word_pairs(bags: DataFrame, min_count: int) -> DataFrame:
    """``(src, dst, n)``: documents and their words, without words that the corpus has fewer than ``min_count`` times."""
    counts = bags.select(F.col("doc_id").alias("src"), F.explode("words").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    counts = cut(counts)
    common = counts.groupBy("dst").agg(F.sum("n").alias("all")).where(F.col("all") >= min_count).select("dst")
    return counts.join(common, "dst", "left_semi")
