"""Shared building blocks that keep hot keys and global orders off single tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SALTS = 8
HASH_BUCKETS = 4096


def salted_join(
    big: DataFrame, small: DataFrame, key: str | Sequence[str], spread: str, how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join on ``key`` where ``big`` may hold very many rows of one key.

    Each key of ``big`` is dealt over ``salts`` tasks by the hash of ``spread``
    and ``small`` is repeated once per salt.  ``how`` may be inner, left (big
    side kept), left_semi or left_anti.

    The salts are a table of their own: Spark takes an exploded table to be as
    small as the one before, and would broadcast all copies of it.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)))
    repeated = small.crossJoin(small.sparkSession.range(salts).withColumnRenamed("id", "_salt"))
    keys = [key] if isinstance(key, str) else list(key)
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


HEAVY_SHARE = 1000   # a key with more than one in so many rows may be heavy; there are no more than that many
HEAVY_ROWS = 100_000  # if it has so many rows, and so many go to a task


@dataclass
class Dealt:
    """Rows written with the salts of their heavy keys, for many joins with smaller tables."""

    rows: DataFrame
    heavy: DataFrame
    key: str | Sequence[str]

    def meet(self, small: DataFrame, how: str = "inner") -> DataFrame:
        """Equi-join with ``small``; only rows of heavy keys are copied, once a salt."""
        keys = [self.key] if isinstance(self.key, str) else list(self.key)
        copied = small.join(F.broadcast(self.heavy), keys, "left")
        salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        return self.rows.join(copied.withColumn("_salt", F.explode(salts)).drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def heavy_keys(rows: DataFrame, key: str, least: int = HEAVY_ROWS) -> DataFrame:
    """``(key, _salts)`` of the keys that one task should not hold alone, by count; at most ``HEAVY_SHARE`` of them."""
    return heavy_of(rows.groupBy(key).agg(F.count("*").alias("_n")), rows.agg(F.count("*").alias("n")), key, least)


def heavy_of(counts: DataFrame, total: DataFrame, key: str | Sequence[str], least: int = HEAVY_ROWS) -> DataFrame:
    """:func:`heavy_keys` of rows that were counted by key (``_n``) before."""
    key = [key] if isinstance(key, str) else list(key)
    heavy = counts.where((F.col("_n") > least) & (F.col("_n") * HEAVY_SHARE > total.scalar()))
    return cut(heavy.select(*key, F.ceil(F.col("_n") / least).cast("int").alias("_salts")))


def deal(rows: DataFrame, key: str, spread: str, least: int = HEAVY_ROWS) -> Dealt:
    """``rows`` with every heavy ``key`` dealt over as many salts as its count asks for, by the hash of ``spread``."""
    dealt = deal_heavy(rows, heavy_keys(rows, key, least), key, spread)
    return Dealt(cut(dealt.rows), dealt.heavy, key)


def deal_heavy(rows: DataFrame, heavy: DataFrame, key: str | Sequence[str], spread: str) -> Dealt:
    """:func:`deal` by heavy keys that are known, for a single join: nothing is written."""
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts"))).cast("int")
    return Dealt(rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt).drop("_salts"), heavy, key)


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group, numbered from 1.

    With a group the rank filter lets Spark cut each group to ``k`` rows before
    the shuffle; without one it is a sort with a limit.
    """
    if group:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def lowest_hashes(
    df: DataFrame, key: str, quota: DataFrame, seed: int, group: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``take`` rows of each group, chosen by the seeded hash of ``key``.

    ``quota`` holds the group columns and ``take``.  Hash buckets are counted
    first; whole buckets are taken as they are and rows are ranked only inside
    the one bucket per group where the quota runs out, so no group is ever
    sorted as a whole.  ``key`` must be unique.
    """
    group = list(group)
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    hashed = hashed.withColumn("_b", F.pmod("_h", F.lit(HASH_BUCKETS)))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    if group:
        counts = counts.join(quota, group)
    else:
        counts = counts.withColumn("take", quota.select("take").scalar())
    room = counts.withColumn("_room", F.col("take") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    room = room.where("_room > 0").select(*group, "_b", "_room", (F.col("_n") <= F.col("_room")).alias("_whole"))
    chosen = hashed.join(room, [*group, "_b"])
    whole = chosen.where("_whole").drop("_h", "_b", "_room", "_whole")
    edge = top_k_by_column(chosen.where("NOT _whole"), [*group, "_b"], [F.col("_h"), F.col(key)], "_room")
    return whole.unionByName(edge.drop("_h", "_b", "_room", "_whole"))


def top_k_by_column(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= F.col(limit)).drop("_r")


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: ``(column, prob, value)``.

    Values are counted first, then range-partitioned, so the running position
    is a sum inside each partition plus one offset per partition.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("x")).select("x.*").where("value IS NOT NULL")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = cut(
        counted.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    )
    per_part = placed.groupBy("column", "part").agg(F.sum("n").alias("n"))
    by_part = Window.partitionBy("column").orderBy("part")
    offsets = per_part.select(
        "column", "part", (F.sum("n").over(by_part) - F.col("n")).alias("offset"),
        F.sum("n").over(Window.partitionBy("column")).alias("total"),
    )
    inside = Window.partitionBy("column", "part").orderBy("value")
    ranked = placed.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["column", "part"])
    ranked = ranked.withColumn("last", F.col("offset") + F.col("upto") - 1).withColumn(
        "first", F.col("offset") + F.col("upto") - F.col("n")
    )
    wanted = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("place", F.col("prob") * (F.col("total") - 1))
    holds = lambda r: (F.col("first") <= r) & (r <= F.col("last"))
    picked = wanted.groupBy("column", "prob").agg(
        F.max(F.when(holds(F.floor("place")), F.col("value"))).alias("low"),
        F.max(F.when(holds(F.ceil("place")), F.col("value"))).alias("high"),
        F.max(F.col("place") - F.floor("place")).alias("share"),
    )
    return picked.select(
        "column", "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("value")
    )
