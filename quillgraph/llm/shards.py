"""Shards of near equal size that keep equal texts together: a minimax contiguous partition.

Groups of equal texts stand in the order of their text's hash.  The smallest
capacity that a greedy cut of this order needs for the given number of shards is
found by binary search, and the order is cut there.  DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BORDERS = 1 << 17   # pieces, each with two group borders, that the driver looks at in one step


def _greedy(borders: np.ndarray, whole: np.ndarray, capacity: int, shards: int, hopeful: bool) -> int:
    """Size that ``shards`` greedy shards of ``capacity`` hold, cut at known borders.

    ``hopeful`` also cuts anywhere in a stretch whose inner borders are not known (not ``whole``).
    """
    at = 0
    for _ in range(shards):
        goal = at + capacity
        i = int(np.searchsorted(borders, goal, side="right")) - 1
        at = goal if hopeful and i + 1 < len(borders) and not whole[i + 1] else int(borders[i])
        if at >= borders[-1]:
            return int(borders[-1])
    return at


def _smallest(borders, whole, shards, hopeful) -> int:
    low, high = max(1, -(-int(borders[-1]) // shards)), max(1, int(borders[-1]))
    while low < high:
        middle = (low + high) // 2
        if _greedy(borders, whole, middle, shards, hopeful) >= borders[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _zones(borders, whole, low, high, shards) -> list[tuple[int, int]]:
    """Stretches with unknown borders in which a cut can fall for a capacity from low to high."""
    zones, a, b = set(), 0, 0
    for _ in range(shards):
        i = int(np.searchsorted(borders, min(a + low, borders[-1]), side="right")) - 1
        j = int(np.searchsorted(borders, min(b + high, borders[-1]), side="right"))
        zones |= {k for k in range(i, min(j, len(borders) - 1) + 1) if not whole[k]}
        a, b = int(borders[i]), b + high
    return [(int(borders[k - 1]), int(borders[k])) for k in sorted(zones)]


def smallest_capacity(ends: DataFrame, total: int, shards: int) -> tuple[int, np.ndarray]:
    """The smallest feasible capacity, and known group borders that reach it.

    ``ends`` (end) are the running sums of the ordered groups.  The driver
    holds at most ``BORDERS`` of them, the last of equal stretches, and looks more
    closely only at stretches in which a cut may fall, until the hopeful and
    the sure capacity meet.
    """
    zones = [(0, total)]
    known = {0: True}  # border -> the stretch before it is one group
    while True:
        pieces = max(2, BORDERS // len(zones))
        spans = ends.sparkSession.createDataFrame(zones, "low bigint, high bigint")
        inside = ends.join(F.broadcast(spans), (F.col("end") > F.col("low")) & (F.col("end") <= F.col("high")))
        piece = F.floor((F.col("end") - F.col("low") - 1) * F.lit(float(pieces)) / (F.col("high") - F.col("low")))
        found = inside.groupBy("low", piece.alias("piece")).agg(
            F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("n")).collect()
        for r in found:  # nothing ends between the last border of a piece and the first of the next
            known[r["last"]] = r["n"] <= 2
            known[r["first"]] = True
        borders = np.array(sorted(known), np.int64)
        whole = np.array([known[int(b)] for b in borders])
        low, high = (_smallest(borders, whole, shards, hopeful) for hopeful in (True, False))
        if low == high:
            return high, borders
        zones = _zones(borders, whole, low, high, shards)


def cuts(borders: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Where the first ``shards`` - 1 shards end: as near to equal parts as the capacity lets them.

    A border is valid if what follows still fits; those limits come from cutting greedily from the end.
    """
    total, limits, at = int(borders[-1]), [], int(borders[-1])
    for _ in range(shards - 1):
        at = int(borders[np.searchsorted(borders, max(at - capacity, 0), side="left")])
        limits.append(at)
    out, at = [], 0
    for i, limit in enumerate(reversed(limits)):
        goal = min(at + (total - at) // (shards - i), at + capacity)
        below = int(np.searchsorted(borders, goal, side="right")) - 1
        best = int(borders[below])
        if below + 1 < len(borders) and borders[below + 1] <= at + capacity and borders[below + 1] - goal < goal - best:
            best = int(borders[below + 1])
        at = max(best, limit, at)
        out.append(at)
    return out


def assign(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row.

    The size is the UTF-8 bytes of the text (null: none) plus 1.  Rows of equal
    text share a shard; null texts are a group of their own.  A group larger
    than an equal part of what is left gets a shard for itself, the largest
    first; the others are parted by the smallest capacity.  Slots count from 0 in
    every shard, by text and id; rows that repeat an id have slots of their own.
    """
    body = F.col(f"`{text}`")
    rows = cut(df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b"")).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect()
    sums = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    total, alone = sums["bytes"], []
    for r in largest:
        if r["bytes"] * (shards - len(alone)) <= total:
            break
        alone.append(bytes(r["key"]))
        total -= r["bytes"]
    single = F.lit(-1)
    for i, key in enumerate(alone):
        single = F.when(F.col("key") == F.lit(key), F.lit(i)).otherwise(single)
    groups = groups.withColumn("alone", single.cast("int"))
    # Running sums: inside buckets of the hash order, plus what lies before a bucket.
    buckets = 1 << max(8, int(sums["n"] // 50_000).bit_length())
    ordered = groups.where("alone < 0").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    before = ordered.groupBy("bucket").agg(F.sum("bytes").alias("b")).select(
        "bucket", (F.sum("b").over(Window.orderBy("bucket")) - F.col("b")).alias("before"))
    inside = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
    ends = cut(ordered.withColumn("inside", inside).join(before, "bucket").select("key", (F.col("before") + F.col("inside")).alias("end")))
    left = shards - len(alone)
    if total:
        capacity, borders = smallest_capacity(ends.select("end"), total, left)
        where = cuts(borders, capacity, left)
    else:
        where = []
    shard = sum(((F.col("end") > F.lit(c)).cast("int") for c in where), F.lit(len(alone)))
    placed = ends.select("key", shard.cast("int").alias("shard")).unionByName(
        groups.where("alone >= 0").select("key", F.col("alone").alias("shard")))
    return numbered(rows.join(placed, "key"))


def numbered(rows: DataFrame) -> DataFrame:
    """Slots from 0 in every shard: rows are sorted over ranges, written, and counted by range."""
    sorted_rows = rows.repartitionByRange("shard", "key", "doc_id").sortWithinPartitions("shard", "key", "doc_id")
    written = cut(sorted_rows.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", 33)
    counts = written.groupBy("shard", part.alias("part")).agg(F.min("place").alias("low"), F.count("*").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("part")
    offsets = counts.select("shard", "part", "low", (F.sum("n").over(by_shard) - F.col("n")).alias("before"))
    found = written.withColumn("part", part).join(offsets, ["shard", "part"])
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("low") + F.col("before")).alias("slot"))
