"""Connected components of links between numbered things, on tables written round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every end of ``links`` (a, b): the smallest id that its links reach.

    Each round ties the larger neighbours of a node, then its smaller ones, to
    its smallest neighbour (alternating stars, Kiveris et al. 2014) until nothing
    changes.  Joins and aggregates only; a hub's rows are summed before they are
    dealt out, and its join is split by the runtime.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == mark:
            break
        mark = state
    found = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("id"), "root").distinct())
