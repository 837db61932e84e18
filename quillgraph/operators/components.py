"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scale import salted_join


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def star_links(stars: DataFrame) -> DataFrame:
    """``(src, dst)``: every member of a hub linked to the hub's smallest member."""
    first = stars.groupBy("hub").agg(F.min("id").alias("dst"))
    joined = salted_join(stars.select("hub", F.col("id").alias("src")), first, "hub", "src")
    return joined.where("src <> dst").select("src", "dst")


def components(nodes: DataFrame, edges: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """``(id, component)``, a component being named by its smallest id (direction ignored).

    Each round links larger neighbours, then smaller ones, of a node to the
    smallest (the large-star and small-star steps of Kiveris et al., 2014).
    The pairs never grow in number and settle after O(log^2 n) rounds into one
    star per component.
    """
    if stars is not None:
        edges = edges.select("src", "dst").unionByName(star_links(stars))
    ordered = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    current = cut(ordered.distinct())
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _lowest(large)
        linked = salted_join(large, low, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = cut(small, plain=True)
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40))).alias("h")).first()
        if (state["n"], state["h"]) == mark:
            break
        mark = (state["n"], state["h"])
    joined = nodes.select("id").hint("merge").join(current.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


def component_stats(found: DataFrame) -> DataFrame:
    """One row: number of components, size of the largest and its share of the nodes."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    row = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))
    return row.select("components", "largest", F.round(F.col("largest") / F.col("nodes"), 6).alias("share"))


def largest_component(found: DataFrame) -> DataFrame:
    """``(id)`` of the largest component, the smaller name on ties."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1).select("component")
    return found.where(F.col("component") == best.scalar()).select("id")
