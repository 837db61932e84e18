"""Article, citation and co-author graphs and their one-pass statistics.

A graph is ``Graph(nodes, edges, stars)``.  ``edges(src, dst, weight)`` lists
pairs; an undirected pair is stored once with ``src < dst``.  ``stars(hub, id,
weight)`` stands for "all members of a hub are joined to each other with this
weight": an author, a reference or a venue with many articles stays as many
rows as it has members, and is never written out as pairs.  Degrees, weights,
components, PageRank and modularity are computed on that form directly.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut
from .scale import exact_percentiles, salted_join, top_k


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    stars: DataFrame | None = None


def stored(graph: Graph) -> Graph:
    """The graph with its tables written once, for work that reads them several times."""
    return Graph(*[None if table is None else cut(table) for table in graph])


# -- building -----------------------------------------------------------------


def memberships(df: DataFrame, list_col: str, kind: str | None = None) -> DataFrame:
    """``(hub, id)``: each distinct entry of an array column with its article.

    ``kind`` is put before the hub where hubs of several kinds share a table.
    """
    rows = df.select("id", F.explode_outer(F.array_distinct(list_col)).alias("hub")).where("hub IS NOT NULL")
    return rows.select("hub", "id") if kind is None else named_hubs(rows, kind)


def named_hubs(members: DataFrame, kind: str) -> DataFrame:
    return members.select(F.concat(F.lit(f"{kind}:"), F.col("hub").cast("string")).alias("hub"), "id")


def venue_memberships(df: DataFrame, venue: str = "venue") -> DataFrame:
    """``(hub, id)`` of the articles with a non-empty venue."""
    named = df.where(F.trim(F.coalesce(F.col(venue).cast("string"), F.lit(""))) != "")
    return named.select(F.concat(F.lit("venue:"), F.col(venue).cast("string")).alias("hub"), "id")


def shared_pairs(members: DataFrame, min_shared: int = 2) -> DataFrame:
    """``(src, dst, shared)``: pairs of articles with at least ``min_shared`` >= 2 hubs in common.

    Every article names the *pairs* of its hubs, and articles meet on a common
    pair of hubs: whoever meets there belongs in the result, so a hub that very
    many articles share produces nothing by itself.  Two articles with s common
    hubs meet s(s-1)/2 times, which gives s back.
    """
    if min_shared < 2:
        raise ValueError("pairs with one common hub stay as stars; see Graph.stars")
    lists = members.groupBy("id").agg(F.array_sort(F.collect_set("hub")).alias("h")).where(F.size("h") >= min_shared)
    first = lists.select("id", "h", F.posexplode("h").alias("i", "a"))
    hub_pairs = first.select("id", "a", F.explode(F.expr("slice(h, i + 2, size(h))")).alias("b"))
    other = hub_pairs.select(F.col("id").alias("dst"), "a", "b")
    met = hub_pairs.withColumnRenamed("id", "src").join(other, ["a", "b"]).where("src < dst")
    times = met.groupBy("src", "dst").agg(F.count("*").alias("c"))
    shared = F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("bigint")
    return times.select("src", "dst", shared.alias("shared")).where(F.col("shared") >= min_shared)


def author_graph(df: DataFrame, authors: str = "authors") -> Graph:
    """Articles joined when they share an author, weight 1 per pair.

    The stars count a pair once per shared author; listed corrections take the
    repeats off again for pairs with two or more.
    """
    members = memberships(df, authors)
    repeats = shared_pairs(members).select("src", "dst", (F.lit(1.0) - F.col("shared")).alias("weight"))
    return Graph(df.select("id"), repeats, members.withColumn("weight", F.lit(1.0)))


def citation_edges(df: DataFrame, references: str = "references") -> DataFrame:
    """``(src, dst)``: directed citations of articles inside the corpus, without self-citations."""
    cited = df.select(F.col("id").alias("src"), F.explode(F.array_distinct(references)).alias("dst"))
    ids = df.select(F.col("id").alias("dst"))
    return salted_join(cited.where("src <> dst"), ids, "dst", "src", "left_semi").select("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` with ``src < dst``, one row per joined pair, weight 1."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pairs.distinct().withColumn("weight", F.lit(1.0))


def coupling_edges(df: DataFrame, threshold: int = 2, references: str = "references") -> DataFrame:
    """``(src, dst, weight)``: articles with at least ``threshold`` references in common."""
    pairs = shared_pairs(memberships(df, references), threshold)
    return pairs.select("src", "dst", F.col("shared").cast("double").alias("weight"))


def venue_graph(df: DataFrame, venue: str = "venue") -> Graph:
    """Articles joined when they appeared in the same non-empty venue, as stars."""
    stars = venue_memberships(df, venue).withColumn("weight", F.lit(1.0))
    none = df.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")).where(F.lit(False))
    return Graph(df.select("id"), none, stars)


# Share of each kind of link in the combined graph.
COMBINED_WEIGHTS = {"author": 1.0, "citation": 0.5, "reference": 0.5, "venue": 0.3}
REFERENCE_CEILING = 5


def combined_graph(
    df: DataFrame, weights: dict[str, float] = COMBINED_WEIGHTS, authors: str = "authors",
    references: str = "references", venue: str = "venue",
) -> Graph:
    """Authors, citations, shared references and venue as one weighted graph.

    A pair weighs ``author`` per shared author, ``citation`` per direction,
    ``reference * min(shared, 5) / 5`` and ``venue``.  All but the ceiling are
    sums over hubs, so they stay stars; only pairs above the ceiling are listed,
    with what they have too much taken off.
    """
    per_reference = weights["reference"] / REFERENCE_CEILING
    refs = memberships(df, references)
    stars = (
        memberships(df, authors, "author").withColumn("weight", F.lit(weights["author"]))
        .unionByName(named_hubs(refs, "reference").withColumn("weight", F.lit(per_reference)))
        .unionByName(venue_memberships(df, venue).withColumn("weight", F.lit(weights["venue"])))
    )
    cited = citation_edges(df, references).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"),
        F.lit(weights["citation"]).alias("weight"))
    above = shared_pairs(refs, REFERENCE_CEILING + 1).select(
        "src", "dst", ((F.lit(REFERENCE_CEILING) - F.col("shared")) * per_reference).alias("weight"))
    edges = cited.unionByName(above).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return Graph(df.select("id"), edges, stars)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges, weight 1 where there is none."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("weight").cast("double").alias("weight")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").cast("double").alias("weight")),
    )
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def coauthor_network(papers: DataFrame, authors: str = "authors") -> DataFrame:
    """``(src, dst, weight)``: authors joined by their number of common papers.

    Partners are read off the author list of each paper inside its row; every
    pair written is part of the result.
    """
    lists = papers.select(F.array_sort(F.array_distinct(authors)).alias("h"))
    first = lists.select("h", F.posexplode("h").alias("i", "src"))
    pairs = first.select("src", F.explode(F.expr("slice(h, i + 2, size(h))")).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def author_papers(papers: DataFrame, authors: str = "authors") -> DataFrame:
    """``(author, id)``: the papers of each author as rows, so that no author's list is collected."""
    return papers.select(F.explode(F.array_distinct(authors)).alias("author"), "id")


def prune_edges(edges: DataFrame, q: float = 0.8) -> DataFrame:
    """Edges no lighter than the ``q`` percentile of the weights; whether a graph is pruned is the caller's choice."""
    mark = exact_percentiles(edges, ["weight"], [q]).agg(F.max("value").alias("v"))
    return edges.where(F.col("weight") >= mark.scalar())


# -- degrees and sizes --------------------------------------------------------


def hub_sizes(stars: DataFrame) -> DataFrame:
    return stars.groupBy("hub").agg(F.count("*").alias("size"))


def weighted_degrees(graph: Graph) -> DataFrame:
    """``(id, degree)``: total weight at each node, isolated nodes included."""
    parts = adjacency(graph.edges).select(F.col("src").alias("id"), F.col("weight").alias("w"))
    if graph.stars is not None:
        inside = salted_join(graph.stars, hub_sizes(graph.stars), "hub", "id")
        parts = parts.unionByName(inside.select("id", (F.col("weight") * (F.col("size") - 1)).alias("w")))
    sums = parts.groupBy("id").agg(F.sum("w").alias("w"))
    return graph.nodes.join(sums, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("degree"))


def degrees(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """``(id, degree)``, with ``in_degree`` and ``out_degree`` for directed edges."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    sums = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(
        F.sum("o").alias("o"), F.sum("i").alias("i"))
    joined = nodes.select("id").hint("merge").join(sums, "id", "left")  # a row a node on either side
    out, inn = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    if directed:
        return joined.select("id", (out + inn).alias("degree"), inn.alias("in_degree"), out.alias("out_degree"))
    return joined.select("id", (out + inn).alias("degree"))


def degree_distribution(degree: DataFrame, column: str = "degree") -> DataFrame:
    """``(degree, n)``."""
    return degree.groupBy(F.col(column).alias("degree")).agg(F.count("*").alias("n"))


def degree_stats(degree: DataFrame, column: str = "degree") -> DataFrame:
    """One row: smallest, largest, mean and median degree; the median from the distribution."""
    dist = degree_distribution(degree, column)
    upto = Window.orderBy("degree")  # one row per distinct degree, at most sqrt(2m) of them
    placed = dist.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    at = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
    return placed.agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 6).alias("mean_degree"),
        ((F.max(F.when(at(low), F.col("degree"))) + F.max(F.when(at(high), F.col("degree")))) / 2.0).alias("median_degree"),
    )


def degree_power_law(dist: DataFrame) -> DataFrame:
    """Slope, intercept and r of the log-log degree distribution; no row at 5 or fewer degrees."""
    x, y = F.log10(F.col("degree") + F.lit(1.0)), F.log10(F.col("n") + F.lit(1.0))
    fit = dist.agg(
        F.count("*").alias("points"), F.round(F.regr_slope(y, x), 6).alias("slope"),
        F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.corr(x, y), 6).alias("r"))
    return fit.where("points > 5")


def degree_centrality(degree: DataFrame) -> DataFrame:
    """``(id, centrality)``: degree over the number of other nodes."""
    n = degree.agg(F.count("*").cast("double").alias("n"))
    return degree.select("id", F.try_divide(F.col("degree"), n.scalar() - 1).alias("centrality"))


def hubs(degree: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best-connected nodes."""
    return top_k(degree.select("id", "degree"), [], [F.desc("degree"), F.asc("id")], k)


def graph_size(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """One row: nodes, edges and density."""
    n = nodes.agg(F.count("*").alias("nodes"))
    row = edges.agg(F.count("*").alias("edges")).withColumn("nodes", n.scalar())
    possible = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    density = F.col("edges") * (1.0 if directed else 2.0) / possible
    return row.select("nodes", "edges", F.round(F.when(possible > 0, density).otherwise(0.0), 9).alias("density"))


def star_graph_size(graph: Graph) -> DataFrame:
    """Nodes, total edge weight and density of a graph with stars (edges, when every weight is 1)."""
    degree = weighted_degrees(graph)
    row = degree.agg(F.count("*").alias("nodes"), F.round(F.sum("degree") / 2, 6).alias("edges"))
    possible = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return row.withColumn("density", F.round(F.try_divide(F.col("edges") * 2.0, possible), 9))


# -- subgraphs ----------------------------------------------------------------


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    left = salted_join(edges, ids.select(F.col("id").alias("src")), "src", "dst", "left_semi")
    return salted_join(left, ids.select(F.col("id").alias("dst")), "dst", "src", "left_semi").select(*edges.columns)


def edges_among(graph: Graph, ids: DataFrame, bound: int) -> DataFrame:
    """All pairs of a graph with stars among a small set of nodes, as listed edges.

    This is where stars become pairs, so the node set must be small: more than
    ``bound`` ids are refused.
    """
    if ids.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} nodes; work on the stars instead")
    edges = induced(graph.edges, ids).select("src", "dst", "weight")
    if graph.stars is not None:
        few = graph.stars.join(ids.select("id"), "id", "left_semi")
        a = few.select("hub", F.col("id").alias("src"), "weight")
        b = few.select("hub", F.col("id").alias("dst"))
        edges = edges.unionByName(a.join(b, "hub").where("src < dst").select("src", "dst", "weight"))
    out = edges.groupBy("src", "dst").agg(F.round(F.sum("weight"), 9).alias("weight"))
    return out.where("weight > 0")


def top_degree_subgraph(graph: Graph, n: int = 100) -> Graph:
    """The ``n`` nodes of largest degree and the pairs among them."""
    ids = weighted_degrees(graph).orderBy(F.desc("degree"), "id").limit(n).select("id")
    return Graph(ids, edges_among(graph, ids, n))


def cluster_subgraph(nodes: DataFrame, edges: DataFrame, labels: DataFrame, k: int = 5) -> Graph:
    """Nodes of the ``k`` largest clusters, noise left out, and the edges among them."""
    sizes = labels.where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "cluster").limit(k).select("cluster")
    ids = salted_join(labels, best, "cluster", "id", "left_semi").select("id").join(nodes.select("id"), "id", "left_semi")
    return Graph(ids, induced(edges, ids))


def degree_filter(nodes: DataFrame, edges: DataFrame, min_degree: int = 1, max_degree: int | None = None) -> Graph:
    """Nodes within the degree bounds, once (not a core).  ``min_degree=1`` keeps isolated nodes."""
    degree = degrees(nodes, edges)
    keep = F.lit(True) if min_degree <= 1 else F.col("degree") >= min_degree
    if max_degree is not None:
        keep = keep & (F.col("degree") <= max_degree)
    ids = degree.where(keep).select("id")
    return Graph(ids, induced(edges, ids))


# -- triangles and modularity -------------------------------------------------


def out_lists(edges: DataFrame) -> DataFrame:
    """``(id, ids, weights)``: the neighbours that edges point to from the end of smaller degree, in order of degree.

    No list is longer than about sqrt(2m), however many edges a hub has.  Whole-number ids
    are held in four bytes where all of them fit.
    """
    weighted = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    degree = adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    ends = salted_join(weighted, degree.select(F.col("id").alias("src"), F.col("d").alias("d_src")), "src", "dst")
    ends = salted_join(ends, degree.select(F.col("id").alias("dst"), F.col("d").alias("d_dst")), "dst", "src")
    low = F.struct(F.col("d_src").alias("d"), F.col("src").alias("id"))
    high = F.struct(F.col("d_dst").alias("d"), F.col("dst").alias("id"))
    directed = ends.select(F.least(low, high).alias("x"), F.struct(F.greatest(low, high).alias("y"), "weight").alias("y"))
    lists = directed.groupBy(F.col("x.id").alias("id")).agg(F.array_sort(F.collect_list("y")).alias("out"))
    ids = F.col("out.y.id")
    if edges.schema["src"].dataType == LongType():
        span = edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).first()
        if span["low"] is not None and -(2**31) <= span["low"] and span["high"] < 2**31:
            ids = ids.cast("array<int>")
    return lists.select("id", ids.alias("ids"), F.col("out.weight").alias("weights"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c, product)``: every triangle once, with the product of its weights.

    Each edge a to b takes what follows b in the list of a to the list of b, and what both
    hold closes a triangle: one row per edge is moved, not one per open wedge.
    """
    lists = cut(out_lists(edges))
    tail = lambda c: F.expr(f"slice({c}, i + 2, size({c}))")
    first = lists.select("id", "ids", "weights", F.posexplode("ids").alias("i", "b")).where(F.size("ids") > F.col("i") + 1)
    kind = edges.schema["src"].dataType
    first = first.select(
        F.col("id").alias("a"), F.col("b").cast(kind).alias("b"), F.get("weights", F.col("i")).alias("w_ab"),
        tail("ids").alias("ids_a"), tail("weights").alias("weights_a"))
    met = first.join(lists.toDF("b", "ids_b", "weights_b"), "b").withColumn("c", F.explode(F.array_intersect("ids_a", "ids_b")))
    at = lambda side: F.get(f"weights_{side}", (F.array_position(f"ids_{side}", F.col("c")) - 1).cast("int"))
    return met.select("a", "b", F.col("c").cast(kind).alias("c"), (F.col("w_ab") * at("a") * at("b")).alias("product"))


def clustering_coefficient(nodes: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``(id, coefficient)``: share of a node's neighbour pairs that are joined.

    Weighted: geometric mean of the triangle's weights over the largest weight.
    """
    top = edges.agg(F.max(F.col("weight").cast("double")).alias("w"))
    value = F.cbrt(F.col("product")) / top.scalar() if weighted else F.lit(1.0)
    corners = triangles(edges).withColumn("v", value).select(F.explode(F.array("a", "b", "c")).alias("id"), "v")
    closed = corners.groupBy("id").agg(F.sum("v").alias("t"))
    joined = degrees(nodes, edges).join(closed, "id", "left")
    k = F.col("degree").cast("double")
    share = 2.0 * F.coalesce("t", F.lit(0.0)) / (k * (k - 1))
    return joined.select("id", F.when(k > 1, share).otherwise(0.0).alias("coefficient"))


def modularity(graph: Graph, labels: DataFrame) -> DataFrame:
    """One row, ``modularity`` of ``labels(id, cluster)``; stars count their members per cluster."""
    degree = weighted_degrees(graph)
    named = lambda side: labels.select(F.col("id").alias(side), F.col("cluster").alias(f"c_{side}"))
    both = salted_join(salted_join(graph.edges, named("src"), "src", "dst"), named("dst"), "dst", "src")
    inside = both.where("c_src = c_dst").select(F.col("weight").cast("double").alias("w"))
    if graph.stars is not None:
        cells = graph.stars.join(labels, "id").groupBy("hub", "weight", "cluster").agg(F.count("*").alias("n"))
        inside = inside.unionByName(cells.select((F.col("weight") * F.col("n") * (F.col("n") - 1) / 2.0).alias("w")))
    within = inside.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    per = degree.join(labels, "id").groupBy("cluster").agg(F.sum("degree").alias("d"))
    row = per.agg(F.sum("d").alias("two_m"), F.sum(F.col("d") * F.col("d")).alias("squares"))
    two_m = F.col("two_m")
    return row.select((
        F.try_divide(2.0 * within.scalar(), two_m) - F.try_divide(F.col("squares"), two_m * two_m)).alias("modularity"))


# -- tables of features and statistics ----------------------------------------


def citation_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree, degree)``, each over its maximum."""
    from .vectors import max_scale

    columns = ["in_degree", "out_degree", "degree"]
    return max_scale(degrees(nodes, edges, directed=True), columns).select("id", *columns)


def stats_rows(*tables: DataFrame) -> DataFrame:
    """One-row tables as ``(metric, value)`` rows."""
    out = None
    for row in tables:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
        part = row.select(F.explode(cells).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out


def citation_stats(nodes: DataFrame, edges: DataFrame, *more: DataFrame) -> DataFrame:
    """Size, density and degree statistics of a directed citation graph."""
    degree = degrees(nodes, edges, directed=True)
    inn = degree_stats(degree, "in_degree").toDF("min_in", "max_in", "mean_in", "median_in")
    out = degree_stats(degree, "out_degree").toDF("min_out", "max_out", "mean_out", "median_out")
    return stats_rows(graph_size(nodes, edges, directed=True), inn, out, *more)


def coauthor_stats(nodes: DataFrame, edges: DataFrame, *more: DataFrame) -> DataFrame:
    """Size, density, degrees, mean weight and mean clustering of a co-author network."""
    mean_weight = edges.agg(F.round(F.avg("weight"), 6).alias("mean_weight"))
    clustering = clustering_coefficient(nodes, edges).agg(F.round(F.avg("coefficient"), 6).alias("mean_clustering"))
    return stats_rows(graph_size(nodes, edges), degree_stats(degrees(nodes, edges)), mean_weight, clustering, *more)
