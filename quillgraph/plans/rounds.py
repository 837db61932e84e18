"""Queries for graph measures that need rounds.

The co-author network (orders as papers, parts as authors) and the citation
graph of parts.  Distances run from a sample of 100 parts, drawn by the hash of their id
without regard to degree, to all parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as N
from ..operators import graph as G
from ..operators import graph_rounds as R
from ..session import cut
from .graphs import (
    DEGREE, NET, WORLD, _clustering_sql, author_nodes, citation_edges, coauthor_network, degrees, part_articles,
    part_nodes, undirected,
)
from .registry import query, table

# Customers joined by orders of a kind: a graph that falls apart.
SPARSE = """cust AS (SELECT c_custkey AS id FROM customer),
alike AS (SELECT DISTINCT o_custkey AS id, o_orderdate::DATE AS day, o_orderpriority AS priority, floor(o_totalprice / 10000)::BIGINT AS price FROM orders)"""


def like_orders(spark, folder):
    """``(hub, id)``: customers with an order of the same day, priority and price class."""
    hub = F.concat_ws("|", F.to_date("o_orderdate").cast("string"), "o_orderpriority", F.floor(F.col("o_totalprice") / 10000).cast("string"))
    return table(spark, folder, "orders").select(hub.alias("hub"), F.col("o_custkey").alias("id")).distinct()


def customers(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))


COMPONENTS = f"""{SPARSE}, link AS (SELECT a.id AS a, b.id AS b FROM alike a JOIN alike b USING (day, priority, price)),
reach(id, root) AS (SELECT id, id FROM cust UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


@query("g14_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comp")
def components(spark, folder):
    nodes = customers(spark, folder)
    none = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).where(F.lit(False))
    return N.components(nodes, none, like_orders(spark, folder))


@query("g14_component_stats", f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT count(*) AS n FROM comp GROUP BY component)
SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM s""")
def component_stats(spark, folder):
    return N.component_stats(components(spark, folder))


@query("g15_filter_graph", f"""WITH RECURSIVE {DEGREE}, ud AS (SELECT node.id, count(e.a) AS d FROM node LEFT JOIN
  (SELECT src AS a FROM und UNION ALL SELECT dst FROM und) e ON e.a = node.id GROUP BY node.id),
kept AS (SELECT id FROM ud WHERE d BETWEEN 30 AND 60),
e AS (SELECT src, dst FROM und WHERE src IN (FROM kept) AND dst IN (FROM kept)),
sym AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e),
reach(id) AS (SELECT min(id) FROM kept UNION SELECT sym.b FROM reach JOIN sym ON sym.a = reach.id)
SELECT src, dst FROM e WHERE src IN (FROM reach) AND dst IN (FROM reach)""")
def filter_graph(spark, folder):
    """Parts of middling degree, then the largest component of what is left."""
    graph = G.degree_filter(part_nodes(spark, folder), cut(undirected(spark, folder)), 30, 60)
    edges = cut(graph.edges.select("src", "dst"))
    ids = N.largest_component(N.components(graph.nodes, edges))
    return G.induced(edges, ids)


DEPTH = 6  # steps written out in the SQL, more than any distance in these graphs
BFS_SQL = f"""{DEGREE}, asked AS (SELECT id FROM node ORDER BY md5(id::VARCHAR), id LIMIT 100), sym AS MATERIALIZED (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und),
walk(source, id, dist) AS (SELECT id, id, 0 FROM asked UNION
  SELECT walk.source, sym.dst, walk.dist + 1 FROM walk JOIN sym ON sym.src = walk.id WHERE walk.dist < {DEPTH}),
far AS MATERIALIZED (SELECT source, id, min(dist)::INT AS dist FROM walk GROUP BY source, id)"""


def citation_world(spark, folder):
    """Nodes, symmetric citation links and the sampled parts that distances start from."""
    nodes = cut(part_nodes(spark, folder))
    links = cut(G.adjacency(undirected(spark, folder)))
    return nodes, links, cut(nodes.orderBy(F.md5(F.col("id").cast("string")), "id").limit(100))


@query("g17_distances", f"WITH RECURSIVE {BFS_SQL} SELECT source, id, dist FROM far")
def distances(spark, folder):
    _, links, sources = citation_world(spark, folder)
    return R.distances(links, sources)


@query("g17_path_stats", f"WITH RECURSIVE {BFS_SQL} SELECT max(dist) AS diameter, round(avg(dist), 6) AS mean_path FROM far WHERE dist > 0")
def path_stats(spark, folder):
    return R.path_stats(distances(spark, folder))


@query("g17_path_stats_sampled")
def path_stats_sampled(spark, folder):
    """From a seeded sample of the largest component."""
    nodes, links, _ = citation_world(spark, folder)
    largest = cut(N.largest_component(N.components(nodes, links)))
    return R.path_stats(R.distances(links, R.sampled_sources(largest)))


def _betweenness_sql():
    """Path counts level by level, then dependencies backward."""
    ctes = ["s0 AS (SELECT source, id, 1.0::DOUBLE AS s FROM far WHERE dist = 0)"]
    for d in range(1, DEPTH + 1):
        ctes.append(f"""s{d} AS MATERIALIZED (SELECT far.source, far.id, sum(s) AS s FROM s{d - 1} p JOIN sym ON sym.src = p.id
          JOIN far ON far.source = p.source AND far.id = sym.dst AND far.dist = {d} GROUP BY ALL)""")
    ctes.append(f"d{DEPTH} AS (SELECT source, id, s, 0.0::DOUBLE AS delta FROM s{DEPTH})")
    for d in range(DEPTH - 1, 0, -1):
        ctes.append(f"""d{d} AS MATERIALIZED (SELECT p.source, p.id, p.s, p.s * coalesce(push, 0) AS delta FROM s{d} p LEFT JOIN (
          SELECT p.source, p.id, sum((1 + n.delta) / n.s) AS push FROM s{d} p JOIN sym ON sym.src = p.id
          JOIN d{d + 1} n ON n.source = p.source AND n.id = sym.dst GROUP BY ALL) x ON x.source = p.source AND x.id = p.id)""")
    every = " UNION ALL ".join(f"SELECT id, delta FROM d{d}" for d in range(1, DEPTH + 1))
    return ",\n".join(ctes) + f", total AS (SELECT id, sum(delta) AS t FROM ({every}) GROUP BY id)"


@query("g19_betweenness", f"""WITH RECURSIVE {BFS_SQL}, {_betweenness_sql()}, n AS (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM asked)::DOUBLE AS k FROM node)
SELECT node.id, round(coalesce(t, 0) * n / k / ((n - 1) * (n - 2)), 9) AS betweenness FROM node CROSS JOIN n LEFT JOIN total USING (id)""")
def betweenness(spark, folder):
    return R.betweenness(*citation_world(spark, folder)).withColumn("betweenness", F.round("betweenness", 9))


@query("g19_weighted_betweenness")
def weighted_betweenness(spark, folder):
    """From every part to every part."""
    nodes, links, _ = citation_world(spark, folder)
    lengths = links.withColumn("weight", 1.0 + F.pmod(F.col("src") + F.col("dst"), F.lit(3)))
    return R.weighted_betweenness(nodes, lengths, nodes)


@query("g20_closeness", f"""WITH RECURSIVE {BFS_SQL}, s AS (SELECT source AS id, count(*) - 1 AS r, sum(dist) AS s FROM far GROUP BY source),
n AS (SELECT max(r) + 1 AS n FROM s)
SELECT id, round(CASE WHEN s > 0 AND r + 1 = n THEN r::DOUBLE / s * r / (n - 1) ELSE 0 END, 6) AS closeness FROM s CROSS JOIN n""")
def closeness(spark, folder):
    nodes, links, sources = citation_world(spark, folder)
    largest = cut(N.largest_component(N.components(nodes, links)))
    return R.closeness(R.distances(links, sources), largest).withColumn("closeness", F.round("closeness", 6))


SETTLED = 1e-15  # ranks equal to the ninth digit whatever the rounds
ROUNDS = 30  # rounds written out in the SQL


def _pagerank_sql(rounds, edges, weight):
    ctes = [f"""nn AS (SELECT count(*)::DOUBLE AS n FROM node), outw AS MATERIALIZED (SELECT src, sum({weight})::DOUBLE AS o FROM {edges} GROUP BY src),
    r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM node, nn)"""]
    for i in range(rounds):
        ctes.append(f"""r{i + 1} AS MATERIALIZED (SELECT node.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g, 0) + lost / n) AS rank FROM node CROSS JOIN nn
          CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM outw))
          LEFT JOIN (SELECT dst AS id, sum(rank * {weight} / o) AS g FROM {edges} e JOIN outw USING (src) JOIN r{i} ON r{i}.id = e.src GROUP BY dst) USING (id))""")
    return ",\n".join(ctes)


@query("g21_pagerank", f"WITH {WORLD}, {_pagerank_sql(ROUNDS, 'cite', '1')} SELECT id, round(rank, 9) AS rank FROM r{ROUNDS}")
def pagerank(spark, folder):
    links = cut(citation_edges(spark, folder)).withColumn("weight", F.lit(1.0))
    return R.pagerank(part_nodes(spark, folder), links, tol=SETTLED).withColumn("rank", F.round("rank", 9))


@query("g21_weighted_pagerank", f"""WITH {NET}, node AS (FROM author), adj AS MATERIALIZED (SELECT src, dst, weight FROM net UNION ALL SELECT dst, src, weight FROM net),
{_pagerank_sql(ROUNDS, 'adj', 'weight')} SELECT id, round(rank, 9) AS rank FROM r{ROUNDS}""")
def weighted_pagerank(spark, folder):
    links = G.adjacency(cut(coauthor_network(spark, folder)))
    return R.pagerank(author_nodes(spark, folder), links, tol=SETTLED).withColumn("rank", F.round("rank", 9))


@query("g22_louvain")
def louvain(spark, folder):
    return R.louvain(cut(author_nodes(spark, folder)), cut(coauthor_network(spark, folder)))


@query("g24_random_walks")
def random_walks(spark, folder):
    nodes, links, _ = citation_world(spark, folder)
    return R.random_walks(nodes, links, 20, 10)


@query("g24_walk_counts", f"WITH {WORLD} SELECT id, 20::BIGINT AS walks FROM node")
def walk_counts(spark, folder):
    nodes, links, _ = citation_world(spark, folder)
    walks = R.random_walks(nodes, links, 20, 10)
    return walks.groupBy(F.col("start").alias("id")).agg(F.count("*").alias("walks"))


@query("g25_node_embeddings")
def node_embeddings(spark, folder):
    nodes, links, _ = citation_world(spark, folder)
    return R.node_embeddings(nodes, cut(R.random_walks(nodes, links, 80, 10)), 64, 10)


@query("g26_embed_by_sample")
def embed_by_sample(spark, folder):
    return R.embed_by_sample(cut(part_nodes(spark, folder)), cut(undirected(spark, folder)), 30, 64, 20)


FEATURES = f"""{NET}, node AS (FROM author), {_clustering_sql(False)},
wd AS (SELECT src AS id, sum(weight) AS degree, count(*) AS links FROM adj GROUP BY src), {_pagerank_sql(ROUNDS, 'adj', 'weight')}"""


@query("g27_graph_features", f"""WITH {FEATURES} SELECT author.id, round(coalesce(wd.degree, 0), 6) AS degree,
round(coalesce(links, 0) / ((SELECT count(*) FROM author) - 1)::DOUBLE, 6) AS centrality, round(coefficient, 6) AS coefficient, round(rank, 9) AS rank
FROM author LEFT JOIN wd USING (id) LEFT JOIN cc USING (id) LEFT JOIN r{ROUNDS} USING (id)""")
def graph_features(spark, folder):
    nodes, edges = cut(author_nodes(spark, folder)), cut(coauthor_network(spark, folder))
    out = R.graph_features(
        nodes, G.weighted_degrees(G.Graph(nodes, edges)), G.degree_centrality(G.degrees(nodes, edges)),
        G.clustering_coefficient(nodes, edges), R.pagerank(nodes, G.adjacency(edges), tol=SETTLED))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("degree", "centrality", "coefficient")], F.round("rank", 9).alias("rank"))


@query("g27_centralities")
def centralities(spark, folder):
    """Degree, betweenness, closeness and clustering of the authors, all by weight."""
    return R.centralities(cut(author_nodes(spark, folder)), cut(coauthor_network(spark, folder)))


@query("g17_diameter")
def diameter(spark, folder):
    """Of the largest component of the customers joined by like orders, whose paths are long."""
    nodes, links = cut(customers(spark, folder)), cut(like_links(spark, folder))
    largest = cut(N.largest_component(N.components(nodes, links)))
    return spark.range(1).select(F.lit(R.diameter(largest, links)).alias("diameter"))


def like_links(spark, folder):
    """``(src, dst, weight)`` both ways: customers with an order of the same day, priority and price class."""
    members = like_orders(spark, folder)
    met = members.toDF("hub", "src").join(members.toDF("hub", "dst"), "hub").where("src <> dst")
    return met.select("src", "dst", F.lit(1.0).alias("weight")).distinct()


@query("g29_citation_structure")
def citation_structure(spark, folder):
    return R.structure_stats(cut(part_nodes(spark, folder)), cut(undirected(spark, folder)))


@query("g29_coauthor_structure")
def coauthor_structure(spark, folder):
    """With the communities found by local moves."""
    nodes, edges = cut(author_nodes(spark, folder)), cut(coauthor_network(spark, folder))
    return R.structure_stats(nodes, edges, cut(R.louvain(nodes, edges)))
