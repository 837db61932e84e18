"""Queries for article, citation and co-author graphs.

Parts are the articles: customers who bought a part are its authors, the next
part in an order is a reference, the brand is the venue.  For the co-author
network orders are the papers and their parts the authors.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import cut
from .registry import query, table


def part_articles(spark, folder):
    """``(id, venue, authors, references)``."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    cited = lines.withColumn("next", F.lead("l_partkey").over(order))
    refs = cited.where("next IS NOT NULL AND next <> l_partkey").groupBy(F.col("l_partkey").alias("id")).agg(
        F.collect_set("next").alias("references"))
    buyers = lines.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    authors = buyers.groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("o_custkey").alias("authors"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("venue"))
    return parts.hint("merge").join(refs.hint("merge"), "id", "left").join(authors.hint("merge"), "id", "left")  # a row a part each


def order_papers(spark, folder):
    """``(id, authors)``: orders with their parts."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set("l_partkey").alias("authors"))


def brand_labels(spark, folder):
    """``(id, cluster)``: the size class of a part as a given clustering."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cluster"))


WORLD = """node AS (SELECT p_partkey AS id, p_brand AS venue FROM part),
cite AS (SELECT DISTINCT l_partkey AS src, next AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next FROM lineitem)
  WHERE next IS NOT NULL AND next <> l_partkey),
auth AS (SELECT DISTINCT l_partkey AS id, o_custkey AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
auth_pair AS (SELECT x.id AS src, y.id AS dst, count(*) AS shared FROM auth x JOIN auth y ON x.a = y.a AND x.id < y.id GROUP BY ALL),
ref_pair AS (SELECT x.src AS src, y.src AS dst, count(*) AS shared FROM cite x JOIN cite y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL),
und AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM cite),
venue_pair AS (SELECT x.id AS src, y.id AS dst FROM node x JOIN node y ON x.venue = y.venue AND x.id < y.id),
comb AS (SELECT src, dst, sum(w) AS weight FROM (
  SELECT src, dst, shared * 1.0::DOUBLE AS w FROM auth_pair UNION ALL
  SELECT least(src, dst), greatest(src, dst), 0.5 FROM cite UNION ALL
  SELECT src, dst, 0.5::DOUBLE * least(shared, 5) / 5 FROM ref_pair UNION ALL
  SELECT src, dst, 0.3 FROM venue_pair) GROUP BY ALL),
lab AS (SELECT p_partkey AS id, p_size AS cluster FROM part)"""


def ends(source, weight="1"):
    return f"(SELECT id, sum(w) AS w, count(*) AS d FROM (SELECT src AS id, {weight} AS w FROM {source} UNION ALL SELECT dst, {weight} FROM {source}) GROUP BY id)"


@query("g1_author_degrees", f"WITH {WORLD} SELECT node.id, coalesce(d, 0) AS degree FROM node LEFT JOIN {ends('auth_pair')} USING (id)")
def author_degrees(spark, folder):
    degree = G.weighted_degrees(G.author_graph(cut(part_articles(spark, folder))))
    return degree.withColumn("degree", F.round("degree").cast("bigint"))


@query("g1_author_graph_size", f"""WITH {WORLD}, s AS (SELECT (SELECT count(*) FROM node) AS nodes, count(*) AS edges FROM auth_pair)
SELECT nodes, edges, round(edges * 2.0::DOUBLE / (nodes::DOUBLE * (nodes - 1)), 9) AS density FROM s""")
def author_graph_size(spark, folder):
    size = G.star_graph_size(G.author_graph(cut(part_articles(spark, folder))))
    return size.withColumn("edges", F.col("edges").cast("bigint"))


@query("g1_repeated_coauthors", f"WITH {WORLD} SELECT * FROM auth_pair WHERE shared >= 2")
def repeated_coauthors(spark, folder):
    return G.shared_pairs(G.memberships(part_articles(spark, folder), "authors"), 2)


@query("g2_citation_edges", f"WITH {WORLD} SELECT src, dst FROM cite")
def citation_edges(spark, folder):
    return G.citation_edges(part_articles(spark, folder))


@query("g3_undirected", f"WITH {WORLD} SELECT src, dst, 1.0::DOUBLE AS weight FROM und")
def undirected(spark, folder):
    return G.undirected(citation_edges(spark, folder))


@query("g4_coupling_edges", f"WITH {WORLD} SELECT src, dst, shared::DOUBLE AS weight FROM ref_pair WHERE shared >= 2")
def coupling_edges(spark, folder):
    return G.coupling_edges(part_articles(spark, folder), 2)


@query("g5_venue_degrees", f"WITH {WORLD} SELECT node.id, coalesce(d, 0)::DOUBLE AS degree FROM node LEFT JOIN {ends('venue_pair')} USING (id)")
def venue_degrees(spark, folder):
    return G.weighted_degrees(G.venue_graph(part_articles(spark, folder)))


@query("g6_combined_degrees", f"WITH {WORLD} SELECT node.id, round(coalesce(w, 0), 6) AS degree FROM node LEFT JOIN {ends('comb', 'weight')} USING (id)")
def combined_degrees(spark, folder):
    degree = G.weighted_degrees(G.combined_graph(cut(part_articles(spark, folder))))
    return degree.withColumn("degree", F.round("degree", 6))


NET = """paper AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS a FROM lineitem),
net AS MATERIALIZED (SELECT x.a AS src, y.a AS dst, count(*)::DOUBLE AS weight FROM paper x JOIN paper y ON x.id = y.id AND x.a < y.a GROUP BY ALL),
author AS (SELECT DISTINCT a AS id FROM paper)"""


@query("g7_prune_edges", """WITH trade AS MATERIALIZED (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL)
SELECT src, dst, weight FROM trade WHERE weight >= (SELECT quantile_cont(weight, 0.8) FROM trade)""")
def prune_edges(spark, folder):
    """Parts and suppliers by the quantity between them: weights that differ, so that edges go."""
    lines = table(spark, folder, "lineitem")
    return G.prune_edges(lines.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight")))


@query("g8_adjacency", f"WITH {NET} SELECT src, dst, weight FROM net UNION ALL SELECT dst, src, weight FROM net")
def adjacency(spark, folder):
    return G.adjacency(coauthor_network(spark, folder))


@query("g9_coauthor_network", f"WITH {NET} SELECT * FROM net")
def coauthor_network(spark, folder):
    return G.coauthor_network(order_papers(spark, folder))


@query("g9_author_papers", f"WITH {NET} SELECT a AS author, count(*) AS papers FROM paper GROUP BY a")
def author_papers(spark, folder):
    return G.author_papers(order_papers(spark, folder)).groupBy("author").agg(F.count("*").alias("papers"))


def part_nodes(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"))


@query("g10_graph_size", f"""WITH {WORLD}, s AS (SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM cite) AS m, (SELECT count(*) FROM und) AS u)
SELECT 'directed' AS kind, nodes, m AS edges, round(m / (nodes::DOUBLE * (nodes - 1)), 9) AS density FROM s
UNION ALL SELECT 'undirected', nodes, u, round(u * 2.0::DOUBLE / (nodes::DOUBLE * (nodes - 1)), 9) FROM s""")
def graph_size(spark, folder):
    nodes, edges = part_nodes(spark, folder), citation_edges(spark, folder)
    a = G.graph_size(nodes, edges, directed=True).withColumn("kind", F.lit("directed"))
    return a.unionByName(G.graph_size(nodes, G.undirected(edges)).withColumn("kind", F.lit("undirected")))


DEGREE = f"""{WORLD}, deg AS (SELECT node.id, coalesce(i, 0) + coalesce(o, 0) AS degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM node
  LEFT JOIN (SELECT src AS id, count(*) AS o FROM cite GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM cite GROUP BY dst) USING (id))"""


@query("g11_degrees", f"WITH {DEGREE} SELECT * FROM deg")
def degrees(spark, folder):
    return G.degrees(part_nodes(spark, folder), citation_edges(spark, folder), directed=True)


@query("g11_degree_distribution", f"WITH {DEGREE} SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def degree_distribution(spark, folder):
    return G.degree_distribution(degrees(spark, folder))


STATS = "min({c}) AS min_{s}, max({c}) AS max_{s}, round(avg({c}), 6) AS mean_{s}, median({c})::DOUBLE AS median_{s}"


@query("g11_degree_stats", f"WITH {DEGREE} SELECT {STATS.format(c='degree', s='degree')} FROM deg")
def degree_stats(spark, folder):
    return G.degree_stats(degrees(spark, folder))


@query("g12_degree_power_law", f"""WITH {DEGREE}, d AS (SELECT log10(degree + 1.0::DOUBLE) AS x, log10(count(*) + 1.0::DOUBLE) AS y FROM deg GROUP BY degree)
SELECT count(*) AS points, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r FROM d HAVING count(*) > 5""")
def degree_power_law(spark, folder):
    return G.degree_power_law(degree_distribution(spark, folder))


@query("g13_degree_centrality", f"WITH {DEGREE} SELECT id, round(degree / ((SELECT count(*) FROM deg) - 1)::DOUBLE, 9) AS centrality FROM deg")
def degree_centrality(spark, folder):
    return G.degree_centrality(degrees(spark, folder)).withColumn("centrality", F.round("centrality", 9))


@query("g13_hubs", f"WITH {DEGREE} SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id)::INT AS rank FROM deg ORDER BY rank LIMIT 10")
def hubs(spark, folder):
    return G.hubs(degrees(spark, folder), 10)


@query("g16_top_degree_subgraph", f"""WITH {WORLD}, top AS (SELECT id FROM (SELECT node.id, round(coalesce(w, 0), 6) AS w FROM node LEFT JOIN {ends('comb', 'weight')} USING (id)) ORDER BY w DESC, id LIMIT 100)
SELECT src, dst, round(weight, 6) AS weight FROM comb WHERE src IN (FROM top) AND dst IN (FROM top)""")
def top_degree_subgraph(spark, folder):
    graph = G.stored(G.combined_graph(cut(part_articles(spark, folder))))
    ids = G.weighted_degrees(graph).orderBy(F.desc(F.round("degree", 6)), "id").limit(100).select("id")
    return G.edges_among(graph, ids, 100).withColumn("weight", F.round("weight", 6))


@query("g16_cluster_subgraph", f"""WITH {WORLD}, top AS (SELECT cluster FROM lab GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 5),
keep AS (SELECT id FROM lab WHERE cluster IN (FROM top)) SELECT src, dst FROM und WHERE src IN (FROM keep) AND dst IN (FROM keep)""")
def cluster_subgraph(spark, folder):
    edges = undirected(spark, folder)
    return G.cluster_subgraph(part_nodes(spark, folder), edges, brand_labels(spark, folder), 5).edges.select("src", "dst")


def _clustering_sql(weighted):
    value = "cbrt(x.weight * y.weight * z.weight) / (SELECT max(weight) FROM net)" if weighted else "1.0::DOUBLE"
    return f"""adj AS (SELECT src, dst, weight FROM net UNION ALL SELECT dst, src, weight FROM net),
    tri AS (SELECT x.src AS id, sum({value}) AS t FROM adj x JOIN adj y ON x.src = y.src AND x.dst < y.dst
      JOIN net z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src),
    dg AS (SELECT src AS id, count(*)::DOUBLE AS k FROM adj GROUP BY src),
    cc AS (SELECT author.id, CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS coefficient
      FROM author LEFT JOIN dg USING (id) LEFT JOIN tri USING (id))"""


def author_nodes(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id")).distinct()


@query("g18_clustering_coefficient", f"WITH {NET}, {_clustering_sql(False)} SELECT id, round(coefficient, 6) AS coefficient FROM cc")
def clustering_coefficient(spark, folder):
    out = G.clustering_coefficient(author_nodes(spark, folder), cut(coauthor_network(spark, folder)))
    return out.withColumn("coefficient", F.round("coefficient", 6))


@query("g18_weighted_clustering", f"WITH {NET}, {_clustering_sql(True)} SELECT id, round(coefficient, 6) AS coefficient FROM cc")
def weighted_clustering(spark, folder):
    out = G.clustering_coefficient(author_nodes(spark, folder), cut(coauthor_network(spark, folder)), weighted=True)
    return out.withColumn("coefficient", F.round("coefficient", 6))


def _modularity_sql(source, weight):
    return f"""m AS (SELECT sum({weight}) AS m FROM {source}),
    ins AS (SELECT sum({weight}) AS w FROM {source} e JOIN lab a ON a.id = e.src JOIN lab b ON b.id = e.dst WHERE a.cluster = b.cluster),
    tot AS (SELECT cluster, sum(w) AS d FROM {ends(source, weight)} JOIN lab USING (id) GROUP BY cluster)
    SELECT round((SELECT w FROM ins) / (SELECT m FROM m) - sum(d * d) / (4 * (SELECT m * m FROM m)), 6) AS modularity FROM tot"""


@query("g23_modularity", f"WITH {WORLD}, {_modularity_sql('comb', 'weight')}")
def modularity(spark, folder):
    graph = G.stored(G.combined_graph(cut(part_articles(spark, folder))))
    return G.modularity(graph, brand_labels(spark, folder)).withColumn("modularity", F.round("modularity", 6))


@query("g28_citation_features", f"""WITH {DEGREE} SELECT id, round(in_degree / (SELECT greatest(max(in_degree), 1) FROM deg)::DOUBLE, 9) AS in_degree,
round(out_degree / (SELECT greatest(max(out_degree), 1) FROM deg)::DOUBLE, 9) AS out_degree,
round(degree / (SELECT greatest(max(degree), 1) FROM deg)::DOUBLE, 9) AS degree FROM deg""")
def citation_features(spark, folder):
    out = G.citation_features(part_nodes(spark, folder), citation_edges(spark, folder))
    return out.select("id", *[F.round(c, 9).alias(c) for c in ("in_degree", "out_degree", "degree")])


@query("g29_citation_stats", f"""WITH {DEGREE}, s AS (SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM cite) AS edges),
r AS (SELECT *, round(edges / (nodes::DOUBLE * (nodes - 1)), 9) AS density FROM s),
d AS (SELECT {STATS.format(c='in_degree', s='in')}, {STATS.format(c='out_degree', s='out')} FROM deg)
SELECT metric, value FROM (UNPIVOT (SELECT * FROM (SELECT columns(*)::DOUBLE FROM r)) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT metric, value FROM (UNPIVOT (SELECT * FROM (SELECT columns(*)::DOUBLE FROM d)) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def citation_stats(spark, folder):
    return G.citation_stats(part_nodes(spark, folder), citation_edges(spark, folder))


@query("g29_coauthor_stats", f"""WITH {NET}, {_clustering_sql(False)},
r AS (SELECT (SELECT count(*) FROM author)::DOUBLE AS nodes, (SELECT count(*) FROM net)::DOUBLE AS edges),
al AS (SELECT nodes, edges, round(edges * 2 / (nodes * (nodes - 1)), 9) AS density, (SELECT round(avg(weight), 6) FROM net) AS mean_weight,
  (SELECT round(avg(coefficient), 6) FROM cc) AS mean_clustering, (SELECT min(coalesce(k, 0)) FROM author LEFT JOIN dg USING (id)) AS min_degree,
  (SELECT max(k) FROM dg) AS max_degree, (SELECT round(avg(coalesce(k, 0)), 6) FROM author LEFT JOIN dg USING (id)) AS mean_degree,
  (SELECT median(coalesce(k, 0)) FROM author LEFT JOIN dg USING (id)) AS median_degree FROM r)
SELECT metric, value FROM (UNPIVOT (SELECT columns(*)::DOUBLE FROM al) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def coauthor_stats(spark, folder):
    return G.coauthor_stats(author_nodes(spark, folder), cut(coauthor_network(spark, folder)))
