"""Queries for profiling and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import tokens as K
from . import sql as Q
from .corpus import GIVEN_SQL, document_bags, documents, given_labels
from .registry import query, table
from .text import order_articles

ORDERS_SQL = """art AS (SELECT o_orderkey AS id, year(o_orderdate) AS year, o_orderpriority AS venue,
  l_partkey AS author, l_suppkey AS ref FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"""


@query("a1_field_availability", "\nUNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS available, round(count({c}) * 100.0::DOUBLE / count(*), 6) AS percent "
    "FROM documents LEFT JOIN labels USING (doc_id)" for c in ("doc_id", "text", "quality", "toxic")))
def field_availability(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return P.field_availability(docs.join(table(spark, folder, "labels"), "doc_id", "left"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@query("a2_describe_numeric", "WITH " + ", ".join(f"""x{i} AS (SELECT '{c}' AS c, count({c})::DOUBLE AS n, avg({c}) AS m,
  stddev_samp({c}) AS s, min({c}) AS lo, max({c}) AS hi, quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM lineitem)"""
  for i, c in enumerate(NUMERIC)) + ", al AS (" + " UNION ALL ".join(f"FROM x{i}" for i in range(len(NUMERIC))) + """)
SELECT c AS "column", metric, round(value, 6) AS value FROM (
  SELECT c, unnest(['count','mean','std','min','max','25%','50%','75%']) AS metric,
    unnest([n, m, s, lo, hi, q[1], q[2], q[3]]) AS value FROM al)""")
def describe_numeric(spark, folder):
    return P.describe_numeric(table(spark, folder, "lineitem"), NUMERIC)


@query("a3_value_counts", """SELECT year(o_orderdate)::INT AS year, count(*) AS n,
round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY 1""")
def value_counts(spark, folder):
    rows = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"))
    return P.value_counts(rows, "year")


@query("a3_class_distribution", """SELECT lang, count(*) AS n,
round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY 1""")
def class_distribution(spark, folder):
    return P.value_counts(documents(spark, folder).select("lang"), "lang")


@query("a4_top_venues", """SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source)::INT AS rank
FROM documents GROUP BY source ORDER BY rank LIMIT 10""")
def top_venues(spark, folder):
    return P.top_values(documents(spark, folder).select("source"), "source", 10)


@query("a5_author_counts", f"""WITH {ORDERS_SQL} SELECT author::VARCHAR AS author, count(DISTINCT id) AS publications
FROM art WHERE author IS NOT NULL GROUP BY author""")
def author_counts(spark, folder):
    return P.author_counts(order_articles(spark, folder))


@query("a5_top_authors", f"""WITH {ORDERS_SQL}, c AS (SELECT author::VARCHAR AS author, count(DISTINCT id) AS publications
FROM art WHERE author IS NOT NULL GROUP BY author)
SELECT *, row_number() OVER (ORDER BY publications DESC, author)::INT AS rank, (SELECT count(*) FROM c) AS unique_authors
FROM c ORDER BY rank LIMIT 20""")
def top_authors(spark, folder):
    return P.top_authors(order_articles(spark, folder), 20)


@query("a6_corpus_stats", f"""WITH {ORDERS_SQL}, per AS (SELECT id, any_value(venue) AS venue, count(DISTINCT author) AS a,
  count(DISTINCT ref) AS r FROM art GROUP BY id),
row AS (SELECT count(*)::DOUBLE AS n, avg(length(venue)) AS t, avg(a) AS a, avg(r) AS r FROM per)
SELECT unnest(['documents', 'mean_text_length', 'mean_authors', 'mean_references']) AS metric,
  round(unnest([n, t, a, r]), 6) AS value FROM row""")
def corpus_stats(spark, folder):
    return P.corpus_stats(order_articles(spark, folder), "venue", ["authors", "references"])


@query("a6_text_stats", """WITH row AS (SELECT count(*)::DOUBLE AS n, avg(length(text)) AS t, avg(n_chars) AS c FROM documents)
SELECT unnest(['documents', 'mean_text_length', 'mean_n_chars']) AS metric, round(unnest([n, t, c]), 6) AS value FROM row""")
def text_stats(spark, folder):
    return P.corpus_stats(documents(spark, folder), "text", [], ["n_chars"])


@query("a7_author_histogram", f"""WITH {ORDERS_SQL}, per AS (SELECT count(DISTINCT author) AS a FROM art GROUP BY id)
SELECT least(10, floor((least(greatest(a::DOUBLE, 0), 10) - 0) / 10 * 10) + 1)::INT AS bin, count(*) AS n FROM per GROUP BY 1""")
def author_histogram(spark, folder):
    return P.histogram(order_articles(spark, folder), F.coalesce(F.array_size("authors"), F.lit(0)), 0, 10, 10)


@query("a7_term_frequency_histogram", f"""WITH {Q.tok()}, c AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
x AS (SELECT ln(1 + n) AS v FROM c)
SELECT least(50, floor((least(greatest(v, 0), 12) - 0) / 12 * 50) + 1)::INT AS bin, count(*) AS n FROM x GROUP BY 1""")
def term_frequency_histogram(spark, folder):
    words = K.words(document_bags(spark, folder))
    counts = words.groupBy("term").agg(F.count("*").alias("n"))
    return P.histogram(counts, F.log(F.lit(1.0) + F.col("n")), 0, 12, 50)


@query("a8_bucket_other", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT source FROM c ORDER BY n DESC, source LIMIT 5)
SELECT CASE WHEN source IN (SELECT source FROM t) THEN source ELSE 'other' END AS source, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def bucket_other(spark, folder):
    return P.bucket_other(documents(spark, folder).select("source"), "source", 5)


@query("a9_classification_ready", """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS e
FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT count(*) AS classes, min(n) AS smallest, sum(n)::BIGINT AS labelled, sum(e)::BIGINT AS empty_texts,
count(*) >= 2 AND min(n) >= 2 AND sum(e) < sum(n) AS ready FROM c""")
def classification_ready(spark, folder):
    return P.classification_ready(documents(spark, folder), "lang", "text")


@query("a10_cluster_sizes", f"""WITH {GIVEN_SQL} SELECT cluster, count(*) AS size,
round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lab), 6) AS percent FROM lab GROUP BY cluster""")
def cluster_sizes(spark, folder):
    return P.cluster_sizes(given_labels(spark, folder))


@query("a10_clustering_summary", """WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source)
SELECT count(*) AS clusters, max(size) AS largest, min(size) AS smallest, round(avg(size), 6) AS mean_size FROM s""")
def clustering_summary(spark, folder):
    return P.clustering_summary(documents(spark, folder).select(F.col("source").alias("cluster")))
