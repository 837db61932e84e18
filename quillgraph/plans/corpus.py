"""The corpus entities read from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import tokens as K
from ..operators.vectors import centroids
from .registry import table

MIN_DF, MAX_DF = 5, 0.95


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def document_bags(spark: SparkSession, folder: str, **options) -> DataFrame:
    return K.bags(documents(spark, folder), **options)


def query_bags(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The benchmark texts as queries."""
    return K.bags(table(spark, folder, "benchmark"), id_col="item_id", **options)


def document_index(spark: SparkSession, folder: str, min_df=MIN_DF, max_df=MAX_DF, **options):
    """``(index, vocabulary, corpus size)`` of the documents."""
    return I.build_index(document_bags(spark, folder, by_document=False), min_df, max_df, **options)


def document_counts(spark: SparkSession, folder: str, **options):
    """``(counts, corpus size)`` of the documents, written once."""
    return I.counted(document_bags(spark, folder, by_document=False, **options))


def given_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A given clustering of the documents that needs no model: the number of their source."""
    return documents(spark, folder).select("doc_id", F.replace("source", F.lit("src"), F.lit("")).cast("int").alias("cluster"))


def class_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The language of a document as its class."""
    return documents(spark, folder).select("doc_id", F.col("lang").alias("cluster"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, vec array<double>, label)``."""
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


GIVEN_SQL = "lab AS (SELECT doc_id, replace(source, 'src', '')::INT AS cluster FROM documents)"
CLASS_SQL = "lab AS (SELECT doc_id, lang AS cluster FROM documents)"
VEC_SQL = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def length_topics(spark: SparkSession, folder: str) -> DataFrame:
    """A given document-topic matrix that needs no model: share of words by length, 8 and more as one."""
    words = K.words(document_bags(spark, folder), "doc_id")
    n = words.groupBy("doc_id", F.least(F.length("term"), F.lit(8)).alias("topic")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return n.select("doc_id", "topic", (F.col("n") / total).alias("p"))


TOPICS_SQL = """tp AS (SELECT doc_id, topic, n / (sum(n) OVER (PARTITION BY doc_id))::DOUBLE AS p FROM (
  SELECT doc_id, least(length(term), 8)::INT AS topic, count(*) AS n FROM tok GROUP BY ALL))"""


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    return centroids(vectors(spark, folder), vectors(spark, folder).select("id", F.col("label").alias("cluster"))).select(
        F.col("cluster").cast("bigint").alias("id"), F.col("centroid").alias("vec"))


CENTROID_SQL = """parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY ALL),
cen AS (SELECT label::BIGINT AS id, list(x ORDER BY i) AS v FROM parts GROUP BY label)"""


def node_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Reversed vectors, for the ids that the ``labels`` table knows."""
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("id")).distinct()
    rows = vectors(spark, folder).join(known, "id", "left_semi")
    return rows.select("id", F.reverse("vec").alias("vec"))


NODE_SQL = "node AS (SELECT id, list_reverse(v) AS v FROM vec WHERE id IN (SELECT doc_id FROM labels))"
