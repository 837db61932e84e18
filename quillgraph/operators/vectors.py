"""Document vectors, topics, reduction and scaling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.vectors import unit
from ..session import cut
from .embeddings import train, word_pairs
from .factors import svd
from .scale import salted_join


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cluster, centroid, size)`` of ``vectors(id, vec)`` under ``labels(id, cluster)``.

    Vectors are summed before the shuffle, so a cluster of any size is only ever
    one partial sum per task.  Null vectors do not count.
    """
    joined = vectors.where("vec IS NOT NULL").join(labels, "id").select("cluster", array_to_vector("vec").alias("v"))
    return joined.groupBy("cluster").agg(Summarizer.mean(F.col("v")).alias("m"), F.count("*").alias("size")).select(
        "cluster", vector_to_array("m").alias("centroid"), "size")


def encode(df: DataFrame, encoder: Callable[[], Callable], batch_size: int = 32,
           id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, vec)`` by a plug-in encoder applied in batches.

    ``encoder()`` is called once per Python worker and returns a function from
    an array of texts to a matrix; the weights of a real model are its own.
    """
    embed = predict_batch_udf(encoder, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), embed(text).alias("vec"))


def hashed_encoder(dim: int = 64) -> Callable[[], Callable]:
    """A model-free encoder: words hashed into ``dim`` signed counts, rows of length one."""
    def make():
        import zlib

        def embed(texts):
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                for word in str(text).split():
                    h = zlib.crc32(word.encode())
                    out[row, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

        return embed

    return make


def doc_vectors(bags: DataFrame, dim: int = 100, min_count: int = 2, seed: int = 42, epochs: int = 20) -> DataFrame:
    """``(id, vec)``: paragraph vectors, the distributed bag of words of each document of ``bags(doc_id, words)``.

    A document's vector is trained to tell its own words from chance; words
    that the corpus has fewer than ``min_count`` times are left out, and a
    document without any other gets zeros.
    """
    found, _ = train(word_pairs(bags, min_count), dim, epochs, rate=0.1, seed=seed)
    ids = bags.select(F.col("doc_id").alias("id")).distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def term_numbers(vocab: DataFrame) -> DataFrame:
    """``(term, j)``: dense column numbers in term order, without a sort on one task.

    Terms are range-partitioned; a number is the place inside the partition
    plus the size of the partitions before it.
    """
    from pyspark.sql import Window

    placed = cut(vocab.select("term").distinct().repartitionByRange("term").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return placed.withColumn("r", inside).join(before, "part").select("term", (F.col("offset") + F.col("r") - 1).cast("int").alias("j"))


def sparse_rows(index: DataFrame, numbers: DataFrame, weight: str = "w") -> DataFrame:
    """``(doc_id, features)``: one sparse vector per document, for Spark ML.

    A sparse vector is stored as four fields, so that the fields are written
    and read back as vectors; no row passes through Python.
    """
    numbered = salted_join(index, numbers, "term", "doc_id")
    size = numbers.agg(F.count("*").cast("int").alias("n"))
    rows = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("j", F.col(weight).cast("double").alias("x")))).alias("e"))
    fields = F.struct(F.lit(0).cast("tinyint").alias("type"), F.col("_size").alias("size"), F.col("e.j").alias("indices"), F.col("e.x").alias("values"))
    plain = rows.withColumn("_size", size.scalar()).select("doc_id", fields.alias("features"))
    return cut(plain, StructType([plain.schema["doc_id"], StructField("features", VectorUDT())]))


def lda(index: DataFrame, vocab: DataFrame, k: int, iterations: int = 20, seed: int = 42, terms: int = 10):
    """Topics of the count index: ``(doc_topics(doc_id, topic, p), topic_terms(topic, rank, term, p))``.

    Every iteration reads all documents, not a sample of them.
    """
    numbers = cut(term_numbers(vocab))
    rows = sparse_rows(index, numbers, "tf")
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0, optimizeDocConcentration=True).fit(rows)
    p = model.transform(rows).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p"))
    described = model.describeTopics(terms).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "x")
    ).select("topic", (F.col("r") + 1).alias("rank"), F.col("x.termIndices").alias("j"), F.col("x.termWeights").alias("p"))
    return p, described.join(numbers, "j").select("topic", "rank", "term", "p")


def topic_distribution(doc_topics: DataFrame) -> DataFrame:
    """``(topic, share)``: mean probability over the documents, largest first."""
    n = doc_topics.select("doc_id").distinct().agg(F.count("*").alias("n"))
    sums = doc_topics.groupBy("topic").agg(F.sum("p").alias("s"))
    return sums.select("topic", F.round(F.col("s") / n.scalar(), 6).alias("share")).orderBy(F.desc("share"), "topic")


def dominant_topic(doc_topics: DataFrame) -> DataFrame:
    """``(doc_id, topic)``: the most probable topic, the smaller number on ties."""
    return doc_topics.groupBy("doc_id").agg(F.max_by("topic", F.struct(F.col("p"), -F.col("topic"))).alias("topic"))


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """``(id, vec)`` on the first ``k`` components, and the variance each explains.

    The sign of a component is fixed by its largest loading.
    """
    rows = vectors.select("id", array_to_vector("vec").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, c]).argmax(), c] >= 0 else -1.0 for c in range(k)]
    means = vectors.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = np.array([r["m"] for r in means.orderBy("i").collect()]) @ loadings
    fixed = F.array(*[
        (F.get("p", F.lit(c)) - float(centre[c])) * signs[c] for c in range(k)
    ])
    out = model.transform(rows).select("id", vector_to_array("p").alias("p")).select("id", fixed.alias("vec"))
    return out, [float(x) for x in model.explainedVariance]


def truncated_svd(index: DataFrame, k: int, weight: str = "w") -> tuple[DataFrame, list[float], DataFrame]:
    """``(vectors, singular values, explained)`` of the sparse index, rows projected as U*s; see ``factors.svd``."""
    return svd(index.select(F.col("doc_id").alias("r"), F.col("term").alias("c"), F.col(weight).alias("x")), k)


def adjacency_svd(edges: DataFrame, k: int) -> tuple[DataFrame, list[float], DataFrame]:
    """The same of the symmetric adjacency of ``edges(src, dst, weight)``, one row a pair."""
    one = edges.where("src <> dst").select(F.col("src").alias("r"), F.col("dst").alias("c"), F.col("weight").alias("x"))
    return svd(one.unionByName(one.select(F.col("c").alias("r"), F.col("r").alias("c"), "x")), k)


def l2(vectors: DataFrame) -> DataFrame:
    """Rows scaled to length one."""
    return vectors.withColumn("vec", unit(F.col("vec")))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1; a constant column becomes 0."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("st"))
    out = df.withColumn("_st", stats.scalar())
    for c in columns:
        gap, s = F.col(c) - F.col(f"_st.{c}.m"), F.col(f"_st.{c}.s")
        out = out.withColumn(c, F.when(s > 0, gap / s).otherwise(gap))
    return out.drop("_st")


def max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns divided by their maximum; a maximum of 0 counts as 1."""
    stats = df.agg(F.struct(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).alias("st"))
    out = df.withColumn("_st", stats.scalar())
    for c in columns:
        top = F.when(F.col(f"_st.{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_st.{c}"))
        out = out.withColumn(c, F.col(c) / top)
    return out.drop("_st")


def combine(parts: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """``(id, features)``: the ``vec`` columns of several tables side by side."""
    joined = None
    names = []
    for i, part in enumerate(parts):
        names.append(f"v{i}")
        column = part.select(id_col, array_to_vector("vec").alias(f"v{i}"))
        joined = column if joined is None else joined.join(column, id_col)
    return VectorAssembler(inputCols=names, outputCol="features").transform(joined).select(id_col, "features")
