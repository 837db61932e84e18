"""Counts, distributions and statistics of an article table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import exact_percentiles, top_k

DIGITS = 6


def _rows(row: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """A one-row aggregate turned into ``(metric, value)`` rows."""
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def field_availability(df: DataFrame) -> DataFrame:
    """``(field, available, percent)`` from one pass over the table."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = [
        F.struct(F.lit(c).alias("field"), F.col(c).alias("available"),
                 F.round(F.try_divide(F.col(c) * 100.0, F.col("_n")), DIGITS).alias("percent"))
        for c in df.columns
    ]
    return _rows(row, cells)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, metric, value)``: count, mean, sample deviation, min, quartiles, max."""
    row = df.agg(*[
        F.struct(
            F.count(c).cast("double").alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
        ).alias(c) for c in columns
    ])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(f"{c}.{m}").alias("value"))
        for c in columns for m in ("count", "mean", "std", "min", "max")
    ]
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    names = F.when(F.col("prob") == 0.25, "25%").when(F.col("prob") == 0.5, "50%").otherwise("75%")
    both = _rows(row, cells).unionByName(quartiles.select("column", names.alias("metric"), "value"))
    return both.withColumn("value", F.round("value", DIGITS))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """``(key, n, percent)`` of a column, sorted by the key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total.scalar(), DIGITS)).orderBy(key)


def top_values(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of a column."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return top_k(counts, [], [F.desc("n"), F.asc(key)], k)


def author_counts(df: DataFrame, authors: str = "authors") -> DataFrame:
    """``(author, publications)``; an author listed twice on a paper counts once."""
    rows = df.select(F.explode(F.array_distinct(authors)).alias("author"))
    return rows.groupBy("author").agg(F.count("*").alias("publications"))


def top_authors(df: DataFrame, k: int, authors: str = "authors") -> DataFrame:
    """The ``k`` most productive authors, with the number of distinct authors."""
    counts = author_counts(df, authors)
    best = top_k(counts, [], [F.desc("publications"), F.asc("author")], k)
    return best.withColumn("unique_authors", counts.agg(F.count("*")).scalar())


def corpus_stats(df: DataFrame, abstract: str, lists: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """``(metric, value)``: documents, mean text length, mean list sizes and mean numbers."""
    row = df.agg(
        F.count("*").cast("double").alias("documents"),
        F.avg(F.length(F.coalesce(abstract, F.lit("")))).alias("mean_text_length"),
        *[F.avg(F.coalesce(F.array_size(F.col(c)), F.lit(0))).alias(f"mean_{c}") for c in lists],
        *[F.avg(c).alias(f"mean_{c}") for c in numbers],
    )
    return _rows(row, [
        F.struct(F.lit(c).alias("metric"), F.round(F.col(c), DIGITS).alias("value")) for c in row.columns
    ])


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """``(bin, n)`` with values clipped to [lo, hi]; the right edge belongs to the last bin."""
    x = F.least(F.greatest(value.cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    place = F.least(F.lit(bins), F.floor((x - lo) / (hi - lo) * bins) + 1)
    return df.where(value.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def bucket_other(df: DataFrame, key: str, k: int, other: str = "other") -> DataFrame:
    """``(key, n)`` of the ``k`` most frequent values, all others under one name."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), key).limit(k).select(key, F.lit(True).alias("_top"))
    named = counts.join(best, key, "left")
    return named.groupBy(F.when(F.col("_top"), F.col(key)).otherwise(F.lit(other)).alias(key)).agg(
        F.sum("n").alias("n"))


def classification_ready(df: DataFrame, label: str, text: str) -> DataFrame:
    """One row: classes, smallest class, empty texts, and whether training makes sense."""
    empty = F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "")
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"), empty.alias("empty"))
    row = per_class.agg(
        F.count("*").alias("classes"), F.min("n").alias("smallest"),
        F.sum("n").alias("labelled"), F.sum("empty").alias("empty_texts"))
    ready = (F.col("classes") >= 2) & (F.col("smallest") >= 2) & (F.col("empty_texts") < F.col("labelled"))
    return row.withColumn("ready", ready)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """``(cluster, size, percent)``, largest first."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    total = labels.agg(F.count("*").alias("t"))
    return sizes.withColumn("percent", F.round(F.col("size") * 100.0 / total.scalar(), DIGITS)).orderBy(
        F.desc("size"), "cluster")


def clustering_summary(labels: DataFrame) -> DataFrame:
    """One row per clustering: number of clusters, largest, smallest and mean size."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.max("size").alias("largest"), F.min("size").alias("smallest"),
        F.round(F.avg("size"), DIGITS).alias("mean_size"))
