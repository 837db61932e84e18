"""Cluster reports as Markdown rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate


def _lines(ranked: DataFrame, n: int, line: Column, name: str) -> DataFrame:
    """The first ``n`` ranked rows of each cluster as one block of lines."""
    best = ranked.where(F.col("rank") <= n).select("cluster", "rank", line.alias("line"))
    rows = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("r"))
    return rows.select("cluster", F.array_join("r.line", "\n").alias(name))


def cluster_report(
    sizes: DataFrame, frequent: DataFrame, discriminating: DataFrame, collocations: DataFrame, central: DataFrame,
    articles: DataFrame, n_terms: int = 10, n_collocations: int = 5, n_documents: int = 3,
) -> DataFrame:
    """``(cluster, report)``: size, frequent and discriminating terms, collocations and central documents.

    ``frequent(cluster, rank, term, n)``, ``discriminating(cluster, rank, term,
    score)``, ``collocations(cluster, rank, first, second, pmi)``,
    ``central(cluster, rank, doc_id, similarity)``, ``articles(doc_id, title,
    abstract)``.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    four = lambda c: F.format_string("%.4f", F.round(c, 4))
    documents = central.where(F.col("rank") <= n_documents).join(articles.select("doc_id", "title", "abstract"), "doc_id")
    blocks = [
        _lines(frequent, n_terms, text("- ", F.col("term"), ": ", F.col("n").cast("string")), "a"),
        _lines(discriminating, n_terms, text("- ", F.col("term"), ": ", four("score")), "b"),
        _lines(collocations, n_collocations, text("- '", F.col("first"), " ", F.col("second"), "': ", four("pmi")), "c"),
        _lines(documents, n_documents, text(
            "### Document ", F.col("rank").cast("string"), " (similarity ", four("similarity"), ")\n- Title: ",
            F.col("title"), "\n- Abstract: ", truncate("abstract", 300)), "d"),
    ]
    out = sizes.select("cluster", "size")
    for block in blocks:
        out = out.join(block, "cluster", "left")
    part = lambda name, heading: text(f"\n\n## {heading}\n", F.coalesce(name, F.lit("")))
    return out.select("cluster", text(
        "# Cluster ", F.col("cluster").cast("string"), "\n\n- Documents: ", F.col("size").cast("string"),
        part("a", "Frequent terms"), part("b", "Discriminating terms"), part("c", "Collocations"),
        part("d", "Central documents"),
    ).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    """Reports as text files, in cluster order."""
    report.orderBy("cluster").select("report").write.mode("overwrite").text(path)
