"""Ranked search on the term index and on dense vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .cells import nearest
from .index import tfidf_index
from .postings import best_documents
from .scale import salted_join, top_k

DIGITS = 6


def query_vectors(query_counts: DataFrame, vocab: DataFrame, n_docs: DataFrame, use_idf: bool = True) -> DataFrame:
    """``(query_id, term, qw)``: queries weighted with the vocabulary of the index."""
    index = tfidf_index(query_counts, vocab, n_docs, use_idf)
    return index.select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select(
        "query_id", "rank", "doc_id", "score"
    )


def search(
    index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", documents: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``, the ``k`` best documents of every query.

    ``queries`` is a :func:`query_vectors` table.  With ``documents(doc_id)``
    the documents that share no term compete too: at score 0 for the cosine,
    at the distance of an orthogonal or empty row for ``euclidean`` (which needs
    them).  Of those only the smallest ids can rank: either ``k`` matches are at
    least as good, or all matches are known and ``k`` of the ``2k`` smallest ids
    are not among them.  Queries of ``asked(query_id)`` without a known term are
    empty rows: they score 0 with every document, or by the distance from zero.
    """
    best = best_documents(index, queries, k, metric)
    if documents is None:
        return best
    best = best.select("query_id", "doc_id", "score")
    ids = documents.select("doc_id")
    known = queries.select("query_id").distinct()
    used = cut(index.select("doc_id").distinct())
    if metric == "cosine":
        pools = [(known, ids, 0.0)]
    else:  # rows have length one, or zero when the document has no vocabulary term
        pools = [(known, used, round(1.0 / (1.0 + math.sqrt(2.0)), DIGITS)), (known, ids.join(used, "doc_id", "left_anti"), 0.5)]
    if asked is not None:
        empty = asked.select("query_id").distinct().join(known, "query_id", "left_anti")
        pools += [(empty, ids, 0.0)] if metric == "cosine" else [(empty, used, 0.5), (empty, ids.join(used, "doc_id", "left_anti"), 1.0)]
    for own, pool, score in pools:
        few = pool.orderBy("doc_id").limit(2 * k).agg(F.collect_list("doc_id").alias("p"))
        extra = own.select("query_id", F.explode(few.scalar()).alias("doc_id")).withColumn("score", F.lit(score))
        best = best.unionByName(extra)
    return _ranked(best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def with_articles(results: DataFrame, articles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Article columns joined back to a result list."""
    return results.join(articles.select("doc_id", *columns), "doc_id")


def explain(index: DataFrame, queries: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms that add most to each hit ``(query_id, doc_id)``, with both weights."""
    rows = index.select("doc_id", "term", "w").join(hits.select("query_id", "doc_id"), "doc_id")
    parts = rows.join(queries, ["query_id", "term"])
    parts = parts.withColumn("contribution", F.round(F.col("qw") * F.col("w"), DIGITS)).where("qw * w > 0")
    ranked = top_k(parts, ["query_id", "doc_id"], [F.desc("contribution"), F.asc("term")], n)
    return ranked.select(
        "query_id", "doc_id", "rank", "term", F.round("qw", DIGITS).alias("query_weight"),
        F.round("w", DIGITS).alias("document_weight"), "contribution",
    )


def tagged(results: dict[str, DataFrame], column: str = "method") -> DataFrame:
    """Several result tables as one, with the name of each in ``column``."""
    out = None
    for name, df in results.items():
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def query_term_importance(vocab: DataFrame, query_words: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Vocabulary terms that contain a word of the query, with their weight in the query vector.

    Terms are listed under their runs of up to three characters, once each; a
    word looks only under its rarest run, and containment is tested there.
    Vocabulary and words are never paired off, and no list holds all substrings.
    """
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.col(c).substr(i, F.lit(n)))
    every = F.concat(*[F.when(F.length("term") >= n, runs("term", n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])
    listed = cut(vocab.where(F.length("term") > 0).select("term", F.explode(F.array_distinct(every)).alias("run")))
    sizes = listed.groupBy("run").agg(F.count("*").alias("n"))
    words = cut(query_words.select("word").where(F.length("word") > 0).distinct())
    own = words.select("word", F.explode(F.when(F.length("word") < 3, F.array("word")).otherwise(F.array_distinct(runs("word", 3)))).alias("run"))
    rarest = own.join(sizes, "run", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("m"))
    rarest = rarest.where("m.n > 0").select("word", F.col("m.run").alias("run"))
    # The file of the runs is many times smaller than the runs, so that Spark would broadcast them by its size.
    holders = salted_join(listed.hint("merge"), rarest, "run", "term").where(F.contains("term", "word")).select("word", "term")
    hits = query_words.select("query_id", "word").distinct().join(holders, "word").select("query_id", "term").distinct()
    weighted = hits.join(queries, ["query_id", "term"], "left")
    weighted = weighted.withColumn("weight", F.round(F.coalesce("qw", F.lit(0.0)), DIGITS))
    return top_k(weighted, ["query_id"], [F.desc("weight"), F.asc("term")], k).select("query_id", "term", "weight")


def importance_table(by_config: dict[str, DataFrame]) -> DataFrame:
    """One row per query and term, one weight column per configuration, 0 where absent."""
    long = tagged(by_config, "config")
    wide = long.groupBy("query_id", "term").pivot("config", list(by_config)).agg(F.first("weight"))
    return wide.na.fill(0.0, list(by_config))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` by cosine; ``vectors(id, vec)``, ``queries(id, vec)``."""
    return nearest(vectors, queries, k, "cosine").select(
        "query_id", "rank", F.col("id").alias("doc_id"), "score"
    )


def hybrid_search(
    vectors: DataFrame, node_vectors: DataFrame, queries: DataFrame, k: int, alpha: float = 0.7
) -> DataFrame:
    """Text similarity blended with how close a candidate's node is to the other candidates' nodes.

    The ``3k`` best by text are candidates; each with a node vector gains
    ``(1 - alpha)`` times its mean cosine to the other candidates that have one.
    That mean is read off the sum of the unit vectors of the candidate set, so
    candidates are not paired.  As a candidate can lose by it, every other
    document competes at ``alpha`` times its similarity; only the ``k`` next by
    text can enter, so the ``4k`` best by text decide exactly.
    """
    from ..functions.vectors import dot, unit

    found = vector_search(vectors, queries, 4 * k)
    nodes = node_vectors.select(F.col("id").alias("doc_id"), unit(F.col("vec")).alias("u"))
    linked = found.where(F.col("rank") <= 3 * k).join(nodes, "doc_id")
    parts = linked.select("query_id", F.posexplode("u").alias("i", "x"))
    sums = parts.groupBy("query_id", "i").agg(F.sum("x").alias("s")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "s"))).alias("t"))
    sizes = linked.groupBy("query_id").agg(F.count("*").alias("m"))
    closeness = linked.join(sums, "query_id").join(sizes, "query_id").where("m > 1").select(
        "query_id", "doc_id",
        ((dot(F.col("u"), F.col("t.s")) - dot(F.col("u"), F.col("u"))) / (F.col("m") - 1)).alias("near"),
    )
    blended = found.join(closeness, ["query_id", "doc_id"], "left").withColumn(
        "score",
        F.round(F.col("score") * alpha + F.coalesce(F.col("near"), F.lit(0.0)) * (1 - alpha), DIGITS),
    )
    return _ranked(blended.drop("rank"), k)


def score_matrix(results: DataFrame, max_titles: int, methods: Sequence[str]) -> DataFrame:
    """Titles shared by most methods, one column per method, scores scaled by the method's maximum."""
    best = F.max("score").over(Window.partitionBy("query_id", "method"))
    scaled = results.withColumn("share", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))
    shared = results.groupBy("query_id", "title").agg(F.count_distinct("method").alias("methods"))
    chosen = top_k(shared, ["query_id"], [F.desc("methods"), F.asc("title")], max_titles).drop("rank")
    wide = scaled.join(chosen, ["query_id", "title"]).groupBy("query_id", "title", "methods").pivot(
        "method", list(methods)).agg(F.round(F.max("share"), DIGITS))
    return wide.na.fill(0.0, list(methods))


def method_agreement(results: DataFrame) -> DataFrame:
    """Jaccard of the result titles for each pair of methods, per query."""
    titles = results.groupBy("query_id", "method").agg(F.collect_set("title").alias("titles"))
    other = titles.select("query_id", F.col("method").alias("method_b"), F.col("titles").alias("titles_b"))
    pairs = titles.withColumnRenamed("method", "method_a").join(other, "query_id").where("method_a < method_b")
    both = F.size(F.array_intersect("titles", "titles_b"))
    union = F.size(F.array_union("titles", "titles_b"))
    return pairs.select(
        "query_id", "method_a", "method_b",
        F.round(F.when(union > 0, both / union).otherwise(F.lit(0.0)), DIGITS).alias("jaccard"),
    )


def term_lookup(index: DataFrame, term: str, threshold: float, n: int, *extras: DataFrame) -> DataFrame:
    """Documents whose weight of ``term`` is above ``threshold``, with cluster and topic tables joined."""
    hits = index.where((F.col("term") == term) & (F.col("w") > threshold))
    hits = hits.select("doc_id", F.round("w", DIGITS).alias("weight"))
    best = top_k(hits, [], [F.desc("weight"), F.asc("doc_id")], n)
    for extra in extras:
        best = best.join(extra, "doc_id", "left")
    return best


def cooccurring_terms(index: DataFrame, term: str, n: int) -> DataFrame:
    """Terms by total weight in the documents that contain ``term``."""
    holders = index.where((F.col("term") == term) & (F.col("w") > 0)).select("doc_id")
    others = index.where(F.col("term") != term).join(holders, "doc_id", "left_semi")
    totals = others.groupBy("term").agg(F.round(F.sum("w"), DIGITS).alias("weight"))
    return top_k(totals, [], [F.desc("weight"), F.asc("term")], n)


def term_by_cluster(index: DataFrame, labels: DataFrame, term: str) -> DataFrame:
    """Mean weight of ``term`` over all documents of a cluster, and how many contain it."""
    hits = index.where(F.col("term") == term).select("doc_id", "w")
    joined = labels.join(hits, "doc_id", "left")
    return joined.groupBy("cluster").agg(
        F.round(F.avg(F.coalesce("w", F.lit(0.0))), DIGITS).alias("mean_weight"),
        F.count_if(F.col("w") > 0).alias("documents"),
    )


def term_by_topic(index: DataFrame, doc_topics: DataFrame, term: str) -> DataFrame:
    """Topic-weighted mean of ``term``; ``doc_topics(doc_id, topic, p)``, 0 where a topic has no mass."""
    hits = index.where(F.col("term") == term).select("doc_id", "w")
    joined = doc_topics.join(hits, "doc_id", "left")
    mass = F.sum("p")
    total = F.sum(F.coalesce("w", F.lit(0.0)) * F.col("p"))
    return joined.groupBy("topic").agg(
        F.round(F.when(mass > 0, total / mass).otherwise(F.lit(0.0)), DIGITS).alias("weight")
    )
