"""Weighted term index, co-occurrence, collocations and discriminating terms.

The document-term matrix is the long table ``(doc_id, term, tf, w)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .scale import salted_join, top_k
from .tokens import bigrams, tokens, words


def corpus_size(bags: DataFrame) -> DataFrame:
    """One row, ``n``: number of documents, those without words included."""
    return bags.agg(F.count("*").cast("double").alias("n"))


def term_counts(bags: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``; without a shuffle when the bags lie by document."""
    return words(bags, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(
    counts: DataFrame, n_docs: DataFrame, min_df: int = 1, max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """``(term, df, cf)`` with ``min_df <= df <= max_df * n``, optionally the most frequent ones."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs.scalar()))
    if max_features is not None:
        terms = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    return terms


def tf_index(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of vocabulary terms: ``(doc_id, term, tf)``."""
    return salted_join(counts, vocab.select("term"), "term", "doc_id", "left_semi")


def tfidf_index(
    counts: DataFrame, vocab: DataFrame, n_docs: DataFrame, use_idf: bool = True
) -> DataFrame:
    """``(doc_id, term, tf, w)``: smoothed idf, rows scaled to length one per document."""
    idf = F.log((F.lit(1.0) + n_docs.scalar()) / (F.lit(1.0) + F.col("df"))) + 1.0
    table = vocab.select("term", (idf if use_idf else F.lit(1.0)).alias("idf"))
    raw = salted_join(counts, table, "term", "doc_id").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", "tf", (F.col("raw") / length).alias("w"))


def counted(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(counts, corpus size)``, the counts written once for all that is built on them.

    Counts are summed before they are shuffled; texts and words stay where they
    are read (bags need not lie by document).
    """
    return cut(term_counts(bags)), corpus_size(bags)


def index_of(
    counts: DataFrame, n: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None,
    use_idf: bool = True, stored: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(index, vocabulary, corpus size)`` of written counts.

    The vocabulary is written once, since index and queries both read it.  With
    ``stored`` the index is written too, for work that reads it several times.
    """
    vocab = cut(vocabulary(counts, n, min_df, max_df, max_features))
    index = tfidf_index(counts, vocab, n, use_idf)
    return cut(index) if stored else index, vocab, n


def build_index(bags: DataFrame, min_df: int = 1, max_df: float = 1.0, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`index_of` the counts of a bag table; the texts are read once."""
    return index_of(*counted(bags), min_df, max_df, **options)


def index_stats(index: DataFrame, vocab: DataFrame, n_docs: DataFrame) -> DataFrame:
    """One row: documents, terms, stored weights and density."""
    terms = vocab.agg(F.count("*").alias("terms"))
    stored = index.agg(F.count("*").alias("nnz"))
    row = stored.select(
        n_docs.scalar().cast("bigint").alias("documents"), terms.scalar().alias("terms"), "nnz"
    )
    return row.withColumn("density", F.try_divide(F.col("nnz"), (F.col("documents") * F.col("terms")).cast("double")))


def term_ranking(index: DataFrame, k: int, weight: str = "w") -> DataFrame:
    """The ``k`` terms with the largest total weight (or count)."""
    totals = index.groupBy("term").agg(F.sum(weight).alias("total"), F.count("*").alias("df"))
    totals = totals.withColumn("total", F.round(F.col("total").cast("double"), 6))
    return top_k(totals, [], [F.desc("total"), F.asc("term")], k)


def token_totals(bags: DataFrame) -> DataFrame:
    """One row: all occurrences and distinct terms."""
    counts = words(bags).groupBy("term").agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count("*").alias("unique_terms")
    )


def with_labels(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Join ``labels(doc_id, cluster)`` to any table keyed by document."""
    return table.join(labels, "doc_id")


def cluster_sizes_of(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("size"))


def cluster_vocabulary(counts: DataFrame, labels: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """``(cluster, term, df, cf, size)``: a vocabulary fitted inside each cluster."""
    terms = with_labels(counts, labels).groupBy("cluster", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )
    sized = salted_join(terms, cluster_sizes_of(labels), "cluster", "term")
    return sized.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("size")))


def cluster_terms(counts: DataFrame, labels: DataFrame, min_df: int, max_df: float, k: int) -> DataFrame:
    """Most frequent terms of each cluster, the vocabulary refitted per cluster."""
    terms = cluster_vocabulary(counts, labels, min_df, max_df)
    ranked = top_k(terms, ["cluster"], [F.desc("cf"), F.asc("term")], k)
    return ranked.select("cluster", "rank", "term", F.col("cf").alias("n"))


def cooccurrence(bags: DataFrame, vocab: DataFrame, window: int = 5) -> DataFrame:
    """``(term_a, term_b, n)``: ordered pairs at distance 1 to ``window`` among vocabulary words.

    Words outside the vocabulary are dropped before distances are measured.
    Partners come from ``lead`` columns of one pass per document, and pairs are
    counted unordered before both directions are written out.
    """
    kept = salted_join(tokens(bags), vocab.select("term"), "term", "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy("pos")
    partners = F.array_compact(F.array(*[F.lead("term", d).over(order) for d in range(1, window + 1)]))
    pairs = kept.select("term", partners.alias("partners")).select("term", F.explode("partners").alias("other"))
    counted = pairs.groupBy(F.least("term", "other").alias("a"), F.greatest("term", "other").alias("b")).agg(
        F.count("*").alias("n")
    )
    same = F.col("a") == F.col("b")
    both = F.when(same, F.array(F.struct(F.col("a").alias("term_a"), F.col("b").alias("term_b"),
                                         (F.col("n") * 2).alias("n")))).otherwise(
        F.array(
            F.struct(F.col("a").alias("term_a"), F.col("b").alias("term_b"), F.col("n").alias("n")),
            F.struct(F.col("b").alias("term_a"), F.col("a").alias("term_b"), F.col("n").alias("n")),
        )
    )
    return counted.select(F.explode(both).alias("x")).select("x.*")


def strongest_terms(cooc: DataFrame, n_nodes: int) -> DataFrame:
    """``(term)``: the terms with the largest row sum."""
    sums = cooc.groupBy(F.col("term_a").alias("term")).agg(F.sum("n").alias("s"))
    return sums.orderBy(F.desc("s"), "term").limit(n_nodes).select("term")


def cooccurrence_network(cooc: DataFrame, n_edges: int, n_nodes: int | None = None) -> DataFrame:
    """``(src, dst, weight)``: the heaviest undirected term pairs, weight both directions summed."""
    pairs = cooc.where("term_a < term_b")
    if n_nodes is not None:
        nodes = strongest_terms(cooc, n_nodes)
        pairs = pairs.join(nodes.withColumnRenamed("term", "term_a"), "term_a", "left_semi").join(
            nodes.withColumnRenamed("term", "term_b"), "term_b", "left_semi"
        )
    edges = pairs.select(F.col("term_a").alias("src"), F.col("term_b").alias("dst"), (F.col("n") * 2).alias("weight"))
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(n_edges)


def network_centrality(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Degree and degree centrality of each of the given terms, isolated ones included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("term")).groupBy("term").agg(F.count("*").alias("d"))
    n = terms.agg(F.count("*").cast("double").alias("n"))
    joined = terms.join(ends, "term", "left").withColumn("degree", F.coalesce("d", F.lit(0)))
    return joined.select("term", "degree", F.try_divide(F.col("degree"), n.scalar() - 1).alias("centrality"))


def collocations(
    bags: DataFrame, min_freq: int, k: int, labels: DataFrame | None = None
) -> DataFrame:
    """Neighbouring words ranked by pointwise mutual information.

    With ``labels`` everything is counted inside each cluster.  Bigrams do not
    cross document borders; the total is the number of words.
    """
    group: list[str] = []
    if labels is not None:
        bags, group = with_labels(bags, labels), ["cluster"]
    pairs = bigrams(bags, group).groupBy(*group, "first", "second").agg(F.count("*").alias("freq"))
    pairs = pairs.where(F.col("freq") >= min_freq)
    single = words(bags, *group).groupBy(*group, "term").agg(F.count("*").alias("n"))
    left = single.withColumnRenamed("term", "first").withColumnRenamed("n", "n_first")
    right = single.withColumnRenamed("term", "second").withColumnRenamed("n", "n_second")
    scored = pairs.join(left, [*group, "first"]).join(right, [*group, "second"])
    if group:
        scored = salted_join(scored, single.groupBy("cluster").agg(F.sum("n").alias("total")), "cluster", "first")
    else:
        scored = scored.withColumn("total", single.agg(F.sum("n").alias("total")).scalar())
    pmi = F.log2(
        F.col("freq").cast("double") * F.col("total") / (F.col("n_first").cast("double") * F.col("n_second"))
    )
    scored = scored.withColumn("pmi", F.round(pmi, 6))
    order = [F.desc("pmi"), F.asc("first"), F.asc("second")]
    return top_k(scored, group, order, k).select(*group, "rank", "first", "second", "freq", "pmi")


def discriminative_terms(index: DataFrame, labels: DataFrame, k: int, weight: str = "w") -> DataFrame:
    """Per cluster, terms whose mean weight inside is largest against the mean outside."""
    inside = with_labels(index, labels).groupBy("cluster", "term").agg(F.sum(weight).cast("double").alias("s_in"))
    # A term has at most one row per cluster here, so its window is small.
    inside = inside.withColumn("s_all", F.sum("s_in").over(Window.partitionBy("term")))
    sizes = cluster_sizes_of(labels)
    total = sizes.agg(F.sum("size").alias("total"))
    joined = salted_join(inside, sizes, "cluster", "term")
    outside = F.greatest(total.scalar() - F.col("size"), F.lit(1))
    mean_in = F.col("s_in") / F.greatest("size", F.lit(1))
    # A term of one cluster only leaves nothing outside; the difference is taken as exactly 0 there.
    rest = F.col("s_all") - F.col("s_in")
    mean_out = F.when(rest < 1e-9, F.lit(0.0)).otherwise(rest) / outside
    scored = joined.withColumn("score", F.round(mean_in / (mean_out + 1e-10), 4))
    ranked = top_k(scored, ["cluster"], [F.desc("score"), F.asc("term")], k)
    return ranked.select("cluster", "rank", "term", "score")


def cluster_labels(ranked_terms: DataFrame, n: int = 5) -> DataFrame:
    """``(cluster, label)``: 'Cluster k: t1, ..., tn' from ranked terms."""
    best = ranked_terms.where(F.col("rank") <= n).groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")
    )
    name = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(": "), F.array_join("t.term", ", "))
    return best.select("cluster", name.alias("label"))
