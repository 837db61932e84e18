"""Queries for the term index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from . import sql as Q
from .corpus import GIVEN_SQL, MAX_DF, MIN_DF, document_bags, document_counts, document_index, given_labels
from .registry import query

TF = f"{Q.tok()},\n{Q.counts()}"
VOCAB = f"{TF},\n{Q.vocab(min_df=MIN_DF, max_df=MAX_DF)}"
INDEX = Q.index(MIN_DF, MAX_DF)


@query("i1_vocabulary", f"WITH {VOCAB} SELECT * FROM vocab")
def vocabulary(spark, folder):
    return document_index(spark, folder)[1]


@query("i1_vocabulary_top", f"WITH {TF}, {Q.vocab(min_df=MIN_DF, max_df=MAX_DF, max_features=500)} SELECT * FROM vocab")
def vocabulary_top(spark, folder):
    return document_index(spark, folder, max_features=500)[1]


@query("i2_count_index", f"WITH {VOCAB} SELECT doc_id, term, tf FROM tf SEMI JOIN vocab USING (term)")
def count_index(spark, folder):
    counts, n = document_counts(spark, folder)
    return I.tf_index(counts, I.vocabulary(counts, n, MIN_DF, MAX_DF)).select("doc_id", "term", "tf")


@query("i3_tfidf_index", f"WITH {INDEX} SELECT doc_id, term, tf, round(w, 6) AS w FROM idx")
def tfidf(spark, folder):
    return document_index(spark, folder)[0].withColumn("w", F.round("w", 6))


@query("i3_tf_index_normalised", f"WITH {Q.index(MIN_DF, MAX_DF, use_idf=False)} SELECT doc_id, term, tf, round(w, 6) AS w FROM idx")
def tf_normalised(spark, folder):
    return document_index(spark, folder, use_idf=False)[0].withColumn("w", F.round("w", 6))


@query("i4_index_stats", f"""WITH {INDEX}, s AS (SELECT (SELECT count(*) FROM documents) AS documents,
(SELECT count(*) FROM vocab) AS terms, count(*) AS nnz FROM idx)
SELECT documents, terms, nnz, round(nnz / (documents * terms)::DOUBLE, 9) AS density FROM s""")
def index_stats(spark, folder):
    return I.index_stats(*document_index(spark, folder)).withColumn("density", F.round("density", 9))


@query("i5_term_ranking", f"""WITH {INDEX}, t AS (SELECT term, round(sum(w), 6) AS total, count(*) AS df FROM idx GROUP BY term)
SELECT *, row_number() OVER (ORDER BY total DESC, term)::INT AS rank FROM t ORDER BY rank LIMIT 50""")
def term_ranking(spark, folder):
    return I.term_ranking(document_index(spark, folder)[0], 50)


@query("i5_token_totals", f"WITH {Q.tok()} SELECT count(*) AS occurrences, count(DISTINCT term) AS unique_terms FROM tok")
def token_totals(spark, folder):
    return I.token_totals(document_bags(spark, folder, by_document=False))


def _cluster_vocab(min_df, max_df):
    return f"""cv AS (SELECT cluster, term, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(size) AS size
      FROM tf JOIN lab USING (doc_id) JOIN (SELECT cluster, count(*) AS size FROM lab GROUP BY cluster) USING (cluster)
      GROUP BY cluster, term HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * any_value(size))"""


FREQUENT = f"""{_cluster_vocab(2, 0.95)}, freq AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY cf DESC, term)::INT AS rank,
  term, cf AS n FROM cv QUALIFY rank <= 50)"""


@query("i6_cluster_terms", f"WITH {TF}, {GIVEN_SQL}, {FREQUENT} SELECT * FROM freq")
def cluster_terms(spark, folder):
    counts = I.term_counts(document_bags(spark, folder))
    return I.cluster_terms(counts, given_labels(spark, folder), 2, 0.95, 50)


COOC_VOCAB = f"{TF}, {Q.vocab(min_df=10, max_df=0.9, max_features=500)}"
COOC = f"""{COOC_VOCAB}, kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok SEMI JOIN vocab USING (term)),
near AS (SELECT a.term AS x, b.term AS y FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.p - a.p BETWEEN 1 AND 5),
cooc AS (SELECT term_a, term_b, count(*) AS n FROM (SELECT x AS term_a, y AS term_b FROM near UNION ALL SELECT y, x FROM near) GROUP BY ALL)"""


def _cooc(spark, folder):
    bags = document_bags(spark, folder)
    counts = I.term_counts(bags)
    vocab = I.vocabulary(counts, I.corpus_size(bags), 10, 0.9, 500)
    return I.cooccurrence(bags, vocab, 5), vocab


@query("i7_cooccurrence", f"WITH {COOC} SELECT * FROM cooc")
def cooccurrence(spark, folder):
    return _cooc(spark, folder)[0]


NETWORK = f"""{COOC}, top AS (SELECT term_a AS term FROM cooc GROUP BY term_a ORDER BY sum(n) DESC, term_a LIMIT 50),
net AS (SELECT a.term_a AS src, a.term_b AS dst, (a.n + b.n)::BIGINT AS weight FROM cooc a JOIN cooc b ON a.term_a = b.term_b AND a.term_b = b.term_a
  WHERE a.term_a < a.term_b AND a.term_a IN (FROM top) AND a.term_b IN (FROM top) ORDER BY weight DESC, src, dst LIMIT 100)"""


@query("i8_cooccurrence_network", f"WITH {NETWORK} SELECT * FROM net")
def cooccurrence_network(spark, folder):
    return I.cooccurrence_network(_cooc(spark, folder)[0], 100, 50)


@query("i8_network_centrality", f"""WITH {NETWORK}, ends AS (SELECT src AS term FROM net UNION ALL SELECT dst FROM net)
SELECT top.term, count(ends.term)::INT AS degree, round(count(ends.term) / ((SELECT count(*) FROM top) - 1)::DOUBLE, 6) AS centrality
FROM top LEFT JOIN ends USING (term) GROUP BY top.term""")
def network_centrality(spark, folder):
    cooc, _ = _cooc(spark, folder)
    out = I.network_centrality(I.cooccurrence_network(cooc, 100, 50), I.strongest_terms(cooc, 50))
    return out.select("term", F.col("degree").cast("int").alias("degree"), F.round("centrality", 6).alias("centrality"))


def _collocations(min_freq, k, group=""):
    by = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    using = f"{by}"
    source = "tok JOIN lab USING (doc_id)" if group else "tok"
    total = f"(SELECT {by}count(*) AS total FROM t GROUP BY ALL)"
    join_total = f"JOIN {total} tt USING ({group})" if group else f"CROSS JOIN {total}"
    return f"""t AS (SELECT * FROM {source}),
    big AS (SELECT {by}term AS first, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM t),
    pr AS (SELECT {by}first, second, count(*) AS freq FROM big WHERE second IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_freq}),
    uni AS (SELECT {by}term, count(*) AS n FROM t GROUP BY ALL),
    sc AS (SELECT {by}first, second, freq, round(log2(freq::DOUBLE * total / (a.n::DOUBLE * b.n)), 6) AS pmi FROM pr
      JOIN (SELECT {by}term AS first, n FROM uni) a USING ({using}first)
      JOIN (SELECT {by}term AS second, n FROM uni) b USING ({using}second) {join_total}),
    col AS (SELECT {by}row_number() OVER ({part} ORDER BY pmi DESC, first, second)::INT AS rank, first, second, freq, pmi
      FROM sc QUALIFY rank <= {k})"""


@query("i9_collocations", f"WITH {Q.tok()}, {_collocations(5, 30)} SELECT * FROM col")
def collocations(spark, folder):
    return I.collocations(document_bags(spark, folder, by_document=False), 5, 30)


@query("i10_cluster_collocations", f"WITH {Q.tok()}, {GIVEN_SQL}, {_collocations(3, 30, 'cluster')} SELECT * FROM col")
def cluster_collocations(spark, folder):
    return I.collocations(document_bags(spark, folder, by_document=False), 3, 30, given_labels(spark, folder))


def discriminating(k=30, weight="w", name="dis"):
    return f"""{name}_in AS (SELECT cluster, term, sum({weight})::DOUBLE AS s_in FROM idx JOIN lab USING (doc_id) GROUP BY ALL),
    {name}_all AS (SELECT term, sum(s_in) AS s_all FROM {name}_in GROUP BY term),
    {name}_size AS (SELECT cluster, count(*) AS size FROM lab GROUP BY cluster),
    {name} AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term)::INT AS rank, term, score FROM (
      SELECT cluster, term, round((s_in / greatest(size, 1)) / ((CASE WHEN s_all - s_in < 1e-9 THEN 0.0::DOUBLE ELSE s_all - s_in END)
        / greatest((SELECT sum(size) FROM {name}_size)::DOUBLE - size, 1) + 1e-10::DOUBLE), 4) AS score
      FROM {name}_in JOIN {name}_all USING (term) JOIN {name}_size USING (cluster)) QUALIFY rank <= {k})"""


GLOBAL = Q.index(5, 0.9)


@query("i11_discriminative_terms", f"WITH {GLOBAL}, {GIVEN_SQL}, {discriminating()} SELECT * FROM dis")
def discriminative_terms(spark, folder):
    return I.discriminative_terms(document_index(spark, folder, 5, 0.9)[0], given_labels(spark, folder), 30)


@query("i11_discriminative_counts", f"WITH {GLOBAL}, {GIVEN_SQL}, {discriminating(weight='tf')} SELECT * FROM dis")
def discriminative_counts(spark, folder):
    return I.discriminative_terms(document_index(spark, folder, 5, 0.9)[0], given_labels(spark, folder), 30, "tf")


@query("i12_cluster_labels", f"""WITH {GLOBAL}, {GIVEN_SQL}, {discriminating()}
SELECT cluster, 'Cluster ' || cluster || ': ' || string_agg(term, ', ' ORDER BY rank) AS label FROM dis WHERE rank <= 5 GROUP BY cluster""")
def cluster_labels(spark, folder):
    return I.cluster_labels(discriminative_terms(spark, folder), 5)
