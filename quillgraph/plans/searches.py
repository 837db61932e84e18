"""Queries for ranked search.

The benchmark texts are the queries of the lexical searches; the mean vector of
each label is a query of the dense ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import search as R
from ..operators import tokens as K
from ..operators.vectors import dominant_topic
from ..session import cut
from . import sql as Q
from .corpus import (
    CENTROID_SQL, GIVEN_SQL, NODE_SQL, TOPICS_SQL, VEC_SQL, document_bags, document_index, documents,
    document_counts, given_labels, label_queries, length_topics, node_vectors, query_bags, vectors,
)
from .registry import query, table
from .text import ARTICLE_SQL, titled

BASE = f"{Q.index()},\n{Q.query_weights()}"
SCORES = """s AS (SELECT q.doc_id AS query_id, idx.doc_id, round(sum(q.w * idx.w), 6) AS score
  FROM idx JOIN q USING (term) GROUP BY ALL)"""


def ranked_sql(source, k, name):
    return f"""{name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank,
      doc_id, score FROM {source} QUALIFY rank <= {k})"""


def query_table(spark, folder, vocab, n, use_idf=True, **options):
    counts = I.term_counts(query_bags(spark, folder, **options))
    return R.query_vectors(counts, vocab, n, use_idf)


def asked(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))


@query("q1_search_cosine", f"WITH {BASE}, {SCORES}, {ranked_sql('s', 10, 'r')} SELECT * FROM r")
def search_cosine(spark, folder):
    index, vocab, n = document_index(spark, folder, stored=True)
    return R.search(index, query_table(spark, folder, vocab, n), 10)


@query("q1_search_with_articles", f"""WITH {BASE}, {SCORES}, {ranked_sql('s', 10, 'r')}
SELECT r.*, lang, source FROM r JOIN documents USING (doc_id)""")
def search_with_articles(spark, folder):
    return R.with_articles(search_cosine(spark, folder), documents(spark, folder), ["lang", "source"])


ALL_SCORES = """s AS (SELECT b.item_id AS query_id, d.doc_id, round(coalesce(sum(q.w * idx.w), 0), 6) AS score
  FROM (SELECT item_id FROM benchmark) b CROSS JOIN documents d
  LEFT JOIN idx ON idx.doc_id = d.doc_id LEFT JOIN q ON q.term = idx.term AND q.doc_id = b.item_id GROUP BY ALL)"""


@query("q1_search_filled", f"WITH {BASE}, {ALL_SCORES}, {ranked_sql('s', 10, 'r')} SELECT * FROM r")
def search_filled(spark, folder):
    index, vocab, n = document_index(spark, folder, stored=True)
    return R.search(index, query_table(spark, folder, vocab, n), 10, documents=documents(spark, folder), asked=asked(spark, folder))


EUCLIDEAN = """len2 AS (SELECT doc_id, sum(w * w) AS n2 FROM idx GROUP BY doc_id),
dots AS (SELECT q.doc_id AS query_id, idx.doc_id, sum(q.w * idx.w) AS dot FROM idx JOIN q USING (term) GROUP BY ALL),
s AS (SELECT b.query_id, d.doc_id,
  round(1.0::DOUBLE / (1.0 + sqrt(greatest(0.0, b.own + round(coalesce(n2, 0), 9) - 2.0 * coalesce(dot, 0)))), 6) AS score
  FROM (SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT doc_id FROM q) THEN 1.0 ELSE 0.0 END AS own FROM benchmark) b CROSS JOIN documents d
  LEFT JOIN len2 ON len2.doc_id = d.doc_id LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.query_id = b.query_id)"""


@query("q2_search_euclidean", f"WITH {BASE}, {EUCLIDEAN}, {ranked_sql('s', 10, 'r')} SELECT * FROM r")
def search_euclidean(spark, folder):
    index, vocab, n = document_index(spark, folder, stored=True)
    queries = query_table(spark, folder, vocab, n)
    return R.search(index, queries, 10, "euclidean", documents(spark, folder), asked(spark, folder))


@query("q3_explain", f"""WITH {BASE}, {SCORES}, {ranked_sql('s', 3, 'r')},
p AS (SELECT r.query_id, r.doc_id, q.term, round(q.w, 6) AS query_weight, round(idx.w, 6) AS document_weight, round(q.w * idx.w, 6) AS contribution
  FROM r JOIN idx USING (doc_id) JOIN q ON q.doc_id = r.query_id AND q.term = idx.term WHERE q.w * idx.w > 0)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY contribution DESC, term)::INT AS rank,
  term, query_weight, document_weight, contribution FROM p QUALIFY rank <= 10""")
def explain(spark, folder):
    index, vocab, n = document_index(spark, folder, stored=True)
    queries = query_table(spark, folder, vocab, n)
    return R.explain(index, queries, R.search(index, queries, 3), 10)


# Compared settings: name, index options, idf used, stop words removed, metric.
CONFIGS = {
    "tfidf": ({}, True, True, "cosine"),
    "tf": ({}, False, True, "cosine"),
    "terms_500": ({"max_features": 500}, True, True, "cosine"),
    "terms_5000": ({"max_features": 5000}, True, True, "cosine"),
    "with_stop_words": ({}, True, False, "cosine"),
    "euclidean": ({}, True, True, "euclidean"),
}


def _config_sql(name, k):
    options, use_idf, stop, metric = CONFIGS[name]
    words = Q.STOP if stop else ""
    base = f"{Q.index(use_idf=use_idf, stop=words, **options)}, {Q.query_weights(use_idf, stop=words)}"
    scores = SCORES if metric == "cosine" else EUCLIDEAN
    return f"(WITH {base}, {scores}, {ranked_sql('s', k, 'r')} SELECT *, '{name}' AS config FROM r)"


def _configs(spark, folder, names=None, k=0):
    """``(name, vocabulary, query vectors, results)`` of every compared setting; texts are counted once a stop list."""
    counts = {}
    for name in names or CONFIGS:
        options, use_idf, stop, metric = CONFIGS[name]
        extra = {} if stop else {"stop": ()}
        if stop not in counts:
            counts[stop] = (*document_counts(spark, folder, **extra), cut(I.term_counts(query_bags(spark, folder, by_document=False, **extra))))
        known, n, of_queries = counts[stop]
        index, vocab, _ = I.index_of(known, n, 5, 0.95, use_idf=use_idf, stored=bool(k), **options)
        queries = R.query_vectors(of_queries, vocab, n, use_idf)
        everything = (documents(spark, folder), asked(spark, folder)) if metric == "euclidean" else ()
        yield name, vocab, queries, R.search(index, queries, k, metric, *everything) if k else None


@query("q4_compare_search", " UNION ALL ".join(_config_sql(name, 5) for name in CONFIGS))
def compare_search(spark, folder):
    return R.tagged({name: found for name, _, _, found in _configs(spark, folder, k=5)}, "config")


IMPORTANCE = list(CONFIGS)


def _importance_sql(name):
    options, use_idf, stop, _ = CONFIGS[name]
    words = Q.STOP if stop else ""
    return f"""(WITH {Q.index(use_idf=use_idf, stop=words, **options)}, {Q.query_weights(use_idf, stop=words)}, {Q.tok("asked", "benchmark", "item_id")},
    words AS (SELECT DISTINCT doc_id AS query_id, term AS word FROM asked),
    hits AS (SELECT DISTINCT query_id, term FROM vocab JOIN words ON contains(term, word)),
    x AS (SELECT h.query_id, h.term, round(coalesce(q.w, 0), 6) AS weight FROM hits h LEFT JOIN q ON q.doc_id = h.query_id AND q.term = h.term)
    SELECT query_id, term, weight, '{name}' AS config FROM x
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) <= 20)"""


@query("q5_query_term_importance", "WITH long AS (" + " UNION ALL ".join(_importance_sql(n) for n in IMPORTANCE) + ") SELECT query_id, term, "
       + ", ".join(f"coalesce(max(weight) FILTER (config = '{n}'), 0) AS {n}" for n in IMPORTANCE)
       + " FROM long GROUP BY query_id, term")
def query_term_importance(spark, folder):
    words = K.tokens(query_bags(spark, folder)).select(F.col("doc_id").alias("query_id"), F.col("term").alias("word"))
    words = cut(words)
    by_config = {name: R.query_term_importance(vocab, words, queries, 20) for name, vocab, queries, _ in _configs(spark, folder)}
    return R.importance_table(by_config)


TITLED = ARTICLE_SQL + ", wt AS (SELECT doc_id, trim(title || ' ' || title || ' ' || abstract) AS text FROM art)"
PROJECT = f"""{TITLED}, {Q.tok(source='wt', rule='b', min_len=2)}, {Q.counts()}, {Q.vocab(min_df=2, max_df=0.9)}, {Q.tfidf()},
{Q.query_weights(rule='b', min_len=2)}"""


def _project_search(spark, folder, k):
    articles = titled(spark, folder).select("doc_id", T.combined_text("title", "abstract", 2).alias("text"))
    bags = K.bags(articles, rule="b", min_len=2, by_document=False)
    index, vocab, n = I.build_index(bags, 2, 0.9, stored=True)
    return R.search(index, query_table(spark, folder, vocab, n, rule="b", min_len=2), k)


@query("q6_title_weighted_search", f"WITH {PROJECT}, {SCORES}, {ranked_sql('s', 10, 'r')} SELECT * FROM r")
def title_weighted_search(spark, folder):
    return _project_search(spark, folder, 10)


DENSE = f"""{VEC_SQL}, {CENTROID_SQL},
sim AS (SELECT cen.id AS query_id, vec.id AS doc_id, round(list_cosine_similarity(cen.v, vec.v), 6) AS score FROM cen CROSS JOIN vec)"""


@query("q8_vector_search", f"WITH {DENSE}, {ranked_sql('sim', 10, 'r')} SELECT * FROM r")
def vector_search(spark, folder):
    return R.vector_search(vectors(spark, folder), label_queries(spark, folder), 10)


HYBRID = f"""{DENSE}, {NODE_SQL}, {ranked_sql('sim', 30, 'cand')},
linked AS (SELECT cand.*, node.v FROM cand JOIN node ON node.id = cand.doc_id),
near AS (SELECT a.query_id, a.doc_id, avg(list_cosine_similarity(a.v, b.v)) AS near FROM linked a JOIN linked b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id GROUP BY ALL),
mix AS (SELECT c.query_id, c.doc_id, round(c.score * 0.7::DOUBLE + coalesce(near, 0) * 0.3::DOUBLE, 6) AS score FROM sim c LEFT JOIN near USING (query_id, doc_id))"""


@query("q9_hybrid_search", f"WITH {HYBRID}, {ranked_sql('mix', 10, 'r')} SELECT * FROM r")
def hybrid_search(spark, folder):
    return R.hybrid_search(vectors(spark, folder), node_vectors(spark, folder), label_queries(spark, folder), 10)


@query("q10_search_all", f"""WITH {HYBRID}, {ranked_sql('sim', 10, 'a')}, {ranked_sql('mix', 10, 'b')}
SELECT *, 'dense' AS method FROM a UNION ALL SELECT *, 'hybrid' FROM b""")
def search_all(spark, folder):
    return R.tagged({"dense": vector_search(spark, folder), "hybrid": hybrid_search(spark, folder)})


METHODS = list(CONFIGS)
METHOD_RESULTS = "res AS (" + " UNION ALL ".join(_config_sql(name, 10) for name in METHODS) + f"""),
{ARTICLE_SQL}, named AS (SELECT query_id, config AS method, title, score FROM res JOIN art USING (doc_id))"""


def _method_results(spark, folder):
    results = {name: cut(found) for name, _, _, found in _configs(spark, folder, METHODS, 10)}
    return R.with_articles(R.tagged(results), titled(spark, folder), ["title"])


@query("q11_score_matrix", f"""WITH {METHOD_RESULTS},
scaled AS (SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS share FROM named WINDOW w AS (PARTITION BY query_id, method)),
chosen AS (SELECT query_id, title, count(DISTINCT method) AS methods FROM named GROUP BY query_id, title
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY methods DESC, title) <= 15)
SELECT query_id, title, methods, """ + ", ".join(
    f"coalesce(round(max(share) FILTER (method = '{m}'), 6), 0) AS {m}" for m in METHODS)
    + " FROM scaled JOIN chosen USING (query_id, title) GROUP BY ALL")
def score_matrix(spark, folder):
    return R.score_matrix(_method_results(spark, folder), 15, METHODS)


@query("q12_method_agreement", f"""WITH {METHOD_RESULTS}, t AS (SELECT DISTINCT query_id, method, title FROM named),
n AS (SELECT query_id, method, count(*) AS n FROM t GROUP BY ALL),
common AS (SELECT a.query_id, a.method AS method_a, b.method AS method_b, count(*) AS c FROM t a JOIN t b USING (query_id, title) GROUP BY ALL)
SELECT a.query_id, a.method AS method_a, b.method AS method_b,
  round(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0))::DOUBLE, 6) AS jaccard
FROM n a JOIN n b ON a.query_id = b.query_id AND a.method < b.method
LEFT JOIN common ON common.query_id = a.query_id AND method_a = a.method AND method_b = b.method""")
def method_agreement(spark, folder):
    return R.method_agreement(_method_results(spark, folder))


TERM = "tion"  # a word of the corpus
INDEXED = f"{Q.index()}"


@query("q13_term_lookup", f"""WITH {INDEXED}, {GIVEN_SQL}, {TOPICS_SQL},
dom AS (SELECT doc_id, arg_max(topic, (p, -topic)) AS topic FROM tp GROUP BY doc_id),
hit AS (SELECT doc_id, round(w, 6) AS weight FROM idx WHERE term = '{TERM}' AND w > 0.01)
SELECT doc_id, weight, row_number() OVER (ORDER BY weight DESC, doc_id)::INT AS rank, cluster, topic
FROM hit LEFT JOIN lab USING (doc_id) LEFT JOIN dom USING (doc_id) ORDER BY rank LIMIT 20""")
def term_lookup(spark, folder):
    index, _, _ = document_index(spark, folder)
    topics = dominant_topic(length_topics(spark, folder))
    return R.term_lookup(index, TERM, 0.01, 20, given_labels(spark, folder), topics)


@query("q14_cooccurring_terms", f"""WITH {INDEXED}, t AS (SELECT term, round(sum(w), 6) AS weight FROM idx
WHERE term <> '{TERM}' AND doc_id IN (SELECT doc_id FROM idx WHERE term = '{TERM}' AND w > 0) GROUP BY term)
SELECT *, row_number() OVER (ORDER BY weight DESC, term)::INT AS rank FROM t ORDER BY rank LIMIT 20""")
def cooccurring_terms(spark, folder):
    return R.cooccurring_terms(document_index(spark, folder, stored=True)[0], TERM, 20)


@query("q15_term_by_cluster", f"""WITH {INDEXED}, {GIVEN_SQL}, hit AS (SELECT doc_id, w FROM idx WHERE term = '{TERM}')
SELECT cluster, round(avg(coalesce(w, 0)), 6) AS mean_weight, count(*) FILTER (w > 0) AS documents FROM lab LEFT JOIN hit USING (doc_id) GROUP BY cluster""")
def term_by_cluster(spark, folder):
    return R.term_by_cluster(document_index(spark, folder)[0], given_labels(spark, folder), TERM)


@query("q16_term_by_topic", f"""WITH {INDEXED}, {TOPICS_SQL}, hit AS (SELECT doc_id, w FROM idx WHERE term = '{TERM}')
SELECT topic, round(CASE WHEN sum(p) > 0 THEN sum(coalesce(w, 0) * p) / sum(p) ELSE 0 END, 6) AS weight FROM tp LEFT JOIN hit USING (doc_id) GROUP BY topic""")
def term_by_topic(spark, folder):
    return R.term_by_topic(document_index(spark, folder)[0], length_topics(spark, folder), TERM)
