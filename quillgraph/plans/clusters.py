"""Queries for vectors, topics, clusterings and what clusters are about."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import index as I
from ..operators import linkage as L
from ..operators import profile as P
from ..operators import quality as U
from ..operators import tokens as K
from ..operators import vectors as V
from ..session import cut, shared_folder
from ..sources import articles as S
from ..sources.report import cluster_report
from . import sql as Q
from .corpus import (
    CLASS_SQL, GIVEN_SQL, TOPICS_SQL, VEC_SQL, class_labels, document_bags, document_index, documents,
    given_labels, length_topics, vectors,
)
from .graphs import author_nodes, coauthor_network
from .indexes import GLOBAL, TF, _cluster_vocab, _collocations, discriminating
from .registry import query, table
from .text import ARTICLE_SQL, order_articles, titled


def label_of_vectors(spark, folder):
    return vectors(spark, folder).select("id", F.col("label").alias("cluster"))


# -- sources and sinks ----------------------------------------------------------


def new_table(spark):
    return f"{shared_folder(spark)}/tables/{uuid.uuid4()}"


@query("s1_read_articles", """SELECT o_orderkey::VARCHAR AS id, any_value(year(o_orderdate))::INT AS year, any_value(o_orderpriority) AS venue,
  count(DISTINCT l_partkey)::INT AS authors, count(DISTINCT l_suppkey)::INT AS "references"
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def read_articles(spark, folder):
    """Articles written as JSON lines, with a broken line added, and read back."""
    path = new_table(spark)
    S.save_table(order_articles(spark, folder), path, "json")
    spark.range(1).select(F.lit('{"id": "broken", "title": [').alias("value")).write.mode("append").text(path)
    size = lambda c: F.coalesce(F.array_size(F.col(c)), F.lit(0)).alias(c)
    return S.read_articles(spark, path).select("id", "year", "venue", size("authors"), size("references"))


@query("s3_read_delimited", """SELECT l_orderkey::VARCHAR AS id, l_partkey::VARCHAR AS part,
  CASE WHEN l_returnflag <> 'R' THEN l_linenumber::VARCHAR END AS line FROM lineitem WHERE l_returnflag <> 'A'""")
def read_delimited(spark, folder):
    """Lines with a field too many (flag A) are skipped, lines one short (flag R) end in null."""
    lines = table(spark, folder, "lineitem")
    cells = [F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")]
    text = F.when(F.col("l_returnflag") == "A", F.concat_ws("\t", *cells, F.lit("more"))).when(
        F.col("l_returnflag") == "R", F.concat_ws("\t", *cells[:2])).otherwise(F.concat_ws("\t", *cells))
    path = new_table(spark)
    lines.select(text.alias("value")).write.mode("overwrite").text(path)
    return S.read_delimited(spark, path, ["id", "part", "line"])


@query("s6_save_table", """SELECT o_orderkey::VARCHAR AS id, count(DISTINCT l_partkey) AS authors
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def save_table(spark, folder):
    """Written as tab-separated text, lists as JSON, and read back."""
    path = new_table(spark)
    S.save_table(order_articles(spark, folder).select("id", "authors"), path, "tsv")
    back = spark.read.option("header", True).option("sep", "\t").schema("id string, authors string").csv(path)
    items = F.from_json("authors", "array<string>")
    return back.select("id", F.coalesce(F.array_size(items), F.lit(0)).cast("bigint").alias("authors"))


# -- vectors and scaling --------------------------------------------------------


@query("v4_topic_distribution", f"""WITH {Q.tok()}, {TOPICS_SQL} SELECT topic, round(sum(p) / (SELECT count(DISTINCT doc_id) FROM tp), 6) AS share FROM tp GROUP BY topic""")
def topic_distribution(spark, folder):
    return V.topic_distribution(length_topics(spark, folder))


@query("v5_dominant_topic", f"WITH {Q.tok()}, {TOPICS_SQL} SELECT doc_id, arg_max(topic, (p, -topic)) AS topic FROM tp GROUP BY doc_id")
def dominant_topic(spark, folder):
    return V.dominant_topic(length_topics(spark, folder))


@query("v9_l2", f"""WITH {VEC_SQL}, u AS (SELECT id, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1)::INT - 1 AS i FROM vec)
SELECT id, i, round(x, 6) AS x FROM u""")
def l2(spark, folder):
    return V.l2(vectors(spark, folder)).select("id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


SCALED = ["c_acctbal", "c_nationkey"]


@query("v9_standardise", "SELECT c_custkey, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED) + " FROM customer")
def standardise(spark, folder):
    out = V.standardise(table(spark, folder, "customer").select("c_custkey", *SCALED), SCALED)
    return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in SCALED])


@query("v9_max_scale", "SELECT c_custkey, " + ", ".join(
    f"round({c} / (max({c}) OVER ())::DOUBLE, 6) AS {c}" for c in SCALED) + " FROM customer")
def max_scale(spark, folder):
    out = V.max_scale(table(spark, folder, "customer").select("c_custkey", *SCALED), SCALED)
    return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in SCALED])


@query("v1_doc_vectors")
def doc_vectors(spark, folder):
    return V.doc_vectors(cut(document_bags(spark, folder)), 100, 2, 42, 20)


@query("v2_lda_doc_topics")
def lda_doc_topics(spark, folder):
    return _lda(spark, folder)[0]


@query("v3_topic_terms")
def topic_terms(spark, folder):
    return _lda(spark, folder)[1]


def _lda(spark, folder):
    bags = document_bags(spark, folder)
    counts = cut(I.term_counts(bags))
    vocab = cut(I.vocabulary(counts, I.corpus_size(bags), 5, 0.95))
    return V.lda(I.tf_index(counts, vocab), vocab, 20, 20)


@query("v6_sampled_topics")
def sampled_topics(spark, folder):
    chosen = S.sample_exact(documents(spark, folder).select("doc_id"), 20, 42, "doc_id")
    return length_topics(spark, folder).join(chosen.select("doc_id"), "doc_id", "left_semi")


@query("v7_pca")
def pca(spark, folder):
    return V.pca(vectors(spark, folder), 2)[0]


@query("v8_truncated_svd")
def truncated_svd(spark, folder):
    return V.truncated_svd(document_index(spark, folder)[0], 200)[0]


@query("v8_adjacency_svd")
def adjacency_svd(spark, folder):
    return V.adjacency_svd(coauthor_network(spark, folder), 100)[0]


@query("q7_encode")
def encode(spark, folder):
    return V.encode(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), V.hashed_encoder(64))


# -- clustering -----------------------------------------------------------------


@query("c1_kmeans")
def kmeans(spark, folder):
    return C.kmeans(vectors(spark, folder), 8)


def index_rows(spark, folder):
    """``(id, features)``: the sparse rows of the term index."""
    index, vocab, _ = document_index(spark, folder)
    return V.sparse_rows(index, cut(V.term_numbers(vocab))).withColumnRenamed("doc_id", "id")


def topic_rows(spark, folder):
    """``(id, vec)``: the given document-topic matrix, a row per document."""
    pairs = length_topics(spark, folder).groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("m"))
    return cut(pairs.select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("vec")))


@query("c1_kmeans_index")
def kmeans_index(spark, folder):
    """Clusters of the sparse rows of the whole term index."""
    return C.kmeans(index_rows(spark, folder), 8, n_init=3)


@query("c1_kmeans_topics")
def kmeans_topics(spark, folder):
    return C.kmeans(topic_rows(spark, folder), 8)


@query("c2_hierarchical")
def hierarchical(spark, folder):
    return C.hierarchical(vectors(spark, folder), 8)


@query("c2_linkage")
def linkage(spark, folder):
    return L.linkage(vectors(spark, folder), 8)


@query("c2_merges")
def linkage_merges(spark, folder):
    """The dendrogram of the vectors by single linkage."""
    return L.merges(L.spanning_forest(vectors(spark, folder)))


EPS, MIN_SAMPLES = 0.65, 3


@query("c3_dbscan", f"""WITH RECURSIVE {VEC_SQL},
pair AS (SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON 1.0 - list_cosine_similarity(a.v, b.v) <= {EPS}),
core AS (SELECT a AS id FROM pair GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
link AS (SELECT a, b FROM pair WHERE a IN (FROM core) AND b IN (FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
grp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
border AS (SELECT a AS id, min(cluster) AS cluster FROM pair JOIN grp ON grp.id = pair.b WHERE a NOT IN (FROM core) GROUP BY a)
SELECT id, coalesce(grp.cluster, border.cluster, -1)::BIGINT AS cluster FROM vec LEFT JOIN grp USING (id) LEFT JOIN border USING (id)""")
def dbscan(spark, folder):
    return C.dbscan(vectors(spark, folder), EPS, MIN_SAMPLES)


@query("c4_gmm")
def gmm(spark, folder):
    reduced, _ = V.pca(vectors(spark, folder), 8)
    return C.gmm(reduced, 4)


@query("c5_silhouette", f"""WITH {VEC_SQL}, far AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n
  FROM vec a CROSS JOIN vec b GROUP BY ALL),
x AS (SELECT id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS i, max(CASE WHEN own = other THEN n END) AS n_own,
  min(CASE WHEN own <> other THEN s / n END) AS o FROM far GROUP BY id)
SELECT round(avg(CASE WHEN n_own > 1 THEN (o - i) / greatest(o, i) ELSE 0 END), 6) AS silhouette FROM x""")
def silhouette(spark, folder):
    out = U.silhouette(vectors(spark, folder), label_of_vectors(spark, folder))
    return out.withColumn("silhouette", F.round("silhouette", 6))


INDICES = f"""{VEC_SQL}, parts AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY ALL),
cen AS (SELECT label, list(x ORDER BY i) AS c, any_value(n) AS n FROM parts GROUP BY label),
mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, sum(x * n) / sum(n) AS m FROM parts GROUP BY i)),
spread AS (SELECT label, avg(list_distance(v, c)) AS s, sum(list_distance(v, c) ** 2) AS ss FROM vec JOIN cen USING (label) GROUP BY label),
ratio AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM cen a JOIN cen b ON a.label <> b.label
  JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = b.label GROUP BY a.label),
ind AS (SELECT count(*) AS clusters, (SELECT avg(r) FROM ratio) AS db,
  (sum(n * list_distance(c, m) ** 2) / (count(*) - 1)) / ((SELECT sum(ss) FROM spread) / (sum(n) - count(*))) AS ch FROM cen CROSS JOIN mean)"""


@query("c6_cluster_indices", f"WITH {INDICES} SELECT clusters, round(db, 6) AS davies_bouldin, round(ch, 6) AS calinski_harabasz FROM ind")
def cluster_indices(spark, folder):
    out = U.cluster_indices(vectors(spark, folder), label_of_vectors(spark, folder))
    return out.select("clusters", *[F.round(c, 6).alias(c) for c in ("davies_bouldin", "calinski_harabasz")])


@query("c7_compare_runs")
def compare_runs(spark, folder):
    rows = vectors(spark, folder)
    runs = {"given": label_of_vectors(spark, folder), "kmeans": cut(C.kmeans(rows, 8)),
            "hierarchical": cut(C.hierarchical(rows, 8))}
    return U.compare_runs(rows, runs)


@query("c8_attach", "SELECT doc_id, lang, coalesce(quality, -1) AS quality_cluster FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)")
def attach(spark, folder):
    known = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("cluster"))
    return U.attach(documents(spark, folder).select("doc_id", "lang"), known, "quality_cluster")


@query("c9_cluster_top_terms", f"""WITH {Q.index()}, {GIVEN_SQL}, s AS (SELECT cluster, term, round(sum(w), 6) AS weight FROM idx JOIN lab USING (doc_id) GROUP BY ALL)
SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::INT AS rank, term, weight FROM s QUALIFY rank <= 10""")
def cluster_top_terms(spark, folder):
    return U.cluster_top_terms(document_index(spark, folder)[0], given_labels(spark, folder), 10)


CLUSTER_TOPIC = f"""{Q.tok()}, {TOPICS_SQL}, {GIVEN_SQL},
ct AS (SELECT cluster, topic, round(sum(p) / any_value(size), 6) AS share FROM tp JOIN lab USING (doc_id)
  JOIN (SELECT cluster, count(*) AS size FROM lab GROUP BY cluster) USING (cluster) GROUP BY cluster, topic),
best AS (SELECT cluster, arg_max(topic, (share, -topic)) AS topic FROM ct GROUP BY cluster)"""


@query("c10_cluster_topic_terms", f"""WITH {CLUSTER_TOPIC}, words AS (SELECT least(length(term), 8)::INT AS topic, term, count(*) AS n FROM tok GROUP BY ALL),
tt AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term)::INT AS rank FROM words)
SELECT cluster, topic, rank, term FROM best JOIN tt USING (topic) WHERE rank <= 5""")
def cluster_topic_terms(spark, folder):
    words = K.words(document_bags(spark, folder)).groupBy(
        F.least(F.length("term"), F.lit(8)).alias("topic"), "term").agg(F.count("*").alias("n"))
    ranked = I.top_k(words, ["topic"], [F.desc("n"), F.asc("term")], 5)
    return U.cluster_topic_terms(length_topics(spark, folder), ranked, given_labels(spark, folder), 5)


@query("c11_nearest_to_centroid", f"""WITH {INDICES}, s AS (SELECT label AS cluster, id, round(list_cosine_similarity(v, c), 6) AS similarity FROM vec JOIN cen USING (label))
SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, id)::INT AS rank, id, similarity FROM s QUALIFY rank <= 5""")
def nearest_to_centroid(spark, folder):
    return U.nearest_to_centroid(vectors(spark, folder), label_of_vectors(spark, folder), 5)


def _central(index="idx"):
    return f"""sums AS (SELECT cluster, term, sum(w) AS s FROM {index} JOIN lab USING (doc_id) GROUP BY ALL),
    lens AS (SELECT cluster, sqrt(sum(s * s)) AS l FROM sums GROUP BY cluster),
    sim AS (SELECT cluster, doc_id, round(sum(w * s / l), 6) AS similarity FROM {index} JOIN lab USING (doc_id) JOIN sums USING (cluster, term) JOIN lens USING (cluster) GROUP BY ALL),
    central AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, doc_id)::INT AS rank, doc_id, similarity FROM sim QUALIFY rank <= 5)"""


@query("c12_central_documents", f"WITH {Q.index()}, {GIVEN_SQL}, {_central()} SELECT * FROM central")
def central_documents(spark, folder):
    return U.central_documents(document_index(spark, folder)[0], given_labels(spark, folder), 5)


REFIT = """refit_raw AS (SELECT doc_id, term, tf, tf * (ln((1.0 + size)::DOUBLE / (1.0 + df)::DOUBLE) + 1.0::DOUBLE) AS raw FROM tf JOIN lab USING (doc_id) JOIN cv USING (cluster, term)),
refit AS (SELECT doc_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM refit_raw)"""


@query("c13_refitted_central_documents", f"WITH {TF}, {GIVEN_SQL}, {_cluster_vocab(5, 0.9)}, {REFIT}, {_central('refit')} SELECT * FROM central")
def refitted_central_documents(spark, folder):
    labels = given_labels(spark, folder)
    counts = I.term_counts(document_bags(spark, folder))
    return U.central_documents(U.refitted_index(counts, labels, 5, 0.9), labels, 5)


@query("c14_topic_central_documents", f"""WITH {CLUSTER_TOPIC}, x AS (SELECT cluster, doc_id, topic, round(p, 6) AS p FROM tp JOIN lab USING (doc_id) JOIN best USING (cluster, topic))
SELECT cluster, doc_id, topic, p, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, doc_id)::INT AS rank FROM x QUALIFY rank <= 5""")
def topic_central_documents(spark, folder):
    return U.topic_central_documents(length_topics(spark, folder), given_labels(spark, folder), 5)


@query("c15_svd_kmeans")
def svd_kmeans(spark, folder):
    return C.svd_kmeans(document_index(spark, folder)[0], 200, 8)


@query("c15_structure_clusters")
def structure_clusters(spark, folder):
    return C.structure_clusters(cut(author_nodes(spark, folder)), cut(coauthor_network(spark, folder)), 100, 8)


@query("c16_spectral")
def spectral(spark, folder):
    return C.spectral(cut(author_nodes(spark, folder)), cut(coauthor_network(spark, folder)), 8)


def _agreement_sql(a, b):
    """Two label columns of ``both_labels``."""
    return f"""cell AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM both_labels WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
    ra AS (SELECT sum(s * (s - 1) / 2) AS p, sum(s * ln(s)) AS h FROM (SELECT sum(n) AS s FROM cell GROUP BY a)),
    cb AS (SELECT sum(s * (s - 1) / 2) AS p, sum(s * ln(s)) AS h FROM (SELECT sum(n) AS s FROM cell GROUP BY b)),
    al AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS h FROM cell),
    m AS (SELECT al.p, ra.p * cb.p / (al.n * (al.n - 1) / 2) AS e, (ra.p + cb.p) / 2 AS t,
      ln(al.n) - ra.h / al.n AS ha, ln(al.n) - cb.h / al.n AS hb, ln(al.n) - al.h / al.n AS hab FROM al, ra, cb),
    agree AS (SELECT round((p - e) / (t - e), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi FROM m)"""


BOTH = "both_labels AS (SELECT doc_id, source, lang, quality FROM documents LEFT JOIN labels USING (doc_id))"


@query("c17_compare_labels", " UNION ALL ".join(
    f"(WITH {BOTH}, {_agreement_sql(x, y)} SELECT '{x}' AS a, '{y}' AS b, ari, nmi FROM agree)"
    for x in ("source", "lang", "quality") for y in ("source", "lang", "quality") if x != y))
def compare_labels(spark, folder):
    docs = documents(spark, folder)
    named = {
        "source": docs.select("doc_id", F.col("source").alias("cluster")), "lang": class_labels(spark, folder),
        "quality": table(spark, folder, "labels").select("doc_id", F.col("quality").alias("cluster")),
    }
    return U.agreement_table(named)


@query("c18_adjusted_rand", f"WITH {BOTH}, {_agreement_sql('source', 'lang')} SELECT ari FROM agree")
def adjusted_rand(spark, folder):
    return U.evaluate_labels(given_labels(spark, folder), class_labels(spark, folder)).select("ari")


EXPECTED = """ms AS (SELECT sum(n) AS s FROM cell GROUP BY a), mt AS (SELECT sum(n) AS t FROM cell GROUP BY b),
met AS (SELECT s, t, al.n AS n, unnest(range(greatest(1, s + t - al.n)::BIGINT, least(s, t)::BIGINT + 1))::DOUBLE AS k FROM ms CROSS JOIN mt CROSS JOIN al),
emi AS (SELECT sum(k / n * ln(n * k / (s * t)) * exp(lgamma(s + 1) + lgamma(t + 1) + lgamma(n - s + 1) + lgamma(n - t + 1) - lgamma(n + 1)
  - lgamma(k + 1) - lgamma(s - k + 1) - lgamma(t - k + 1) - lgamma(n - s - t + k + 1))) AS emi FROM met)"""


@query("c18_evaluate_labels", f"""WITH {BOTH}, {_agreement_sql('source', 'lang')}, {EXPECTED}
SELECT agree.ari, round((ha + hb - hab - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM agree, m, emi""")
def evaluate_labels(spark, folder):
    return U.evaluate_labels(given_labels(spark, folder), class_labels(spark, folder))


@query("c19_run_clusterings")
def run_clusterings(spark, folder):
    rows = cut(vectors(spark, folder).select("id", "vec"))
    reduced = cut(V.pca(rows, 8)[0])
    runs = C.run_clusterings({"embedding": rows, "reduced": reduced}, 8, 42, 10, EPS, MIN_SAMPLES, dense=["reduced"])
    return U.compare_runs(rows, {name: cut(labels) for name, labels in runs.items()})


@query("c19_document_clusterings")
def document_clusterings(spark, folder):
    """The term index and the topics by each algorithm, judged on the topics."""
    topics = topic_rows(spark, folder)
    runs = C.run_clusterings({"index": index_rows(spark, folder), "topics": topics}, 8, 42, 3, 0.01, MIN_SAMPLES, dense=["topics"])
    return U.compare_runs(topics, {name: cut(labels) for name, labels in runs.items()})


# -- reports --------------------------------------------------------------------


def _report_sql():
    line = "string_agg({x}, chr(10) ORDER BY rank)"
    return f"""WITH {GLOBAL}, {GIVEN_SQL}, {discriminating(10)}, {_cluster_vocab(2, 0.95)},
    freq AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY cf DESC, term) AS rank, term, cf AS n FROM cv QUALIFY rank <= 10),
    {_collocations(3, 5, 'cluster')}, {_central()}, {ARTICLE_SQL},
    a AS (SELECT cluster, {line.format(x="'- ' || term || ': ' || n")} AS a FROM freq GROUP BY cluster),
    b AS (SELECT cluster, {line.format(x="printf('- %s: %.4f', term, round(score, 4))")} AS b FROM dis GROUP BY cluster),
    c AS (SELECT cluster, {line.format(x="printf('- ''%s %s'': %.4f', first, second, round(pmi, 4))")} AS c FROM col GROUP BY cluster),
    d AS (SELECT cluster, {line.format(x="printf('### Document %d (similarity %.4f)', rank, round(similarity, 4)) || chr(10) || '- Title: ' || title || chr(10) || '- Abstract: ' || CASE WHEN length(abstract) > 300 THEN substring(abstract, 1, 300) || '...' ELSE abstract END")} AS d
      FROM central JOIN art USING (doc_id) WHERE rank <= 3 GROUP BY cluster),
    s AS (SELECT cluster, count(*) AS size FROM lab GROUP BY cluster)
    SELECT cluster, '# Cluster ' || cluster || chr(10) || chr(10) || '- Documents: ' || size
      || chr(10) || chr(10) || '## Frequent terms' || chr(10) || coalesce(a, '') || chr(10) || chr(10) || '## Discriminating terms' || chr(10) || coalesce(b, '')
      || chr(10) || chr(10) || '## Collocations' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || '## Central documents' || chr(10) || coalesce(d, '') AS report
    FROM s LEFT JOIN a USING (cluster) LEFT JOIN b USING (cluster) LEFT JOIN c USING (cluster) LEFT JOIN d USING (cluster)"""


@query("s8_cluster_report", _report_sql())
def report(spark, folder):
    labels = given_labels(spark, folder)
    bags = document_bags(spark, folder)
    counts = I.term_counts(bags)
    index, _, _ = document_index(spark, folder, 5, 0.9, stored=True)
    return cluster_report(
        P.cluster_sizes(labels), I.cluster_terms(counts, labels, 2, 0.95, 10),
        I.discriminative_terms(index, labels, 10), I.collocations(bags, 3, 5, labels),
        U.central_documents(index, labels, 5), titled(spark, folder))


@query("s7_save_cluster_analysis", f"""WITH {Q.index()}, {GIVEN_SQL}, {_central()},
s AS (SELECT cluster, term, round(sum(w), 6) AS weight FROM idx JOIN lab USING (doc_id) GROUP BY ALL),
t AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank, term FROM s QUALIFY rank <= 10)
SELECT 'labels' AS part, cluster, count(*) AS n FROM lab GROUP BY cluster UNION ALL SELECT 'top_terms', cluster, count(*) FROM t GROUP BY cluster
UNION ALL SELECT 'central_documents', cluster, count(*) FROM central GROUP BY cluster""")
def save_cluster_analysis(spark, folder):
    path = new_table(spark)
    labels, (index, _, _) = given_labels(spark, folder), document_index(spark, folder, stored=True)
    S.save_cluster_analysis(path, labels, U.cluster_top_terms(index, labels, 10), U.central_documents(index, labels, 5))
    out = None
    for part in ("labels", "top_terms", "central_documents"):
        rows = spark.read.option("header", True).csv(f"{path}/{part}").groupBy(F.col("cluster").cast("int").alias("cluster")).agg(
            F.count("*").alias("n")).withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return out
