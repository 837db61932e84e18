"""Queries for sources, sampling and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import CLASS_NAMES, OTHER_CLASS, VENUE_KEYWORDS
from ..operators import tokens as K
from ..sources import articles as S
from . import sql as Q
from .corpus import document_bags, documents
from .registry import query, table

ARTICLE_SQL = """art AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS abstract,
  source AS venue, lang FROM documents)"""


def titled(spark, folder):
    """Documents as articles: the first line is the title, the whole text the abstract."""
    return documents(spark, folder).select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("venue"), "lang",
    )


@query("s2_sample_exact", None)
def sample(spark, folder):
    return S.sample_exact(documents(spark, folder), 30, 42, "doc_id").select("doc_id", "lang")


@query("s2_sample_exact_size", "SELECT floor(count(*) * 30.0 / 100)::BIGINT AS n, count(*) AS total FROM documents")
def sample_size(spark, folder):
    docs = documents(spark, folder)
    drawn = S.sample_exact(docs, 30, 42, "doc_id").select("doc_id").distinct()
    return drawn.agg(F.count("*").alias("n")).withColumn("total", docs.agg(F.count("*")).scalar())


def _profile_sql(tbl, cols, by):
    parts = []
    for c in cols:
        t = f"{c}::VARCHAR"
        parts.append(f"""SELECT '{c}' AS "column", bool_and(TRY_CAST({t} AS DOUBLE) IS NOT NULL OR {c} IS NULL) AS is_number,
          bool_or(coalesce(contains({t}, '[') AND contains({t}, ']'), false)) AS is_list, count({c}) AS filled,
          arg_min({t}, {by}) AS first_example, arg_max({t}, {by}) AS last_example FROM {tbl}""")
    return " UNION ALL ".join(parts)


PROFILED = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("s4_profile_columns", _profile_sql("customer", PROFILED, "c_custkey"))
def profile(spark, folder):
    return S.profile_columns(table(spark, folder, "customer"), PROFILED, "c_custkey")


@query("s5_load_table", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders")
def load_table(spark, folder):
    rows = S.load_table(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])
    return rows.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("p1_to_articles", """
SELECT o_orderkey::VARCHAR AS id, '' AS title, '' AS abstract, any_value(year(o_orderdate))::INT AS year,
  any_value(o_orderpriority) AS venue, 0 AS n_citation, count(DISTINCT l_partkey)::INT AS author_count,
  count(DISTINCT l_suppkey)::INT AS references_count,
  coalesce(string_agg(DISTINCT l_partkey::VARCHAR, ', ' ORDER BY l_partkey::VARCHAR), '') AS author_names
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def to_articles(spark, folder):
    """Orders as articles: parts are the authors, suppliers the references."""
    return S.to_articles(order_articles(spark, folder)).drop("authors", "references")


def order_articles(spark, folder):
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("authors"),
        F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("references"),
    )
    return orders.join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("abstract"), F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("venue"), F.lit(None).cast("int").alias("n_citation"),
        "authors", "references",
    )


@query("p2_clean_articles", """
SELECT event_id, coalesce(trunc(TRY_CAST(value::VARCHAR AS DOUBLE))::INT, 0) AS year,
  coalesce(trunc(TRY_CAST(event_type AS DOUBLE))::INT, 0) AS n_citation, coalesce(props, '') AS props FROM events""")
def clean(spark, folder):
    """Number cells that hold numbers as text, and text that is no number."""
    raw = table(spark, folder, "events").select(
        F.col("event_id").alias(" Event_ID"), F.col("value").cast("string").alias("YEAR "),
        F.col("event_type").alias("n_citation"), F.col("props").alias("Props"),
    )
    return S.clean_articles(raw)


@query("p3_parse_list", """
WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(""" + Q.norm_a("text") + """, ' '), lambda x: x <> ''))) AS ws FROM documents)
SELECT doc_id, len(ws)::INT AS n, coalesce(array_to_string(ws, ' '), '') AS items FROM w""")
def parse_list(spark, folder):
    """Distinct words written as a quoted list cell and read back."""
    words = F.array_sort(F.array_distinct(T.word_array(T.normalise_a("text"))))
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    cells = documents(spark, folder).select("doc_id", F.concat(F.lit(" ["), quoted, F.lit("]")).alias("cell"))
    parsed = cells.select("doc_id", T.parse_list("cell").alias("items"))
    return parsed.select("doc_id", F.size("items").alias("n"), F.array_join("items", " ").alias("items"))


@query("p3_parse_cells", r"""WITH x AS (SELECT doc_id, lang, doc_id % 6 AS kind FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN doc_id || '|-1.5|None' WHEN 1 THEN 'it''s ' || lang || '|"x", [y]|\d' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' ELSE lang END AS items,
  (CASE kind WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 5 THEN 1 ELSE 0 END)::INT AS n FROM x""")
def parse_cells(spark, folder):
    """Bare items, escapes, an empty list, a nested one, an unclosed quote, and a comma after the last item."""
    kind, lang, number = F.col("doc_id") % 6, F.col("lang"), F.col("doc_id").cast("string")
    cell = (
        F.when(kind == 0, F.concat(F.lit("["), number, F.lit(" ,-1.5,None]")))
        .when(kind == 1, F.concat(F.lit(r"['it\'s "), lang, F.lit(r"""', "\"x\", [y]", '\d']""")))
        .when(kind == 2, F.lit(" [ ] "))
        .when(kind == 3, F.concat(F.lit("[["), number, F.lit("], 'a']")))
        .when(kind == 4, F.concat(F.lit("['"), lang, F.lit(", 'a]")))
        .otherwise(F.concat(F.lit('["'), lang, F.lit('",]'))))
    parsed = documents(spark, folder).select("doc_id", T.parse_list(cell).alias("items"))
    return parsed.select("doc_id", F.array_join("items", "|").alias("items"), F.size("items").alias("n"))


@query("p4_combined_text", f"WITH {ARTICLE_SQL} SELECT doc_id, md5(trim(title || ' ' || abstract)) AS digest FROM art")
def combined(spark, folder):
    return titled(spark, folder).select("doc_id", F.md5(T.combined_text("title", "abstract").cast("binary")).alias("digest"))


@query("p5_weighted_text", f"WITH {ARTICLE_SQL} SELECT doc_id, md5(trim(title || ' ' || title || ' ' || abstract)) AS digest FROM art")
def weighted(spark, folder):
    text = T.combined_text("title", "abstract", title_weight=2)
    return titled(spark, folder).select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@query("p6_normalise_a", f"SELECT doc_id, {Q.norm_a('text')} AS text FROM documents")
def normalise_a(spark, folder):
    return documents(spark, folder).select("doc_id", T.normalise_a("text").alias("text"))


@query("p7_normalise_b", f"""WITH {Q.tok(rule='b')}
SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS text
FROM documents d LEFT JOIN tok ON tok.doc_id = d.doc_id GROUP BY d.doc_id""")
def normalise_b(spark, folder):
    from ..functions.words import STOP_WORDS

    return documents(spark, folder).select("doc_id", T.normalise_b("text", STOP_WORDS, stem=False).alias("text"))


@query("p8_tokenise", f"WITH {Q.tok(stop='', min_len=2, rule='b')} SELECT doc_id, pos, term FROM tok")
def tokenise(spark, folder):
    return K.tokens(document_bags(spark, folder, stop=(), min_len=2, rule="b", by_document=False)).withColumn("pos", F.col("pos").cast("bigint"))


@query("p9_remove_stop", f"WITH {Q.tok(stop='')} SELECT term, count(*) AS n FROM tok WHERE term NOT IN ({Q.STOP}) GROUP BY term")
def remove_stop(spark, folder):
    kept = K.remove_stop(K.tokens(document_bags(spark, folder, stop=(), by_document=False)))
    return kept.groupBy("term").agg(F.count("*").alias("n"))


# Same rules as functions.text.light_stem, written for the check.
def _shape_sql(w):
    marked = f"regexp_replace({w}, '[aeiou]', 'V', 'g')"
    marked = f"regexp_replace({marked}, '(^|V)y', '\\1C', 'g')"
    return f"regexp_replace(regexp_replace({marked}, 'y', 'V', 'g'), '[^V]', 'C', 'g')"


STEM_SQL = f"""
forms AS (SELECT DISTINCT term AS form FROM tok),
s1 AS (SELECT form, CASE WHEN form LIKE '%sses' OR form LIKE '%ies' THEN left(form, length(form) - 2)
  WHEN form LIKE '%ss' THEN form WHEN form LIKE '%s' THEN left(form, length(form) - 1) ELSE form END AS w FROM forms),
s2 AS (SELECT form, w, CASE WHEN w LIKE '%ed' THEN left(w, greatest(length(w) - 2, 0)) ELSE left(w, greatest(length(w) - 3, 0)) END AS c FROM s1),
s3 AS (SELECT form, CASE
  WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches({_shape_sql("left(w, length(w) - 3)")}, '^C*V+C') THEN left(w, length(w) - 1) ELSE w END
  WHEN (w LIKE '%ed' OR w LIKE '%ing') AND contains({_shape_sql('c')}, 'V') THEN CASE
    WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e'
    WHEN regexp_matches(c, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$') THEN left(c, length(c) - 1)
    WHEN regexp_matches({_shape_sql('c')}, '^C+VC$') AND NOT regexp_matches(c, '[wxy]$') THEN c || 'e'
    ELSE c END
  ELSE w END AS w FROM s2),
stems AS (SELECT form, CASE WHEN w LIKE '%y' AND contains({_shape_sql("left(w, length(w) - 1)")}, 'V')
  THEN left(w, length(w) - 1) || 'i' ELSE w END AS stem FROM s3)"""


@query("p10_light_stems", f"WITH {Q.tok()}, {STEM_SQL} SELECT form, stem FROM stems")
def light_stems(spark, folder):
    return K.light_stems(K.tokens(document_bags(spark, folder, by_document=False)))


@query("p10_stem_tokens", f"""WITH {Q.tok()}, {STEM_SQL}
SELECT stem AS term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok JOIN stems ON form = term GROUP BY stem""")
def stem_tokens(spark, folder):
    stemmed = K.stem(K.tokens(document_bags(spark, folder, by_document=False)))
    return stemmed.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(
        F.sum("tf").alias("n"), F.count("*").alias("df"))


@query("p11_lemmatise", f"""WITH {Q.tok()},
lemmas AS (SELECT DISTINCT term AS form, left(term, length(term) - 2) AS lemma FROM tok WHERE term LIKE '%ing' AND length(term) > 5)
SELECT coalesce(lemma, term) AS term, count(*) AS n FROM tok LEFT JOIN lemmas ON form = term GROUP BY 1""")
def lemmatise(spark, folder):
    """The dictionary here is derived from the corpus; a real one is a supplied table."""
    words = K.tokens(document_bags(spark, folder, by_document=False))
    forms = words.where(F.col("term").endswith("ing") & (F.length("term") > 5)).select(F.col("term").alias("form")).distinct()
    lemmas = forms.withColumn("lemma", F.expr("left(form, length(form) - 2)"))
    return K.lemmatise(words, lemmas).groupBy("term").agg(F.count("*").alias("n"))


@query("p12_ngrams", f"""WITH {Q.tok()}, runs AS (
  SELECT doc_id, 1 AS n, term FROM tok UNION ALL
  SELECT doc_id, 2 AS n, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS term FROM tok)
SELECT n, term, count(*) AS freq, count(DISTINCT doc_id) AS df FROM runs WHERE term IS NOT NULL GROUP BY n, term""")
def ngrams(spark, folder):
    rows = K.ngrams(document_bags(spark, folder, by_document=False), 1, 2)
    return rows.groupBy("n", "doc_id", "term").agg(F.count("*").alias("tf")).groupBy("n", "term").agg(
        F.sum("tf").alias("freq"), F.count("*").alias("df"))


def _venue_sql(col):
    cases = []
    for class_id, words in VENUE_KEYWORDS.items():
        tests = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        cases.append(f"WHEN {tests} THEN {class_id}")
    return f"CASE {' '.join(cases)} ELSE {OTHER_CLASS} END"


@query("p13_venue_class", f"SELECT page_id, {_venue_sql('html')}::INT AS class FROM pages")
def venue_class(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.venue_class("html").alias("class"))


@query("p14_class_name", "SELECT p_partkey, CASE p_size " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in CLASS_NAMES.items()) + " ELSE 'Class ' || p_size::VARCHAR END AS class_name FROM part")
def class_name(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.class_name("p_size").alias("class_name"))


@query("p15_truncate", "SELECT doc_id, " + ", ".join(
    f"CASE WHEN length(text) > {n} THEN substring(text, 1, {n}) || '...' ELSE text END AS t{n}" for n in (150, 200, 300)
) + " FROM documents")
def truncate(spark, folder):
    return documents(spark, folder).select("doc_id", *[T.truncate("text", n).alias(f"t{n}") for n in (150, 200, 300)])


@query("p16_row_filters", "SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic = 0")
def row_filters(spark, folder):
    return table(spark, folder, "labels").where("quality = 1 AND toxic = 0").select("doc_id", "quality")
