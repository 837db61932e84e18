import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import index as I
from quillgraph.operators import search as R
from quillgraph.operators import tokens as K
from quillgraph.operators.scale import exact_percentiles, lowest_hashes
from quillgraph.sources import articles as S


def bags(spark, **docs):
    rows = [(i, words.split()) for i, words in enumerate(docs.values())]
    return spark.createDataFrame(rows, "doc_id bigint, words array<string>")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_normalise(spark):
    df = spark.createDataFrame([("Été, H2O_x!  é",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalise_a("t")).collect()] == ["été ho_x é", ""]
    assert df.select(T.plain_b("t")).first()[0] == "été h2o_x é"


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agree"), ("feed", "feed"),
    ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflate"), ("troubled", "trouble"), ("sized", "size"), ("hopping", "hop"),
    ("falling", "fall"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
])
def test_light_stem(spark, word, stem):
    assert spark.range(1).select(T.light_stem(F.lit(word))).first()[0] == stem


def test_venue_class(spark):
    names = ["Journal of Machine Learning", "Very Large Data Bases", "Human-Computer Interaction",
             "Image Processing", "Systems Biology", "Graph Theory", "Riots Review", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(T.venue_class("v")).collect()] == [1, 2, 3, 4, 5, 6, 5, 8]


def test_parse_list(spark):
    df = spark.createDataFrame([("['a', \"b c\"]",), (" [] ",), ("none",), (None,)], "c string")
    assert [r[0] for r in df.select(T.parse_list("c")).collect()] == [["a", "b c"], [], [], []]


def test_clean_and_delimited(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t2\t3\n1\t2\n1\t2\t3\t4\n")
    got = S.read_delimited(spark, str(tmp_path / "t.tsv"), ["a", "b", "c"])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "2", "3"), ("1", "2", None)]
    years = spark.createDataFrame([("3.7",), ("x",), (None,)], " Year string")
    assert [r[0] for r in S.clean_articles(years.toDF(" Year")).collect()] == [3, 0, 0]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "title": "x", "authors": ["a", "b"]}\nbroken\n')
    row = S.to_articles(S.read_articles(spark, str(tmp_path / "a.json"))).collect()
    assert len(row) == 1 and row[0]["author_names"] == "a, b" and row[0]["references_count"] == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "tsv"])
def test_save(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, x array<string>")
    S.save_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.format("text").load(str(tmp_path / fmt)).count() > 0 if fmt != "parquet" else True


def test_sample_is_exact_and_seeded(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    first = rows(S.sample_exact(df, 30, 1, "k"), "k")
    assert len(first) == 3000 and first == rows(S.sample_exact(df.repartition(7), 30, 1, "k"), "k")
    assert first != rows(S.sample_exact(df, 30, 2, "k"), "k")
    assert S.sample_exact(df, 0, 1, "k").count() == 10_000


def test_lowest_hashes_per_group(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).alias("g"))
    quota = df.groupBy("g").agg(F.lit(100).alias("take"))
    got = lowest_hashes(df, "k", quota, 3, ["g"]).groupBy("g").count()
    assert [r["count"] for r in got.collect()] == [100, 100]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 2, 9, 10)], "a double, b double")
    got = {(r["column"], r["prob"]): r["value"] for r in exact_percentiles(df, ["a", "b"], [0.0, 0.5, 0.8, 1.0]).collect()}
    assert got[("a", 0.0)] == 1 and got[("a", 0.5)] == 2 and got[("a", 0.8)] == pytest.approx(9.2) and got[("a", 1.0)] == 10
    assert got[("b", 0.8)] == 1


def test_tfidf_and_search(spark):
    docs = bags(spark, a="a a b", b="b c", c="b")
    index, vocab, n = I.build_index(docs)
    w = {(r["doc_id"], r["term"]): r["w"] for r in index.collect()}
    assert w[(0, "a")] == pytest.approx(0.959056, abs=1e-6) and w[(0, "b")] == pytest.approx(0.283217, abs=1e-6)
    assert w[(1, "c")] == pytest.approx(0.861037, abs=1e-6) and w[(2, "b")] == pytest.approx(1.0)
    queries = R.query_vectors(I.term_counts(bags(spark, q="a c")), vocab, n)
    assert rows(R.search(index, queries, 2), "rank", "doc_id", "score") == [(1, 0, 0.678155), (2, 1, 0.608845)]
    assert rows(R.search(index, queries, 3, documents=docs), "rank", "doc_id")[-1] == (3, 2)
    assert rows(I.vocabulary(I.term_counts(docs), I.corpus_size(docs), 1, 0.67), "term") == [("a",), ("c",)]


def test_euclidean_ranks_an_empty_document_above_an_unrelated_one(spark):
    docs = bags(spark, a="x y", b="z", c="")
    index, vocab, n = I.build_index(docs)
    queries = R.query_vectors(I.term_counts(bags(spark, q="x y")), vocab, n)
    got = rows(R.search(index, queries, 3, "euclidean", docs), "rank", "doc_id", "score")
    assert got == [(1, 0, 1.0), (2, 2, 0.5), (3, 1, 0.414214)]


def test_collocations(spark):
    got = rows(I.collocations(bags(spark, a="x y x y x y z"), 1, 10), "first", "second", "freq", "pmi")
    assert got == [("x", "y", 3, 1.222392), ("y", "x", 2, 0.63743), ("y", "z", 1, 1.222392)]


def test_cooccurrence(spark):
    docs = bags(spark, a="x y x")
    vocab = I.vocabulary(I.term_counts(docs), I.corpus_size(docs))
    cooc = I.cooccurrence(docs, vocab, 1)
    assert rows(cooc, "term_a", "term_b", "n") == [("x", "y", 2), ("y", "x", 2)]
    assert rows(I.cooccurrence_network(cooc, 5), "src", "dst", "weight") == [("x", "y", 4)]


def test_discriminative(spark):
    index = spark.createDataFrame([(0, "t", 2.0), (1, "t", 1.0), (2, "t", 1.0)], "doc_id bigint, term string, w double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "doc_id bigint, cluster int")
    assert rows(I.discriminative_terms(index, labels, 1), "cluster", "score")[0] == (0, 1.5)


def test_ngrams_and_lemmas(spark):
    docs = bags(spark, a="x y z", b="x", c="")
    assert rows(K.ngrams(docs, 2, 2), "doc_id", "pos", "term") == [(0, 0, "x y"), (0, 1, "y z")]
    lemmas = spark.createDataFrame([("y", "yy")], "form string, lemma string")
    assert rows(K.lemmatise(K.tokens(docs), lemmas), "doc_id", "pos", "term") == [(0, 0, "x"), (0, 1, "yy"), (0, 2, "z"), (1, 0, "x")]
    back = rows(K.to_bags(K.tokens(docs)), "doc_id", "words")
    assert back == [(0, ["x", "y", "z"]), (1, ["x"])]


def test_hybrid(spark):
    vectors = spark.createDataFrame([(1, [0.9, 0.43588989]), (2, [0.8, 0.6]), (3, [0.85, 0.52678268])], "id bigint, vec array<double>")
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.8660254037844386])], "id bigint, vec array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, vec array<double>")
    got = {r["doc_id"]: r["score"] for r in R.hybrid_search(vectors, nodes, query, 3).collect()}
    assert got == {1: pytest.approx(0.78, abs=1e-6), 2: pytest.approx(0.71, abs=1e-6), 3: pytest.approx(0.595, abs=1e-6)}
    best = rows(R.hybrid_search(vectors, nodes, query, 1), "doc_id")
    assert best == [(1,)]


def test_agreement(spark):
    data = [(0, "a", t, 1.0) for t in "123"] + [(0, "b", t, 1.0) for t in "234"]
    results = spark.createDataFrame(data, "query_id int, method string, title string, score double")
    assert R.method_agreement(results).first()["jaccard"] == 0.5
