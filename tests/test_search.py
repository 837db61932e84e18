"""Exact searches by postings in blocks, containment by runs, list cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import index as I
from quillgraph.operators import postings as P
from quillgraph.operators import search as R


def random_index(spark, rng, n, topics, kind="bigint"):
    """Documents about one topic each, rows of length one; some repeat, so that scores tie."""
    rows, dense = [], {}
    for d in range(n):
        topic = int(rng.integers(topics))
        words = {f"t{topic}_{int(w)}": float(rng.integers(1, 5)) for w in rng.integers(0, 6, 4)} | {f"common{int(rng.integers(3))}": 1.0}
        if d % 7 == 3:
            words = dense[max(dense)]
        dense[d] = words
    for d, words in dense.items():
        size = np.sqrt(sum(w * w for w in words.values()))
        rows += [(f"d{d:04}" if kind == "string" else d, t, float(w / size)) for t, w in words.items()]
    return spark.createDataFrame(rows, f"doc_id {kind}, term string, w double")


def slow_search(index, queries, k, metric):
    docs, asked = {}, {}
    for r in index.collect():
        docs.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    for r in queries.collect():
        asked.setdefault(r["query_id"], {})[r["term"]] = r["qw"]
    out = set()
    for q, own in asked.items():
        scored = []
        for d, words in docs.items():
            if own.keys() & words.keys():
                dot = sum(w * words.get(t, 0) for t, w in own.items())
                score = dot if metric == "cosine" else 1 / (1 + np.sqrt(max(0, 2 - 2 * dot)))
                scored.append((-round(float(score), 6), d))
        out |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("metric,kind", [("cosine", "bigint"), ("euclidean", "string")])
def test_best_documents_are_exact_and_few_blocks_are_visited(spark, metric, kind):
    rng = np.random.default_rng(1)
    index = random_index(spark, rng, 600, 20, kind)
    rows = [(f"q{q}", f"t{q % 20}_{w}", 0.5) for q in range(12) for w in range(3)] + [(f"q{q}", "common0", 0.2) for q in range(12)] + [("lost", "unknown", 1.0)]
    queries = spark.createDataFrame(rows, "query_id string, term string, qw double")
    seen = {}
    got = {tuple(r) for r in P.best_documents(index, queries, 5, metric, block=15, counted=seen).collect()}
    assert got == slow_search(index, queries, 5, metric)
    assert seen["visited"] < 0.6 * seen["possible"]
    assert {tuple(r) for r in P.best_documents(index, queries, 700, metric, block=40).collect()} == slow_search(index, queries, 700, metric)


def test_search_with_all_documents_and_unknown_queries(spark):
    index = spark.createDataFrame([(5, "a", 1.0), (6, "a", 0.6), (6, "b", 0.8), (7, "c", 1.0)], "doc_id bigint, term string, w double")
    queries = spark.createDataFrame([(1, "b", 1.0)], "query_id bigint, term string, qw double")
    ids = spark.createDataFrame([(i,) for i in (3, 4, 5, 6, 7)], "doc_id bigint")
    asked = spark.createDataFrame([(1,), (2,), (2,)], "query_id bigint")
    found = lambda metric, k: [tuple(r) for r in R.search(index, queries, k, metric, ids, asked).orderBy("query_id", "rank").collect()]
    assert found("cosine", 3) == [(1, 1, 6, 0.8), (1, 2, 3, 0.0), (1, 3, 4, 0.0), (2, 1, 3, 0.0), (2, 2, 4, 0.0), (2, 3, 5, 0.0)]
    assert found("euclidean", 4) == [
        (1, 1, 6, 0.612574), (1, 2, 3, 0.5), (1, 3, 4, 0.5), (1, 4, 5, 0.414214), (2, 1, 3, 1.0), (2, 2, 4, 1.0), (2, 3, 5, 0.5), (2, 4, 6, 0.5)]
    assert R.search(index, queries.where("false"), 3).isEmpty() and R.search(index.where("false"), queries, 3).isEmpty()


def test_containment_by_runs(spark):
    rng = np.random.default_rng(2)
    draw = lambda n: "".join(rng.choice(list("abcé"), n))
    terms = sorted({draw(int(rng.integers(1, 9))) for _ in range(150)})
    words = sorted({draw(int(rng.integers(1, 6))) for _ in range(25)}) + ["", "zzz"]
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    asked = spark.createDataFrame([(i % 3, w) for i, w in enumerate(words)], "query_id int, word string")
    weights = spark.createDataFrame([(0, terms[0], 0.5), (1, terms[5], 0.25)], "query_id int, term string, qw double")
    got = {(r["query_id"], r["term"]) for r in R.query_term_importance(vocab, asked, weights, 1000).collect()}
    assert got == {(i % 3, t) for i, w in enumerate(words) for t in terms if w and w in t}


def test_counts_are_read_once_and_shared(spark):
    bags = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, ["a", "c"])], "doc_id bigint, words array<string>")
    counts, n = I.counted(bags)
    assert {tuple(r) for r in counts.collect()} == {(1, "a", 2), (1, "b", 1), (2, "b", 1), (4, "a", 1), (4, "c", 1)} and n.first()["n"] == 4
    one, two = I.index_of(counts, n, 2)[0], I.build_index(bags, 2)[0]
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    assert "explode_outer" not in one._jdf.queryExecution().toString()  # words are not read again


def test_list_cells(spark):
    cells = {
        "[1, 2]": ["1", "2"], r"""['a\'b', "c"]""": ["a'b", "c"], "[]": [], " [ ] ": [], "[[1], 2]": [], "['a'": [], "['a',]": ["a"], "[,]": [],
        "[a, b]": [], "['a' 'b']": [], "x": [], "": [], "['a'] x": [], r"['\n\t\\\d']": ["\n\t\\\\d"], "[-1.5e3,True , None]": ["-1.5e3", "True", "None"],
        """['[a], "b"', ',']""": ['[a], "b"', ","], "[1.,.5,+3]": ["1.", ".5", "+3"], "[1 2]": [], "['a',,'b']": [], "[\n'a'\n,'']": ["a", ""], "['a\\']": [],
    }
    df = spark.createDataFrame([(c,) for c in [*cells, None]], "cell string")
    got = {r["cell"]: r["items"] for r in df.select("cell", T.parse_list("cell").alias("items")).collect()}
    assert got == cells | {None: []}
    many = spark.range(1).select(F.lit("[" + ", ".join(f"'w{i}'" for i in range(2000)) + "]").alias("cell"))
    assert many.select(F.size(T.parse_list("cell")).alias("n")).first()["n"] == 2000
