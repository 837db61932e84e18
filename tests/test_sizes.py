"""What Spark takes a table to be, where the choice of a join depends on it."""

import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import components, factors
from quillgraph.operators import graph as G
from quillgraph.operators import graph_rounds as R
from quillgraph.operators import quality, scale
from quillgraph.operators.scale import salted_join
from quillgraph.operators.search import query_term_importance
from quillgraph.plans import graphs, rounds


def test_salted_copies_count_in_the_size(spark):
    """Eight copies of a table that just fits the limit are not broadcast."""
    big = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("s"))
    small = spark.range(40_000).select(F.col("id").alias("k"))  # 320 kB, 8 copies 5 MB with their salts
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = salted_join(big.repartition(4), small.repartition(4), "k", "s", how)
            plan = joined._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" not in plan, how
            assert joined.count() == {"left": 100_000, "left_anti": 60_000}.get(how, 40_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ids_are_as_large_as_they_count(spark):
    """Numbers of nodes and stars of components, packed below the limit of a broadcast, are not taken for small tables."""
    edges = spark.range(40_000).select((F.col("id") % 20_000 + 1).alias("r"), (F.col("id") % 19_997 + 20_001).alias("c"), F.lit(1.0).alias("x"))
    names = factors.blocked(edges, 4, square=True).r.names
    found = components.components(names.select(F.col("name").alias("id")), edges.select(F.col("r").alias("src"), F.col("c").alias("dst")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")  # of 39,997 rows with 16 bytes each
    try:
        big = spark.range(1_000_000).select((F.col("id") % 20_000 + 1).alias("name"))
        for joined in (big.repartition(4).join(names, "name"), found):
            assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found.count() == names.count() == 39_997


def test_tables_of_a_row_a_node_are_merged(spark):
    """Nodes that Spark takes for small, because their file is, meet degrees, references and components by merging."""
    folder = "/root/testdata/sf0.001"
    nodes, edges = rounds.part_nodes(spark, folder), scale.cut(rounds.citation_edges(spark, folder))
    kept = G.degree_filter(nodes, edges, 30, 60).nodes
    for table in (kept, G.degrees(nodes, edges).where("degree > 1"), graphs.part_articles(spark, folder).select("id", "references"),
                  components.components(nodes, edges)):
        assert "BroadcastHashJoin" not in table._jdf.queryExecution().sparkPlan().toString()


def test_runs_of_a_vocabulary_are_not_broadcast(spark):
    vocab = spark.createDataFrame([("station",), ("nation",), ("stone",)], "term string")
    words = spark.createDataFrame([(1, "tion"), (2, "st"), (2, "zebra")], "query_id long, word string")
    queries = spark.createDataFrame([(1, "nation", 0.5)], "query_id long, term string, qw double")
    found = query_term_importance(vocab, words, queries, 5)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[run#\d+, _salt", plan)
    assert sorted(map(tuple, found.collect())) == [(1, "nation", 0.5), (1, "station", 0.0), (2, "station", 0.0), (2, "stone", 0.0)]


def test_edges_read_more_than_once_are_written(spark):
    """Ranks and degree filters start from a written table, not from the order lines each time."""
    folder, seen = "/root/testdata/sf0.001", []
    asked = {"pagerank": rounds.pagerank, "degree_filter": rounds.filter_graph, "weighted": rounds.weighted_pagerank}
    for name, build in asked.items():
        def stop(nodes, edges, *rest, **more):
            seen.append(edges._jdf.queryExecution().sparkPlan().toString())
            raise StopIteration

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(*((G, "degree_filter") if name == "degree_filter" else (R, "pagerank")), stop)
            with pytest.raises(StopIteration):
                build(spark, folder)
    assert len(seen) == 3 and not any("lineitem" in plan for plan in seen)


def test_centres_are_copied_for_heavy_terms_only(spark, monkeypatch):
    """The rows of a term that most documents have are dealt over salts; a term of few has one copy of its centre."""
    monkeypatch.setattr(quality, "heavy_of", lambda *a, run=quality.heavy_of: run(*a, 20))
    rows = [(d, t, 0.6 if t == "all" else 0.8) for d in range(60) for t in ("all", f"t{d}")]
    index = spark.createDataFrame(rows, "doc_id bigint, term string, w double")
    labels = spark.createDataFrame([(d, 0) for d in range(60)], "doc_id bigint, cluster int")
    met, before = [], scale.Dealt.meet
    monkeypatch.setattr(scale.Dealt, "meet", lambda self, small, *a: met.append((self, small)) or before(self, small, *a))
    got = [tuple(r) for r in quality.central_documents(index, labels, 2).orderBy("rank").collect()]
    length = ((60 * 0.6) ** 2 + 60 * 0.8 ** 2) ** 0.5
    want = round((0.6 * 36 + 0.8 * 0.8) / length, 6)
    assert got == [(0, 1, 0, want), (0, 2, 1, want)]
    dealt, centre = met[0]
    assert centre.count() == 61 and dealt.heavy.select("term", "_salts").collect() == [("all", 3)]
    assert dealt.rows.groupBy("term", "_salt").count().where("count > 40").isEmpty()
