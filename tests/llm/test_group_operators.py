"""Near-duplicates, vectors, shards, URL filters and the pipeline: brute force and edge cases."""

import zlib

import numpy as np
import xxhash
from llm.conftest import FOLDER
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import lattice, queries, shards, simhash, urls
from quillgraph.llm.links import components


def union(pairs, things):
    root = {t: t for t in things}
    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {t: find(t) for t in things}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    real = union(pairs, {x for p in pairs for x in p})
    assert all(found.get(x, x) == r for x, r in real.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def check_links(spark, prints):
    found = [(r["a"] & 2**64 - 1, r["b"] & 2**64 - 1) for r in simhash.links(spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint")).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    real = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    assert union(found, prints) == union(real, prints)
    return found


def test_simhash_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)}
    for p in list(prints)[:60]:  # chains of near prints, and a dense cluster
        for _ in range(rng.integers(1, 4)):
            p ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            prints.add(p)
    centre = int(rng.integers(0, 2**63))
    prints |= {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (300, 3))}
    found = check_links(spark, sorted(prints))
    assert len(found) < 25 * len(prints)
    monkeypatch.setattr(simhash, "BUCKET", 16)  # the way of buckets too large for a task
    check_links(spark, sorted(prints))


def test_chain_keys_meet_for_every_small_difference():
    keys, starts, chains = simhash._masks()
    rng = np.random.default_rng(3)
    for _ in range(3000):
        x = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
        met = [i for i in range(len(keys)) if not x & keys[i]]
        assert any(all(int(x & chains[starts[i], k]).bit_count() <= (k + 1) * 4 // 5 for k in range(4)) for i in met)


def test_simhash_query(spark, docs, edge, none, clash):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_simhash"](spark, FOLDER).collect()}
    prints = {r["doc_id"]: slow_print(r["text"]) for r in docs.collect()}
    assert {d: r["fingerprint"] for d, r in rows.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    ids = list(prints)
    real = union([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4], ids)
    assert {d: r["component_id"] for d, r in rows.items()} == real
    found = simhash.near_duplicates(clash).collect()
    assert len(found) == edge.count()
    by_id = {r["doc_id"]: r["component_id"] for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[5] == by_id[6] == 5 and by_id[None] is None
    kept = simhash.keep_first(edge)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9, 10] and kept.columns == edge.columns
    assert simhash.near_duplicates(none).isEmpty() and simhash.keep_first(none).isEmpty()


def test_keep_first_decides_by_row(spark):
    """Repeated ids with unlike texts, chains over ids, null ids: no text of its own is lost."""
    a, b, c = ("the old house by the river in spring", "seven ships went out on a cold morning", "a song nobody ever heard before")
    schema = "doc_id bigint, text string, row bigint"
    def kept(rows):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
        out = simhash.keep_first(df)
        assert out.columns == df.columns
        return sorted((r["doc_id"] or -1, r["text"]) for r in out.collect())
    assert kept([(3, b), (5, a), (5, b)]) == sorted([(3, b), (5, a)])
    assert kept([(5, a), (5, b)]) == sorted([(5, a), (5, b)])
    assert kept([(5, a), (5, a), (5, b), (6, a), (4, b), (7, c)]) == sorted([(5, a), (4, b), (7, c)])
    assert kept([(9, a), (9, b), (8, b), (8, c), (7, c)]) == sorted([(9, a), (8, b), (7, c)])
    assert kept([(None, a), (None, a), (2, a), (2, b)]) == sorted([(-1, a), (-1, a), (2, a), (2, b)])


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(4)
    grid = rng.normal(0, 1.5, (40, 8))
    near = lattice.nearest_points(grid)[0]
    assert ((near * 2) % 1 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    steps = np.array([[(i == a) * s + (i == b) * t for i in range(8)] for a in range(8) for b in range(a) for s in (1, -1) for t in (1, -1)], float)
    halves = np.array([x for x in np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T if (x < 0).sum() % 2 == 0])
    own = ((grid - near) ** 2).sum(axis=1)
    for step in np.concatenate([steps, halves]):
        assert (own <= ((grid - near - step) ** 2).sum(axis=1) + 1e-9).all()


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = list(base)
    for c in (0.951, 0.96, 0.98, 0.995, 0.93):
        for x in base[:40]:
            z = rng.normal(size=64)
            z -= z @ x * x
            rows.append(c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    rows += [base[0].copy() for _ in range(5)]
    x = np.array(rows)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64, [1.0, 0.0], [2.0, 0.0]]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)] + [(2000, odd[-1])], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r for r in lattice.near_vectors(table.withColumns({"id": F.lit("x"), "vec": F.lit("y"), "code": F.lit("z")})).collect()}
    close = (x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2) >= 0.95) & ~np.eye(len(x), dtype=bool)
    links = sum(found[i]["n_links"] for i in range(len(x)))
    assert all(found[i]["n_links"] <= close[i].sum() for i in range(len(x))) and links >= 0.95 * close.sum()
    assert [found[1000 + i]["n_links"] for i in range(6)] == [0] * 6 and all(found[1000 + i]["kept"] for i in range(6))
    assert found[1006]["n_links"] == 2 and found[1007]["component_id"] == found[2000]["component_id"] == 1006
    assert found[len(x) - 1]["component_id"] == found[0]["component_id"] and not found[len(x) - 1]["kept"]
    assert lattice.near_vectors(table.limit(0)).isEmpty()
    far = [(i, [float(size * v) for v in base[1]]) for i, size in enumerate((1e300, 1e-300, 1.0))] + [(3, [float(1e300 * v) for v in base[2]])]
    found = lattice.near_vectors(spark.createDataFrame(far, "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in found] == [(2, 0), (2, 0), (2, 0), (0, 3)]


def test_vectors_query(spark):
    rows = queries.QUERIES["op7_embedding_lattice"](spark, FOLDER).toPandas()
    assert len(rows) == 500 and (rows.kept == (rows.vec_id == rows.component_id)).all()


def slow_capacity(sizes, n):
    low, high = max([*sizes, 1]), max(sum(sizes), 1)
    def fits(c):
        used, room = 0, 0
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def test_capacity_is_the_smallest(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for borders in (1 << 17, 24):  # all borders at once, and by zooming
        monkeypatch.setattr(shards, "BORDERS", borders)
        for n, sizes in ((4, rng.integers(1, 50, 300)), (7, rng.integers(1, 9, 40)), (5, [100, 1, 1, 90, 3, 80, 2]), (16, [5])):
            sizes = [int(s) for s in sizes]
            ends = np.cumsum(sizes)
            frame = spark.createDataFrame([(int(e),) for e in ends], "end bigint")
            capacity, known = shards.smallest_capacity(frame, int(ends[-1]), n)
            assert capacity == slow_capacity(sizes, n) and set(known[1:].tolist()) <= set(ends.tolist())
            where = [0, *shards.cuts(known, capacity, n), int(ends[-1])]
            assert len(where) == n + 1 and all(0 <= b - a <= capacity for a, b in zip(where, where[1:]))


def test_shards_query(spark, docs, edge, none, clash):
    rows = queries.QUERIES["op8_shards"](spark, FOLDER).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts) and set(rows.law) == {"bytes"} and rows.shard.between(0, 15).all()
    by_text = {}
    for r in rows.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        assert by_text.setdefault(texts[r.doc_id], r.shard) == r.shard
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sums = rows.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() <= rows["size"].sum() / 16 + rows["size"].max()
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text " * 9).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = shards.assign(hot, 16).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n.tolist()
    assert len(sizes) == 16 and sorted(sizes)[-2] < 1.1 * sorted(sizes)[0]  # the large group has a shard, the others are even
    found = shards.assign(clash, 16).collect()
    assert len(found) == edge.count() and all(r["shard"] is not None and r["slot"] is not None for r in found)
    assert shards.assign(none, 16).isEmpty()


def test_urls(spark):
    rows = queries.QUERIES["op2_url_filters"](spark, FOLDER).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    def slow(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(low), rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, best and best[1] + best[2], best and best[0]
    for r in pages:
        host, path, rule, verdict = slow(r["url"])
        own = rows.loc[r["page_id"]]
        assert (own.host, own.path) == (host, path) and (own.rule or None) == rule and own.verdict in ("allow", "block")
        assert verdict in (None, own.verdict)
    odd = [None, "", "no scheme/at/all", "http://", "HTTP://WWW.Example.COM/en/x?a=/b", "https://com", "x://a.com?b#c", "ftp://é.net/es/" + "a" * 20000, "http://b.net#/es/", "a://b://c.com/d"]
    table = spark.createDataFrame([(i, u, "old") for i, u in enumerate(odd)] * 2, "page_id bigint, url string, host string")
    for r in urls.verdicts(table).collect():
        host, path, rule, verdict = slow(odd[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) in ("allow", "block")
    assert urls.verdicts(table.limit(0)).isEmpty()
    assert {r["verdict"] for r in urls.verdicts(table.where("page_id < 4")).collect()} == {"allow"}


def test_trees_learn_a_pattern(spark):
    rules = [("allow", "site.com", "/page/"), ("block", "site.com", "/fr/")]  # one suffix, so that only the form tells
    good, bad = "http://h%d.%s/page/%d", "http://h%d.%s/fr/%d?a=1&b=2&c=3"
    rows = [(i, (good if i % 2 else bad) % (i % 90, "site.com", i)) for i in range(800)]
    rows += [(10_000 + i, (good if i % 2 else bad) % (i, "other.org", i)) for i in range(40)]
    found = urls.verdicts(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("rule IS NULL").toPandas()
    assert len(found) == 40 and (found.verdict == found.page_id.map(lambda i: "allow" if i % 2 else "block")).mean() > 0.9


def test_pipeline(spark, docs, edge, none, tmp_path):
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, FOLDER)
        now.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert now.columns == docs.columns
        assert now.count() <= before.count()
    assert now.count() > 100
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    prints = [slow_print(r["text"]) for r in spark.read.parquet(str(tmp_path / "1")).collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert not any("@mail" in t for t in texts.values())


def test_pipeline_is_registered_and_runs_on_odd_tables(spark, edge, none):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, none, FOLDER).isEmpty() and stage(spark, edge, FOLDER).count() > 0


def test_url_tail_and_sample(spark):
    given = F.when(F.col("id") < 6000, F.when(F.col("id") % 2 == 0, "allow").otherwise("block"))
    hosts = spark.range(7000).select(F.lit("net").alias("_s1"), F.format_string("d%d.net", "id").alias("_s2"), given.alias("_given"))
    found = {r["suffix"]: r for r in urls.suffix_statistics(hosts).collect()}
    assert len(found) == 7001 and [round(found[f"d{i}.net"]["f_allowed"], 6) for i in (4, 5, 6500)] == [0.666667, 0.333333, 0.5]
    # One verdict of a few rows among many, all of one URL: the few are all there, the many in part, and the weights make up for it.
    rows = spark.range(20_000).select("id", F.lit("http://com/").alias("_url"), F.when(F.col("id") < 5, "block").otherwise("allow").alias("_given"))
    learned = urls.learning_sample(rows, {"allow": 19_995, "block": 5}, 1000, ["id", "_url"]).groupBy("_given").agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))
    by = {r["_given"]: (r["n"], r["w"]) for r in learned.collect()}
    assert by["block"] == (5, 5.0) and 850 < by["allow"][0] < 1150 and abs(by["allow"][1] - 19_995) < 3000
