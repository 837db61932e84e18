"""Importance resampling, tokenizer alignment and line dedup: brute force and edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from llm.conftest import FOLDER
from pyspark.sql import functions as F

from quillgraph.llm import alignment, lines, queries, resample


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- line dedup -----------------------------------------------------------------


def key(line):
    return fold(line.strip(" \t\n\v\f\r"))


def slow_lines(rows, min_chars=40, min_docs=5):
    """Per row: lines, dropped ones and the rest."""
    holders = collections.defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(doc)
    keeper = {k: max((d for d in ids if d is not None), default=None)
              for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if keeper.get(key(x), doc) == doc]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def lines_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


def test_line_query(spark, docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.QUERIES["op13_line_dedup"](spark, FOLDER).collect()}
    rows = slow_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in rows}


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_batches(spark, batches):
    """Short lines, so that everything repeats; ids that repeat or are null; several levels of runs."""
    rng = np.random.default_rng(batches)
    words = ["a", "B ", " b", "c\t", "d", "", "\x85e", "Ä", "ä", "f"]
    rows = [(int(i) if i else None, "\n".join(rng.choice(words, rng.integers(0, 9)))) for i in rng.integers(0, 25, 60)]
    rows += [(3, None), (None, "g"), (None, "g\ng"), (None, "G"), (7, "h"), (7, "h"), (7, "h"), (6, "h\nh")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (2, 4):
        got = lines.drop_repeats(df, min_chars=1, min_docs=least, batches=batches)
        assert lines_of(got) == sorted(slow_lines(rows, 1, least), key=repr)


def test_runs_are_levelled(spark):
    runs = lines.Runs(spark, 3)
    for i in range(5):
        batch = spark.createDataFrame([(100 - i, k, k, True) for k in range(i, i + 4)], "id bigint, k1 bigint, k2 bigint, first boolean")
        runs.add(batch)
    assert [run is not None for run in runs.levels] == [True, False, True]
    found = {r["k1"]: (r["docs"], r["lines"], r["keeper"]) for r in runs.whole().collect()}
    many = {k: sum(i <= k < i + 4 for i in range(5)) for k in range(8)}
    assert found == {k: (many[k], many[k], 100 - max(0, k - 3)) for k in range(8)}
    runs.forget()


def test_line_edges(spark, edge, none, clash):
    assert lines_of(lines.drop_repeats(edge)) == sorted(slow_lines([(r["doc_id"], r["text"]) for r in edge.collect()]), key=repr)
    assert lines.drop_repeats(none).isEmpty()
    extra = clash.withColumns({n: F.lit("extra") for n in ("n_lines", "kept", "row", "drops", "lines", "r1", "k1", "pos", "keeper", "hot")})
    found = lines.drop_repeats(extra, min_docs=2)
    assert set(found.columns) == set(extra.columns) | {"n_dropped"}
    assert found.where("row = 'extra' AND k1 = 'extra'").count() == edge.count()
    assert lines_of(found) == sorted(slow_lines([(r["doc_id"], r["text"]) for r in edge.collect()], 40, 2), key=repr)


def test_long_text_of_many_lines(spark):
    """Work grows with the lines of a text, not with their square."""
    shared = [f"shared line number {i} that is long enough to be counted" for i in range(30_000)]
    rows = [(i, "\n".join(shared + [f"own line of document {i}"] * 3 + shared[:5])) for i in range(5)]
    got = lines.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert lines_of(got) == sorted(slow_lines(rows), key=repr)


def test_line_ids_of_any_type(spark):
    line = "the same long line in every one of these documents"
    df = spark.createDataFrame([(f"doc{i}", line) for i in range(6)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.drop_repeats(df).collect()} == {f"doc{i}": int(i < 5) for i in range(6)}


# -- importance resampling ------------------------------------------------------


def features(text, low=1, high=1, buckets=10_000):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", fold(text).encode())
    return words, [zlib.crc32(b" ".join(words[i:i + n])) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def slow_resample(rows, target, percent=10, min_words=20, low=1, high=1, buckets=10_000):
    own = [(d, *features(t, low, high, buckets)) for d, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in own:
        s.update(f)
    for text in target:
        t.update(features(text, low, high, buckets)[1])
    many_s, many_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (many_s + buckets) / ((s[b] + 1) * (many_t + buckets)))) for b in range(buckets)]
    out = []
    for d, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= min_words)
    return out, able[:percent * len(able) // 100]


def check_resample(df, target, **options):
    rows, drawn = slow_resample([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in target.collect()], **options)
    got = resample.resample(df, target, **options).collect()
    assert sorted(map(repr, rows)) == sorted(repr([r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")]) for r in got)
    ranked = sorted((r["rank"], (-r["score"], r["doc_id"] is None, r["doc_id"] or 0)) for r in got if r["rank"] is not None)
    assert [r for r, _ in ranked] == list(range(1, len(drawn) + 1)) and [x for _, x in ranked] == drawn
    return got


def test_resample_query(spark, docs):
    rows, drawn = slow_resample([(r["doc_id"], r["text"]) for r in docs.collect()],
                                [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    place = {d: i + 1 for i, (_, _, d) in enumerate(drawn)}
    got = {tuple(r) for r in queries.QUERIES["op11_importance_resampling"](spark, FOLDER).select("doc_id", "n_features", "weight", "score", "rank").collect()}
    assert got == {(d, n, w, s, place.get(d)) for d, _, n, w, s in rows}


def test_crc_of_ranges():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4900, 400)
    ends = starts + np.append(rng.integers(0, 64, 396), [65, 64, 100, 0])
    whole = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resample.crc32(data, starts, ends).tolist() == whole
    middle = np.minimum(starts + 7, ends)
    assert resample.crc32(data, middle, ends, resample.crc32(data, starts, middle)).tolist() == whole
    assert not len(resample.crc32(data, starts[:0], ends[:0]))


def test_resample_edges(spark, edge, none, clash):
    target = spark.createDataFrame([("The old house of the town",), (None,), ("",)], "text string")
    check_resample(edge, target, percent=50, min_words=1)
    check_resample(edge, target, percent=100, min_words=0, low=1, high=3, buckets=50)
    check_resample(edge, target, percent=70, min_words=2, low=2, high=2)
    check_resample(edge, target.where("false"), percent=30, min_words=0)
    check_resample(edge, target, percent=0)
    assert resample.resample(none, target).isEmpty()
    extra = clash.withColumns({n: F.lit("extra") for n in ("n_words", "weight", "rank", "bucket", "_row", "_id", "_kept")})
    found = resample.resample(extra, target, min_words=0)
    assert set(found.columns) == set(extra.columns) | {"n_features", "score"} and found.where("_row = 'extra' AND _id = 'extra'").count() == edge.count()


def test_ties_at_the_cutoff(spark):
    """Many rows of one score: ids decide, then the rows' own numbers; bisection over negative scores as well."""
    rng = np.random.default_rng(7)
    for spread, ids in ((1, 2000), (3, 40), (4000, 10)):
        rows = [(int(i) - 10 if i % 9 else None, int(s) - 5) for i, s in zip(rng.integers(0, ids, 300), rng.integers(0, spread, 300))]
        df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "id bigint, score bigint, row bigint")
        for k in (0, 1, 37, 150, 299, 300):
            got = resample.draw(df, k, F.col("row") >= 0, "id").where("rank IS NOT NULL").orderBy("rank").collect()
            want = sorted((-s, i is None, i or 0, n) for n, (i, s) in enumerate(rows))[:k]
            assert [(-r["score"], r["id"] is None, r["id"] or 0, r["row"]) for r in got] == want
            assert [r["rank"] for r in got] == list(range(1, k + 1))
    named = spark.createDataFrame([(f"d{i:03}", i % 2, i) for i in range(50)], "id string, score bigint, row bigint")
    got = resample.draw(named, 10, F.lit(True), "id").where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["id"] for r in got] == [f"d{i:03}" for i in range(1, 21, 2)]


# -- tokenizer alignment --------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    """Per side: what the library itself says, and the bytes of its tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=alignment.vocabulary_path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in range(50256)] + [b"<|endoftext|>"]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    return [(lambda t: a.encode(" " + t, add_special_tokens=False).ids, bytes_a), (b.encode, bytes_b)]


def slow_align(rows, sides):
    """Cuts at common ends found one text at a time."""
    found, count = [], collections.Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        ids = [encode(text) for encode, _ in sides] if text else [[], []]
        if not text or any(b"".join(tokens[i] for i in own) != whole for (_, tokens), own in zip(sides, ids)):
            ids = [[], []]
        ends = [np.cumsum([len(tokens[i]) for i in own]).tolist() for (_, tokens), own in zip(sides, ids)]
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids[0][ends[0].index(p)], ids[1][ends[1].index(p)]) for p in common]
        groups, low = [], 0
        for p in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(own, at) if low < e <= p) for own, at in zip(ids, ends)))
            low = p
        count.update(links)
        found.append((doc, len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, a, b, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), shown) for d, a, b, g, ls, shown in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = [(1, "naïve café — 東京タワー 🙂🙂"), (2, "a  b\t\tc\n\n d "), (3, "<|endoftext|> <s> <unk> <0x41> ▁"), (4, "▁x"), (5, "\x00\x01 ok"), (6, " "),
       (7, "aaaa" * 500), (8, "é ﬁ ½   ﻿"), (9, None), (10, ""), (10, "twice"), (None, "no id"), (11, "  lead"), (12, "12345678901 3.14 $%&"),
       (13, "a\n b\n\n  c \t\n d\r\n"), (14, "x\xa0 y\xa0\xa0z  \u2003 w"), (15, "tail \n"), (16, "\n\n"), (17, "it's I'll  'sx ''s 'S don't"), (18, "\x1c a \x1f\x85 b")]


def test_alignment_query(spark, docs, sides):
    rows = {r[0]: r[1:] for r in slow_align([(r["doc_id"], r["text"]) for r in docs.collect()], sides)}
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, FOLDER).collect()
    digest = lambda shown: hashlib.sha256(shown.encode()).hexdigest() if shown else ""
    assert {r["doc_id"]: tuple(r[c] for c in [*COLUMNS[1:-1], "groups_sha256"]) for r in got} == {d: (*r[:-1], digest(r[-1])) for d, r in rows.items()}


def test_alignment_of_odd_texts(spark, sides, monkeypatch):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    want = sorted(map(repr, slow_align(ODD, sides)))
    got = lambda: sorted(repr(tuple(r[c] for c in COLUMNS)) for r in alignment.with_counts(alignment.align(df)).collect())
    assert got() == want
    monkeypatch.setattr(alignment, "CHUNK", 40)  # many chunks, a text or two each
    monkeypatch.setattr(alignment, "BLOCK", 20)
    assert got() == want


def test_alignment_edges(spark, edge, none, clash, sides):
    want = sorted(map(repr, slow_align([(r["doc_id"], r["text"]) for r in edge.collect()], sides)))
    extra = clash.withColumns({n: F.lit("extra") for n in ("n_a", "groups", "n_best", "at", "n", "best", "chunk", "pair", "_whole", "_text")})
    found = alignment.with_counts(alignment.align(extra))
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in found.collect()) == want
    assert set(found.columns) == set(extra.columns) | set(COLUMNS) and found.where("pair = 'extra'").count() == edge.count()
    assert alignment.with_counts(alignment.align(none)).isEmpty()


def test_encoders_agree_on_every_character(sides):
    side = alignment.ByteSide(alignment.vocabulary_path("byte_bpe_50k.json"))
    assert side.tokens == sides[0][1]
    texts = [f"a{chr(c)} {chr(c)}b1{chr(c)}{chr(c)} !{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    assert side(texts + ["ab" * 50_000]) == [sides[0][0](t) for t in texts + ["ab" * 50_000]]


def test_groups_and_overlaps():
    rng = np.random.default_rng(8)
    for _ in range(200):
        ends = [np.unique(np.append(rng.integers(1, 30, rng.integers(1, 12)), 30)) for _ in range(2)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        a, b = alignment.overlaps(starts[0], ends[0], starts[1], ends[1])
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                                                    if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        s, e = np.concatenate(starts), np.concatenate(ends)
        order = np.lexsort((e, s))
        group = alignment.groups_of(s[order], e[order])
        common = np.intersect1d(*ends)
        assert group.tolist() == np.searchsorted(common, s[order], side="right").tolist()
