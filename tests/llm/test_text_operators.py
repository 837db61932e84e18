"""Language, toxicity, BPE, language model, personal data, decontamination: brute force, libraries, held-out accuracy, edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from llm.conftest import FOLDER
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontaminate, language, lm, pii, queries, toxicity
from quillgraph.llm.words import Hasher, Index, find_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_words_and_index():
    texts = [" ab\tc", "", "c ab", "x" * 500]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    starts, ends, row = find_words(data, offsets)
    assert ["".join(texts)[a:b] for a, b in zip(starts, ends)] == ["ab", "c", "c", "ab", "x" * 500]
    assert row.tolist() == [0, 0, 2, 2, 3]
    h = Hasher()(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3
    keys = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (Index(keys)(keys) == np.arange(1000)).all() and (Index(keys)(keys + np.uint64(1)) == -1).all()
    assert (Index(keys[:0])(keys) == -1).all()


def test_language(spark, docs, edge, none, clash):
    rows = queries.QUERIES["op6_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == docs.count() and (held.lang == held.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    model = language.fit(docs)
    found = {r["doc_id"]: r for r in language.identify(edge.where("doc_id IS NOT NULL"), model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and found[1]["score"] == 0.0
    assert found[5]["lang_pred"] == found[7]["lang_pred"] == "en" and found[8]["lang_pred"] == "fr"
    assert language.identify(clash, model).where("lang_pred = 'extra'").isEmpty()
    assert language.keep_known(edge, model).count() == 8 and language.keep_known(edge, model).columns == edge.columns
    assert language.identify(none, model).isEmpty() and language.fit(none) == {"names": []}
    assert {r[0] for r in language.identify(edge, language.fit(none)).select("lang_pred").collect()} == {"und"}
    for k in (1, 2, 3, 4, 7, 12, 40):
        words = language.codewords(k)
        assert len({tuple(w) for w in words}) == k and (k == 1 or (abs(words.sum(axis=0)) < k).all())


def test_toxicity(spark, docs, edge, none, clash):
    words = ["idiot", "scum", "moron"]
    rows = [(i, f"the old town number {i % 50} of the garden and a house " + (words[i % 3] if i % 5 == 0 else "rose") + " in it") for i in range(600)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = texts.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(texts, labels.where("doc_id < 450"))
    held = toxicity.score(texts.where("doc_id >= 450"), model).toPandas()
    assert (held.predicted == (held.doc_id % 5 == 0)).all() and held.score.between(0, 1).all()
    scored = toxicity.score(clash, model)
    assert scored.count() == edge.count() and scored.where("score IS NULL").isEmpty()
    by_id = {r["doc_id"]: r["score"] for r in toxicity.score(edge, model).collect()}
    assert by_id[1] == by_id[2] == by_id[3]
    assert toxicity.score(none, model).isEmpty()
    only = toxicity.fit(texts, labels.where("toxic = 0"))
    assert {r[0] for r in toxicity.score(edge, only).select("score").collect()} == {0.0}
    assert toxicity.score(edge, toxicity.fit(none, labels.limit(0))).count() == edge.count()
    done = queries.QUERIES["op10_toxicity"](spark, FOLDER).toPandas()
    assert len(done) == docs.count() and (done.predicted == (done.score >= 0.3)).all()


def test_bpe(spark, docs, edge, none, clash):
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    found = queries.QUERIES["op9_bpe"](spark, FOLDER).toPandas().set_index("doc_id")
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        own = found.loc[r["doc_id"]]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    model = bpe.load(bpe.vocabulary_path())
    odd = ["the's 'LL \x1c a\x85b aaaaaaa hahahaha", "ΣΑΣ İ ſ K ﬀ 你好 ٣ ½ é", "<|endoftext|>x<|startoftext|>y <|end", "", None, "'s're!!??", "🙂👍 ab"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for r in bpe.encode(rows, model).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert {len(r["ids"]) for r in bpe.encode(clash.where("doc_id IN (1, 2, 3)"), model).collect()} == {0}
    assert bpe.encode(none, model).isEmpty()


def test_merger_against_one_word_at_a_time():
    model = bpe.load(bpe.vocabulary_path())
    ranks = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(model["left"].tolist(), model["right"].tolist(), model["made"].tolist()))}
    rng = np.random.default_rng(4)
    pieces = list({bytes(rng.choice(list(b"abinthe"), rng.integers(1, 25)).tolist()) for _ in range(400)} | {b"a" * n for n in range(1, 20)})
    symbols, begin = bpe.Merger(model)(pieces)
    for i, piece in enumerate(pieces):
        own = [int(model["inner"][c]) for c in piece[:-1]] + [int(model["last"][piece[-1]])]
        while True:
            options = [(ranks[p][0], at) for at, p in enumerate(zip(own, own[1:])) if p in ranks]
            if not options:
                break
            _, at = min(options)
            own[at:at + 2] = [ranks[own[at], own[at + 1]][1]]
        assert symbols[begin[i]:begin[i + 1]].tolist() == own


def test_lm_base_and_model(spark, docs, edge, none, clash):
    rows = queries.QUERIES["op3_lm_scoring"](spark, FOLDER).toPandas()
    own = {r["doc_id"]: tokens(r["text"]) + [None] for r in docs.collect()}
    counts = collections.Counter(w for i, t in own.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(own) and set(rows.train_tokens) == {n}
    for r in rows.itertuples():
        t = own[r.doc_id]
        assert r.n_tokens == len(t) and r.n_known == sum(counts[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum()
    some = lm.score(clash, F.col("doc_id") < 9).toPandas()
    assert len(some) == edge.count() and some[some.doc_id == 1].n_tokens.tolist() == [1]
    assert some[some.doc_id == 5].score.nunique() == 1 and some.train_tokens.nunique() == 1
    assert lm.score(none, F.lit(True)).isEmpty()
    assert lm.score(edge, F.lit(False)).where("n_known > 0 OR score > 0").isEmpty()


def test_network_carries_its_state_and_learns():
    rng = np.random.default_rng(0)
    texts = [np.array([1, 2, 3, 4] * 40 + [0]) if i % 2 else np.array([4, 3, 2, 1] * 30 + [0]) for i in range(60)]
    net = lm.start_network(np.array([60, 4000, 4000, 4000, 4000, 1]))
    # A single step at a time, text by text, gives what the lanes give.
    cuts = np.cumsum([0] + [len(t) for t in texts])
    fast = lm.text_logs(net, np.concatenate(texts), cuts)
    for i in rng.choice(60, 5):
        h, total, x = np.zeros((1, lm.HIDDEN), np.float32), 0.0, 0
        for y in texts[i]:
            h = lm._step(net, h, np.array([x]))[0]
            total += lm.output_logs(net, h, np.array([y]))[0]
            x = y + 1
        assert fast[i] == pytest.approx(total, rel=1e-4)
    better = lm.learn(net, texts, lanes=4)
    assert lm.text_logs(better, np.concatenate(texts), cuts).sum() > 0.5 * fast.sum()


def test_every_text_is_learned_and_every_word_has_a_class(spark, docs, monkeypatch):
    """The network reads each learned text once; a word without a softmax of its own depends on the words before it."""
    monkeypatch.setattr(lm, "FREQUENT", 3000)
    read, nets = spark.sparkContext.accumulator(0), []

    def window(net, h, symbols, *rest, run=lm._learn_window):
        read.add(symbols.size)
        return run(net, h, symbols, *rest)

    monkeypatch.setattr(lm, "_learn_window", window)
    monkeypatch.setattr(lm, "_trained", lambda *a, run=lm._trained: nets.append((a, run(*a))) or nets[0][1])
    turns = [(i, "before common " + " ".join(f"seldom{(i * 7 + j * 3) % 4000}" for j in range(40)), None, None, None) for i in range(300)]
    rows = lm.score(docs.unionByName(spark.createDataFrame(turns, docs.schema)), F.col("doc_id") >= 0).toPandas()
    assert read.value == rows.train_tokens[0] == rows.n_tokens.sum()
    (_, words, _, _), net = nets[0]
    listed, place = words.value
    assert len(listed) == 3000 and (place[:1024] == np.arange(1024)).all() and set(place[1024:-1]) == set(range(-lm.RANKED, 0))
    every = np.array([-1 - k for k in range(lm.RANKED + lm.HASHED)])
    states = np.stack([lm._step(net, np.zeros((1, lm.HIDDEN), np.float32), np.array([x]))[0][0] for x in (1, 2)])
    logs = [lm.output_logs(net, np.repeat(h[None], len(every), axis=0), every) for h in states]
    assert (np.abs(logs[0] - logs[1]) > 1e-6).all()


def test_word_shares_add_up(spark, monkeypatch):
    """What may come first in a text, with one word that was never learned for each class by hash, has a probability of one."""
    nets = []
    monkeypatch.setattr(lm, "FREQUENT", 1200)
    monkeypatch.setattr(lm, "_trained", lambda *a, run=lm._trained: nets.append((a[1].value, run(*a))) or nets[0][1])
    hashes = lambda words: np.concatenate([own[:-1] for _, own, _ in lm._tokens(pa.array([" ".join(words)]), Hasher())])
    words, strange = [f"w{i}" for i in range(1500)], [f"strange{i}" for i in range(500)]
    _, one = np.unique(lm._bucket(hashes(strange)), return_index=True)
    words_asked = words + [strange[i] for i in one]
    taught = [(-1, " ".join(words))] + [(-2 - i, "w1 w2") for i in range(5)]
    some = spark.createDataFrame(taught + list(enumerate(words_asked)), "doc_id long, text string")
    score = lm.score(some, F.col("doc_id") < 0).toPandas().set_index("doc_id").score
    (listed, place), net = nets[0]
    every = np.append(hashes(words_asked), lm.END)
    targets = lm._targets(every, Index(listed)(every), place)
    end = targets[-1]
    assert end >= 0 and len(one) == lm.HASHED and set(targets[targets < 0]) == set(range(-lm.RANKED - lm.HASHED, 0))
    start = lm._step(net, np.zeros((1, lm.HIDDEN), np.float32), np.array([0]))[0]
    after = lm._step(net, np.repeat(start, len(words_asked), axis=0), lm._symbols(net, targets[:-1]))[0]
    ends = lm.output_logs(net, after, np.full(len(after), end))
    total = np.exp(score.loc[range(len(words_asked))].to_numpy() * np.log(10) - ends).sum()
    assert total + np.exp(lm.output_logs(net, start, np.array([end])))[0] == pytest.approx(1, abs=1e-4)


def test_network_gradients():
    rng = np.random.default_rng(2)
    net = {k: v.astype(np.float64) for k, v in lm.start_network(np.array([5, 4, 3, 2, 6])).items()}
    x, y, fresh = rng.integers(0, 6, (5, 3)), rng.integers(-1, 4, (5, 3)), rng.random((5, 3)) < 0.3
    h = rng.normal(size=(3, lm.HIDDEN))
    _, grads, _ = lm._learn_window(net, h, x, y, fresh)
    for key, at in (("input", (2, 3)), ("state", (1, 2)), ("state", (4, 50)), ("class", (3, 0)), ("bias", (7,)), ("word", (0, 5, 2))):
        sides = []
        for step in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in net.items()}
            moved[key][at] += step
            sides.append(lm._learn_window(moved, h, x, y, fresh)[0])
        assert grads[key][at] == pytest.approx((sides[0] - sides[1]) / 2e-4, abs=1e-5)


def slow_spans(text):
    """The patterns by plain ``finditer``."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, docs, edge, none, clash):
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list("a1.@+- (9é2"), 60)) for _ in range(3000)] + ["a@b@c.d@e.f", "1.2.3.45.6.7.8", "x.@y.z", "+1+123456789 12", "4111 1111 1111 1111"]
    assert pii.base_spans("0" * 5000 + "1.2.3.004 and 1.2.3." + "9" * 5000) == [(1, 0, 5009)]
    for text in odd:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == slow_spans(text), text
    found = queries.QUERIES["op5_pii"](spark, FOLDER).toPandas().set_index("doc_id")
    for r in docs.collect():
        slow, own = slow_spans(r["text"]), found.loc[r["doc_id"]]
        listed = [f"{k}:{a}:{b}" for k, a, b in slow]
        assert own.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(own.spans.split(","))
        assert [own[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in slow) for k in pii.KINDS]
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    added = pii.spans_of(["write to bob.24 (at) mail4.example.com or call (266) 555-7228 today", "born 1984, room 12, 24be64439e3e49cf46b2d7c90f", LOREM], model)
    assert {k for k, *_ in added[0]} & {0, 3} and not added[1] and not added[2]
    assert pii.find(clash, model).where("spans IS NULL").isEmpty() and pii.find(none, model).isEmpty()
    masked = {r["doc_id"]: r["text"] for r in pii.mask(edge, model).collect()}
    assert masked[1] is None and masked[2] == "" and masked[9] == "<EMAIL> " * 3 + "<PHONE>"
    assert pii.mask(edge, model).columns == edge.columns
    assert pii.fit(none) is None and pii.mask(edge, None).count() == edge.count()


LOREM = "no digits, no sign, nothing to find in this text at all " * 5


def test_pii_gradients_and_viterbi():
    rng = np.random.default_rng(5)
    model = pii.start_model()
    x, tags = rng.integers(0, pii.SYMBOLS, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, grads = pii.gradients(model, x, tags)
    for key, at in (("move", (1, 2)), ("first", (3,)), ("out", (4, 1)), ("f_state", (2, 9)), ("b_in", (int(x[1, 2]), 5)), ("b_bias", (20,))):
        sides = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in model.items()}
            moved[key][at] += step
            sides.append(pii.gradients(moved, x, tags)[0])
        assert grads[key][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)
    scores = pii.emissions(model, x[:1, :4])[0][:, 0]
    ways = {way: model["first"][way[0]] + sum(scores[t, way[t]] for t in range(4)) + sum(model["move"][way[t], way[t + 1]] for t in range(3))
            for way in np.ndindex(*[pii.TAGS] * 4)}
    assert pii.best_tags(model, x[:1, :4])[0].tolist() == list(max(ways, key=ways.get))


def slow_match(item, text):
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(last[j] + (a != b), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last)


def test_decontamination(spark, docs, edge, none, clash):
    rng = np.random.default_rng(6)
    for _ in range(200):
        item, text = ("".join(rng.choice(list("abc "), n)) for n in (rng.integers(1, 20), rng.integers(0, 40)))
        assert decontaminate.best_match(item, text)[0] == slow_match(item, text)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    known = {r["item_id"]: r["text"] for r in items.collect()}
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op1_decontamination"](spark, FOLDER).collect()}
    for r in docs.collect():  # every item that stands in a text as it is, and nothing far from all of them
        for i, t in known.items():
            if decontaminate.fold(t) in decontaminate.fold(r["text"]):
                assert (r["doc_id"], i) in found
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, i in found:
        assert slow_match(decontaminate.fold(known[i]), decontaminate.fold(texts[d])) <= 0.3 * len(known[i])
    planted, clean = [], [t for d, t in texts.items() if d not in {x for x, _ in found}][:80]
    for i, t in known.items():  # a tenth of the words replaced, another case, inside other text
        words = [w if rng.random() > 0.1 else str(rng.choice(t.split())) for w in t.split()]
        planted.append((1000 + i, f"{clean[i % len(clean)][:300]} {' '.join(words).upper()} {clean[(i + 7) % len(clean)][:300]}"))
    rows = spark.createDataFrame(planted + list(enumerate(clean)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, items).collect()}
    assert sum((1000 + i, i) in got for i in known) >= 0.95 * len(known) and all(d >= 1000 for d, _ in got)
    assert decontaminate.keep_clean(rows, items).where("doc_id < 1000").count() == len(clean)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "the house and the garden of the old town")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(clash, odd).collect()} == {(5, 4, 0), (6, 4, 0)}
    assert decontaminate.leaks(edge, odd.limit(0)).isEmpty() and decontaminate.leaks(none, odd).isEmpty()
    assert decontaminate.keep_clean(edge, odd).columns == edge.columns and decontaminate.keep_clean(edge, odd).count() == edge.count() - 3


def test_decontamination_recall(spark, docs):
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"]) > 600]
    whole = [decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    items = {"whole": whole, "80-160": [t[:int(rng.integers(80, 161))] for t in whole], "24-48": [t[:int(rng.integers(24, 49))] for t in whole]}

    def edited(t, share):
        t = list(t)
        for p in sorted(rng.choice(len(t), int(share * len(t)), replace=False))[::-1]:
            kind, c = rng.integers(3), str(rng.choice(letters))
            t[p:p + 1] = [[c], [], [c, t[p]]][kind]
        return "".join(t)

    for own in items.values():
        table = spark.createDataFrame(list(enumerate(own)), "item_id bigint, text string")
        shares = [0.15, 0.2, 0.3] * 2
        rows = [(1000 * s + i, f"{texts[i % len(texts)][:300]} {edited(t, share)} {texts[(i + 7) % len(texts)][:300]}")
                for s, share in enumerate(shares) for i, t in enumerate(own)]
        found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), table).collect()
        got = {(r["doc_id"], r["item_id"]) for r in found}
        for s, least in enumerate([0.97, 0.97, 0.95]):
            assert np.mean([(1000 * (s + 3 * k) + i, i) in got for k in (0, 1) for i in range(len(own))]) >= least
        folded = {d: decontaminate.fold(t) for d, t in rows}
        assert all(slow_match(own[r["item_id"]], folded[r["doc_id"]]) <= r["edits"] <= 0.3 * len(own[r["item_id"]]) for r in found[::40])


def test_decontamination_short_items(spark):
    items = spark.createDataFrame([(1, "Ünder 24 chars"), (2, "not here"), (3, ""), (4, None), (5, "z" * 23)], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "é it is ÜNDER\t24 chars?"), (2, "ünder"), (3, None), (4, "z" * 30)], "doc_id bigint, text string")
    assert {tuple(r) for r in decontaminate.leaks(rows, items).collect()} == {(1, 1, 0, 8, 22), (4, 5, 0, 0, 23)}
    assert {r["doc_id"] for r in decontaminate.keep_clean(rows, items).collect()} == {2, 3}


def test_runs_are_counted_near_their_places_at_any_border():
    rng = np.random.default_rng(3)
    text, item = (rng.integers(1, 90, n).astype(np.uint16) for n in (300, 40))
    for guess in range(-120, 420, 7):
        want = 0
        for i, run in enumerate(item):
            near = range(max(guess + i - decontaminate.WIDE, 0), min(guess + i + decontaminate.WIDE + 1, 300))
            want += any(text[k] == run for k in near)
        assert decontaminate.standing(item, text, guess) == want
