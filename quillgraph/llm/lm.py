"""Language-model scores of whole documents by a gated recurrent network.

The network reads word after word, its state carried from window to window to
the end of a document.  The output softmax is factored by classes, and every
word has a class that is read and foretold by the network: the most frequent
words stand in classes with a softmax of their own, all others in classes by
rank or hash in which a word has its add-one share of the exact corpus counts.
Counts of frequent words go out to the tasks (a table of fixed size); those of
all others meet their documents in a shuffle.

Training: every learned text is read once.  Tasks run truncated backpropagation
on the texts that they hold, a share of them in each round, and the weights are
averaged after every round.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .words import LOWER, Hasher, Index, blocks, find_words, mixed, signed

FREQUENT = 1 << 17        # words whose counts are sent out
CLASSES, PER_CLASS = 32, 32
RANKED, HASHED = 8, 8     # classes of the other words that are sent out, and of all that are not (a power of two)
HIDDEN = 20
WINDOW = 32               # words of truncated backpropagation
WORKERS, ROUNDS = 6, 3
TOKENS = 1_000_000        # that are worth a task of training, if there are more than WORKERS times as many
FAN = 16                  # averages of weights that the driver reads
LANES = 512               # documents read side by side
END = np.uint64(0x0E4D5EED0E4D5EED)  # the end of a text, a token of its own


# --- tokens ------------------------------------------------------------------------------------------------------------------

def _tokens(column: pa.Array, hasher: Hasher, size: int = 1 << 20, rows: int = 1 << 14):
    """``(first row, hashes, cuts)`` of blocks of texts: the words of row i and an end stand from cuts[i] to cuts[i + 1]."""
    for first, data, offsets in blocks(column, size, rows):
        data = LOWER[data]
        starts, ends, row = find_words(data, offsets)
        n = len(offsets) - 1
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)])
        out = np.full(cuts[-1], END)
        out[np.arange(len(row)) + row] = hasher(data, starts, ends)
        yield first, out, cuts


def _gathered(parts, least: int = 1_500_000):
    """Blocks of ``_tokens`` put together until they have ``least`` tokens, so that lanes are long enough for long texts."""
    held, first = [], 0
    for at, own, cuts in parts:
        if not held:
            first = at
        held.append((own, cuts))
        if sum(len(o) for o, _ in held) >= least:
            yield first, *_joined(held)
            held = []
    if held:
        yield first, *_joined(held)


def _joined(held):
    cuts, upto = [np.zeros(1, np.int64)], 0
    for own, part in held:
        cuts.append(part[1:] + upto)
        upto += len(own)
    return np.concatenate([own for own, _ in held]), np.concatenate(cuts)


def _counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all tokens; each task sums a block first."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for _, own, _ in _gathered(_tokens(batch.column(0), hasher)):
                kinds, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(kinds)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _rare(rows: DataFrame, known) -> DataFrame:
    """``(word, id, code, n, learned)``: tokens that are not in ``known``, by document; and for each row one with n = 0 and
    a word of its own, so that rows that repeat a document can be counted."""
    def run(batches):
        hasher, index = Hasher(), Index(known.value)
        for batch in batches:
            ids, codes, learned = batch.column(1), batch.column(2), batch.column(3)
            for first, own, cuts in _tokens(batch.column(0), hasher):
                row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                rare = np.flatnonzero(index(own) < 0)
                words, row = own[rare], row[rare]
                order = np.argsort(words + mixed(row.astype(np.uint64)))  # equal words of a row come together
                words, row = words[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])) if len(words) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(words)))
                every = np.arange(len(cuts) - 1)
                at = pa.array(np.concatenate([first + row[new], first + every]))
                marks = mixed(codes.to_numpy()[first + every].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate([words[new], marks]))), ids.take(at), codes.take(at),
                     pa.array(np.concatenate([n, np.zeros(len(every), np.int64)])), learned.take(at)],
                    names=["word", "id", "code", "n", "learned"])

    return rows.mapInArrow(run, "word bigint, id bigint, code bigint, n bigint, learned boolean")


# --- the network -------------------------------------------------------------------------------------------------------------
# Targets: words with a softmax from 0, classes of other words from -1 down.
# Inputs: 0 the start of a text, then the words with a softmax, then the classes of the others.

def start_network(sizes: np.ndarray, seed: int = 17, others: int = 1) -> dict:
    """Small random weights; the biases begin at the unigram shares.  ``sizes`` are the counts of the softmax words and of
    the ``others`` classes."""
    rng, words = np.random.default_rng(seed), len(sizes) - others
    share = np.log(np.maximum(sizes, 0.5))
    top = np.full(CLASSES * PER_CLASS, -30.0)
    top[:words] = share[:words]
    inner = top.reshape(CLASSES, PER_CLASS)
    classes = np.append(np.logaddexp.reduce(inner, axis=1), share[words:])
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "input": normal(words + 1 + others, 3 * HIDDEN), "state": normal(HIDDEN, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32),
        "class": normal(HIDDEN, CLASSES + others), "class_bias": (classes - np.logaddexp.reduce(classes)).astype(np.float32),
        "word": normal(CLASSES, HIDDEN, PER_CLASS), "word_bias": (inner - np.logaddexp.reduce(inner, axis=1)[:, None]).astype(np.float32),
    }


def _kinds(targets):
    return np.where(targets < 0, CLASSES - 1 - targets, targets // PER_CLASS)


def _symbols(net, targets):
    """What the network reads after each target."""
    words = len(net["input"]) - 1 - (net["class"].shape[1] - CLASSES)
    return np.where(targets < 0, words - targets, targets + 1)


def _step(net, h, symbols, table=None):
    """One gated step: update and reset gates, candidate, new state.  ``table`` is the input with its bias, if known."""
    x = (net["input"] + net["bias"] if table is None else table)[symbols]
    gates = h @ net["state"][:, :2 * HIDDEN]
    gates += x[:, :2 * HIDDEN]
    np.exp(np.negative(gates, out=gates), out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    new = (r * h) @ net["state"][:, 2 * HIDDEN:]
    new += x[:, 2 * HIDDEN:]
    np.tanh(new, out=new)
    return h + z * (new - h), z, r, new


def _with_bias(states):
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)


def _softmax(states, weights, bias, at):
    """``(logit of column at, exponentials, their sum, base)`` by row, with exponentials of logit - base."""
    weights = np.concatenate([weights, bias[None]])
    e = states @ weights
    picked, base = e[np.arange(len(at)), at], e.max() if e.size else e.dtype.type(0)
    np.exp(np.subtract(e, base, out=e), out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    if len(total) and not total.min() > 1e-20:  # rows far below the largest one
        e = states @ weights
        base = e.max(axis=1)
        np.exp(np.subtract(e, base[:, None], out=e), out=e)
        total = e.sum(axis=1)
    return picked, e, total, base


def _picked(states, weights, bias, at):
    """Log probability of column ``at`` of each row."""
    picked, _, total, base = _softmax(states, weights, bias, at)
    return picked - base - np.log(total)


def _by_class(kind):
    """``(class, rows)`` of the classes with a softmax of their own."""
    order = np.argsort(kind.astype(np.int16), kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(edges)):
        yield c, order[edges[c]:edges[c + 1]]


def output_logs(net, states, targets):
    """Natural log probability of each target (softmax word, or another class as a whole) after its state."""
    assert (targets < CLASSES * PER_CLASS).all()
    kind, states = _kinds(targets), _with_bias(states)
    logs = _picked(states, net["class"], net["class_bias"], kind)
    for c, at in _by_class(kind):
        logs[at] += _picked(states[at], net["word"][c], net["word_bias"][c], targets[at] % PER_CLASS)
    return logs


def _slope(states, weights, bias, at):
    """Summed loss of picking ``at``, and the slope of the loss by logit."""
    picked, e, total, base = _softmax(states, weights, bias, at)
    e *= (1 / total)[:, None]
    e[np.arange(len(at)), at] -= 1
    return (np.log(total) + base - picked).sum(), e


def _learn_window(net, h, symbols, targets, fresh):
    """Mean loss and gradients of one window (time, lane), and the state after it.  ``fresh`` marks the starts of texts."""
    steps, lanes = symbols.shape
    kept, states, table = [], [], net["input"] + net["bias"]
    begins = fresh.any(axis=1)
    for t in range(steps):
        old = np.where(fresh[t][:, None], np.float32(0), h) if begins[t] else h
        h, z, r, new = _step(net, old, symbols[t], table)
        kept.append((old, z, r, new))
        states.append(h)
    flat, y = _with_bias(np.concatenate(states)), targets.ravel()
    kind = _kinds(y)
    grads = {k: np.zeros_like(v) for k, v in net.items() if k.startswith("word")}
    loss, d = _slope(flat, net["class"], net["class_bias"], kind)
    both = flat.T @ d
    grads["class"], grads["class_bias"] = both[:-1], both[-1]
    d_flat = d @ net["class"].T
    for c, at in _by_class(kind):
        mine = flat[at]
        more, d = _slope(mine, net["word"][c], net["word_bias"][c], y[at] % PER_CLASS)
        loss += more
        both = mine.T @ d
        grads["word"][c], grads["word_bias"][c] = both[:-1], both[-1]
        d_flat[at] += d @ net["word"][c].T
    given, dh = d_flat.reshape(steps, lanes, HIDDEN), np.zeros((lanes, HIDDEN), np.float32)
    gates_state, new_state = net["state"][:, :2 * HIDDEN].T.copy(), net["state"][:, 2 * HIDDEN:].T.copy()
    old, z, r, new = (np.stack(x) for x in zip(*kept))
    # What does not depend on later steps is reckoned for all at once.
    by_new, by_z, by_r, stay = z * (1 - new * new), (new - old) * z * (1 - z), old * r * (1 - r), 1 - z
    d_x = np.empty((steps, lanes, 3 * HIDDEN), d_flat.dtype)
    for t in range(steps - 1, -1, -1):
        dh = dh + given[t]
        d_new = dh * by_new[t]
        d_reset = d_new @ new_state
        mine = d_x[t]
        np.multiply(dh, by_z[t], out=mine[:, :HIDDEN])
        np.multiply(d_reset, by_r[t], out=mine[:, HIDDEN:2 * HIDDEN])
        mine[:, 2 * HIDDEN:] = d_new
        dh *= stay[t]
        dh += d_reset * r[t]
        dh += mine[:, :2 * HIDDEN] @ gates_state
        if begins[t]:
            dh[fresh[t]] = 0
    d_x, old, r = d_x.reshape(-1, 3 * HIDDEN), old.reshape(-1, HIDDEN), r.reshape(-1, HIDDEN)
    grads["bias"] = np.ones(len(d_x), d_x.dtype) @ d_x
    grads["state"] = np.concatenate([old.T @ d_x[:, :2 * HIDDEN], (r * old).T @ d_x[:, 2 * HIDDEN:]], axis=1)
    read = symbols.ravel()
    order = np.argsort(read.astype(np.int16), kind="stable")
    read, first = np.unique(read[order], return_index=True)
    grads["input"] = np.zeros_like(net["input"])
    grads["input"][read] = np.add.reduceat(d_x[order], first, axis=0)
    return loss / len(y), {k: grads[k] / len(y) for k in net}, h


def learn(net: dict, texts: list[np.ndarray], lanes: int = 24, rate: float = 0.08, seed: int = 0, squares: dict | None = None) -> dict:
    """One pass of truncated backpropagation (Adagrad) over texts of targets, side by side in lanes.

    ``squares`` of earlier passes go on, in place.
    """
    net, order = {k: v.copy() for k, v in net.items()}, np.random.default_rng(seed).permutation(len(texts))
    y = np.concatenate([np.zeros(0, np.int64), *[texts[i] for i in order]])
    if not len(y):
        return net
    lanes = max(1, min(lanes, len(y) // 2))
    length, more = divmod(len(y), lanes)  # the first lanes have one more
    begin = np.arange(lanes) * length + np.minimum(np.arange(lanes), more)
    fresh = np.zeros(len(y), bool)
    fresh[np.cumsum([0] + [len(texts[i]) for i in order][:-1])] = True
    fresh[begin] = True
    x = np.concatenate([[0], _symbols(net, y[:-1])])
    x[fresh] = 0
    squares = {} if squares is None else squares
    for k, v in net.items():
        squares.setdefault(k, np.full_like(v, 1e-4))
    h = np.zeros((lanes, HIDDEN), np.float32)
    pieces = [begin + np.arange(a, min(a + WINDOW, length))[:, None] for a in range(0, length, WINDOW)]
    for at in pieces + [begin[None, :more] + length] * (more > 0):
        _, grads, h = _learn_window(net, h[:at.shape[1]], x[at], y[at], fresh[at])
        for k, g in grads.items():
            squares[k] += g * g
            net[k] -= rate * g / np.sqrt(squares[k])
    return net


def text_logs(net: dict, targets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Natural log probability of every text: targets from cuts[i] to cuts[i + 1], read to the end by ``LANES`` lanes.

    A lane reads its texts one after the other; the state starts anew at each
    text and is carried over the windows inside it.
    """
    sizes, n = np.diff(cuts), len(cuts) - 1
    count = min(LANES, n)
    loads, own = [(0, i) for i in range(count)], [[] for _ in range(count)]
    for text in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heapq.heappop(loads)
        own[lane].append(text)
        heapq.heappush(loads, (load + int(sizes[text]), lane))
    own.sort(key=lambda texts: -sum(int(sizes[t]) for t in texts))
    lengths = np.array([sum(int(sizes[t]) for t in texts) for texts in own])
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    queue = np.array([t for texts in own for t in texts], np.int64)
    y = np.concatenate([targets[cuts[t]:cuts[t + 1]] for t in queue.tolist()])
    text = np.repeat(queue, sizes[queue])
    first = np.concatenate([[True], text[1:] != text[:-1]])
    x = np.concatenate([[0], _symbols(net, y[:-1])])
    x[first] = 0
    h, table, logs = np.zeros((count, HIDDEN), np.float32), net["input"] + net["bias"], np.zeros(len(y))
    for a in range(0, int(lengths[0]), WINDOW):
        states, places = [], []
        for t in range(a, min(a + WINDOW, int(lengths[0]))):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # lanes are sorted by length, the longest first
            at = begin[:live] + t
            old = h[:live]
            fresh = first[at]
            if fresh.any():
                old = np.where(fresh[:, None], np.float32(0), old)
            h = _step(net, old, x[at], table)[0]
            states.append(h)
            places.append(at)
        places = np.concatenate(places)
        logs[places] = output_logs(net, np.concatenate(states), y[places])
    out = np.zeros(n)
    out[queue] = np.add.reduceat(logs, np.flatnonzero(first))
    return out


# --- the operator ------------------------------------------------------------------------------------------------------------

def _targets(hashes: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Targets of words that lie ``at`` a place of the list, -1 for those that are not in it."""
    return np.where(at < 0, -1 - RANKED - _bucket(hashes), place[at])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) % np.uint64(HASHED)).astype(np.int64)


def _averaged(nets: DataFrame) -> dict | None:
    """The mean of networks ``(part, n, net)`` by the tokens that they read; tasks make few of many."""

    def mean(rows):
        n = np.maximum(rows.column("n").to_numpy(), 1)
        found = [pickle.loads(x) for x in rows.column("net").to_pylist()]
        return n.sum(), {k: np.average([f[k] for f in found], axis=0, weights=n).astype(np.float32) for k in found[0]}

    def join(rows):
        n, net = mean(rows)
        return pa.table({"n": pa.array([n], pa.int64()), "net": pa.array([pickle.dumps(net)], pa.binary())})

    few = nets.groupBy(F.pmod("part", F.lit(FAN)).alias("group")).applyInArrow(join, "n bigint, net binary").toArrow()
    return mean(few)[1] if few.num_rows else None


def _trained(taught: DataFrame, words, tokens: int, net: dict) -> dict:
    """The network after ``ROUNDS`` rounds that read all of ``taught(text, code)`` once, some of the texts each.

    Each task learns from the texts that it holds, then weights are averaged.
    ``words`` are the broadcast list of words and their targets.
    """
    context = taught.sparkSession.sparkContext
    dealt = taught.coalesce(max(WORKERS, math.ceil(tokens / TOKENS)))
    for turn in range(ROUNDS):
        sent = context.broadcast(net)

        def run(batches, sent=sent, turn=turn):
            listed, place = words.value
            now, squares, part, read = sent.value, {}, TaskContext.get().partitionId(), 0
            hasher, index = Hasher(), Index(listed)
            parts = (block for batch in batches for block in _tokens(batch.column(0), hasher))
            for _, hashes, cuts in _gathered(parts):
                targets = _targets(hashes, index(hashes), place)
                lanes = int(np.clip(len(targets) // 5000, 24, 256))
                now = learn(now, np.split(targets, cuts[1:-1]), lanes, 0.1 / (1 + turn), part, squares)
                read += len(targets)
            if read:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([read], pa.int64()), pa.array([pickle.dumps(now)], pa.binary())], names=["part", "n", "net"])

        some = dealt.where(F.pmod(F.col("code"), F.lit(ROUNDS)) == turn).select("text")
        net = _averaged(some.mapInArrow(run, "part int, n bigint, net binary")) or net
        sent.unpersist()
    return net


def _listed(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``FREQUENT`` most frequent words of ``(word, n)`` and their counts, the most frequent first."""
    sizes = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()
    held = np.flatnonzero(sizes["words"].cumsum().to_numpy() >= FREQUENT)
    least = int(sizes["n"].iloc[held[0]]) if len(held) else 0
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    return top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)


def _unlisted(counted: DataFrame, known) -> DataFrame:
    """``(bucket, tokens, kinds)`` of the counted words that are not in the broadcast ``known`` ones."""
    def run(batches):
        index = Index(known.value)
        for batch in batches:
            words = batch.column(0).to_numpy().view(np.uint64)
            rest = np.flatnonzero(index(words) < 0)
            bucket, tokens, kinds = _bucket(words[rest]), np.zeros(HASHED, np.int64), np.zeros(HASHED, np.int64)
            np.add.at(tokens, bucket, batch.column(1).to_numpy()[rest])
            np.add.at(kinds, bucket, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(HASHED), pa.int32()), pa.array(tokens), pa.array(kinds)], names=["bucket", "tokens", "kinds"])

    found = counted.select("word", "n").mapInArrow(run, "bucket int, tokens bigint, kinds bigint")
    return found.groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))


def score(df: DataFrame, learned, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``learned`` is a condition on ``df``: the rows that count (null: not).
    Tokens are the words of the whole text and one end; null and empty texts
    are their end alone.  ``base_score`` is the add-one unigram log10
    probability, ``score`` that of the network.  Rows that repeat a document
    each have a row and each count.  What is held in a task is bounded by the longest text.
    """
    context = df.sparkSession.sparkContext
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(body.alias("text"), F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{doc_id}`"), body).alias("code"),
                     F.coalesce(learned, F.lit(False)).alias("learned"))
    taught = rows.where("learned")
    counted = cut(_counts(taught.select("text")))
    frequent, counts = _listed(counted)
    known = context.broadcast(frequent)
    counts = np.append(counts, 0)
    # Rare words: the count of a word is a sum over its own rows, the sums of a document follow in a second shuffle.
    rare = _rare(rows, known)
    c = F.sum(F.when(F.col("learned"), F.col("n")).otherwise(F.lit(0))).over(Window.partitionBy("word"))
    numbered = F.row_number().over(Window.partitionBy("word").orderBy("id"))
    valued = rare.withColumns({"c": c, "nth": numbered})
    by_text = cut(valued.groupBy("id", "code").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))).alias("known"),
        F.sum(F.when((F.col("nth") == 1) & (F.col("c") > 0), F.lit(1)).otherwise(F.lit(0))).alias("kinds"),
        F.sum(F.when(F.col("learned"), F.col("n")).otherwise(F.lit(0))).alias("tokens"),
        F.sum((F.col("n") == 0).cast("int")).alias("copies")))
    sums = by_text.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n_all, v_all = int(counts.sum()) + sums["tokens"], int((counts > 0).sum()) + sums["kinds"]
    base_floor = math.log10(n_all + v_all + 1)
    # The softmax words are the most frequent ones.  The others listed stand in classes of equal mass by rank, all others in
    # classes by hash; a class shares its mass by add-one counts, with one more for words that were never learned.
    top = min(len(frequent), CLASSES * PER_CLASS)
    place = np.full(len(frequent) + 1, -1)
    place[:top] = np.arange(top)
    upto = np.cumsum(counts[top:-1]) - counts[top:-1]
    place[top:-1] = -1 - upto * RANKED // max(int(counts[top:].sum()), 1)
    tokens, kinds = np.zeros((2, RANKED + HASHED), np.int64)
    np.add.at(tokens, -1 - place[top:-1], counts[top:-1])
    np.add.at(kinds, -1 - place[top:-1], 1)
    for row in _unlisted(counted, known).collect():
        tokens[RANKED + row["bucket"]], kinds[RANKED + row["bucket"]] = row["tokens"], row["kinds"]
    floors = np.log10(np.maximum(tokens + kinds + np.repeat([0, 1], [RANKED, HASHED]), 1))
    words = context.broadcast((frequent, place))
    net = _trained(taught, words, n_all, start_network(np.append(counts[:top], tokens), others=RANKED + HASHED))
    model = context.broadcast({"words": frequent, "counts": counts, "place": place, "net": net, "floors": floors})

    def run(batches):
        m, hasher = model.value, Hasher()
        index, logs = Index(m["words"]), np.log10(m["counts"] + 1.0)
        seen = m["counts"] > 0
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for first, hashes, cuts in _gathered(_tokens(batch.column(0), hasher)):
                at = index(hashes)
                target = _targets(hashes, at, m["place"])
                listed, n = logs[at], np.arange(first, first + len(cuts) - 1)
                sums = lambda x: np.add.reduceat(x, cuts[:-1])  # noqa: B023, E731
                out[0, n], out[1, n], out[2, n] = np.diff(cuts), sums(seen[at].astype(np.int64)), sums(listed)
                out[3, n] = text_logs(m["net"], target, cuts) / np.log(10) + sums(np.where(target < 0, listed - m["floors"][np.maximum(-1 - target, 0)], 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in (1, 2, 3)] + [pa.array(out[i].astype(np.int64) if i < 2 else out[i]) for i in range(4)],
                names=["id", "code", "learned", "n", "known_f", "base_f", "score_f"])

    whole = rows.mapInArrow(run, "id bigint, code bigint, learned boolean, n bigint, known_f bigint, base_f double, score_f double")
    found = whole.join(by_text.select("id", "code", "logs", "known", "copies").withColumnRenamed("id", "other"),
                       "code").where(F.col("id").eqNullSafe(F.col("other")))
    logs, known_rare = F.col("logs") / F.col("copies"), (F.col("known") / F.col("copies")).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"), "learned", F.col("n").alias("n_tokens"), (F.col("known_f") + known_rare).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"), (F.col("base_f") + logs - F.col("n") * F.lit(base_floor)).alias("base_score"),
        (F.col("score_f") + logs).alias("score"))
