"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds what they miss.

The model is trained in numpy on windows of texts whose spans the patterns
labelled, and on copies of them with other separators.  Texts are read in
overlapping windows; of every character the tag of the window in which it stands
most central counts, and runs of tags become spans of the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import added

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)         # outside, then begin and inside of each kind
WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN, SYMBOLS = 16, 130         # symbols: ASCII, other, padding
SAMPLE = 3000                     # labelled windows that are learned from, at most

# Fixed patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Every kind has digits or an at-sign, or the at-sign spelt in brackets; nothing else can hold a span.
TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start: leftmost matches of each pattern; those that fail their test are dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        numbers = [p.lstrip("0") or "0" for p in m[0].split(".")]  # without zeros in front, of which there may be thousands
        if all(len(n) <= 3 and int(n) <= 255 for n in numbers):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows over all that lies within ``MARGIN`` of a trigger."""
    starts, upto, first = [], -1, 0
    def close():
        starts.extend(range(first, max(first + 1, upto - STRIDE), STRIDE))
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a > upto:
            if upto >= 0:
                close()
            first = a
        upto = b
    if upto >= 0:
        close()
    return starts


def encoded(pieces: list[str]) -> np.ndarray:
    out = np.full((len(pieces), WINDOW), SYMBOLS - 1, np.int64)
    for i, piece in enumerate(pieces):
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        out[i, :len(codes)] = np.minimum(codes, 128)
    return out


def tagged(spans, start: int, size: int = WINDOW) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, a, b in reversed(spans):  # of overlapping kinds the first listed counts
        a, b = a - start, b - start
        if b > 0 and a < size:
            tags[max(a, 0):min(b, size)] = 2 + 2 * kind
            if a >= 0:
                tags[a] = 1 + 2 * kind
    return tags


# --- the model ---------------------------------------------------------------------------------------------------------------

def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def start_model(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.15, shape)
    model = {"out": small(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "move": small(TAGS, TAGS), "first": np.zeros(TAGS)}
    for side in ("f", "b"):
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN:2 * HIDDEN] = 1.0
        model |= {f"{side}_in": small(SYMBOLS, 4 * HIDDEN), f"{side}_state": small(HIDDEN, 4 * HIDDEN), f"{side}_bias": bias}
    return model


def _lstm(x, w, u, bias):
    """States of one direction over ``x`` (time, row), and what the way back needs."""
    h = c = np.zeros((x.shape[1], HIDDEN))
    states, kept = [], []
    for symbols in x:
        z = w[symbols] + h @ u + bias
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        old, before = c, h
        c = f * c + i * g
        t = np.tanh(c)
        h = o * t
        states.append(h)
        kept.append((i, f, o, g, old, before, t))
    return np.array(states), kept


def _lstm_back(x, u, kept, given):
    dw, du, db = np.zeros((SYMBOLS, 4 * HIDDEN)), np.zeros_like(u), np.zeros(4 * HIDDEN)
    dh = dc = np.zeros((x.shape[1], HIDDEN))
    for step in range(len(x) - 1, -1, -1):
        i, f, o, g, old, before, t = kept[step]
        dh = dh + given[step]
        dc = dc + dh * o * (1 - t * t)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dw, x[step], dz)
        du += before.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ u.T, dc * f
    return dw, du, db


def emissions(model, x):
    """Tag scores (time, row, tag) of symbols (row, time)."""
    x = x.T
    ahead, kept_a = _lstm(x, model["f_in"], model["f_state"], model["f_bias"])
    back, kept_b = _lstm(x[::-1], model["b_in"], model["b_state"], model["b_bias"])
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return both @ model["out"] + model["out_b"], (x, both, kept_a, kept_b)


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(model, x, tags):
    """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
    scores, (x, both, kept_a, kept_b) = emissions(model, x)
    steps, rows = scores.shape[:2]
    move, y, own = model["move"], tags.T, np.arange(rows)
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0] + model["first"]
    for t in range(1, steps):
        ahead[t] = scores[t] + _logsum(ahead[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = _logsum(move + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    whole = _logsum(ahead[-1], 1)
    d_scores = np.exp(ahead + back - whole[:, None])
    grads = {"move": np.zeros_like(move)}
    gold = model["first"][y[0]] + scores[np.arange(steps)[:, None], own, y].sum(axis=0)
    for t in range(1, steps):
        pair = ahead[t - 1][:, :, None] + move + (scores[t] + back[t])[:, None, :] - whole[:, None, None]
        grads["move"] += np.exp(pair).sum(axis=0)
        gold += move[y[t - 1], y[t]]
    np.add.at(grads["move"], (y[:-1].ravel(), y[1:].ravel()), -1.0)
    d_scores[np.arange(steps)[:, None], own, y] -= 1.0
    grads["first"] = d_scores[0].sum(axis=0)
    grads["out"] = np.einsum("trh,trk->hk", both, d_scores)
    grads["out_b"] = d_scores.sum(axis=(0, 1))
    given = d_scores @ model["out"].T
    for side, symbols, kept, part in (("f", x, kept_a, given[:, :, :HIDDEN]), ("b", x[::-1], kept_b, given[::-1, :, HIDDEN:])):
        grads[f"{side}_in"], grads[f"{side}_state"], grads[f"{side}_bias"] = _lstm_back(symbols, model[f"{side}_state"], kept, part)
    return (whole - gold).mean(), {k: g / rows for k, g in grads.items()}


def train(x: np.ndarray, tags: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 3) -> dict:
    """Adam on shuffled batches."""
    model, rng, step = start_model(seed), np.random.default_rng(seed), 0
    means = {k: np.zeros_like(v) for k, v in model.items()}
    squares = {k: np.zeros_like(v) for k, v in model.items()}
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            some, step = order[a:a + batch], step + 1
            for k, g in gradients(model, x[some], tags[some])[1].items():
                means[k] += 0.1 * (g - means[k])
                squares[k] += 0.01 * (g * g - squares[k])
                model[k] -= rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-6)
    return model


def best_tags(model: dict, x: np.ndarray) -> np.ndarray:
    """The best tags of every window by Viterbi."""
    scores = emissions(model, x)[0]
    best, back = scores[0] + model["first"], []
    for t in range(1, len(scores)):
        ways = best[:, :, None] + model["move"]
        back.append(ways.argmax(axis=1))
        best = ways.max(axis=1) + scores[t]
    tags = np.zeros(x.shape, np.int64)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(len(scores) - 1, 0, -1):
        tags[:, t - 1] = np.take_along_axis(back[t - 1], tags[:, t:t + 1], 1)[:, 0]
    return tags


# --- reading texts -----------------------------------------------------------------------------------------------------------

def reconcile(starts: list[int], tags: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Runs of tags of a whole text; each character has the tag of the window in which it is farthest from an edge."""
    out, kind, first, last = [], None, 0, -1
    centre = (WINDOW - 1) / 2
    votes: dict[int, tuple[float, int]] = {}
    for s, own in zip(starts, tags):
        for i in np.flatnonzero(np.ones(min(WINDOW, size - s))).tolist():
            away = abs(i - centre)
            if s + i not in votes or away < votes[s + i][0]:
                votes[s + i] = (away, int(own[i]))
    for at in sorted(votes):
        tag = votes[at][1]
        new = None if tag == 0 else (tag - 1) // 2
        if kind is not None and (new != kind or at != last + 1 or tag % 2 == 1):
            out.append((kind, first, last + 1))
            kind = None
        if new is not None and kind is None:
            kind, first = new, at
        last = at
    if kind is not None:
        out.append((kind, first, last + 1))
    return out


AT = re.compile(r" ?[\[(] ?at ?[\])] ?|@")
DOT = re.compile(r" ?[\[(] ?dot ?[\])] ?|\.")
SEPARATED = re.compile(r"\(?[0-9]+\)?(?:[ ().-]+[0-9]+)+")


def plausible(kind: int, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span without dull ends, if its form is that of its kind and it does not stand inside a word or number."""
    while a < b and not (text[a].isalnum() or text[a] in "(+"):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    span, digits = text[a:b], NOT_DIGITS.sub("", text[a:b])
    if not span or (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return None
    if kind == 0:
        name, at, domain = span.partition(m[0]) if (m := AT.search(span)) else ("", "", "")
        good = bool(at) and bool(name) and all(c in LOCAL for c in name) and bool(DOMAIN.fullmatch(DOT.sub(".", domain)))
    elif kind == 1:
        numbers = re.split(r"[.,:]| ?[\[(]?\.[\])]? ?", span)
        good = len(numbers) == 4 and all(n.isdigit() and n.isascii() and len(n) <= 3 and int(n) <= 255 for n in numbers)
    elif kind == 2:
        good = bool(re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", span)) and 13 <= len(digits) <= 19 and luhn(digits)
    else:
        good = 9 <= len(digits) <= 15 and bool(SEPARATED.fullmatch(span.lstrip("+"))) and len(span) <= 24
    return (a, b) if good else None


def spans_of(texts: list[str], model: dict | None) -> list[list[tuple[int, int, int, bool]]]:
    """``(kind, start, end, base)`` of every text, by kind and start."""
    base = [base_spans(t) for t in texts]
    found = [[(*s, True) for s in own] for own in base]
    where = [windows(t) for t in texts] if model else [[] for _ in texts]
    pieces = [t[s:s + WINDOW] for t, starts in zip(texts, where) for s in starts]
    if pieces:
        tags = np.concatenate([best_tags(model, encoded(pieces[i:i + 4096])) for i in range(0, len(pieces), 4096)])
        done = 0
        for i, starts in enumerate(where):
            own, done = tags[done:done + len(starts)], done + len(starts)
            if not own.any():
                continue
            for kind, a, b in reconcile(starts, own, len(texts[i])):
                span = plausible(kind, texts[i], a, b)
                if span and not any(x < span[1] and span[0] < y for _, x, y, _ in found[i]):
                    found[i].append((kind, *span, False))
    return [sorted(own) for own in found]


def _varied(piece: str, spans, rng) -> tuple[str, list]:
    """A copy of a window with its spans written in other ways."""
    out, new, last = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < last:
            continue
        old, sep = piece[a:b], " -."[rng.integers(3)]
        digits = NOT_DIGITS.sub("", old)
        if kind == 0:
            old = old.replace("@", [" (at) ", "[at]", " [at] ", "(at)"][rng.integers(4)])
        elif kind == 2:
            old = sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
        elif kind == 3:
            form = rng.integers(3)
            old = [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", sep.join([digits[-10:-7], digits[-7:-4], digits[-4:]]),
                   "+" + sep.join([digits[:-10] or "1", digits[-10:-7], digits[-7:-4], digits[-4:]])][form]
        out += piece[last:a]
        new.append((kind, len(out), len(out) + len(old)))
        out, last = out + old, b
    return out + piece[last:], new


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict | None:
    """The model, trained on at most ``sample`` windows of ``docs``, chosen by hash; None if no window holds a span.

    Three quarters of the sample go to windows with a span, where there are as many.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(0).fill_null("").to_pylist():
                spans = base_spans(value)
                rows += [(value[s:s + WINDOW], [(k, max(a - s, 0), min(b - s, WINDOW)) for k, a, b in spans if a < s + WINDOW and b > s])
                         for s in windows(value)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.string()), pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in rows], pa.string())],
                names=["piece", "spans"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "piece string, spans string").distinct()
    own = found.withColumns({"some": F.col("spans") != "", "spot": F.xxhash64("piece", "spans")}).persist()
    parts = [own.where("some" if some else "NOT some").orderBy("spot", "piece").limit(n).collect()
             for some, n in ((True, sample * 3 // 4), (False, sample // 4))]
    own.unpersist()
    if not parts[0]:
        return None
    rng, pieces, tags = np.random.default_rng(9), [], []
    for r in parts[0] + parts[1]:
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
        for piece, own_spans in [(r["piece"], spans)] + ([_varied(r["piece"], spans, rng)] if spans else []):
            pieces.append(piece[:WINDOW])
            tags.append(tagged(own_spans, 0))
    return train(encoded(pieces), np.array(tags), rounds=max(6, -(-200 * 64 // len(pieces))))  # 200 steps or more


SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False),
                     T.StructField("end", T.IntegerType(), False), T.StructField("base", T.BooleanType(), False)])


def _texts(column: pa.Array, size: int = 4 << 20):
    """Lists of texts of about ``size`` characters."""
    own, n = [], 0
    for value in column:
        own.append(value.as_py() or "")
        n += len(own[-1])
        if n >= size:
            yield own
            own, n = [], 0
    yield own


def find(df: DataFrame, model: dict | None, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``spans``: an array of (kind, start, end, base) by kind and start, in code points of the whole text.

    All matches of the patterns are there (``base`` true); the model adds spans
    that overlap none of them.  Null and empty texts have an empty array.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(column):
            found = [own for texts in _texts(column) for own in spans_of(texts, shared.value)]
            flat = [s for own in found for s in own]
            arrays = [pa.array([KINDS[s[0]] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int32()),
                      pa.array([s[2] for s in flat], pa.int32()), pa.array([s[3] for s in flat], pa.bool_())]
            fields = [pa.field(n, a.type, False) for n, a in zip(("kind", "start", "end", "base"), arrays)]
            values = pa.StructArray.from_arrays(arrays, fields=fields)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, values, type=pa.list_(pa.field("element", values.type, False)))]

        return work

    return added(df, [text], [T.StructField(spans, T.ArrayType(SPAN, False))], make)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, last = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= last:
            out += [text[last:a], f"<{KINDS[kind].upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def mask(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; null texts stay null, all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(column):
            values = [v for texts in _texts(column) for v in map(masked, texts, spans_of(texts, shared.value))]
            return [pa.array(values, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))]

        return work

    return added(docs, [text], [T.StructField(text, T.StringType())], make).select(*[F.col(f"`{c}`") for c in docs.columns])
