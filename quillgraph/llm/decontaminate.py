"""Benchmark decontamination by rare seeds, place by place.

A passage within some edits of an item keeps some of the item's short runs of
bytes, near their places.  An item's seeds are the least likely of its runs (by the
items' own counts), so that a common phrase raises no guess; every byte of a text is
looked up among them.  Where enough seeds of an item meet within a band of places,
and enough of its four-byte runs stand near theirs, the exact edit distance of the whole
item to that place decides.  Length and number of the seeds go by the item's length
(``CLASSES``), for a recall of about 0.98 or more at ``EDITS`` random edits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .words import LOWER, SPACES, STEP, SYMBOLS, Index, added, blocks

SHORTEST = 24         # characters; shorter items are looked up as they are
EDITS = 0.3           # of an item's characters, at most
# Items from so many characters on: bytes of a seed, share of the runs that are seeds, seeds that must meet.
CLASSES = [(SHORTEST, 4, 0.8, 2), (48, 4, 0.7, 3), (80, 5, 0.6, 3), (128, 6, 0.55, 3), (200, 7, 0.6, 3)]
BAND = 16             # half the width of the places that seeds meet in
WIDE = 32             # shorter runs may stand so far from their places
ITEM_BYTES = 8 << 20  # of items that go out at a time
SIEVE = 44            # low bits of a hash that the sieve of seeds leaves out
FOLDED = np.where(SPACES, np.uint8(32), LOWER).astype(np.uint8)


def fold(text: str) -> str:
    """A-Z in lower case, every white-space character a space; as long as the text."""
    return FOLDED[np.frombuffer(text.encode(), np.uint8)].tobytes().decode()


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` bytes."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    power, size, out, length = SYMBOLS[data], 1, None, 0
    while True:
        if q & size:
            head = power[:len(data) - q + 1 + (q - length - size)]
            out = head if out is None else out[:len(head)] + np.uint64(pow(int(STEP), length, 2**64)) * power[length:length + len(out)][:len(head)]
            length += size
        if length == q:
            return out[:len(data) - q + 1]
        power = power[:-size] + np.uint64(pow(int(STEP), size, 2**64)) * power[size:]
        size *= 2


RUN = 4               # bytes of the runs that support a place


def runs_of(data: np.ndarray) -> np.ndarray:
    """Numbers of all runs of ``RUN`` bytes, 16 bits each (few share one by chance)."""
    return (grams(data, RUN) >> np.uint64(48)).astype(np.uint16)


def chances(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the logarithms of the chances of its bytes, each given the two before, as counted in all the texts."""
    def codes(size):
        return [sum(x[i:len(x) - size + 1 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(size)) for x in texts]

    logs = []
    for size in (3, 2):
        own = codes(size)
        kinds, place, often = np.unique(np.concatenate([*own, np.zeros(0, np.uint32)]), return_inverse=True, return_counts=True)
        logs.append(np.split(np.log(often)[place], np.cumsum([len(x) for x in own])[:-1]))
    return [np.concatenate([[0.0], two[:1] - np.log(sum(map(len, texts))), three - two[:-1]]) for three, two in zip(*logs)]


def item_index(items: list[tuple]) -> dict:
    """Seeds of the items ``(id, text)`` by length class: sorted hashes, and the item and place of each."""
    kept = [(i, fold(t)) for i, t in items if t]
    groups: dict[tuple[int, float, int], list[int]] = {}
    for k, (_, text) in enumerate(kept):
        kind = [c[1:] for c in CLASSES if c[0] <= len(text)]
        groups.setdefault(kind[-1] if kind else (len(text.encode()), 1.0, 1), []).append(k)
    long = [k for k, (_, text) in enumerate(kept) if len(text) >= SHORTEST]
    chance = dict(zip(long, chances([np.frombuffer(kept[k][1].encode(), np.uint8) for k in long]))) if long else {}
    classes = []
    for (q, share, least), members in sorted(groups.items()):
        keys, owners, places = [], [], []
        hashes = [grams(np.frombuffer(kept[k][1].encode(), np.uint8), q) for k in members]
        _, place, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = np.split(often[place], np.cumsum([len(h) for h in hashes])[:-1])
        for k, h, times in zip(members, hashes, often):
            if share < 1:  # the seldom ones in the items first, then those of a small chance
                run = np.concatenate([[0.0], np.cumsum(chance[k])])
                rare = np.lexsort((run[q:] - run[:len(run) - q], times))[:int(np.ceil(share * len(h)))]
            else:
                rare = np.zeros(1, np.int64)
            keys.append(h[rare])
            owners.append(np.full(len(rare), k, np.int32))
            places.append(rare.astype(np.int32))
        keys, owners, places = (np.concatenate(x) for x in (keys, owners, places))
        order = np.argsort(keys, kind="stable")
        kinds, first = np.unique(keys[order], return_index=True)
        classes.append({"q": q, "least": least, "keys": kinds, "cuts": np.append(first, len(keys)),
                        "owners": owners[order], "places": places[order]})
    return {"ids": [i for i, _ in kept], "texts": [t for _, t in kept], "classes": classes}


def best_match(item: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any substring of ``text``, and where the first such substring ends (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def verified(item: str, text: str, near: list[int]) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best place of ``item`` near the given starts, if the edits are few enough."""
    most = int(EDITS * len(item))
    found, done = None, -1
    for guess in sorted(near):
        a, b = max(0, guess - most - BAND), min(len(text), guess + len(item) + most + BAND)
        if b <= done:
            continue
        a, done = max(a, done - len(item) - 2 * most - 2 * BAND), b
        edits, end = best_match(item, text[a:b])
        if edits <= most and (found is None or edits < found[0]):
            back = best_match(item[::-1], text[a:a + end][::-1])[1]
            found = edits, a + end - back, a + end
    return found


def standing(item: np.ndarray, text: np.ndarray, guess: int) -> int:
    """How many of the runs of ``item`` stand near their places in ``text``."""
    n, a = len(item), guess - WIDE
    if a < 0 or a + n + 2 * WIDE > len(text):
        low, high = max(a, 0), min(a + n + 2 * WIDE, len(text))
        if low >= high:
            return 0
        window = np.zeros(n + 2 * WIDE, np.uint16)
        window[low - a:high - a] = text[low:high]
        text, a = window, 0
    near = np.ndarray((2 * WIDE + 1, n), np.uint16, text, 2 * a, (2, 2)) == item
    return int(np.count_nonzero(np.logical_or.reduce(near)))


def supported(item: np.ndarray, text: np.ndarray, guess: int, usual: list[float]) -> bool:
    """Whether about as many runs of ``item`` stand near their places as ``EDITS`` random edits and chance leave.

    What chance leaves is seen at two other places of the same text, the lesser
    of them; where the text has no such place, nothing is left to chance.  Some
    1 in 200 passages with so many edits has too few.  ``usual`` collects what
    chance left to items in this text; half of the least is expected before
    the other places are looked at.
    """
    n, least = len(item), (1 - EDITS) ** RUN
    room = 0.8 * n ** 0.5
    enough = lambda chance: seen >= (least + (1 - least) * chance) * n - room
    seen = standing(item, text, guess)
    if not enough(0.5 * min(usual, default=0.0)):
        return False
    away = n + -(-n // 2) + 2 * WIDE
    chance = min(standing(item, text, guess + away), standing(item, text, guess - away)) / n
    usual.append(chance)
    return enough(chance)


def _meetings(kind: dict, data: np.ndarray, offsets: np.ndarray, lookup: Index, sieve: np.ndarray, n_items: int):
    """``(row, item, place of the item in the row)``, bytes, of all bands in which enough seeds meet."""
    h = grams(data, kind["q"])
    at = np.flatnonzero(sieve[(h >> np.uint64(SIEVE)).view(np.int64)])
    slot = lookup(h[at])
    at, slot = at[slot >= 0], slot[slot >= 0]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + kind["q"] <= offsets[row + 1]
    at, slot, row = at[inside], slot[inside], row[inside]
    if not len(at):
        return
    n = kind["cuts"][slot + 1] - kind["cuts"][slot]
    own = np.repeat(kind["cuts"][slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    base = (-int(kind["places"].max()) // BAND - 1) * BAND
    band = (np.repeat(at - offsets[row], n) - kind["places"][own] - base) // BAND
    span = int(band.max()) + 3
    pair = np.repeat(row, n) * n_items + kind["owners"][own]
    key, count = np.unique(pair * span + band, return_counts=True)
    beside = np.where(np.diff(key, append=-1) == 1, np.append(count[1:], 0), 0)
    # A band that meets its neighbour: the place between them; one by itself: its own middle is near enough.
    good = np.flatnonzero(count + beside >= kind["least"])
    pair, band = np.divmod(key[good], span)
    row, item = np.divmod(pair, n_items)
    yield from zip(row.tolist(), item.tolist(), (band * BAND + BAND + base).tolist())


def _search(index: dict, first_only: bool = False):
    """A function of a text column that gives ``(row, item, edits, start, end)`` of all matches, or of one a row."""
    tools = []
    for kind in index["classes"]:
        sieve = np.zeros(1 << (64 - SIEVE), bool)
        sieve[(kind["keys"] >> np.uint64(SIEVE)).view(np.int64)] = True
        tools.append((kind, Index(kind["keys"]), sieve))
    runs: dict[int, np.ndarray] = {}

    def search(column):
        for first, data, offsets in blocks(column, 1 << 20, 4096):
            data = FOLDED[data]
            guesses: dict[tuple[int, int], list[int]] = {}
            for kind, lookup, sieve in tools:
                for row, item, place in _meetings(kind, data, offsets, lookup, sieve, len(index["texts"])):
                    guesses.setdefault((row, item), []).append(place)
            last = found = -1
            for (r, item), near in sorted(guesses.items()):
                if first_only and r == found:
                    continue
                if r != last:
                    own = data[offsets[r]:offsets[r + 1]]
                    text, codes, last, usual = None, None, r, []
                wanted = index["texts"][item]
                if len(wanted) >= SHORTEST:
                    if item not in runs:
                        runs[item] = runs_of(np.frombuffer(wanted.encode(), np.uint8))
                    if codes is None:
                        codes = runs_of(own)
                    near = [g for g in near if supported(runs[item], codes, g, usual)]
                    if not near:
                        continue
                if text is None:
                    raw = own.tobytes()
                    text = raw.decode()
                at = text.find(wanted)
                if at >= 0:
                    found = r
                    yield first + r, item, 0, at, at + len(wanted)
                    continue
                if len(wanted) < SHORTEST:
                    continue
                if len(text) != len(raw):  # byte positions become code points
                    near = [len(raw[:max(g, 0)].decode(errors="ignore")) for g in near]
                match = verified(wanted, text, near)
                if match:
                    found = r
                    yield (first + r, item, *match)

    return search


def _indexes(items: DataFrame, item_id: str, text: str):
    """Indexes of the items, a part of at most about ``ITEM_BYTES`` at a time, so that what is sent out stays bounded."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text")).dropna()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size) // ITEM_BYTES
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).distinct()
        yield item_index(sorted(((r["item"], r["text"]) for r in own.collect()), key=repr))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: every item found in a text, at its best place there (code points).

    An item counts as found if a passage of the text is within ``EDITS`` of the
    item's length by edit distance, after folding A-Z and white space; an item under
    ``SHORTEST`` characters if it stands in the text without edits.  Passages without seeds in
    common with the item (see the module) are missed: about 1 or 2 in 100 at ``EDITS`` random edits.
    Null and empty texts and items match nothing; equal items each have rows; a row that
    repeats a document has rows of its own.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType),
        *[T.StructField(n, T.IntegerType()) for n in ("edits", "start", "end")]])
    kind = to_arrow_type(items.schema[item_id].dataType)
    asked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = None
    for index in _indexes(items, item_id, text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            search = _search(shared.value)
            ids = shared.value["ids"]
            for batch in batches:
                rows = list(search(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([ids[r[1]] for r in rows], kind)]
                    + [pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4)],
                    names=["doc_id", "item_id", "edits", "start", "end"])

        one = asked.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    for index in _indexes(items, item_id, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            search = _search(shared.value, first_only=True)

            def work(column):
                hit = np.zeros(len(column), bool)
                hit[[r[0] for r in search(column)]] = True
                return [pa.array(hit)]

            return work

        marked = added(docs, [text], [T.StructField("_leak", T.BooleanType())], make)
        docs = marked.where("NOT _leak").select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs
