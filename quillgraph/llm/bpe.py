"""BPE encoding and decoding with a public vocabulary.

A task cuts its texts into pieces, and encodes the pieces that it has not met
before together: an occurrence index maps each pair to all its positions,
active ranks are applied in ascending order, and only the lists of pairs that a
merge makes are updated.
"""

from __future__ import annotations

import ctypes
import gc
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .words import Index, added, blocks, mixed

# Fixed by the vocabulary's format: white space, pieces of a text, the byte alphabet.
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
KNOWN_WORDS = 250_000   # words that a task remembers before it starts anew
KNOWN_CHARS = 8 << 20   # and their characters
SLICE_BYTES = 2 << 20   # bytes of text (or one text) whose ids and decoded text are held at once


def alphabet() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else the next from U+0100 on."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return [chr(b) if b in set(SHOWN) else chr(256 + hidden.index(b)) for b in range(256)]


def load(path: str) -> dict:
    """Merge table, byte symbols and token strings of a vocabulary file (read on the driver; a fixed public file)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocab, special = content["model"]["vocab"], {t["content"]: t["id"] for t in content["added_tokens"]}
    end = content["model"]["end_of_word_suffix"]
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in [*vocab.items(), *special.items()]:
        tokens[i] = token
    pairs = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
    left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in
                         ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    first_use = np.full(len(tokens), len(pairs))
    rank = np.arange(len(pairs))
    for side in (left, right):
        np.minimum.at(first_use, side, rank)
    letters = alphabet()
    return {
        "tokens": tokens, "special": special, "left": left, "right": right, "made": made,
        "early": first_use[made] < rank,  # the new symbol has a merge of a lower rank
        "inner": np.array([vocab[c] for c in letters], np.int64), "last": np.array([vocab[c + end] for c in letters], np.int64),
    }


class Merger:
    """The pair occurrence index over the pieces of one call."""

    def __init__(self, model: dict):
        self.model, self.size = model, np.int64(len(model["tokens"]))
        self.index = Index(mixed((model["left"] * self.size + model["right"]).astype(np.uint64)))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.index(mixed((a * self.size + b).astype(np.uint64)))
        return np.where((a < 0) | (b < 0), -1, found)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols, and where each piece's begin (one more entry than pieces)."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths + 1)  # a border symbol -1 follows every piece
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        symbol = self.model["inner"][data]  # of a merged pair the right one becomes -2
        symbol[ends - 2] = self.model["last"][data[ends - 2]]
        symbol[ends - 1] = -1
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[at] < n)]
            rank = self._ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for r, i, j in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(at[i:j])

        note(np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            at = np.concatenate(places.pop(r))
            a, b, made = self.model["left"][r], self.model["right"][r], self.model["made"][r]
            live = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if not len(live):
                continue
            live.sort()
            live = live[np.concatenate([[True], live[1:] != live[:-1]])]
            if a == b:  # of overlapping pairs the left one counts
                kept, stop = [], -1
                for p in live.tolist():
                    if p != stop:
                        kept.append(p)
                        stop = int(after[p])
                live = np.array(kept)
            if self.model["early"][r]:  # the merge may make a pair that goes first: one place of a piece at a time
                piece = np.searchsorted(ends, live, side="right")
                first = np.flatnonzero(np.diff(piece, prepend=-1))
                rest, live = np.delete(live, first), live[first]
                if len(rest):
                    places[r] = [rest]
                    heapq.heappush(active, r)
            gone = after[live]
            symbol[live], symbol[gone] = made, -2
            after[live] = after[gone]
            before[after[live]] = live
            note(np.concatenate([before[live], live]))
        whole = symbol >= 0
        return symbol[whole], np.concatenate([[0], np.cumsum(np.add.reduceat(whole, ends - lengths - 1))])


def taken(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered ``at`` one after the other, and their sizes."""
    size = sizes[at]
    end = np.cumsum(size)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[at] - end + size, size)], size


def words_of(text: str) -> list[str]:
    """Runs between white space; no piece reaches over white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for ``split`` only
        return [w for w in WHITE.split(text) if w]
    return text.split()


def pieces_of(words: list[str], special: dict, cutter) -> list[list[str]]:
    """The pieces of every word: NFC, lower case letter by letter, then the pattern; special tokens stay whole."""
    plain = " ".join(words)
    if cutter is None or not cutter.search(plain):
        return [[w] if w.isalpha() else PIECES.findall(w) for w in normalise(plain).split(" ")]
    return [[p for i, part in enumerate(cutter.split(w)) for p in ([part] if i % 2 else PIECES.findall(normalise(part)))]
            for w in words]


def normalise(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def give_back() -> None:
    """Hands memory that is free in this process back to the system, where the system's library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def encode(df: DataFrame, model: dict, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` (array of token ids) and ``decoded`` (the text that those ids stand for).

    Whole texts are encoded, without special tokens of our own; the strings of
    special tokens in a text are those tokens.  A null text is an empty one: no
    ids, an empty string.  The vocabulary is broadcast; it is a fixed file.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        vocabulary = shared.value
        special = vocabulary["special"]
        merger = Merger(vocabulary)
        cutter = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        tokens = vocabulary["tokens"]
        give_back()  # what earlier work of the same worker holds
        known: dict[str, int] = {}
        chars = [0]
        table: list = []  # of the words known: all symbols, where each word's begin, and how many they are

        def learn(new: list[str]) -> None:
            cut = pieces_of(new, special, cutter)
            distinct = list(set().union(*cut).difference(special))
            symbols, begin = merger([p.encode() for p in distinct]) if distinct else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            place = {p: i for i, p in enumerate([*distinct, *special])}
            symbols = np.concatenate([symbols, list(special.values())]).astype(np.int32)
            sizes = np.concatenate([np.diff(begin), np.ones(len(special), np.int64)])
            each = np.array([place[p] for own in cut for p in own], np.int64)
            many = np.array([len(own) for own in cut], np.int64)
            symbols, size = taken(symbols, np.cumsum(sizes) - sizes, sizes, each)
            run = np.concatenate([[0], np.cumsum(size)])
            last = np.cumsum(many)
            sizes = run[last] - run[last - many]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            chars[0] += sum(map(len, new))
            if table:
                symbols, sizes = np.concatenate([table[0], symbols]), np.concatenate([table[2], sizes])
            table[:] = [symbols, np.cumsum(sizes) - sizes, sizes]

        def work(column):
            column = column.fill_null("")
            flat, lengths, texts = [np.zeros(0, np.int32)], [], []
            for first, data, offsets in blocks(column, SLICE_BYTES, 1 << 16):
                values = column.slice(first, len(offsets) - 1)
                if len(known) > KNOWN_WORDS or chars[0] > KNOWN_CHARS:
                    known.clear()
                    table.clear()
                    chars[0] = 0
                    give_back()
                new: set[str] = set()
                for value in values:
                    new.update(words_of(value.as_py()))
                new.difference_update(known)
                if new:
                    learn(list(new))
                for value in values:
                    own = words_of(value.as_py())
                    at = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                    one = taken(*table, at)[0] if len(at) else flat[0]
                    flat.append(one)
                    lengths.append(len(one))
                    texts.append(decode(one.tolist(), tokens))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32())), pa.array(texts, pa.string())

        return work

    return added(df, [text], fields, make, SLICE_BYTES)


def decode(ids: list[int], tokens: list[str]) -> str:
    """The token strings with a space between them; the vocabulary names no decoder."""
    return " ".join([tokens[i] for i in ids])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
