"""Alignment of two tokenizers over the same bytes, by interval coalescing.

Tokens of both sides are byte ranges.  Sorted by start, with the running maximum
of their ends, they fall into groups wherever a start reaches that maximum.
Inside a group only ranges that overlap are met, and those that end together are
links.  How often a pair of ids is linked is counted over the whole corpus: a
task hands on each distinct pair of a chunk of texts once, and a chunk's texts
meet the totals of the chunk's own pairs.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .bpe import alphabet
from .words import blocks

CHUNK = 8 << 20   # bytes of text that share a list of pairs
BLOCK = 1 << 20   # bytes of text (or one text) that are aligned at once
PAIR = np.int64(1 << 32)
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
# Fixed by the kind of vocabulary: the pieces of a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteSide:
    """Byte-level BPE of ``space + text``: ids, and the bytes of every id.

    Where the ids are in the order of the merges, as in the public files, they
    are ranks too, and the faster of two encoders gives the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, special = content["model"], {t["id"]: t["content"] for t in content["added_tokens"]}
        byte = {c: b for b, c in enumerate(alphabet())}
        names = special | {i: t for t, i in model["vocab"].items()}
        self.tokens = [b""] * (max(names) + 1)
        for i, t in names.items():
            self.tokens[i] = t.encode() if i in special else bytes(byte[c] for c in t)
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        cutter = content["pre_tokenizer"] or {}
        plain = content["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter["add_prefix_space"]
        if plain and not model["ignore_merges"] and made == list(range(made[0], made[0] + len(made))):
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.tokens) if i not in special}
            self.encode = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["RAYON_NUM_THREADS"] = "1"  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True  # their strings in a text are plain text
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(" " + t) for t in texts]


class PieceSide:
    """Sentence pieces of a text, to which the model itself adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def groups_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of every range, for ranges in order of their starts: a group ends where a start reaches all ends so far."""
    if not len(start):
        return np.zeros(0, np.int64)
    reached = np.maximum.accumulate(end)
    return np.concatenate([[0], np.cumsum(start[1:] >= reached[:-1])])


def overlaps(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of overlapping ranges; each side is in order and its own ranges do not overlap."""
    first = np.searchsorted(b_end, a_start, side="right")
    many = np.maximum(np.searchsorted(b_start, a_end, side="left") - first, 0)
    total = np.cumsum(many)
    a = np.repeat(np.arange(len(a_start)), many)
    return a, np.arange(len(a)) - np.repeat(total - many - first, many)


class Aligner:
    """Aligns blocks of texts; made once a task."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = ByteSide(a_path), PieceSide(b_path)
        self.sizes = [np.array([len(t) for t in s.tokens], np.int64) for s in self.sides]
        # Every id as text with what may follow it: the same side, the other side, the next group.
        self.shown = [f"{i}{mark}" for s in self.sides for i in range(len(s.tokens)) for mark in ",|;"]
        self.offset = 3 * len(self.sides[0].tokens)

    def _ids(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of both sides for each text; none where either side does not stand for ``space + text``."""
        both = [side(texts) for side in self.sides]
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if not text or any(b"".join(map(s.tokens.__getitem__, ids[i])) != whole for s, ids in zip(self.sides, both)):
                both[0][i], both[1][i] = [], []
        return both

    def __call__(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Counts of each text, its groups as ``a1,a2|b1;...``, and the text and id pair of every link."""
        n = len(texts)
        ids, row, start, end = [], [], [], []
        for own, size in zip(self._ids(texts), self.sizes):
            many = np.fromiter(map(len, own), np.int64, n)
            ids.append(np.fromiter(chain.from_iterable(own), np.int64, int(many.sum())))
            row.append(np.repeat(np.arange(n), many))
            end.append(np.cumsum(size[ids[-1]]))  # both sides of a text have the same bytes, so that positions agree
            start.append(end[-1] - size[ids[-1]])
        side = np.repeat([0, 1], [len(x) for x in ids])
        starts, ends = np.concatenate(start), np.concatenate(end)
        order = np.lexsort((side, starts))
        group = np.empty(len(order), np.int64)
        group[order] = groups_of(starts[order], ends[order])
        a, b = overlaps(start[0], end[0], start[1], end[1])
        met = (end[0][a] == end[1][b]) & (group[a] == group[len(ids[0]) + b])
        a, b = a[met], b[met]

        rows = np.concatenate(row)
        order = np.lexsort((starts, side, group))
        g, s, r = group[order], side[order], rows[order]
        mark = np.where(g[1:] != g[:-1], 2, np.where(s[1:] != s[:-1], 1, 0))
        code = 3 * np.concatenate(ids)[order] + np.append(mark, 2) + self.offset * s
        parts = list(map(self.shown.__getitem__, code.tolist()))
        border = np.searchsorted(r, np.arange(n + 1))
        shown = ["".join(parts[i:j])[:-1] for i, j in zip(border[:-1].tolist(), border[1:].tolist())]
        each = lambda x: np.bincount(x, minlength=n)
        breaks = r[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else r
        counts = {"n_a": each(row[0]), "n_b": each(row[1]), "n_groups": each(breaks), "n_links": each(row[0][a])}
        return counts, shown, row[0][a], ids[0][a] * PAIR + ids[1][b]


def _lists(values: np.ndarray, many: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(values, kind))


def align(df: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (``a1,a2|b1;a3|b2,b3``: ids in order).

    For ``with_counts`` there are further the columns ``_chunk``, ``_at`` and
    ``_times``, and one row more for each chunk of texts, whose ``_pairs`` and
    ``_sums`` list its distinct pairs; its other columns are null.  Texts that
    are null, empty, or that one of the sides does not give back byte for byte
    have zeros and no groups.  Rows that repeat are rows of their own.
    """
    a_path, b_path = a_path or vocabulary_path("byte_bpe_50k.json"), b_path or vocabulary_path("piece_bpe_32k.model")
    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("groups", T.StringType())]
    inner = [T.StructField("_chunk", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("_at", "_times")],
             *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("_pairs", "_sums")]]
    new = {f.name.lower() for f in fields + inner}
    kept = [c for c in df.columns if c.lower() not in new]
    whole = "_".join(["_whole", *kept])  # no other column has this name
    asked = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(whole))
    own = [T.StructField(c, df.schema[c].dataType, True) for c in kept]
    schema = T.StructType(own + fields + inner)
    names = schema.names

    def run(batches):
        work = Aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        place: dict[int, int] = {}  # of the pairs of this chunk
        sums = np.zeros(0, np.int64)
        held = 0

        def chunk_row(like):
            pairs = np.fromiter(place, np.int64, len(place))
            empty = [pa.nulls(1, t) for t in like]
            one = [pa.array([number]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                   _lists(pairs, np.array([len(pairs)]), pa.int64()), _lists(sums, np.array([len(sums)]), pa.int64())]
            return pa.RecordBatch.from_arrays(empty + one, names=names)

        like = None
        for batch in batches:
            column = batch.column(len(kept))
            for first, data, offsets in blocks(column, BLOCK, 1 << 16):
                n = len(offsets) - 1
                counts, shown, row, pair = work(column.slice(first, n).fill_null("").to_pylist())
                kinds, which = np.unique(pair, return_inverse=True)
                for p in kinds.tolist():
                    place.setdefault(p, len(place))
                at = np.array([place[p] for p in kinds.tolist()], np.int64)
                sums = np.concatenate([sums, np.zeros(len(place) - len(sums), np.int64)])
                sums[at] += np.bincount(which, minlength=len(kinds))
                each, times = np.unique(row * PAIR + at[which], return_counts=True)
                many = np.bincount(each // PAIR, minlength=n)
                columns = [batch.column(i).slice(first, n) for i in range(len(kept))]
                columns += [pa.array(counts[c]) for c in COUNTS] + [pa.array(shown, pa.string())]
                like = [c.type for c in columns]
                columns += [pa.array(np.full(n, number)), _lists(each % PAIR, many, pa.int32()), _lists(times, many, pa.int32()),
                            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                held += len(data)
                if held >= CHUNK:
                    yield chunk_row(like)
                    place, sums, held, number = {}, np.zeros(0, np.int64), 0, number + 1
        if len(place):
            yield chunk_row(like)

    return asked.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, b_id, n, best)``: how many links of the corpus hold a pair of ids, and whether no other pair of its B id has more."""
    chunks = aligned.where("_pairs IS NOT NULL").select(F.inline(F.arrays_zip(F.col("_pairs").alias("pair"), F.col("_sums").alias("n"))))
    counted = chunks.toDF("pair", "n").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b_id", F.col("pair") % F.lit(1 << 32))
    counted = cut(counted)
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))  # at most a row an id of B
    return counted.join(F.broadcast(most), "b_id").select("pair", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """The rows of ``align`` (with whatever was added to them) and ``n_best`` and ``count_sum``; the inner columns go.

    ``n_best`` are the links whose pair is the most frequent of its B id in the
    corpus, ties included; ``count_sum`` adds up the corpus counts of all links.
    A text without links has 0 and 0.  An empty table gives no rows.
    """
    rows = cut(aligned)
    listed = rows.where("_pairs IS NOT NULL").select(F.col("_chunk").alias("chunk"), F.posexplode("_pairs").alias("at", "pair"))
    known = listed.join(pair_counts(rows), "pair").select("chunk", "at", "n", "best")
    docs = rows.where("_pairs IS NULL").drop("_pairs", "_sums")
    kept = [c for c in docs.columns if c not in ("_chunk", "_at", "_times", "n_best", "count_sum")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def judge(own: pa.Table, totals: pa.Table) -> pa.Table:
        n, best = np.zeros((2, len(totals)), np.int64)
        place = totals.column("at").to_numpy()
        n[place], best[place] = totals.column("n").to_numpy(), totals.column("best").to_numpy(zero_copy_only=False)
        lists = [own.column(c).combine_chunks() for c in ("_at", "_times")]
        at, times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        row = np.repeat(np.arange(len(own)), lists[0].value_lengths().to_numpy())
        found = [np.zeros(len(own), np.int64) for _ in range(2)]
        for total, value in zip(found, (best, n)):
            np.add.at(total, row, value[at] * times)
        table = own.select(kept)
        for name, total in zip(("n_best", "count_sum"), found):
            table = table.append_column(name, pa.array(total))
        return table

    return docs.groupBy("_chunk").cogroup(known.groupBy("chunk")).applyInArrow(judge, schema)
