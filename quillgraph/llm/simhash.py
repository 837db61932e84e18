"""SimHash near-duplicates with a pigeonring filter.

Of two fingerprints that differ in at most 4 of 64 bits, cut into a ring of 5
segments, some chain of consecutive segments keeps its running sum of
differences within the proportional budget at every length: 0 in one segment, at
most 1 in two, 2 in three, 3 in four (4/5 of the length, rounded down).  The
first three links of the chain are an equality test on masked bits, so
candidates meet in an ordinary shuffle; the whole chain is tested before the
full Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .links import components
from .words import STEP, added, mixed, signed

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 5
SMALL_RUN = 8          # buckets up to this size are compared pair by pair at once
BUCKET = 1 << 20       # fingerprints of a bucket that one task compares; larger buckets are cut into blocks


def _bits(first: int, last: int) -> int:
    return ((1 << last) - 1) ^ ((1 << first) - 1)


def _masks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key masks, the chain start of each, and the masks of chains of 1 to 4 segments by start."""
    edges = [round(64 * i / SEGMENTS) for i in range(SEGMENTS + 1)]
    whole = [_bits(a, b) for a, b in zip(edges, edges[1:])]
    halves = [(_bits(a, (a + b) // 2), _bits((a + b) // 2, b)) for a, b in zip(edges, edges[1:])]
    keys, starts, chains = [], [], []
    for i in range(SEGMENTS):
        second, third = halves[(i + 1) % SEGMENTS], halves[(i + 2) % SEGMENTS]
        # No difference in the second segment, or one: then a half of it and a half of the third have none.
        for rest in [second[0] | second[1]] + [a | b for a in second for b in third]:
            keys.append(whole[i] | rest)
            starts.append(i)
        run, own = 0, []
        for step in range(SEGMENTS - 1):
            run |= whole[(i + step) % SEGMENTS]
            own.append(run)
        chains.append(own)
    return np.array(keys, np.uint64), np.array(starts), np.array(chains, np.uint64)


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 (seed 42) of the 4-word shingles, A-Z in lower case, words joined by one space."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    return [digest(line[a:b], 42) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; zero without any."""
    if not hashes:
        return 0
    values = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(values[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(values), 1 << 16))
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the 64-bit fingerprint of the whole text as a (signed) bigint; null and empty texts have 0."""
    def make():
        def work(column):
            prints = np.array([fingerprint(shingle_hashes(v.as_py())) for v in column], np.uint64)
            return [pa.array(signed(prints))]

        return work

    return added(df, [text], [T.StructField(name, T.LongType(), False)], make)


def _keys(prints: DataFrame) -> DataFrame:
    """``(key, start, fp)``: the 25 equality tests of every fingerprint."""
    masks, starts, _ = _masks()

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            tag = np.arange(1, len(masks) + 1, dtype=np.uint64) * STEP
            key = mixed((fp[:, None] & masks) ^ tag).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key)), pa.array(np.tile(starts.astype(np.int32), len(fp))), pa.array(signed(np.repeat(fp, len(masks))))],
                names=["key", "start", "fp"])

    return prints.mapInArrow(run, "key bigint, start int, fp bigint")


def _spanning(fp: np.ndarray, other: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what lies within ``DISTANCE``, directly or step by step, without listing all pairs.

    Everything near a pivot is tied to the pivot; only what is neither near nor
    out of reach (twice the distance) is compared with those.  With ``other``,
    links between and inside both.
    """
    todo = np.unique(fp if other is None else np.concatenate([fp, other]))
    out = []
    while len(todo) > 1:
        away = np.bitwise_count(todo ^ todo[0])
        near, edge = todo[away <= DISTANCE], todo[(away > DISTANCE) & (away <= 2 * DISTANCE)]
        out.append((near[1:], np.full(len(near) - 1, near[0])))
        for i in range(0, len(edge), max(1, (1 << 22) // len(near))):
            part = edge[i:i + max(1, (1 << 22) // len(near))]
            close = np.bitwise_count(part[:, None] ^ near[None, :]) <= DISTANCE
            tied = close.any(axis=1)
            out.append((part[tied], near[close[tied].argmax(axis=1)]))
        todo = todo[away > DISTANCE]
    return out


def _compare(keyed: DataFrame) -> DataFrame:
    """``(key, a, b)`` from rows sorted by key: links found in a bucket, or (a, null) for the rows of one too large."""
    _, _, chains = _masks()
    budgets = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS)]

    def links(key, start, fp):
        found = []
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cuts)
        some = np.repeat(size, size)
        for step in range(1, SMALL_RUN):
            at = np.flatnonzero((key[step:] == key[:-step]) & (some[:len(some) - step] <= SMALL_RUN))
            x = fp[at] ^ fp[at + step]
            for k, most in enumerate(budgets):
                ok = np.bitwise_count(x & chains[start[at], k]) <= most
                at, x = at[ok], x[ok]
            at = at[np.bitwise_count(x) <= DISTANCE]
            found.append((fp[at], fp[at + step]))
        for i in np.flatnonzero(size > SMALL_RUN):
            found += _spanning(fp[cuts[i]:cuts[i + 1]])
        return found

    def run(batches):
        held: list = []  # the last bucket of the batches so far, which may go on

        def told(found):
            a, b = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.uint64)]) for i in (0, 1))
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(signed(pairs[0])), pa.array(signed(pairs[1]))], names=["key", "a", "b"])

        def passed_on(part):
            key, _, fp = part
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed(fp)), pa.nulls(len(fp), pa.int64())], names=["key", "a", "b"])

        too_large = None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if too_large is not None:
                same = int(np.searchsorted(part[0], too_large, side="right"))
                yield from passed_on([x[:same] for x in part])
                part = [x[same:] for x in part]
                if not len(part[0]):
                    continue
                too_large = None
            part = [np.concatenate(x) for x in zip(held, part)] if held else part
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1], side="left"))
            yield from told(links(*[x[:last] for x in part]))
            held = [x[last:] for x in part]
            if len(held[0]) > BUCKET:
                too_large = held[0][0]
                yield from passed_on(held)
                held = []
        if held:
            yield from told(links(*held))

    return keyed.mapInArrow(run, "key bigint, a bigint, b bigint")


def _large_buckets(rows: DataFrame) -> DataFrame:
    """Links in buckets of more than ``BUCKET`` fingerprints ``(key, fp)``: cut into blocks, a task a pair of blocks."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BUCKET // 2)).cast("int").alias("n"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("key", F.least("own", "i").alias("i"), F.greatest("own", "i").alias("j"), "fp")

    def run(table: pa.Table) -> pa.Table:
        found = _spanning(table.column("fp").to_numpy().view(np.uint64))
        a, b = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.uint64)]) for k in (0, 1))
        return pa.table({"a": signed(a), "b": signed(b)})

    return pairs.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links that join all fingerprints (column ``fp``) within ``DISTANCE`` of each other, directly or by others.

    Every two fingerprints that near meet in some bucket and are tied there;
    inside a dense bucket by a spanning set of links instead of all pairs.
    """
    keyed = _keys(prints.select("fp").distinct())
    found = cut(_compare(keyed.repartition("key").sortWithinPartitions("key")))
    plain = found.where("b IS NOT NULL").select("a", "b")
    return plain.unionByName(_large_buckets(found.where("b IS NULL").select("key", F.col("a").alias("fp"))))


def _placed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, fingerprint, component_id, root)``: ``root`` tells components apart that have the same smallest id."""
    rows = cut(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fingerprint"))
    prints = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"))
    prints = cut(prints)
    roots = components(links(prints)).withColumnRenamed("id", "fp")
    placed = prints.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    table = placed.join(named, "root").select(F.col("fp").alias("fingerprint"), "component_id", "root")
    return rows.join(table, "fingerprint").select("doc_id", "fingerprint", "component_id", "root")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: the smallest id reachable over near fingerprints.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows
    that repeat an id are rows of their own; a null id is kept, but names no
    component unless all ids of the component are null.
    """
    return _placed(df, doc_id, text).select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id cannot be named and stay.

    Rows are decided one by one: a row goes if its own text is in a component
    with a smaller id, or if another row of its id and component stays.  Rows
    that repeat an id but have unlike texts are in components of their own.
    """
    found = cut(_placed(docs, doc_id, text).where("doc_id IS NOT NULL"))
    again = cut(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    named = F.col("doc_id").alias(doc_id)
    gone = found.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone.unionByName(again).distinct().select(named), doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    more = docs.join(again.select(named), doc_id, "left_semi").select(row, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    places = found.join(again, "doc_id", "left_semi").where("doc_id = component_id").select("doc_id", "fingerprint", "root").distinct()
    firsts = fingerprints(more).join(places, ["doc_id", "fingerprint"]).dropDuplicates(["doc_id", "root"])
    return kept.unionByName(firsts.select("row.*"))
