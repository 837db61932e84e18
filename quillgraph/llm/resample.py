"""Importance resampling towards a target distribution of hashed word features.

Counts of hashed features of the corpus and of the target become an array of
gains; a task scores whole texts against that array.  Scores with seeded Gumbel
noise are written once.  The cutoff of the draw is found by bisection over the
numbers themselves, each step an exact count job over the written table, first
on the score, then on the ids of those tied at it.  Only the drawn rows are
range-partitioned and numbered.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .words import LOWER, blocks

BUCKETS = 10_000
SCALE = 1000
SEED = 2024
STEPS = 3           # halvings that one count job makes
LONG_WORD = 64      # bytes beyond which a word's checksum is taken by itself
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

_LETTERS = np.zeros(256, bool)  # bytes of words, after lower-casing: 0-9, a-z, all of non-ASCII characters
_LETTERS[48:58] = _LETTERS[97:123] = _LETTERS[128:] = True


def _table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> 1), value >> 1)
    return value


_CRC = _table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, so_far: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of byte ranges, all ranges a byte further at a time; ``so_far`` goes on from earlier checksums."""
    state = np.zeros(len(starts), np.uint32) if so_far is None else so_far.astype(np.uint32)
    size = ends - starts
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        state[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(state[i]))
    state = ~state
    order = np.argsort(-np.where(size > LONG_WORD, 0, size), kind="stable")
    counted = size[order]
    live, at = state[order], starts[order]
    live[counted > LONG_WORD] = state[order][counted > LONG_WORD]
    counted = np.where(counted > LONG_WORD, 0, counted)
    for k in range(int(counted.max(initial=0))):
        n = int(np.searchsorted(-counted, -k, side="left"))  # ranges longer than k bytes
        live[:n] = _CRC[(live[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (live[:n] >> np.uint32(8))
    state[order] = live
    return ~state


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of every word."""
    data = LOWER[data]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:n + 1] = _LETTERS[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:n + 1] & (~solid[:n] | border[:n]))
    ends = np.flatnonzero(solid[1:n + 1] & (~solid[2:] | border[1:])) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _features(data, offsets, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature (runs of ``low`` to ``high`` words, joined by a space), and words of each row."""
    data, starts, ends, row = _words(data, offsets)
    found, rows = [], []
    space = np.full(1, 32, np.uint8)
    state = crc32(data, starts, ends)
    for size in range(1, high + 1):
        if size > 1:  # one word more behind each run that stays in its text
            more = np.flatnonzero(row[:len(row) - size + 1] == row[size - 1:])
            held = np.zeros(len(row), np.uint32)
            before = crc32(space, np.zeros(len(more), np.int64), np.ones(len(more), np.int64), state[more])
            held[more] = crc32(data, starts[more + size - 1], ends[more + size - 1], before)
            state = held
        else:
            more = np.arange(len(row))
        if size >= low:
            found.append(state[more] % np.uint32(buckets))
            rows.append(row[more])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows), np.bincount(row, minlength=len(offsets) - 1)


def bucket_counts(df: DataFrame, text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket.  A task hands on one row a bucket; nulls have no features."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(_features(data, offsets, low, high, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most ``buckets`` rows
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole-number log ratio of each bucket's smoothed shares, target over corpus."""
    many = len(corpus)
    of_corpus, of_target = float(corpus.sum() + many), float(target.sum() + many)
    return np.array([math.floor(scale * math.log((t + 1.0) * of_corpus / ((s + 1.0) * of_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    """``df`` with ``n_words``, ``n_features`` and ``weight``, the floored mean of its features' gains (none: 0)."""
    new = ["n_words", "n_features", "weight"]
    kept = [c for c in df.columns if c.lower() not in new]
    asked = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in new])
    many = len(gain)

    def run(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch.column(len(kept))):
                n = len(offsets) - 1
                bucket, row, words = _features(data, offsets, low, high, many)
                held = np.bincount(row, minlength=n)
                total = np.zeros(n, np.int64)
                np.add.at(total, row, gain[bucket])
                weight = np.where(held > 0, total // np.maximum(held, 1), 0)
                own = [batch.column(i).slice(first, n) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (words, held, weight))], names=kept + new)

    return asked.mapInArrow(run, schema)


def noise(doc_id: str, seed: int = SEED, scale: int = SCALE) -> Column:
    """Whole-number Gumbel noise of an id: from the first 8 hex digits of sha256(``seed:id``); a null id is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _bisect(rows: DataFrame, column: str, down: bool, k: int) -> int | None:
    """The value at which the first ``k`` rows of ``rows`` in the order of a whole-number column end: exact counts only.

    A job counts the rows before each of ``2 ** STEPS - 1`` evenly spaced values.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    low, high = int(low), int(high)
    while low < high:
        parts = 1 << STEPS
        marks = sorted({low + (high - low) * i // parts for i in range(1 if down else 0, parts + (1 if down else 0))} - ({low} if down else {high}))
        seen = rows.agg(*[F.count_if(F.col(column) >= F.lit(m) if down else F.col(column) <= F.lit(m)) for m in marks]).first()
        enough = [m for m, n in zip(marks, seen) if n >= k]
        short = [m for m, n in zip(marks, seen) if n < k]
        if down:
            low, high = max(enough, default=low), min(short, default=high + 1) - 1
        else:
            low, high = max(short, default=low - 1) + 1, min(enough, default=high)
    return low


def draw(scored: DataFrame, k: int, eligible: Column, doc_id: str = "doc_id", score: str = "score", row: str = "row") -> DataFrame:
    """``scored`` with ``rank`` (1, 2, ...) for the ``k`` eligible rows of the highest score, ties to the smaller id.

    ``scored`` is a written table whose column ``row`` numbers its rows; rows of
    one score and id go by that number, null ids after all others.  Ids other
    than whole numbers are not bisected: all rows tied at the last score are
    ranked, and those beyond ``k`` lose their rank.
    """
    scored = scored.drop("rank")
    if k <= 0:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    able = scored.where(eligible)
    least = _bisect(able, score, True, k)
    taken = F.col(score) >= least
    if isinstance(scored.schema[doc_id].dataType, INTEGERS):
        above = able.where(F.col(score) > least).count()
        tied = able.where(F.col(score) == least)
        named = tied.where(F.col(doc_id).isNotNull())
        if k - above <= named.count():
            last = _bisect(named, doc_id, False, k - above)
            taken = (F.col(score) > least) | ((F.col(score) == least) & (F.col(doc_id) <= last))
    taken = F.coalesce(eligible & taken, F.lit(False))
    order = [F.desc(score), F.asc_nulls_last(doc_id), F.asc(row)]
    parts = cut(scored.where(taken).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    ranked = parts.join(F.broadcast(sizes), "_part").withColumn("rank", (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("bigint")))


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 10,
             min_words: int = 20, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``df`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn).

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred
    (rounded down) are drawn: those of the highest score, ties to the smaller
    id.  Null and empty texts have no features, weight 0, and cannot be drawn
    unless ``min_words`` is 0.  Rows that repeat an id share its noise and are
    drawn one by one.  Without target rows, weights say what is rare in the
    corpus; an empty table gives no rows.  Whole texts are read, of any length.
    Columns of ``df`` with the names of the new ones are replaced, all others
    stay, ``text`` included.
    """
    new = ["n_words", "n_features", "weight", "score", "rank"]
    gain = gains(bucket_counts(df, text, low, high, buckets), bucket_counts(target, target_text, low, high, buckets))
    others = [c for c in df.columns if c.lower() not in new]
    held = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_kept")
    rows = weigh(df.select(held, F.col(doc_id).alias("_id"), F.col(text).alias("_whole")), gain, "_whole", low, high).drop("_whole")
    scored = cut(rows.withColumn("score", (F.col("weight") + noise("_id", seed)).cast("bigint")).withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    k = percent * scored.where(able).count() // 100
    return draw(scored, k, able, "_id", "score", "_row").select("_kept.*", *new)
