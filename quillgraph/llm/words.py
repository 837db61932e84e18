"""Words of whole texts as arrays: byte positions and 64-bit hashes, a block of rows at a time.

Used inside Arrow tasks.  A word is a run of bytes that are none of space and
tab to carriage return; A-Z count as lower case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOLS = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SLICE = 3000  # rows that a task turns into results at a time
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, size: int = 1 << 20, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets from 0)`` of runs of whole rows: ``size`` bytes or one row, at most ``rows`` rows."""
    data, offsets = raw(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = max(a + 1, min(b, a + rows, n))
        yield a, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:n + 1] = SPACES[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    solid = ~gap[1:n + 1]
    starts = np.flatnonzero(solid & (gap[:n] | border[:n]))
    ends = np.flatnonzero(solid & (gap[2:] | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= MIX
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of byte ranges from running sums of symbol values times powers of an odd number (modulo 2^64)."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = max(n + 1, 1 << 20)
            back = np.uint64(pow(int(STEP), -1, 2**64))
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
                for x in (STEP, back))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(SYMBOLS[data] * self.up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


class Index:
    """Places of distinct 64-bit keys, looked up a whole array at a time (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.asarray(keys, np.uint64), np.uint64(0))
        n = len(self.keys) - 1
        size = 1 << max(4, int(2 * n).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        left = np.arange(n, dtype=np.int32)
        at = (self.keys[:n] & self.mask).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            miss = self.slots[at] != left
            left, at = left[miss], (at[miss] + 1) & int(self.mask)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for an unknown one."""
        at = (asked & self.mask).astype(np.int64)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != asked))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != asked[wrong])]
        return found


def totals(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their weights."""
    kinds, place = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(place, weights, minlength=len(kinds))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def slices(batch: pa.RecordBatch, size: int | None, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows: ``SLICE`` of them, with ``size`` no more than that many bytes in column ``at`` (or one row)."""
    if size is None:
        yield from (batch.slice(a, SLICE) for a in range(0, batch.num_rows, SLICE))
    else:
        yield from (batch.slice(a, len(offsets) - 1) for a, _, offsets in blocks(batch.column(at), size, SLICE))


def added(df: DataFrame, columns: list[str], fields: list[T.StructField], make: Callable, size: int | None = None) -> DataFrame:
    """``df`` with new columns from ``make()``, called once a task: a function of ``columns`` (Arrow arrays) that
    gives the new arrays.  A column of ``df`` that has the name of a new one is replaced.  ``size`` bounds the
    bytes of the first of ``columns`` that are handed over at once."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    inputs = [f"_in_{c}" for c in columns]
    asked = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in zip(columns, inputs)])
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches):
        work = make()
        for batch in (part for whole in batches for part in slices(whole, size, len(kept))):
            done = work(*[batch.column(len(kept) + i) for i in range(len(inputs))])
            arrays = [batch.column(i) for i in range(len(kept))] + list(done)
            yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in fields])

    return asked.mapInArrow(run, schema)


def fold(column: str, n: int):
    """``crc32(id as text) mod n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
