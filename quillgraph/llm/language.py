"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier on hashed letter trigrams
(log-odds of two mixtures of languages) predicts each bit.  Decoding sums the
logistic loss of the bits against a codeword, weighted by how well the bit's
two sides can be told apart, and takes the nearest codeword.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LOWER, added, blocks

BUCKETS = 8192
UNKNOWN = "und"
# Bytes that are no part of a word: ASCII other than letters (all other bytes belong to letters).
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 0


def _trigrams(column: pa.Array):
    """``(first row, rows, bucket counts)`` for blocks of texts; every text is put between separators."""
    padded = pc.binary_join_element_wise(" ", column.fill_null(""), " ", "")
    for first, data, offsets in blocks(padded):
        rows = len(offsets) - 1
        b = PLAIN[data].astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code *= np.uint32(0x9E3779B1)
        bucket = (code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        dull = (b[1:-1] == 0)
        ends = offsets[1:]
        for back in (1, 2):  # trigrams that reach into the next text
            at = ends - back
            dull[at[(at >= 0) & (at < len(dull))]] = True
        row = np.repeat(np.arange(rows), np.diff(offsets))[:len(bucket)]
        use = ~dull
        counts = np.bincount(row[use] * BUCKETS + bucket[use], minlength=rows * BUCKETS)
        yield first, rows, counts.reshape(rows, BUCKETS)


def trigram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, bucket, n)`` over whole texts with a language; each task sums its own rows first."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for first, rows, counts in _trigrams(batch.column(0)):
                own = names[first:first + rows]
                for name in set(own):
                    part = counts[own == name].sum(axis=0)
                    sums[name] = sums[name] + part if name in sums else part
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    parts = rows.mapInArrow(run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to seven languages get all 2^(k-1) - 1 ways of parting them; more get
    fixed random words of 15 log2(k) bits in which no column is constant.
    """
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        sides = [set(s) | {0} for r in range(k) for s in combinations(range(1, k), r) if len(s) < k - 1]
        return np.array([[1.0 if i in s else -1.0 for s in sides] for i in range(k)])
    rng, bits = np.random.default_rng(7), int(np.ceil(15 * np.log2(k)))
    words = np.where(np.arange(k)[:, None] % 2 == 0, 1.0, -1.0).repeat(bits, axis=1)
    return rng.permuted(words, axis=0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """The bit classifiers, from the trigram counts of all labelled rows.

    What reaches the driver is one vector of 8,192 counts per language.
    """
    rows = trigram_counts(labelled, text, lang).toPandas()
    names = sorted(rows["lang"].unique()) if len(rows) else []
    if not names:
        return {"names": []}
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, rows["lang"]), rows["bucket"]] = rows["n"]
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    words = codewords(len(names))
    odds, apart = [], []
    for bit in words.T:
        yes = share[bit > 0].mean(axis=0) if (bit > 0).any() else share.mean(axis=0)
        no = share[bit < 0].mean(axis=0) if (bit < 0).any() else yes
        w = np.log(yes) - np.log(no)
        odds.append(w)
        apart.append(max(float(((yes - no) * w).sum()) / 2, 1e-9))  # half of Jeffreys' divergence: a usual margin
    apart = np.array(apart)
    return {"names": names, "words": words, "odds": np.array(odds).T / apart, "weights": np.sqrt(apart) / np.sqrt(apart).sum()}


def decode(margins: np.ndarray, lengths: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Best language and the score of every language, from the mean margin of each bit.

    A margin near 1 is that of an ordinary text; the slope of the loss grows
    with the number of trigrams seen, up to 200.
    """
    slope = 8.0 * np.sqrt(np.minimum(lengths, 200) / 200.0) * len(model["weights"])
    agree = margins[:, None, :] * model["words"][None, :, :]
    loss = (np.logaddexp(0.0, -2.0 * agree) * model["weights"]).sum(axis=2) * slope[:, None]
    likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
    likely /= likely.sum(axis=1, keepdims=True)
    return likely.argmax(axis=1), likely


def identify(df: DataFrame, model: dict, text: str = "text", margin: float = 0.2, prefix: str = "") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, their names after ``prefix``.

    Whole texts are used.  A null text, or one without a letter, is ``und``
    with score 0 and not ambiguous, as is every text if no language was
    learned.  A text is ambiguous if the two best scores are nearer than
    ``margin``; among equal scores the first name wins.
    """
    fields = [T.StructField(prefix + "lang_pred", T.StringType()), T.StructField(prefix + "score", T.DoubleType()),
              T.StructField(prefix + "ambiguous", T.BooleanType())]

    def make():
        names = np.array(model["names"] + [UNKNOWN], object)

        def work(column):
            n = len(column)
            best, score, close = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n, bool)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if len(names) > 1:
                for first, rows, counts in _trigrams(column):
                    seen = counts.sum(axis=1)
                    own, likely = decode(counts @ model["odds"] / np.maximum(seen, 1)[:, None], seen, model)
                    at = np.flatnonzero(letters[first:first + rows])
                    top = -np.sort(-likely, axis=1)
                    best[first + at], score[first + at] = own[at], top[at, 0]
                    if likely.shape[1] > 1:
                        close[first + at] = (top[:, 0] - top[:, 1] < margin)[at]
            return pa.array(names[best], pa.string()), pa.array(score), pa.array(close)

        return work

    return added(df, [text], fields, make)


def keep_known(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language, with their own columns.

    ``und`` is rejected.  Ambiguity is a flag, no reason to drop a row.
    """
    marked = identify(docs, model, text, prefix="_lid_")
    return marked.where(F.col("_lid_lang_pred") != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
