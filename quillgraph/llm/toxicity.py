"""Toxicity from two word models, one learned from toxic and one from ordinary texts.

Both models interpolate discounted joint shares of pairs; they are not Kneser-Ney models.  Below
the pairs of a class stand its text counts (in how many texts, rather than how often, a word
occurs), and below those the text counts of both classes together, so
that a rare word or expression says little about the class.  A text is compared by the
length-normalised log-likelihoods of its windows and of the whole, and the two
differences become a score by logistic regression on texts kept out of the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LOWER, STEP, Hasher, Index, added, blocks, find_words, mixed, signed, totals

PER_CLASS = 8000   # labelled texts of either class that are learned from, about
WINDOWS = (1, 3)    # words
SELDOM = 8         # words and pairs in fewer of these texts are backed off wholly
SIGNS = ["narrow", "wide", "whole"]
BEGIN = np.uint64(0x5851F42D4C957F2D)


def _pairs(hasher, data, offsets):
    """Word hash, hash of the word before (BEGIN at the start of a text) and row."""
    data = LOWER[data]
    starts, ends, row = find_words(data, offsets)
    own = hasher(data, starts, ends)
    before = np.roll(own, 1)
    if len(own):
        before[np.flatnonzero(np.diff(row, prepend=-1))] = BEGIN
    return own, before, row


def _joint(before, own):
    return mixed(before * STEP + own)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``(u, v, toxic, plain)`` of ``(text, y)``: in how many texts of either class word v follows u, and, where u
    is null, in how many texts v occurs.  A text that repeats itself counts once."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in blocks(batch.column(0), 4 << 20, 4096):
                own, before, row = _pairs(hasher, data, offsets)
                for single, key in ((True, own), (False, _joint(before, own))):
                    at = np.unique(mixed(key ^ mixed(row.astype(np.uint64) * STEP)), return_index=True)[1]
                    kinds, some, place = np.unique(key[at], return_index=True, return_inverse=True)
                    y = label[first + row[at]]
                    toxic, plain = (np.bincount(place[y == c], minlength=len(kinds)) for c in (1, 0))
                    u = signed(before[at][some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u, mask=np.full(len(u), single)), pa.array(signed(own[at][some])), pa.array(toxic), pa.array(plain)],
                        names=["u", "v", "toxic", "plain"])

    parts = texts.mapInArrow(run, "u bigint, v bigint, toxic bigint, plain bigint")
    return parts.groupBy("u", "v").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def sample(labels: DataFrame, per_class: int, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``(doc_id, y, part)`` of about ``per_class`` labelled ids of either class; part 1, a quarter, is for calibration.

    The higher label of an id counts; null ids and labels are left out.
    """
    one = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    one = one.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(per_class / max(sizes.get(1, 0), 1))).otherwise(F.lit(per_class / max(sizes.get(0, 0), 1)))
    return one.where(spot < share * (1 << 30)).withColumn(
        "part", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0).cast("int"))


def _discount(counts: list) -> float:
    """Ney's discount from the numbers of things seen once and twice."""
    once, twice = counts
    return once / (once + 2 * twice) if once else 0.5


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seldom: int = SELDOM, text: str = "text",
        doc_id: str = "doc_id") -> dict:
    """The two models as one table of log-likelihood differences, and the calibration.

    Learned from a sample of about ``per_class`` texts of either class.  The sample's ids are
    broadcast (at most some 2 x ``per_class`` rows), so no text is shuffled, and
    the expressions in ``seldom`` or more texts of the sample are all that reaches the driver.
    """
    chosen = F.broadcast(sample(labels, per_class))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    counts = pair_counts(texts.where("part = 0").select("text", "y")).persist()
    pairs, words = counts.where("u IS NOT NULL"), counts.where("u IS NULL").drop("u")
    classes = ("toxic", "plain")
    seen = lambda c, k: F.sum((F.col(c) == k).cast("bigint")).alias(f"{c}{k}")
    sizes = [seen(c, k) for c in classes for k in (1, 2)] + [F.sum(c).alias(f"n_{c}") for c in classes] + [
        F.sum((F.col(c) > 0).cast("bigint")).alias(f"t_{c}") for c in classes] + [F.count("*").alias("types")]
    top, low = pairs.agg(*sizes).first(), words.agg(*sizes).first()
    if not low["types"] or not low["n_toxic"] or not low["n_plain"]:
        counts.unpersist()
        return {"prior": _prior(texts)}
    d1 = {c: _discount([low[f"{c}1"], low[f"{c}2"]]) for c in classes}
    size, types = float(low["n_toxic"] + low["n_plain"]), float(low["types"])

    # What a class leaves to the counts below it is the same for both, so that something new tells nothing.
    own = {c: d1[c] * low[f"t_{c}"] / low[f"n_{c}"] for c in classes}
    rest = max(own.values())
    shared = F.lit(rest) * (F.col("toxic") + F.col("plain") + 1) / F.lit(size + types + 1)
    p_word = {c: F.greatest(F.col(c) - F.lit(d1[c]), F.lit(0.0)) * F.lit((1 - rest) / max(1 - own[c], 1e-9) / low[f"n_{c}"]) + shared
              for c in classes}
    words = words.select("v", (F.col("toxic") + F.col("plain")).alias("n"), shared.alias("ps"), p_word["toxic"].alias("pt"), p_word["plain"].alias("pp"))
    words = words.where(F.col("n") >= seldom)
    # A pair backs off to its share in both classes, tilted as the model below tilts its second word.
    bent = {c: _discount([top[f"{c}1"], top[f"{c}2"]]) for c in classes}
    kept = max(bent[c] * top[f"t_{c}"] / max(top[f"n_{c}"], 1) for c in classes)
    both = (F.col("toxic") + F.col("plain")) / F.lit(float(top["n_toxic"] + top["n_plain"]))
    p = {c: F.lit(1 - kept) * F.greatest(F.col(c) - F.lit(bent[c]), F.lit(0.0)) / F.lit(float(max(top[f"n_{c}"], 1)))
         + F.lit(kept) * both * F.col(f"p{c[0]}") / F.col("ps") for c in classes}
    known = pairs.where(F.col("toxic") + F.col("plain") >= seldom).join(words, "v")
    expressions = known.select("u", "v", F.log(p["toxic"] / p["plain"]).alias("odds")).toPandas()
    single = words.select("v", F.log(F.col("pt") / F.col("pp")).alias("odds")).toPandas()
    counts.unpersist()
    code = lambda s: s.to_numpy(np.int64).view(np.uint64)
    table = {
        "words": code(single["v"]), "odds": np.append(single["odds"].to_numpy(np.float32), 0.0),
        "pairs": _joint(code(expressions["u"]), code(expressions["v"])),
        "pair_odds": np.append(expressions["odds"].to_numpy(np.float32), 0.0),
    }
    tried = texts.where("part = 1").select("y", "text")
    rows = evidence(tried, table).select("y", *SIGNS).toPandas()
    table["line"] = calibrate(rows[SIGNS].to_numpy(), rows["y"].to_numpy(), _weights(labels, rows["y"]))
    return table


def _prior(texts: DataFrame) -> float:
    row = texts.agg(F.avg("y").alias("p")).first()
    return float(row["p"] or 0.0)


def _weights(labels: DataFrame, y) -> tuple[float, float]:
    """Weights that give the calibration texts the classes' true shares."""
    rows = {r["y"]: r["n"] for r in labels.select(F.col("toxic").cast("int").alias("y")).dropna().groupBy("y").agg(F.count("*").alias("n")).collect()}
    whole, own = max(sum(rows.values()), 1), max(len(y), 1)
    return tuple(rows.get(c, 0) / whole / max((y == c).sum() / own, 1e-9) for c in (0, 1))


def calibrate(x: np.ndarray, y: np.ndarray, weights=(1.0, 1.0), rounds: int = 50) -> list[float]:
    """Logistic regression with a small ridge, by Newton steps: weights and intercept."""
    if not len(y):
        return [2.5, 0.0, 0.0, -6.0]
    z = np.column_stack([np.nan_to_num(x), np.ones(len(y))])
    w, part = np.zeros(z.shape[1]), np.where(y == 1, weights[1], weights[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (part * (y - p)) - 0.1 * w
        w = w + np.linalg.solve((z * (part * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), slope)
    return w.tolist()


def evidence(df: DataFrame, table: dict, text: str = "text", windows: tuple = WINDOWS) -> DataFrame:
    """``df`` with ``narrow``, ``wide`` and ``whole``: the greatest difference of the two log-likelihoods per word
    among windows of either length, and that of the whole text.

    A text shorter than a window counts as one window of the full length.
    Null and empty texts have 0 for all.
    """
    fields = [T.StructField(name, T.DoubleType()) for name in SIGNS]
    shared = df.sparkSession.sparkContext.broadcast({k: v for k, v in table.items() if k != "line"})

    def make():
        t = shared.value
        words, pairs, hasher = Index(t["words"]), Index(t["pairs"]), Hasher()

        def work(column):
            found = np.zeros((len(SIGNS), len(column)))
            for first, data, offsets in blocks(column, 1 << 20, 4096):
                own, before, row = _pairs(hasher, data, offsets)
                if not len(own):
                    continue
                place = words(own)
                new = np.flatnonzero(np.diff(row, prepend=-1))
                joint = pairs(_joint(before, own))
                value = np.where(joint >= 0, t["pair_odds"][joint], t["odds"][place]).astype(float)
                run = np.concatenate([[0.0], np.cumsum(value)])
                texts, lengths = row[new], np.diff(np.append(new, len(own)))
                found[2, first + texts] = (run[new + lengths] - run[new]) / lengths
                stop = np.repeat(new + lengths, lengths)
                for i, window in enumerate(windows):
                    spans = (run[np.minimum(np.arange(len(own)) + window, stop)] - run[:-1]) / window
                    found[i, first + texts] = np.maximum.reduceat(spans, new)
            return [pa.array(x) for x in found]

        return work

    return added(df, [text], fields, make)


def score(df: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` (0 to 1, the chance of label 1) and ``predicted`` (1 from ``threshold`` on).

    Whole texts are read.  Null and empty texts get the score of a text
    without evidence.  Where a class had no text to learn from, every score is
    the share of label 1 among those learned from.
    """
    if "prior" in model:
        found = df.drop("score", "predicted").withColumn("score", F.lit(model["prior"]))
    else:
        plain = df.drop("score", "predicted")
        kept = [x for x in plain.columns]
        rows = evidence(plain.select(*[F.col(f"`{x}`").alias(f"_c{i}") for i, x in enumerate(kept)]), model, f"_c{kept.index(text)}")
        sums = sum((F.lit(w) * F.col(x) for w, x in zip(model["line"], SIGNS)), F.lit(model["line"][-1]))
        rated = 1 / (1 + F.exp(-sums))
        found = rows.select(*[F.col(f"_c{i}").alias(x) for i, x in enumerate(kept)], rated.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
