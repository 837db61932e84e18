"""From texts to words: bags (one word array per document) and token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import STOP_WORDS
from .scale import salted_join


def bags(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    stop: Sequence[str] = STOP_WORDS, min_len: int = 1, rule: str = "a", keep: Sequence[str] = (),
    by_document: bool = True,
) -> DataFrame:
    """``(doc_id, words)``: the words of each document in order, stop words left out.

    The texts are dealt out by document first: a text is several times smaller
    than its exploded words, and all later steps per document (counts, norms,
    word windows) then need no further shuffle.  ``by_document=False`` leaves
    the input as it lies, for work that needs no such grouping.
    """
    df = df.select(id_col, text_col, *keep)
    if by_document:
        df = df.repartition(id_col)
    normal = T.normalise_a(text_col) if rule == "a" else T.plain_b(text_col)
    words = T.word_array(normal, stop, min_len)
    return df.select(F.col(id_col).alias("doc_id"), *keep, words.alias("words"))


def words(bags: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, term)``, one row per word.

    The outer form is deliberate: the inner one makes Spark test for empty
    arrays first, and it pushes that test, with the whole text treatment in it,
    below the shuffle into the scan.
    """
    return bags.select(*keep, F.explode_outer("words").alias("term")).where("term IS NOT NULL")


def tokens(bags: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, pos, term)``, one row per word, ``pos`` from 0."""
    rows = bags.select("doc_id", *keep, F.posexplode_outer("words").alias("pos", "term"))
    return rows.where("term IS NOT NULL")


def to_bags(tokens: DataFrame) -> DataFrame:
    """Word arrays rebuilt from token rows; documents without tokens are absent."""
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("r"))
    return rows.select("doc_id", F.col("r.term").alias("words"))


def remove_stop(tokens: DataFrame, stop: Sequence[str] | DataFrame = STOP_WORDS) -> DataFrame:
    """Token rows without stop words; ``stop`` is a list or a table with a ``term`` column."""
    if isinstance(stop, DataFrame):
        return salted_join(tokens, stop.select("term").distinct(), "term", "doc_id", "left_anti")
    return tokens.where(~F.col("term").isin(list(stop)))


def light_stems(terms: DataFrame) -> DataFrame:
    """``(form, stem)`` for every distinct term, by the light rules."""
    return terms.select(F.col("term").alias("form")).distinct().withColumn("stem", T.light_stem(F.col("form")))


def apply_forms(tokens: DataFrame, forms: DataFrame, target: str) -> DataFrame:
    """Replace each term by its entry in ``forms(form, target)``; unknown terms stay."""
    table = forms.select(F.col("form").alias("term"), F.col(target).alias("_new"))
    joined = salted_join(tokens, table, "term", "doc_id", "left")
    return joined.withColumn("term", F.coalesce("_new", "term")).drop("_new")


def stem(tokens: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Stem by a vocabulary table: each distinct term is stemmed once, then joined back."""
    return apply_forms(tokens, light_stems(tokens) if stems is None else stems, "stem")


def lemmatise(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Lemmas from a ``(form, lemma)`` dictionary table."""
    return apply_forms(tokens, lemmas, "lemma")


def ngrams(bags: DataFrame, lo: int = 1, hi: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, pos, n, term)``: runs of ``lo`` to ``hi`` neighbouring words of a document.

    Built inside the row from shifted slices, so no shuffle is needed.
    """
    size = F.size("words")
    runs = []
    for n in range(lo, hi + 1):
        count = F.greatest(size - (n - 1), F.lit(0))
        shifted = F.arrays_zip(*[F.slice("words", i + 1, count).alias(f"w{i}") for i in range(n)])
        rows = bags.select("doc_id", *keep, F.posexplode_outer(shifted).alias("pos", "w")).where("w IS NOT NULL")
        term = F.concat_ws(" ", *[F.col(f"w.w{i}") for i in range(n)])
        runs.append(rows.select("doc_id", *keep, "pos", F.lit(n).alias("n"), term.alias("term")))
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out


def bigrams(bags: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, first, second)`` for neighbouring words."""
    count = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("words", 1, count).alias("first"), F.slice("words", 2, count).alias("second"))
    return bags.select("doc_id", *keep, F.explode_outer(pairs).alias("p")).where("p IS NOT NULL").select(
        "doc_id", *keep, F.col("p.first").alias("first"), F.col("p.second").alias("second")
    )
