"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches, the largest ids first.  A run is a table of distinct
line hashes, bucketed and sorted by hash.  Each batch is merge-anti-joined with
the runs: a hash that no run has is new, and the batch's largest id becomes its
keeper; of a known hash only the sightings count.  The batch is then added as a
run of its own, and two runs of one level are merged into one of the next, so
that few runs ever have to be met.
"""

from __future__ import annotations

import uuid
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_folder

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
HOT = 1000  # a hash with more than one in HOT of all lines is hot; there can be no more than HOT of them
STRIP = " \t\n\v\f\r"
KEY = ["k1", "k2"]


def key_of(line: Column) -> Column:
    """What makes two lines the same: white space at both ends gone, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(STRIP)), ascii_uppercase, ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_hash(doc_id: str, text: str) -> list[Column]:
    """128 bits that name a row by its id and text; equal rows lose equal lines."""
    return [F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias(name) for seed, name in ((1, "r1"), (2, "r2"))]


def occurrences(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``(id, r1, r2, k1, k2, pos, first)``: every line that is long enough, ``first`` where its document has it first.

    The lines of a document are sorted by hash inside its row, so a document
    counts once for a line without a shuffle.
    """
    keys = df.select(F.col(doc_id).alias("id"), *_row_hash(doc_id, text), F.transform(split_lines(F.col(text)), key_of).alias("keys"))
    hashed = F.transform("keys", lambda k, i: F.when(
        F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(1), k).alias("k2"), i.alias("pos"))))
    own = keys.select("id", "r1", "r2", F.sort_array(F.filter(hashed, lambda s: s.isNotNull())).alias("own"))
    first = F.transform("own", lambda s, i: F.struct(s["k1"].alias("k1"), s["k2"].alias("k2"), s["pos"].alias("pos"), F.coalesce(
        (F.get("own", i - 1)["k1"] != s["k1"]) | (F.get("own", i - 1)["k2"] != s["k2"]), F.lit(True)).alias("first")))
    return own.select("id", "r1", "r2", F.inline(first))


class Runs:
    """Levelled runs of ``(k1, k2, docs, lines, keeper)``: documents and lines that have the hash, and who keeps it.

    ``levels[i]`` is None or one run.  Runs are written as tables of ``buckets``
    buckets, sorted by hash, so that joins between them move nothing.
    """

    def __init__(self, spark, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{shared_folder(self.spark)}/tables/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch ``(id, k1, k2, first, ...)`` whose ids are smaller than those of all batches before."""
        dealt = lines.groupBy(*KEY).agg(F.count_if("first").alias("docs"), F.count("*").alias("lines"), F.max("id").alias("keeper"))
        own, met = dealt.repartition(self.buckets, *KEY), F.lit(False)
        for i, run in enumerate(self.levels):
            if run is not None:
                own = own.join(run.select(*KEY, F.lit(True).alias(f"met{i}")), KEY, "left")
                met = met | F.coalesce(f"met{i}", F.lit(False))
        run = self._write(own.select(*KEY, "docs", "lines", F.when(~met, F.col("keeper")).alias("keeper"), (~met).alias("held")))
        for level, older in enumerate(self.levels):
            if older is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self._write(_merged(older, run)), None
        self.levels.append(run)

    def whole(self) -> DataFrame:
        """All runs as one."""
        left = [run for run in reversed(self.levels) if run is not None]
        return reduce(_merged, left)

    def forget(self) -> None:
        """Takes the runs out of the catalog; the files stay until the shared folder is cleaned."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two sorted runs as one; a hash is kept by whom the older one names."""
    a, b = (run.select(*KEY, *[F.col(c).alias(f"{c}_{tag}") for c in ("docs", "lines", "keeper", "held")]) for run, tag in ((older, "a"), (newer, "b")))
    total = lambda c: (F.coalesce(f"{c}_a", F.lit(0)) + F.coalesce(f"{c}_b", F.lit(0))).alias(c)
    return a.join(b, KEY, "full").select(
        *KEY, total("docs"), total("lines"), F.when(F.coalesce("held_a", F.lit(False)), F.col("keeper_a")).otherwise(F.col("keeper_b")).alias("keeper"),
        (F.coalesce("held_a", F.lit(False)) | F.coalesce("held_b", F.lit(False))).alias("held"))


def _batches(lines: DataFrame, n: int) -> list[Column]:
    """Conditions on ``id`` that cut the documents into about ``n`` batches of falling ids; null ids are the last."""
    ids = lines.select("id").where("id IS NOT NULL").distinct()
    parts = ids.repartitionByRange(n, F.desc("id")).groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("low"))
    lows = [r["low"] for r in parts.orderBy("part").collect()]
    step = -(-len(lows) // n) if lows else 1
    lows = lows[step - 1:-1:step]
    conditions, above = [], F.lit(True)
    for low in lows:
        conditions.append(above & (F.col("id") >= F.lit(low)))
        above = F.col("id") < F.lit(low)
    return [*conditions, (above | F.col("id").isNull()) if lows else F.lit(True)]


def line_index(lines: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(k1, k2, docs, lines, keeper)`` of every line hash in ``occurrences``."""
    runs = Runs(lines.sparkSession)
    for batch in _batches(lines, batches):
        runs.add(lines.where(batch))
    index = cut(runs.whole().drop("held"))
    runs.forget()
    return index


def drop_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 batches: int = BATCHES) -> DataFrame:
    """``df`` with ``n_lines`` (before), ``n_dropped`` and ``kept``: its text without repeated lines.

    A line of at least ``min_chars`` code points (ends stripped) that at least
    ``min_docs`` rows hold goes everywhere but in the rows of the largest id
    that holds it; there all its lines stay.  A null or empty text is one empty
    line.  Rows are documents: rows that repeat an id count one by one, and if
    that id is the largest all of them keep the line.  A null id is smaller than
    any other; a line that only rows without an id hold stays in all of them.
    An empty table gives no rows.  Columns of ``df`` with the names of the new
    ones are replaced, all others stay.
    """
    new = ["n_lines", "n_dropped", "kept"]
    lines = cut(occurrences(df, doc_id, text, min_chars))
    index = line_index(lines, batches)
    repeated = index.where(F.col("docs") >= min_docs)
    total = index.agg(F.sum("lines")).first()[0] or 0
    hot = F.col("lines") * HOT > total
    few = F.broadcast(repeated.where(hot).select(*KEY, F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot")))
    held = lines.select("id", "r1", "r2", *KEY, "pos").join(few, KEY, "left")
    own = held.where("hot AND NOT (id <=> hot_keeper)").select("r1", "r2", "pos")
    rest = held.where("hot IS NULL").join(repeated.where(~hot), KEY).where("NOT (id <=> keeper)").select("r1", "r2", "pos")
    drops = own.unionByName(rest).groupBy("r1", "r2").agg(F.collect_set("pos").alias("drops"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_row_hash(doc_id, text))
    rows = rows.join(drops, ["r1", "r2"], "left").select("row", "drops", split_lines(F.col("row")[text]).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.coalesce(F.col("row")[text], F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    dropped = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("bigint")
    done = rows.select("row", F.struct(F.size("lines").cast("bigint").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept")).alias("found"))
    return done.select(*[F.col("row")[c].alias(c) for c in df.columns if c.lower() not in new], "found.*")
