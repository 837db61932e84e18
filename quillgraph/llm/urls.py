"""URL filters: fixed rules first, then gradient-boosted trees on lexical features.

The trees learn from the URLs that a rule judges and decide the others.
DataFrame and ML functions only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import salted_join

SAMPLE = 20_000    # judged URLs that the trees learn from, about
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# (verdict, host, path): fixed rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up
    to ``?``, ``#`` or the end.  Both are empty without ``://`` or for a null url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, CAPITALS, CAPITALS.lower()), path


def judged(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits (its string and verdict, or nulls): host or a subdomain, and the start of the path."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col(host) == domain) | F.endswith(F.col(host), F.lit("." + domain))) & F.startswith(F.col(path), F.lit(start))
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _count(text: Column, of: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, of, ""))).cast("double")


def features(url: str = "_url", host: str = "_host", path: str = "_path") -> dict[str, Column]:
    """Lexical features of a URL; null urls count as empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    # Shannon entropy in bits: a term for every distinct character, counted by taking it out.
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    entropy = F.aggregate(terms, F.lit(0.0), lambda s, k: s - F.when(k > 0, k / n * F.log2(k / n)).otherwise(F.lit(0.0)))
    return {
        "f_length": F.length(text).cast("double"), "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"), "f_depth": _count(F.col(path), "/"),
        "f_digits": _count(text, "0123456789") / n, "f_entropy": entropy,
        "f_parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(F.lit(0.0)),
        "f_labels": _count(F.col(host), "."), "f_hyphens": _count(text, "-"), "f_escapes": _count(text, "%"),
        "f_fragment": F.contains(text, F.lit("#")).cast("double"), "f_secure": F.startswith(text, F.lit("https")).cast("double"),
    }


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """``(suffix, f_seen, f_allowed)`` of every host suffix of one or two labels: the logarithm of the
    number of URLs, and the smoothed share of those allowed among those with a verdict."""
    long = rows.select(F.explode(F.array_distinct(F.array("_s1", "_s2"))).alias("suffix"), "_given")
    found = long.groupBy("suffix").agg(
        F.count("*").alias("n"), F.sum((F.col("_given") == "allow").cast("int")).alias("good"), F.count("_given").alias("known"))
    return found.select("suffix", F.log1p("n").alias("f_seen"), ((F.coalesce("good", F.lit(0)) + 1) / (F.col("known") + 2)).alias("f_allowed"))


def learning_sample(rows: DataFrame, seen: dict[str, int], sample: int, key: list[str], given: str = "_given") -> DataFrame:
    """About ``sample`` of the ``rows`` with a verdict, half of either one as far as there are, by a hash of the ``key``
    columns, with ``_weight``, which gives the verdicts their shares among all rows back."""
    kinds = {k: min(n, max(sample / 2, sample - sum(seen.values()) + n)) / n for k, n in seen.items()}
    share, weight = F.lit(0.0), F.lit(0.0)
    for kind, part in kinds.items():
        share = F.when(F.col(given) == kind, F.lit(part)).otherwise(share)
        weight = F.when(F.col(given) == kind, F.lit(1 / part)).otherwise(weight)
    spot = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(3)), F.lit(1 << 30))
    return rows.where(F.col(given).isNotNull() & (spot < share * (1 << 30))).withColumn("_weight", weight)


def verdicts(df: DataFrame, rules=RULES, url: str = "url", sample: int = SAMPLE, rounds: int = 15, depth: int = 4) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` (allow or block) and ``score``.

    A rule's verdict holds; for other URLs, null and malformed ones included,
    the trees decide (``score`` is their chance of allow).  They learn from about
    ``sample`` rows with a rule, see ``learning_sample``.  If the rules gave one
    verdict only, it holds for all, and ``allow`` if they gave none.
    """
    new = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in df.columns if c.lower() not in new]
    host, path = parts(F.col("_url"))
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], F.col(f"`{url}`").alias("_url"))
    rows = rows.withColumns({"_host": host, "_path": path})
    rule, verdict = judged(rules, "_host", "_path")
    rows = rows.withColumns({
        "_rule": rule, "_given": verdict, "_s1": F.substring_index("_host", ".", -1), "_s2": F.substring_index("_host", ".", -2)})
    seen = {r["_given"]: r["n"] for r in rows.groupBy("_given").agg(F.count("*").alias("n")).collect() if r["_given"]}
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)]
    own = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule")]
    if len(seen) < 2:
        only = next(iter(seen), "allow")
        return rows.select(*names, *own, F.coalesce("_given", F.lit(only)).alias("verdict"), F.lit(float(only == "allow")).alias("score"))
    statistics = suffix_statistics(rows)
    key = [f"_c{i}" for i, c in enumerate(kept) if "map<" not in df.schema[c].dataType.simpleString()] + ["_url"]
    measured = rows.withColumn("_spot", F.xxhash64(*key))
    for name in ("s1", "s2"):
        own_name = statistics.select(F.col("suffix").alias(f"_{name}"), F.col("f_seen").alias(f"f_seen_{name}"), F.col("f_allowed").alias(f"f_allowed_{name}"))
        measured = salted_join(measured, own_name, f"_{name}", "_spot", "left")
    measured = measured.withColumns(features())
    measured = measured.fillna({"f_seen_s1": 0.0, "f_seen_s2": 0.0, "f_allowed_s1": 0.5, "f_allowed_s2": 0.5})
    inputs = sorted(c for c in measured.columns if c.startswith("f_"))
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(measured)
    learned = learning_sample(ready, seen, sample, key).select("_x", (F.col("_given") == "allow").cast("double").alias("_y"), "_weight")
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_weight", maxIter=rounds, maxDepth=depth, maxBins=64, seed=5).fit(learned)
    rated = trees.transform(ready).withColumn("_score", vector_to_array("probability")[1])
    chosen = F.coalesce("_given", F.when(F.col("_score") >= 0.5, "allow").otherwise("block"))
    return rated.select(*names, *own, chosen.alias("verdict"), F.col("_score").alias("score"))
