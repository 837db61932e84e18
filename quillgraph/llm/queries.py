"""The registered queries of this subpackage: every operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, language, lattice, lines, lm, pii, resample, shards, simhash, toxicity, urls
from .words import fold

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_url_filters")
def op2(spark, folder):
    rows = urls.verdicts(table(spark, folder, "pages").select("page_id", "url"))
    return rows.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op4_simhash")
def op4(spark, folder):
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op6_language_id")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = fold("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out))
    rows = language.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op8_shards")
def op8(spark, folder):
    rows = shards.assign(table(spark, folder, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_bpe")
def op9(spark, folder):
    rows = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), bpe.load(bpe.vocabulary_path()))
    digest = lambda text: F.sha2(text, 256)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query("op10_toxicity")
def op10(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.fit(docs, labels.where(~held_out))
    rows = toxicity.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op1_decontamination")
def op1(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_pii")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = pii.find(docs, pii.fit(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    count = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", *count, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


@query("op7_embedding_lattice")
def op7(spark, folder):
    return lattice.near_vectors(table(spark, folder, "embeddings"))


@query("op3_lm_scoring")
def op3(spark, folder):
    docs = table(spark, folder, "documents")
    rows = lm.score(docs, fold("doc_id", 7) != 2)
    return rows.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_importance_resampling", sql=f"""
WITH crc AS (
    SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) ORDER BY i) AS t
    FROM range(256) AS bytes(i)),
texts AS (
    SELECT 0 AS side, row_number() OVER () AS r, doc_id, {FOLDED.format("coalesce(text, '')")} AS text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, {FOLDED.format("coalesce(text, '')")} FROM benchmark),
words AS (SELECT side, r, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
named AS (SELECT word, hex(encode(word)) AS h FROM words GROUP BY word),
hashed AS (
    SELECT word, xor(4294967295, list_reduce(
        list_transform(range(length(h) // 2), lambda j: ('0x' || substr(h, (2 * j + 1)::INT, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
    FROM named, crc),
found AS (SELECT side, r, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
totals AS (
    SELECT (SELECT coalesce(sum(n), 0) FROM found WHERE side = 0)::DOUBLE + 10000 AS s,
        (SELECT coalesce(sum(n), 0) FROM found WHERE side = 1)::DOUBLE + 10000 AS t),
counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
    FROM found GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((c.t + 1) * a.s / ((c.s + 1) * a.t)))::BIGINT AS gain FROM counts c, totals a),
weights AS (
    SELECT r, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
    FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
    SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (r) WHERE side = 0),
placed AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS many
    FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * many // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
""")
def op11(spark, folder):
    rows = resample.resample(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_tokenizer_alignment")
def op12(spark, folder):
    rows = alignment.align(table(spark, folder, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = alignment.with_counts(rows.select(*[c for c in rows.columns if c not in ("groups", "text")], digest))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_line_dedup", sql=f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
lines AS (SELECT r, doc_id, unnest(own) AS line, unnest(range(len(own))) AS pos FROM docs),
keyed AS (
    SELECT *, {FOLDED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
judged AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.keeper AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
""")
def op13(spark, folder):
    rows = lines.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
