"""The training-data operators over whole tables, and SQL where it can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    decontaminate, language, licenses, mixing, ngram_lm, onebit_search, periodic_runs, secret_scan, simhash, token_alignment, token_store,
    toxicity, url_filter, word_lm,
)
from .common import fold_of, table

TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return onebit_search.search(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0), k=10)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies_by_document(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.LanguageModel.fit(docs.where(~held_out))
    return model.predict(docs, {"doc_id": F.col("doc_id").cast("long"), "held_out": held_out})


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model, {"doc_id": F.col("doc_id").cast("long"), "held_out": held_out})
    return scored.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("block_probability")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lm.score(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), ngram_lm.FOLDS))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, secret_scan.KINDS),
        _sha256(written(F.filter("spans", lambda s: s["kind"] != secret_scan.LEARNED))).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; where crc32 of the id ends in 0, the words from some place on repeat those that begin there, as op12's contract says."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    cut = kept.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.expr("nullif(cardinality(w), 0)")).withColumn("g", F.expr("h div 10"))
    placed = cut.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.scan(with_planted_period(table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        _sha256(F.array_join(lines, "")).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.agreement(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_nearest, op3_licenses, op4_mixing, op5_language, op6_tokens, op7_toxicity, op8_decontamination, op9_urls, op10_lm,
        op11_secrets, op12_periods, op13_alignment,
    )
}

_WEIGHTS = ", ".join(f"{w}e0" for w in mixing.WEIGHTS)
_PLAIN = r"[^\x20\x09-\x0D]+"
_LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                     AND len([x FOR x IN embedding IF x <> 0]) > 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(q.e, c.e)], lambda a, b: a + b)) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # The level rises as long as sources below it are capped, then falls: its maximum holds.
    "op4_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_PLAIN}')) AS size FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                          [{_WEIGHTS}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w
                   FROM d GROUP BY source),
             c AS (SELECT *, {mixing.CEILING}e0 * source_size AS cap, {mixing.CEILING}e0 * source_size / w AS ratio FROM s),
             l AS (SELECT *, ({mixing.SHARE}e0 * sum(source_size) OVER ()
                              - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
             t AS (SELECT source, source_size,
                          least(cap, w * (SELECT max(level) FROM l)) AS target FROM l),
             r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM d)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(size * CASE WHEN source_size = 0 THEN 0 ELSE
                   floor({mixing.offset()!r} + target / source_size * k) - floor({mixing.offset()!r} + target / source_size * (k - 1))
               END AS BIGINT) AS taken
        FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_AZ}, ''), '{_LETTER}') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(coalesce({_AZ}, ''), '{_LETTER}') AS w FROM benchmark),
             bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS phrase FROM (
                        SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p
                        FROM b WHERE len(w) > 0)),
             dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS phrase FROM (
                        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
                        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
             m AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (n, phrase)),
             h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
             i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                          string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
