"""The queries of the operators: thin contracts over the operators' own results."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import bpe, filter_audit, fingerprints, language, packing, pii, quality_rules, secret_scan, sentencepiece_codec, sharding, similarity, toxicity, whitening
from trailweave.llm.common import crc_of_id, table

#: Folder of the public vocabulary files; a parameter, never a copy.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.pmod(crc_of_id(), F.lit(5)) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"), "score", "predicted", "n_spans", "spans")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = language.train(docs.filter(~out))
    return language.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_langs", "langs")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    entries = quality_rules.apply_policy(quality_rules.ledger(docs))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        quality_rules.fails(quality_rules.BASE).alias("base_failed"),
        "kept", "failures",
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymise(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    placed = sharding.assign(rows, F.col("digest"), F.struct("doc_id", "digest"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents", "doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the whitening, which SQL can state."""
    return whitening.deviations(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return filter_audit.audit(filter_audit.facts(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
    "whitening_deviation": whitening_deviation,
}

ORACLE_SQL = {
    "op6_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS r
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
                + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
                + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
                + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
                + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
                + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
""",
    "op13_filter_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, fails),
o(filter_order, step, state, filter) AS (
  SELECT '', 0, 0, -1
  UNION ALL SELECT filter_order || chr(65 + f), step + 1, CASE WHEN filter < 0 THEN 0 ELSE state + (1 << filter) END, f
  FROM o, (SELECT CAST(unnest(range(5)) AS INTEGER) AS f) WHERE step < 5 AND NOT contains(filter_order, chr(65 + f))),
e AS (SELECT d.filter_order, o.step, o.state, o.filter FROM o JOIN o d ON d.step = 5 AND starts_with(d.filter_order, o.filter_order) WHERE o.step > 0),
r AS (SELECT part, filter_order, step, filter,
             sum(CASE WHEN fails & state = 0 AND (fails >> filter) & 1 = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN fails & state = 0 AND (fails >> filter) & 1 = 1 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails & state <> 0 AND (fails >> filter) & 1 = 1 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = 1 << filter THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails & state = 0 AND (fails >> filter) & 1 = 1 THEN g ELSE 0 END) AS good_lost,
             sum(CASE WHEN fails & state = 0 AND (fails >> filter) & 1 = 1 THEN x ELSE 0 END) AS toxic_lost
      FROM c, e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
""",
    "whitening_deviation": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS v
           FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT i, sum(c) AS total, count(*) AS n FROM (SELECT unnest(v) AS c, generate_subscripts(v, 1) AS i FROM x) GROUP BY i),
t AS (SELECT list(CAST(total AS HUGEINT) ORDER BY i) AS totals, max(n) AS n FROM s)
SELECT vec_id, n, CAST(list_sum(list_transform(list_zip(v, totals), lambda z: (n * z[1] - z[2]) * (n * z[1] - z[2]))) AS BIGINT) AS deviation FROM x, t
""",
}
