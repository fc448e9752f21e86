"""Registered queries of the text operators and of the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.llm import (
    html_text,
    joined_bpe,
    line_dedup,
    lookup_sharding,
    merkle,
    near_dedup,
    piece_table,
    pii,
    quality_model,
    quality_rules,
    secret_formats,
    slot_negatives,
    templates,
)
from tablewatch.llm.shared import table

SHARDS = [f"shard-{k:02d}" for k in range(16)]
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_formats.secrets(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = lookup_sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.kept_lines(table(spark, sf_dir, "documents"), keys=line_dedup.ANCHORED, whole=True)
    return kept.select(
        "doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"),
        F.concat_ws(",", F.col("kept").cast("array<string>")).alias("kept_lines"),
    )


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return slot_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_quality_rules, op3_secrets, op4_decontamination, op5_sharding, op6_near_dedup, op7_html_text,
        op8_pieces, op9_line_dedup, op10_quality_model, op11_hard_negatives, op12_byte_pieces,
        op13_merkle_manifest, pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op5_sharding": f"""
WITH placed AS (
    SELECT doc_id, CAST(list_reduce(list_transform(string_split(substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {lookup_sharding.DIGITS}), ''),
               lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, b: a * 16 + b) % {lookup_sharding.SLOTS} AS BIGINT) AS slot
    FROM documents
)
SELECT doc_id, slot, ({[SHARDS[k] for k in lookup_sharding.lookup_table(SHARDS)]})[slot + 1] AS shard FROM placed
""",
    "op11_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same,
           CAST(coalesce(list_sum(list_transform(range(1, least(len(a.e), len(v.e)) + 1), lambda i: a.e[i] * v.e[i])), 0) AS BIGINT) AS score
    FROM v AS a JOIN v ON a.vec_id <> v.vec_id
    WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
    "op13_merkle_manifest": """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), d AS (
    SELECT doc_id, coalesce('+' || lang, '') AS lane, concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
               coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
               coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
           text, 4294967295 - list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
               lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295) AS sum
    FROM documents, crc
), leaf AS (
    SELECT doc_id, lane, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
           sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS other,
           row_number() OVER (PARTITION BY lane ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lane) AS n
    FROM (SELECT *, CASE WHEN sum % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM d)
), node AS (
    SELECT 0 AS level, lane, pos, n, h FROM leaf
    UNION ALL
    SELECT level + 1, lane, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY level, lane, n, pos // 8
), sub AS (
    SELECT lane, h AS subroot, row_number() OVER (ORDER BY lane) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
    SELECT 0 AS level, pos, n, subroot AS h FROM sub
    UNION ALL
    SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, n, pos // 8
), beside AS (
    SELECT level, tier, lane, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM (SELECT 1 AS tier, level, lane, pos, n, h FROM node UNION ALL SELECT 2, level, '', pos, n, h FROM top)
    WHERE n > 1
    WINDOW w AS (PARTITION BY tier, level, lane, pos // 8 ORDER BY pos)
), low AS (
    SELECT lane AS own, pos AS spot, 0 AS level, pos, '' AS proof, other AS acc FROM leaf
    UNION ALL
    SELECT own, spot, low.level + 1, low.pos // 8, proof || l || r, sha256(l || acc || r)
    FROM low JOIN beside ON tier = 1 AND lane = own AND beside.level = low.level AND beside.pos = low.pos
), high AS (
    SELECT own, spot, 0 AS level, sub.pos, proof, acc
    FROM (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY own, spot ORDER BY level DESC) = 1) JOIN sub ON lane = own
    UNION ALL
    SELECT own, spot, high.level + 1, high.pos // 8, proof || l || r, sha256(l || acc || r)
    FROM high JOIN beside ON tier = 2 AND beside.level = high.level AND beside.pos = high.pos
)
SELECT doc_id, leaf.h AS leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM leaf JOIN sub USING (lane), (SELECT h AS root FROM top WHERE n = 1), high
WHERE own = leaf.lane AND spot = leaf.pos
QUALIFY row_number() OVER (PARTITION BY own, spot ORDER BY level DESC) = 1
""",
}
