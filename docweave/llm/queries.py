"""Queries over the tables, one per operator, with SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import exact_dedup, fertility, interpolation, line_dedup, mixing, packing, pii, simhash, token_counts, toxicity
from docweave.llm._spark import documents


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; DOCWEAVE_VOCABULARIES may name another folder."""
    folder = os.environ.get("DOCWEAVE_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(documents(spark, sf_dir))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.Packing(vocabulary("word_bpe_49k.json")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_measures(documents(spark, sf_dir), fertility.Rules(vocabulary("piece_bpe_32k.model")))


def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scored(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_pack_sequences, op4_exact_dedup, op5_simhash, op6_fertility, op7_interpolated_lm, op8_toxicity, op9_personal_data, op10_mix_sources)}

#: Upper-case letters A-Z and no others are lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_line_dedup": """
        WITH l AS (SELECT doc_id, substr(md5(text), 1, 15) AS tie, string_split(text, chr(10)) AS parts FROM documents),
        w AS (SELECT doc_id, tie, i AS line, parts[i + 1] || chr(10) || parts[i + 2] || chr(10) || parts[i + 3] AS body
              FROM (SELECT doc_id, tie, parts, unnest(range(0, len(parts) - 2)) AS i FROM l)),
        o AS (SELECT doc_id, tie, line, rank() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, tie, line) AS r FROM w),
        c AS (SELECT DISTINCT doc_id, tie, line + k AS line FROM o, (VALUES (0), (1), (2)) AS t(k) WHERE r > 1),
        g AS (SELECT doc_id, tie, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM c GROUP BY doc_id, tie)
        SELECT l.doc_id, coalesce(len(l.parts), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.removed, '') AS removed
        FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.tie IS NOT DISTINCT FROM g.tie""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
}
