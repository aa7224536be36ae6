"""A training corpus from raw documents: quality rules, exact and near duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs.  All but the last return the
columns of documents.  As a stage's result is written before the next begins,
what it kept in the shared folder for itself is dropped by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import exact_dedup, fertility, mixing, packing, simhash
from docweave.llm._spark import documents, written
from docweave.llm.queries import vocabulary
from docweave.sources.store import drop, noted


_kept: list[str] = []  # folders of the stage before


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _kept)
        with noted(_kept):
            return work(spark, docs, sf_dir)

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_ordinary(docs, fertility.Rules(vocabulary("piece_bpe_32k.model")))


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Blocks long enough to train on.
    return mixing.mixed_documents(docs, mixing.Mix(block=512))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drop(spark, _kept)
    return packing.pack(docs, packing.Packing(vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Learned bands, fingerprints and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        made, own = stage(spark, docs, sf_dir), []
        with noted(own):
            docs = written(made)
        drop(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
