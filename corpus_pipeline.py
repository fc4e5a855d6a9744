"""A corpus pipeline of five stages over documents: each works on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bulletin.llm import bpe, mixing, neardup, substrings, toxicity
from bulletin.llm.common import documents, forgotten, scope, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the nearest labelled examples don't call toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more): one with the smallest doc_id, null last. Rows without words are in no group."""
    return neardup.one_of_each(docs, width=5, part=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 50 bytes that also start in one with a smaller doc_id."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them: up to three times."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, for every row."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: SQL can't express the suffix, sketch and neighbour stages; tests hold each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself goes when its result is written, and that when the next one's is."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        scope(spark, own := f"{name} {uuid.uuid4().hex}")
        out = stage(spark, docs, sf_dir)
        scope(spark, "")
        docs = written(out, f"stage-{name}")
        scope(spark, "", after=own)
        if before is not None:
            forgotten(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
