"""The queries of this subpackage, by name, over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, maxent, media, mixing, neardup, sharding, substrings, tools, topk, toxicity
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_balanced_label_propagation": lambda spark, d: sharding.shard_documents(documents(spark, d)),
    "op2_tool_call_linking": lambda spark, d: tools.link_dialogues(spark.read.parquet(f"{d}/conversations.parquet")),
    "op3_kd_tree_top_k": lambda spark, d: topk.embeddings_top_k(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op4_hash_threshold_mixing": lambda spark, d: mixing.taken(documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken"),
    "op5_suffix_array_dedup": lambda spark, d: substrings.digests(documents(spark, d)),
    "op6_hashed_maxent": lambda spark, d: maxent.score(documents(spark, d)),
    "op7_set_sketch": lambda spark, d: neardup.near_duplicates(documents(spark, d)),
    "op8_byte_bpe": lambda spark, d: bpe.digests(documents(spark, d)),
    "op10_toxicity": lambda spark, d: toxicity.score(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op9_media_columns": lambda spark, d: media.media_columns(documents(spark, d)).drop("shard", "offset"),
}
