"""What the operators of this subpackage share: the shared folder, written tables, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.postings import spread
from ..sources.scratch import dropped, forgotten, noted, scope, shared_dir, small_batches, written

__all__ = ["documents", "dropped", "forgotten", "hot_join", "noted", "scope", "shared_dir", "small_batches", "written"]

#: A key with more than one row in HOT_SHARE counts as hot, so there are at most HOT_SHARE hot keys: the bound of what is broadcast.
HOT_SHARE = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """left joined with right, which has one row per key and, in the column weight, how many rows of left have it.

    Rows of left whose key is hot (more than total / HOT_SHARE rows) meet a broadcast of at most HOT_SHARE
    rows and are not shuffled by the key; the rest is shuffled, and no key of the rest is large.
    """
    most = max(1, total // HOT_SHARE)
    hot = right.where(F.col(weight) > most)
    cold = right.where(F.col(weight) <= most)
    mark = left.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    first = mark.where("_hot is not null").drop("_hot").join(F.broadcast(hot), key)
    return first.unionByName(mark.where("_hot is null").drop("_hot").join(cold, key, how))
