"""Spending by day: the same aggregation over a batch and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_spend(calls: DataFrame, late: str | None = None) -> DataFrame:
    """Cost by day of calls (ts, value); of a stream, with a watermark of `late`, a day is final once it is that far past."""
    if calls.isStreaming:
        calls = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "1 day")
    spent = calls.where("value > 0").groupBy(F.window("ts", "1 day").alias("w")).agg(F.round(F.sum("value"), 4).alias("cost"))
    return spent.select(F.to_date("w.start").alias("day"), "cost")
