"""Similarity scores and the quality of rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length; vectors of different sizes are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different sizes")).cast("double")).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def calibrate(similarity: Column) -> Column:
    """0 to 100; null stays null, which least and greatest would pass over."""
    ratio = (similarity - P.COSINE_ZERO) / F.lit(P.COSINE_FULL - P.COSINE_ZERO)
    return F.when(similarity.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(ratio * 100 + 0.5))).cast("int"))


def keyword_score(keywords: Column, interests: Column) -> Column:
    """Keywords that contain an interest or are within one, out of at most five, in percent."""
    near = lambda k: F.exists(interests, lambda i: F.contains(F.lower(k), F.lower(i)) | F.contains(F.lower(i), F.lower(k)))
    hits = F.size(F.filter(keywords, near))
    score = F.least(F.lit(100), F.floor(hits * 100 / F.least(F.size(keywords), F.lit(5)) + 0.5))
    return F.when((F.size(keywords) == 0) | (F.size(interests) == 0), 0).otherwise(score).cast("int")


def interest_texts(codes: Column, tags: Column, labels: Column) -> Column:
    """Each code, followed by its label where it has one, then the tags."""
    named = F.transform(codes, lambda c: F.filter(F.array(c, F.try_element_at(labels, c)), lambda x: x.isNotNull()))
    return F.concat(F.flatten(named), tags)


def auc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve of each group by average ranks, ties half; null where a class is empty. Scores are counted first, so windows hold distinct scores."""
    tied = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(before), F.lit(0))
    wins = tied.withColumn("wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    sums = wins.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return sums.select(*by, "pos", "neg", (F.col("wins") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auc"))


def r_precision(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Share of the positives among as many best rows; rows tied at the edge count by expectation."""
    tied = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = W.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, -1)
    all_pos = F.sum("pos").over(W.partitionBy(*by))
    room = F.greatest(all_pos - F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(0))
    hits = tied.withColumn("hits", F.least("n", room) * F.col("pos") / F.col("n"))
    return hits.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("hits").alias("hits")).select(*by, "pos", (F.col("hits") / F.nullif("pos", F.lit(0))).alias("r_precision"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def drawn(replicate: int, size: int, seed: int) -> np.ndarray:
    """How often each of `size` items is in one sample with replacement of the same size: a function of its arguments alone."""
    return np.bincount(np.random.default_rng([seed, replicate]).integers(0, size, size), minlength=size)


def _weighted_auc(score: np.ndarray, label: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The area under the curve for each column of times (rows, samples), ties half; nan where a class is empty."""
    order = np.argsort(score, kind="stable")
    score, label, times = score[order], label[order], times[order].astype(np.float64)
    first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    pos, neg = (np.add.reduceat(times * x[:, None], first, axis=0) for x in (label, ~label))
    below = np.cumsum(neg, axis=0) - neg
    with np.errstate(invalid="ignore", divide="ignore"):
        return (pos * (below + neg / 2)).sum(0) / (pos.sum(0) * neg.sum(0))


def bootstrap_auc_difference(base: DataFrame, samples: int = 2000, seed: int = 0, block: int = 100) -> DataFrame:
    """n, low, high: the 95 % interval of the mean difference in AUC of two scores over paired samples; base is (profile, item, a, b, label).

    Every sample draws items anew, the same for all profiles, whose rows are those of one evaluation set. Each profile meets each block of samples in a task of its own.
    """

    def run(key: tuple, data: pa.Table) -> pa.Table:
        items, of = np.unique(data["item"].to_numpy(), return_inverse=True)
        label = np.array(data["label"].to_pylist(), bool)
        at = range(key[1].as_py() * block, min(samples, (key[1].as_py() + 1) * block))
        times = np.stack([drawn(r, len(items), seed)[of] for r in at], axis=1)
        diff = _weighted_auc(data["b"].to_numpy(), label, times) - _weighted_auc(data["a"].to_numpy(), label, times)
        return pa.table({"replicate": pa.array(at, pa.int32()), "diff": pa.array(diff, pa.float64())})

    parts = base.select("profile", "item", "a", "b", F.coalesce("label", F.lit(False)).alias("label"), F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // block))).alias("part"))
    each = parts.groupBy("profile", "part").applyInArrow(run, "replicate int, diff double").where(~F.isnan("diff"))
    mean = each.groupBy("replicate").agg(F.avg("diff").alias("diff"))
    # One row a replicate: as many as were asked for.
    ordered = mean.agg(F.array_sort(F.collect_list("diff")).alias("d"), F.count("*").alias("n"))
    return ordered.select("n", F.try_element_at("d", F.floor(F.col("n") * 0.025).cast("int") + 1).alias("low"), F.try_element_at("d", F.greatest(F.lit(1), F.ceil(F.col("n") * 0.975).cast("int"))).alias("high"))


def pooled_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One area under the curve over the rows of all groups."""
    return auc(rows.withColumn("_all", F.lit(1)), ["_all"], score, label).select("pos", "neg", "auc")
