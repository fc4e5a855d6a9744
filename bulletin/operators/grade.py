"""Grades of extracted against expected values, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import squeezed


def due(failed: Column, present: Column, want: Column, got: Column) -> Column:
    """A label that isn't there is not graded; one that is null has to stay null."""
    there = F.when(got.isNull(), "missed").when(got == want, "correct").otherwise("wrong")
    return F.when(failed | ~present, "skip").when(want.isNull() & got.isNull(), "correct_null").when(want.isNull(), "hallucinated").otherwise(there)


def kind(failed: Column, want: Column, got: Column) -> Column:
    return F.when(failed | want.isNull(), "skip").when(got.eqNullSafe(want), "correct").otherwise("wrong")


def posting(reason: Column, failed: Column, want_kind: Column, likely: Column) -> Column:
    denied = reason.eqNullSafe(F.lit("NOT_A_POSTING"))
    return F.when(denied, F.when(~likely, "correct").otherwise("false_positive")).when(failed | want_kind.isNull(), "skip").when(likely, "correct").otherwise("false_negative")


def questions(failed: Column, present: Column, want: Column, got: Column) -> Column:
    return F.when(failed | ~present, "skip").when(want == got, "correct").when(got > want, "false_positive").otherwise("missed")


def matches(a: Column, b: Column) -> Column:
    """Equal but for blanks and case, or one within the other where both have two characters."""
    x, y = squeezed(a), squeezed(b)
    short = (F.length(x) < 2) | (F.length(y) < 2)
    return (F.length(x) > 0) & (F.length(y) > 0) & F.when(short, x == y).otherwise(F.contains(y, x) | F.contains(x, y))


def qualification(present: Column, wants: Column, got: Column) -> Column:
    """wants is an array of accepted answers, null if there is to be none."""
    none = F.coalesce(F.length(got), F.lit(0)) == 0
    graded = F.when(wants.isNull() & none, "correct_null").when(wants.isNull(), "hallucinated").when(none, "missed").when(F.exists(wants, lambda w: matches(w, got)), "correct").otherwise("wrong")
    return F.when(present, graded)


def lists(gold: Column, found: Column, forbidden: Column) -> Column:
    n = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: matches(x, y))))
    return F.struct(F.size(gold).alias("gold"), n(gold, found).alias("hit"), F.size(found).alias("pred"), n(found, gold).alias("pred_hit"), n(found, forbidden).alias("forbidden"))


def confusion(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, grade, n) from one column of grades a metric."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("grade")) for m in metrics])).alias("x")).select("x.*").where("grade is not null").groupBy("metric", "grade").agg(F.count("*").alias("n"))


def accuracy(counts: DataFrame) -> DataFrame:
    """(metric, graded, correct, accuracy) without what is skipped; null where nothing is graded."""
    graded = F.sum(F.when(F.col("grade") != "skip", F.col("n")).otherwise(0))
    right = F.sum(F.when(F.col("grade").isin("correct", "correct_null"), F.col("n")).otherwise(0))
    return counts.groupBy("metric").agg(graded.alias("graded"), right.alias("correct"), (right / F.nullif(graded, F.lit(0))).alias("accuracy"))


def micro(rows: DataFrame, column: str) -> DataFrame:
    """Recall and precision as ratios of sums over structs of :func:`lists`; null structs are not graded."""
    total = lambda f: F.sum(f"{column}.{f}")
    return rows.agg(total("gold").alias("gold"), total("hit").alias("hit"), total("pred").alias("pred"), total("pred_hit").alias("pred_hit"), total("forbidden").alias("forbidden")).select("*", (F.col("hit") / F.nullif("gold", F.lit(0))).alias("recall"), (F.col("pred_hit") / F.nullif("pred", F.lit(0))).alias("precision"))


def length(chars: Column, limit: Column) -> Column:
    bounded = F.when(chars > limit, "over").when(chars < limit * (2 / 3), "under").otherwise("ok")
    return F.when(limit > 0, bounded).when(chars < 400, "short").when(chars > P.DEFAULT_DRAFT, "long").otherwise("ok")


def expectation(want: dict[str, Column], got: dict[str, Column], no_call: Column, calls: Column) -> Column:
    """Names of the expectations that a row misses; a null expectation is not graded."""
    missed = [F.when(want[k].isNotNull() & (want[k] != (F.length(F.coalesce(got[k], F.lit(""))) > 0)), F.lit(k)) for k in sorted(want)]
    return F.filter(F.array(*missed, F.when(F.coalesce(no_call, F.lit(False)) & (calls > 0), F.lit("noCall"))), lambda x: x.isNotNull())
