"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Sources get shares of all words in proportion to their weights. A source's target stops at ``most`` times its
size, and what it leaves is shared again by weight among the others (the level that this converges to is found
in closed form over the sources' sizes). A source whose target is t and size s takes every document
floor(t / s) times, and once more those whose hash lies below a threshold. The threshold comes from a
histogram: words by source and by the first bits of the hash, running sums over the buckets, then the same
over the next bits of the boundary bucket only, until the bits end; rows are then filtered by one comparison
each and never sorted. What is left of the budget is smaller than the next document, so the search is nested:
it goes on among the documents that are not taken yet and fit into what is left.

Null text has no words. Null sources are one source, which sorts last. Documents without words are in no
bucket and take nothing. Repeated rows are rows of their own when their doc_id differs; rows with equal doc_id
and text share a hash and are taken together or not at all. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Bits of the hash that one histogram looks at, and how many histograms refine each threshold.
BITS, LEVELS = 10, 3
#: Searches one inside the other, each among the documents that still fit.
NESTED = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sizes (source, source_size) with weight and target. One row a source; the sorts below are over sources, not documents."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    whole = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    most_of = most * F.col("source_size")
    filled = weighed.withColumn("_cap", most_of).withColumn("_all", F.sum("source_size").over(whole))
    # If this source and all after it were free, the level would be: what the sources before it leave, over the weights from here on.
    filled = filled.withColumn("_level", (F.col("_all") - (F.sum("_cap").over(upto) - F.col("_cap"))) / F.sum("weight").over(after))
    filled = filled.withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    level = F.min(F.when(F.col("_free"), F.struct(F.col("source_size") / F.col("weight"), F.col("_level")))).over(whole)["_level"]
    return filled.withColumn("_final", level).withColumn("target", F.coalesce(F.least("_cap", F.col("_final") * F.col("weight")), F.col("_cap"))).select("source", "source_size", "weight", "target")


def _threshold(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """budget (sid, left) with below: the largest hash bound such that the rows under it hold at most `left` words, and what they hold."""
    state = budget.withColumn("low", F.lit(0).cast("long")).withColumn("got", F.lit(0).cast("long"))
    for level in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - level))
        inside = rows.join(state.select("sid", "low"), "sid").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * (1 << BITS)))
        buckets = inside.groupBy("sid", F.floor((F.col("h") - F.col("low")) / width).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        upto = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        full = buckets.withColumn("upto", F.sum("words").over(upto)).join(state, "sid").where(F.col("got") + F.col("upto") > F.col("left"))
        # The first bucket that goes over the budget; where none does, all rows are below the bound.
        edge = full.groupBy("sid").agg(F.min(F.struct("bucket", "upto", "words")).alias("e"))
        state = written(
            state.join(edge, "sid", "left").select(
                "sid", "left",
                F.when(F.col("e").isNull(), F.col("low") + width * (1 << BITS)).otherwise(F.col("low") + F.col("e.bucket") * width).alias("low"),
                F.when(F.col("e").isNull(), F.col("got")).otherwise(F.col("got") + F.col("e.upto") - F.col("e.words")).alias("got"),
            ),
            "mix-threshold",
        )
    return state


def _hash() -> Column:
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), 32 - BITS * LEVELS)


def taken(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs with size, source_size, target and taken; taken is a whole number of copies times size, at most `most`.

    The plan by source and the thresholds are written tables without a broadcast hint: Spark broadcasts them while
    their files are under its threshold and else joins by source, where adaptive execution splits a hot source.
    """
    base = written(docs.select("source", n_words().alias("size"), _hash().alias("h")), "mix-rows")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("long")
    plan = written(plan.withColumn("copies", copies).withColumn("left", F.floor(F.col("target") - F.col("copies") * F.col("source_size") + 1e-6).cast("long")).withColumnRenamed("source", "_source"), "mix-plan")
    left, bounds = plan.select("sid", "left"), []
    open_rows = base.join(plan.select("_source", "sid"), F.col("source").eqNullSafe(F.col("_source"))).where("size > 0").select("sid", "size", "h")
    for _ in range(NESTED):
        # Only documents that fit into what is left, which shrinks below the size of the document at the last bound.
        fit = open_rows.join(left.where("left > 0"), "sid").where(F.col("size") <= F.col("left")).select("sid", "size", "h")
        found = _threshold(fit, left.where("left > 0"))
        bounds.append(found.select("sid", F.col("left").alias("most_size"), "low"))
        open_rows = open_rows.join(bounds[-1], "sid", "left").where("low is null or size > most_size or h >= low").select("sid", "size", "h")
        left = found.select("sid", (F.col("left") - F.col("got")).alias("left"))
    clash = ["size", "source_size", "target", "taken"]
    out = docs.drop(*clash).withColumn("size", n_words()).withColumn("_h", _hash())
    out = out.join(plan.select("_source", "source_size", "target", F.col("sid").alias("_sid"), F.col("copies").alias("_copies")), F.col("source").eqNullSafe(F.col("_source")))
    chosen = F.lit(False)
    for i, b in enumerate(bounds):
        out = out.join(b.select(F.col("sid").alias("_sid"), F.col("most_size").alias(f"_m{i}"), F.col("low").alias(f"_l{i}")), "_sid", "left")
        chosen = chosen | F.coalesce((F.col("size") <= F.col(f"_m{i}")) & (F.col("_h") < F.col(f"_l{i}")), F.lit(False))
    once_more = F.when(chosen & (F.col("size") > 0) & (F.col("_copies") < most), 1).otherwise(0)
    out = out.withColumn("taken", (F.col("size") * (F.col("_copies") + once_more)).cast("long"))
    return out.select(*[c for c in docs.columns if c not in clash], *clash)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, in the columns of docs."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    own = [F.col(c) for c in docs.columns]
    return taken(docs, weights, most).where("taken > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), times))).select(*own)
