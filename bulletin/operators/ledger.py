"""Costs, caches, budgets and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import patterns as P


def cache_key(*fields: Column) -> Column:
    """A digest of the fields in order; null and empty differ."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat_ws("|", *[part(c) for c in fields]), 256)


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests that the cache doesn't have, one of each key."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def replayed(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their cached answers; one that isn't there is an error."""
    hit = requests.join(cache, key, "left")
    return hit.withColumn("answer", F.when(F.col("answer").isNull(), F.raise_error(F.lit("not in the replay cache")).cast("string")).otherwise(F.col("answer")))


def cached(requests: DataFrame, cache: DataFrame, mode: str, answer: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """requests with an answer. off: all are asked; record: those that the cache lacks, one of each key; replay: none, and one that the cache lacks is an error.

    answer makes (key, answer) of requests; the cache is (key, answer), one row a key.
    """
    if mode == "replay":
        return replayed(requests, cache, key)
    if mode == "off":
        return requests.join(answer(requests.dropDuplicates([key])).select(key, "answer"), key, "left")
    if mode != "record":
        raise ValueError(f"not a cache mode: {mode}")
    known = cache.select(key, "answer").unionByName(answer(misses(requests, cache, key)).select(key, "answer"))
    return requests.join(known, key, "left")


def _price(model: Column, i: int) -> Column:
    table = F.create_map(*[F.lit(x) for m, p in P.PRICES.items() for x in (m, p[i])])
    return F.coalesce(F.try_element_at(table, model), F.lit(0.0))


def cost(model: Column, prompt: Column, completion: Column) -> Column:
    """To four places, halves to even; in decimals, so that a half is one."""
    exact = lambda i: _price(model, i).cast("decimal(12,8)")
    return F.bround(prompt.cast("decimal(18,0)") * exact(0) + completion.cast("decimal(18,0)") * exact(1), 4).cast("double")


def estimate(model: Column, system: Column, user: Column, max_tokens: Column, reserved: Column) -> Column:
    return (F.length(system) + F.length(user)) * _price(model, 0) + (max_tokens + reserved) * _price(model, 1)


def daily(calls: DataFrame, ts: str, amount: str) -> DataFrame:
    return calls.where(F.col(amount) > 0).groupBy(F.to_date(ts).alias("day")).agg(F.round(F.sum(amount), 4).alias("cost"))


def monthly(days: DataFrame) -> DataFrame:
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.round(F.sum("cost"), 4).alias("cost"))


def budget_status(days: DataFrame, today: Column, day_limit: float, month_limit: float) -> DataFrame:
    """One row: what was spent today and this month, to two places, and both limits. days is (day, cost)."""
    same_month = F.date_format("day", "yyyy-MM") == F.date_format(today, "yyyy-MM")
    spent = lambda hit: F.round(F.coalesce(F.sum(F.when(hit, F.col("cost"))), F.lit(0.0)), 2)
    return days.agg(spent(F.col("day") == today).alias("today_krw"), spent(same_month).alias("month_krw"), F.lit(day_limit).alias("daily_limit_krw"), F.lit(month_limit).alias("monthly_limit_krw"))


def recorded(items: DataFrame, record: DataFrame, key: str, value: str) -> DataFrame:
    """items with the array that a record has for their key, an empty one where it has none. record is (key, value), one row a key."""
    kind = record.schema[value].dataType
    return items.join(record.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.array().cast(kind)))


def admitted(calls: DataFrame, by: list[str], order: list[str], estimated: str, actual: str, day_limit: float, month_limit: float) -> DataFrame:
    """Calls in order, one budget a group: rejected where day or month would go over, and then not spent.

    Each decision needs all before it, so a group's calls pass through one task in order; of them only the sums so far are held.
    """
    keys = StructType([calls.schema[c] for c in by])
    own = calls.withColumn("_day", F.to_date(order[0])).select(*by, *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)], F.unix_date("_day").alias("_day"), F.date_format("_day", "yyyy-MM").alias("_month"), F.col(estimated).cast("double").alias("_estimate"), F.col(actual).cast("double").alias("_cost"))
    sorted_rows = own.repartition(*by).sortWithinPartitions(*by, *[f"_order{i}" for i in range(len(order))])
    names = [*by, "admitted", "rejected", "month", "spent_month", "spent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, state, out = None, None, []

        def rows() -> pa.RecordBatch:
            kinds = [*[first.schema.field(c).type for c in by], pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        first = None
        for b in batches:
            first = b if first is None else first
            who = list(zip(*[b.column(c).to_pylist() for c in by]))
            for key, day, month, estimate, cost in zip(who, *[b.column(c).to_pylist() for c in ("_day", "_month", "_estimate", "_cost")]):
                if key != account:
                    if state is not None:
                        out.append((*account, *state[:2], *state[3:]))
                    account, state = key, [0, 0, None, None, 0.0, 0.0]
                    spent_day = 0.0
                spent_day = spent_day if state[2] == day and day is not None else 0.0
                spent_month = state[4] if state[3] == month and month is not None else 0.0
                ok = estimate is not None and spent_day + estimate <= day_limit and spent_month + estimate <= month_limit
                more = max(cost or 0.0, 0.0) if ok else 0.0
                spent_day += more
                state = [state[0] + ok, state[1] + (not ok), day, month, spent_month + more, state[5] + more]
            if len(out) > 10_000:
                yield rows()
                out = []
        if state is not None:
            out.append((*account, *state[:2], *state[3:]))
        if out:
            yield rows()

    kinds = StructType([*keys.fields, *[StructField(n, k) for n, k in zip(names[len(by) :], (LongType(), LongType(), StringType(), DoubleType(), DoubleType()))]])
    return sorted_rows.mapInArrow(run, kinds).withColumn("spent", F.round("spent", 4))


def may_retry(elapsed_s: Column, last_ms: Column, cached: Column) -> Column:
    """Whether another call fits into the deadline, as long as the last one took."""
    expected = F.when(last_ms.isNull(), P.FIRST_S).when(cached, P.CACHED_S).otherwise(last_ms / 1000)
    return F.lit(P.DEADLINE_S) - elapsed_s >= expected + P.SPARE_S


def status(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in P.STATUS.items() for x in kv]), code)
