"""Event operators: histories, sessions, windows, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_history(rows: DataFrame, key: str, time: str, tie: str, tracked: Sequence[str]) -> DataFrame:
    """The rows that differ from the one before of their key, with ``state`` (first or
    changed), ``changed`` (names of the columns that did) and how many there were before."""
    w = Window.partitionBy(key).orderBy(time, tie)
    before = {c: F.lag(c).over(w) for c in tracked}
    first = F.row_number().over(w) == 1
    out = rows.withColumn("is_first", first)
    for c in tracked:
        out = out.withColumn(f"prev_{c}", before[c])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"prev_{c}")), F.lit(c)) for c in tracked]))
    out = out.withColumn("changed", F.when(F.col("is_first"), F.array().cast("array<string>")).otherwise(names))
    out = out.where(F.col("is_first") | (F.size("changed") > 0))
    return out.withColumn("state", F.when(F.col("is_first"), "first").otherwise("changed"))


def price_delta(old: Column, new: Column, old_currency: Column, new_currency: Column) -> Column:
    """Ratio, amount and direction of a price change; none if the currency changed."""
    comparable = old_currency.eqNullSafe(new_currency) & (old > 0)
    ratio = F.round(((new - old) / old).cast("decimal(20,8)"), 4).cast("double")
    way = F.when(new > old, "up").when(new < old, "down").otherwise("same")
    return F.when(comparable, F.struct((new - old).alias("amount"), ratio.alias("ratio"), way.alias("direction")))


def sessions(rows: DataFrame, key: str, time: str, tie: str, gap: str) -> DataFrame:
    """Rows with the number of their session: a new one begins after a gap."""
    w = Window.partitionBy(key).orderBy(time, tie)
    begins = F.coalesce((F.col(time) - F.expr(f"interval {gap}") > F.lag(time).over(w)).cast("int"), F.lit(1))
    numbered = rows.withColumn("begins", begins)
    return numbered.withColumn("session", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def counts_until(rows: DataFrame, key: str, time: str, now: str, days: Sequence[int]) -> DataFrame:
    """Rows of each key in the last so many days before ``now``, one column for each span."""
    at = F.lit(now).cast("timestamp_ntz")
    own = [
        F.count_if((F.col(time) > at - F.expr(f"interval {d} days")) & (F.col(time) <= at)).alias(f"last_{d}d") for d in days
    ]
    return rows.groupBy(key).agg(*own)


def cycles(rows: DataFrame, key: str, time: str, tie: str, state: str, gone: str, back: str, days: int) -> DataFrame:
    """Times each key came back within ``days`` after it had gone, and whether it did thrice."""
    w = Window.partitionBy(key).orderBy(time, tie)
    before, when = F.lag(state).over(w), F.lag(time).over(w)
    steps = rows.withColumn("before", before).withColumn("gone_at", when)
    is_cycle = (F.col("before") == gone) & (F.col(state) == back) & (F.col(time) <= F.col("gone_at") + F.expr(f"interval {days} days"))
    out = steps.groupBy(key).agg(F.count_if(is_cycle).alias("cycles"))
    return out.withColumn("flagged", F.col("cycles") >= 3)


def crawl_state(observed: Column, known: Column, empty_streak: Column, complete: Column) -> Column:
    """What a crawl's result allows: confirmed empty needs three spaced empty scans, and a
    removal of over nine tenths of the known rows is blocked."""
    gone = F.when(known > 0, 1 - observed / known)
    return (
        F.when((observed == 0) & (empty_streak >= 3), "confirmed_empty")
        .when(observed == 0, "suspect_empty")
        .when(~complete, "partial")
        .when(gone > 0.9, "blocked")
        .otherwise("apply")
    )
