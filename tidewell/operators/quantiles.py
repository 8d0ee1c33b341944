"""Exact percentiles by distributed selection: counts first, then only the values of the buckets that hold the ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import Scratch

#: A bucket is sorted in one task only if it holds at most so many values; a larger one is split.
MOST_VALUES = 100_000
#: Buckets to each doubling of the value, and into how many a large bucket is split.
STEPS, SPLIT = 64, 1024


def bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: at most 275,000 of them, for all doubles."""
    level = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * STEPS).cast("int") + 100_000
    return F.when(v > 0, level).when(v < 0, -level).otherwise(0)


def holding(cells: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """``cells`` with ``before``: how many values of the group stand in cells before this one."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))


def _same(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], scratch: Scratch, most: int = MOST_VALUES) -> DataFrame:
    """(keys, values, p): of each group the number of values that are neither null nor NaN, and its percentiles in the order
    of ``shares``, interpolated between neighbours. Groups without a value are missing; null keys are a group.

    The first pass counts values by bucket, combined before the shuffle; a group has a bounded number of buckets. While the bucket of a wanted rank
    holds more than ``most`` values, not all equal, a pass splits it. The last pass sorts the values of the wanted
    buckets, equal ones counted once. So no task holds a group, however large, and ``rows`` are read once a pass: give a written table.
    Bounds and ranks (a few rows a group) are written to ``scratch``."""
    keys = list(keys)
    held = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    cells = held.groupBy(*keys, bucket(F.col("v")).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = holding(cells, keys, "b").withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    places = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), (F.ceil(p) if up else F.floor(p)).cast("long").alias("rank")) for i, p in enumerate(places) for up in (0, 1)])
    inside = lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("c"))
    found = cells.select(*keys, "n", "c", "lo", "hi", "before", F.explode(F.filter(ranks, inside)).alias("r"))
    found = found.select(*keys, "n", F.col("r.i").alias("i"), (F.col("r.rank") - F.col("before")).alias("rank"), "c", "lo", "hi")
    found = scratch.put(found, "ranks")
    large = (F.col("c") > most) & (F.col("lo") < F.col("hi"))
    while found.where(large).limit(1).count():
        wide = found.where(large).select(*keys, "n", "i", "rank", "lo", "hi")
        met = held.alias("r").join(wide.alias("t"), [*_same("r", "t", keys), F.col("r.v") >= F.col("t.lo"), F.col("r.v") <= F.col("t.hi")])
        width = F.col("t.hi") / 2 - F.col("t.lo") / 2  # halves, as a difference may leave the doubles
        part = F.floor((F.col("r.v") / 2 - F.col("t.lo") / 2) / width * SPLIT)
        group = [*keys, "n", "i", "rank"]
        split = met.select(*[F.col(f"t.{g}").alias(g) for g in group], "r.v", part.alias("b")).groupBy(*group, "b")
        split = holding(split.agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")), group, "b").where("rank >= before AND rank < before + c")
        split = split.select(*keys, "n", "i", (F.col("rank") - F.col("before")).alias("rank"), "c", "lo", "hi")
        last, found = found, scratch.put(found.where(~large).unionByName(split), "ranks")
        scratch.drop(last)
    single = found.where("lo = hi").select(*keys, "n", "i", F.col("lo").alias("v"))
    few = found.where("lo < hi").select(*keys, "n", "i", "rank", "lo", "hi")
    met = held.alias("r").join(few.alias("t"), [*_same("r", "t", keys), F.col("r.v") >= F.col("t.lo"), F.col("r.v") <= F.col("t.hi")])
    group = [*keys, "n", "i", "rank"]
    counted = met.groupBy(*[F.col(f"t.{g}").alias(g) for g in group], F.col("r.v").alias("v")).agg(F.count("*").alias("c"))
    sorted_ = holding(counted, group, "v").where("rank >= before AND rank < before + c").select(*keys, "n", "i", "v")
    at = lambda j: F.max(F.when(F.col("i") == j, F.col("v")))
    ends = single.unionByName(sorted_).groupBy(*keys, "n").agg(*[at(j).alias(f"v{j}") for j in range(2 * len(shares))])
    after = [p - F.floor(p) for p in places]
    mixed = [F.col(f"v{2 * i}") * (1 - d) + F.col(f"v{2 * i + 1}") * d for i, d in enumerate(after)]
    return ends.select(*keys, F.col("n").alias("values"), F.array(*mixed).alias("p"))


def prefix_sums(a: Column) -> Column:
    """Prefix sums of an array of longs by doubling: as many rounds as its size has bits, so long arrays cost little more than their size."""
    n = F.size(a)
    zero = F.lit(0).cast("long")
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    shifted = lambda acc, r: F.concat(F.array_repeat(zero, F.pow(F.lit(2), r).cast("int")), acc)
    return F.aggregate(rounds, a, lambda acc, r: F.slice(F.zip_with(acc, shifted(acc, r), lambda x, y: x + y), 1, n))
