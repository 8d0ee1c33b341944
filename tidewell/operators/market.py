"""Each listing's price against the median of its market segment, without pairs of listings.

A listing whose rooms are known is compared with those of as many rooms: a percentile of the group. One without is compared with
areas within max(5, 15 %) of its own: a median over a window of sorted areas, found from counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import bucket, holding, percentiles
from tidewell.session import Scratch

#: Fewest comparables, the area's least reach and share.
LEAST, REACH, SHARE = 3, 5.0, 0.15
CELL = 5.0


def window_values(points: DataFrame, windows: DataFrame, segment: Sequence[str], ranks: Column, scratch: Scratch, inside: Callable[[Column], Column] | None = None, own: DataFrame | None = None) -> DataFrame:
    """(segment, w, n, rank, v): the values at ``ranks`` (an array made of ``n``, from 0) among the ``n`` values ``v`` of ``points`` (segment, x, v, c: how
    often) with x between ``lo`` and ``hi`` of each row of ``windows`` (segment, w, lo, hi), or ``inside`` it, and those that ``own`` (segment, w, v)
    adds to a window. A window adds up counts by price bucket of the whole cells inside it and of the places in its outer cells; then only
    the values of a few buckets are sorted. Windows without a value are missing."""
    seg = list(segment)
    group = [*seg, "w"]
    inside = inside or (lambda x: x.between(F.col("lo"), F.col("hi")))
    cell = lambda x: F.floor(x / CELL)
    points = points.select(*seg, "x", "v", "c", cell(F.col("x")).alias("cell"), bucket(F.col("v")).alias("b"))
    by_cell = points.groupBy(*seg, "cell", "b").agg(F.sum("c").alias("c"))
    by_place = points.groupBy(*seg, "cell", "x", "b").agg(F.sum("c").alias("c"))
    # A cell counts as a whole if both its ends are inside.
    reached = windows.withColumn("cell", F.explode(F.sequence(cell(F.col("lo") - CELL * 1e-6), cell(F.col("hi") + CELL * 1e-6))))
    reached = reached.withColumn("whole", inside(F.col("cell") * CELL) & inside((F.col("cell") + 1) * CELL))
    whole = reached.where("whole").select(*group, "cell").join(by_cell, [*seg, "cell"]).select(*group, "b", "c")
    edges = reached.where("NOT whole").join(by_place, [*seg, "cell"]).where(inside(F.col("x"))).select(*group, "b", "c")
    counts = whole.unionByName(edges)
    if own is not None:
        own = own.select(*group, "v", bucket(F.col("v")).alias("b"), F.lit(1).cast("long").alias("c"))
        counts = counts.unionByName(own.select(*group, "b", "c"))
    counts = counts.groupBy(*group, "b").agg(F.sum("c").alias("c"))
    counts = holding(counts, group, "b").withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    held = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c"))
    found = counts.withColumn("ranks", F.filter(F.array_distinct(ranks), held)).where(F.size("ranks") > 0).select(*group, "n", "b", "before", "ranks")
    found = scratch.put(found.join(windows, group), "buckets")
    values = points.groupBy(*seg, "b", "x", "v").agg(F.sum("c").alias("c"))
    met = found.join(values, [*seg, "b"]).where(inside(F.col("x"))).select(*group, "n", "b", "before", "ranks", "v", "c")
    if own is not None:
        met = met.unionByName(found.select(*group, "n", "b", "before", "ranks").join(own, [*group, "b"]).select(*group, "n", "b", "before", "ranks", "v", "c"))
    met = met.groupBy(*group, "n", "b", "before", "ranks", "v").agg(F.sum("c").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy(*group, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = met.withColumn("before", F.col("before") + below)
    return at.select(*group, "n", F.explode(F.filter("ranks", held)).alias("rank"), "v")


def window_medians(points: DataFrame, windows: DataFrame, segment: Sequence[str], scratch: Scratch, own: DataFrame | None = None) -> DataFrame:
    """(segment, w, n, median) of the values of each window, see ``window_values``."""
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    at = window_values(points, windows, segment, F.array(low, high), scratch, own=own)
    value = lambda r: F.max(F.when(F.col("rank") == r, F.col("v")))
    ends = at.groupBy(*segment, "w", "n").agg(value(low).alias("a"), value(high).alias("z"))
    return ends.select(*segment, "w", "n", (F.col("a") * 0.5 + F.col("z") * 0.5).alias("median"))


def compare(rows: DataFrame, scratch: Scratch, fresh: Column) -> DataFrame:
    """(id, segment_kind, comparables, median, ratio, good_price) of every row that can be compared.

    ``rows``: id, dkey, country, city, district, ptype, deal_key, rooms, area, usd, created_at. A row needs a price, a city, a type, a deal and
    rooms or an area. Comparables are rows marked ``fresh`` with a price, of the same country, city (in any case), type and deal; of the same district
    too if the row has one, else of the whole city; and of as many rooms, or of a near area if the row's rooms are unknown. Of equal keys among a row's
    comparables only the newest counts (then the highest id). With fewer than three comparables median and ratio are null."""
    squeezed = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    base = rows.select(
        "id", "dkey", F.upper("country").alias("country"), squeezed("city").alias("city"), squeezed("district").alias("district"), "ptype", "deal_key",
        F.col("rooms").cast("int").alias("rooms"), F.col("area").cast("double").alias("area"), F.col("usd").cast("double").alias("usd"), "created_at", F.coalesce(fresh, F.lit(False)).alias("fresh"),
    )
    base = scratch.put(base.where("usd IS NOT NULL AND city IS NOT NULL AND ptype IS NOT NULL AND deal_key IS NOT NULL AND country IS NOT NULL"), "market")
    place = ["country", "city", "ptype", "deal_key"]
    # Every comparable stands for its district, if it has one, and for the whole city ('*').
    spread = F.array_compact(F.array(F.lit("*"), F.when(F.col("district") != "*", F.col("district"))))
    offers = base.where("fresh").withColumn("zone", F.explode(spread))
    asking = base.where("rooms IS NOT NULL OR area IS NOT NULL").withColumn("zone", F.coalesce("district", F.lit("*")))
    newest = lambda *by: Window.partitionBy(*by).orderBy(F.desc_nulls_last("created_at"), F.desc("id"))

    seg = [*place, "zone"]
    one = offers.where("rooms IS NOT NULL").withColumn("rn", F.row_number().over(newest(*seg, "rooms", "dkey"))).where("rn = 1")
    by_rooms = percentiles(scratch.put(one.select(*seg, "rooms", "usd"), "rooms"), [*seg, "rooms"], "usd", [0.5], scratch)
    by_rooms = by_rooms.select(*seg, "rooms", F.col("values").alias("n"), F.col("p")[0].alias("median"))
    roomy = asking.where("rooms IS NOT NULL").join(by_rooms, [*seg, "rooms"], "left").select("id", F.lit("rooms").alias("segment_kind"), "usd", "n", "median")

    # A key counts once in a window: its newest row there. A key of one area is so everywhere; the rows of a key of several areas
    # count from the window's point of view, so they are chosen for each window.
    sized = offers.where("area IS NOT NULL").withColumn("rn", F.row_number().over(newest(*seg, "dkey", "area"))).where("rn = 1")
    sized = scratch.put(sized.withColumn("areas", F.count("*").over(Window.partitionBy(*seg, "dkey"))).select(*seg, "dkey", "area", "usd", "created_at", "id", "areas"), "areas")
    reach = F.greatest(F.lit(REACH), F.col("area") * SHARE)
    wide = asking.where("rooms IS NULL").select(*seg, F.col("area").alias("w")).distinct().withColumn("area", F.col("w"))
    wide = scratch.put(wide.select(*seg, "w", (F.col("area") - reach).alias("lo"), (F.col("area") + reach).alias("hi")), "windows")
    plain = sized.where("areas = 1").select(*seg, F.col("area").alias("x"), F.col("usd").alias("v"), F.lit(1).cast("long").alias("c"))
    several = sized.where("areas > 1")
    cells = F.sequence(F.floor(F.col("lo") / CELL), F.floor(F.col("hi") / CELL))
    met = wide.withColumn("cell", F.explode(cells)).join(several.withColumn("cell", F.floor(F.col("area") / CELL)), [*seg, "cell"]).where("area BETWEEN lo AND hi")
    chosen = met.withColumn("rn", F.row_number().over(newest(*seg, "w", "dkey"))).where("rn = 1")
    # Such a choice belongs to one window alone, beside the points that all windows share.
    own = scratch.put(chosen.select(*seg, "w", F.col("usd").alias("v")), "chosen")
    by_area = window_medians(plain, wide, seg, scratch, own)
    sizeable = asking.where("rooms IS NULL").withColumn("w", F.col("area")).join(by_area, [*seg, "w"], "left").select("id", F.lit("area").alias("segment_kind"), "usd", "n", "median")
    out = roomy.unionByName(sizeable)
    enough = F.coalesce("n", F.lit(0)) >= LEAST
    median = F.when(enough, F.floor(F.col("median") * 100 + 0.5) / 100)
    ratio = F.when(median > 0, F.col("usd") / median)
    return out.select("id", "segment_kind", F.coalesce("n", F.lit(0)).cast("long").alias("comparables"), median.alias("median"), ratio.alias("ratio"), F.coalesce(ratio < 1, F.lit(False)).alias("good_price"))

