"""Every point against every zone of a table: polygons covered by grid cells.

A polygon's box is covered by cells of a size that its extent chooses, at most about 64 x 64. Cells that an edge runs through are border
cells, of the others those inside are found once by their middle. A point meets the polygons of its cell;
only in a border cell the polygon's corners are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import Scratch

CELLS = 64
#: Fixed value: degrees by which the box of an area is widened, of latitude.
PADDING = 0.02
EDGE = "struct<y1:double,x1:double,y2:double,x2:double>"


def _usable(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def edges_of(rings: DataFrame) -> DataFrame:
    """(zone, polygon, edges, holes): of ``rings`` (zone, polygon, ring, corners: array of lat, lng; ring 0 is the outer one) those with at least
    three distinct usable corners; closing corners make no difference. A polygon without a usable outer ring is left out, so it
    holds no point; a hole that isn't usable is no hole."""
    good = F.filter("corners", lambda c: _usable(c["lat"], c["lng"]))
    usable = rings.select("zone", "polygon", "ring", good.alias("c")).where(F.size(F.array_distinct("c")) >= 3)
    n = F.size("c")
    closed = F.zip_with("c", F.concat(F.slice("c", 2, n - 1), F.slice("c", 1, 1)), lambda a, b: F.struct(a["lat"].alias("y1"), a["lng"].alias("x1"), b["lat"].alias("y2"), b["lng"].alias("x2")))
    flat = usable.select("zone", "polygon", "ring", F.filter(closed, lambda e: (e["y1"] != e["y2"]) | (e["x1"] != e["x2"])).cast(f"array<{EDGE}>").alias("edges"))
    outer = flat.where("ring = 0").select("zone", "polygon", "edges")
    holes = flat.where("ring > 0").groupBy("zone", "polygon").agg(F.collect_list("edges").alias("holes"))  # a polygon's own holes
    return outer.join(holes, ["zone", "polygon"], "left").select("zone", "polygon", "edges", F.coalesce("holes", F.array().cast(f"array<array<{EDGE}>>")).alias("holes"))


def _inside(edges: Column, lat: Column, lng: Column) -> Column:
    """Ray casting over an array of edges."""
    cut = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lng < (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]) * (lat - e["y1"]) + e["x1"])
    # a flat edge isn't cut, whatever its quotient
    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when((e["y1"] != e["y2"]) & F.coalesce(F.when(e["y1"] != e["y2"], cut(e)), F.lit(False)), 1).otherwise(0))
    return crossings % 2 == 1


def holds(edges: Column, holes: Column, lat: Column, lng: Column) -> Column:
    """In the outer ring and in none of the holes."""
    return _inside(edges, lat, lng) & ~F.exists(holes, lambda h: _inside(h, lat, lng))


def cover(polygons: DataFrame) -> DataFrame:
    """(zone, polygon, level, row, col, border): the cells of each polygon; level k has cells of 2^k degrees."""
    ys, xs = F.flatten(F.transform("edges", lambda e: F.array(e["y1"], e["y2"]))), F.flatten(F.transform("edges", lambda e: F.array(e["x1"], e["x2"])))
    boxed = polygons.select("*", F.array_min(ys).alias("s"), F.array_max(ys).alias("n"), F.array_min(xs).alias("w"), F.array_max(xs).alias("e"))
    level = F.ceil(F.log2(F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(1e-9)) / CELLS)).cast("int")
    sized = boxed.withColumn("level", level).withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    size = F.col("size")
    # Each edge, of holes as well, row by row: the columns between its ends there, one more on either side for rounding.
    every = sized.select("zone", "polygon", "level", "size", F.explode(F.concat("edges", F.flatten("holes"))).alias("g"))
    rows = F.sequence(F.floor(F.least("g.y1", "g.y2") / size).cast("long"), F.floor(F.greatest("g.y1", "g.y2") / size).cast("long"))
    every = every.select("zone", "polygon", "level", "size", "g.*", F.explode(rows).alias("row"))
    slope = F.when(F.col("y2") != F.col("y1"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    at = lambda y: F.coalesce(F.col("x1") + (F.greatest(F.least(y, F.greatest("y1", "y2")), F.least("y1", "y2")) - F.col("y1")) * slope, F.col("x1"))
    a, b = at(F.col("row") * size), at((F.col("row") + 1) * size)
    left = F.when(slope.isNull(), F.least("x1", "x2")).otherwise(F.least(a, b))
    right = F.when(slope.isNull(), F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
    tiny = size * 1e-6
    cols = F.sequence(F.floor((left - tiny) / size).cast("long"), F.floor((right + tiny) / size).cast("long"))
    # Points on the line between two rows belong to either.
    near = F.array(F.col("row"), F.when(F.abs(F.greatest("y1", "y2") - (F.col("row") + 1) * size) < tiny, F.col("row") + 1), F.when(F.abs(F.least("y1", "y2") - F.col("row") * size) < tiny, F.col("row") - 1))
    border = every.select("zone", "polygon", "level", F.explode(F.array_compact(near)).alias("row"), cols.alias("cols")).select("zone", "polygon", "level", "row", F.explode("cols").alias("col")).distinct()
    grid = sized.select("zone", "polygon", "level", "size", "edges", "holes", "w", "e", F.explode(F.sequence(F.floor(F.col("s") / size).cast("long"), F.floor(F.col("n") / size).cast("long"))).alias("row"))
    grid = grid.select("*", F.explode(F.sequence(F.floor(F.col("w") / size).cast("long"), F.floor(F.col("e") / size).cast("long"))).alias("col"))
    key = ["zone", "polygon", "level", "row", "col"]
    inner = grid.join(border, key, "left_anti").where(holds(F.col("edges"), F.col("holes"), (F.col("row") + 0.5) * size, (F.col("col") + 0.5) * size))
    return border.select(*key, F.lit(True).alias("border")).unionByName(inner.select(*key, F.lit(False).alias("border")))


def points_in_zones(points: DataFrame, rings: DataFrame, scratch: Scratch) -> DataFrame:
    """(point, zone), once, for every point (point, lat, lng) in any polygon of a zone (multipolygons have several). Points without usable
    coordinates are in no zone, and neither is any point in a zone without a usable ring. A point on an edge is in or out as ray casting says."""
    polygons = scratch.put(edges_of(rings), "polygons")
    cells = scratch.put(cover(polygons), "cells")
    # At most some thirty sizes, from a millionth of a degree to the globe.
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    if not levels:
        return points.select("point").where("false").join(rings.select("zone").where("false"), how="cross")
    keyed = points.where(_usable(F.col("lat"), F.col("lng"))).select("point", "lat", "lng", F.explode(F.array(*[F.lit(k) for k in levels])).alias("level"))
    size = F.pow(F.lit(2.0), F.col("level"))
    keyed = keyed.select("*", F.floor(F.col("lat") / size).cast("long").alias("row"), F.floor(F.col("lng") / size).cast("long").alias("col"))
    met = keyed.join(cells, ["level", "row", "col"])
    sure = met.where("NOT border").select("point", "zone")
    asked = met.where("border").select("point", "zone", "polygon", "lat", "lng")
    exact = asked.join(polygons, ["zone", "polygon"]).where(holds(F.col("edges"), F.col("holes"), F.col("lat"), F.col("lng"))).select("point", "zone")
    return sure.unionByName(exact).distinct()


def oriented(lat: Column, lng: Column, south: Column, west: Column, north: Column, east: Column, padding: float = PADDING) -> Column:
    """struct(lat, lng, state) of coordinates against the box of their area: 'ok' inside the padded box or where there is no box, 'swapped' where only
    the exchanged ones are inside, 'outside' otherwise, 'none' without coordinates. The padding is of latitude; of longitude it is wider by 1 / cos."""
    across = padding / F.greatest(F.lit(0.1), F.cos(F.radians((south + north) / 2)))
    inside = lambda y, x: (y >= south - padding) & (y <= north + padding) & (x >= west - across) & (x <= east + across)
    no_box = south.isNull() | west.isNull() | north.isNull() | east.isNull()
    state = F.when(lat.isNull() | lng.isNull(), "none").when(no_box, "ok").when(inside(lat, lng), "ok").when(inside(lng, lat), "swapped").otherwise("outside")
    turned = state == "swapped"
    return F.struct(F.when(turned, lng).otherwise(lat).alias("lat"), F.when(turned, lat).otherwise(lng).alias("lng"), state.alias("state"))
