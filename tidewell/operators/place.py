"""A place from its distances to known ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def located(anchors: Column, prior: Column | None = None) -> Column:
    """struct(lat, lng, residual_m, anchors) of the point that best fits an array of anchors (lat, lng, d: metres); null with fewer than two usable
    ones (of finite coordinates and a distance above 0). ``prior`` (lat, lng) is a candidate too and draws the choice towards it.

    In the plane around the anchors' middle, candidates are the crossings of each two circles (or the point between two that don't meet), the
    middle weighted by 1 / distance, and the prior; the one with the least root mean square of distance errors, plus a hundredth of
    its way to the prior, wins, the first of equals. A few anchors a row are meant: candidates grow with their square."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.filter(anchors, lambda a: F.coalesce(fine(a["lat"]) & fine(a["lng"]) & fine(a["d"]) & (a["d"] > 0), F.lit(False)))
    n = F.size(usable)
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    lat0, lng0 = add(usable, lambda a: a["lat"]) / n, add(usable, lambda a: a["lng"]) / n
    origin = F.struct(lat0.alias("lat"), lng0.alias("lng"))

    def flat(p: Column, o: Column, *more: Column) -> Column:
        return F.struct((F.radians(p["lng"] - o["lng"]) * EARTH_M * F.cos(F.radians(o["lat"]))).alias("x"), (F.radians(p["lat"] - o["lat"]) * EARTH_M).alias("y"), *more)

    far = lambda dx, dy: F.sqrt(dx * dx + dy * dy)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def crossings(a: Column, b: Column) -> Column:
        d = far(b["x"] - a["x"], b["y"] - a["y"])
        ux, uy = (b["x"] - a["x"]) / d, (b["y"] - a["y"]) / d
        along = (a["d"] * a["d"] - b["d"] * b["d"] + d * d) / (2 * d)
        bx, by = a["x"] + along * ux, a["y"] + along * uy
        h2 = a["d"] * a["d"] - along * along
        h = F.sqrt(F.greatest(h2, F.lit(0.0)))
        apart = point((a["x"] + ux * a["d"] + b["x"] - ux * b["d"]) / 2, (a["y"] + uy * a["d"] + b["y"] - uy * b["d"]) / 2)
        met = F.when(h2 >= 0, F.array(point(bx - uy * h, by + ux * h), point(bx + uy * h, by - ux * h))).otherwise(F.array(apart))
        return F.when(d < 0.001, F.array().cast("array<struct<x:double,y:double>>")).otherwise(met)

    def solved(o: Column) -> Column:
        local = F.transform(usable, lambda a: flat(a, o, a["d"].cast("double").alias("d")))
        pairs = F.flatten(F.transform(local, lambda a, i: F.flatten(F.transform(F.slice(local, i + 2, F.greatest(F.size(local) - i - 1, F.lit(0))), lambda b: crossings(a, b)))))
        weight = add(local, lambda a: 1 / a["d"])
        middle = point(add(local, lambda a: a["x"] / a["d"]) / weight, add(local, lambda a: a["y"] / a["d"]) / weight)
        near = F.when(prior.isNotNull(), flat(prior, o)) if prior is not None else None
        every = F.concat(pairs, F.array(middle), F.array_compact(F.array(near)) if near is not None else F.array().cast("array<struct<x:double,y:double>>"))
        error = lambda c: F.sqrt(add(local, lambda a: F.pow(far(c["x"] - a["x"], c["y"] - a["y"]) - a["d"], 2)) / n)
        drawn = lambda c: F.coalesce(far(c["x"] - near["x"], c["y"] - near["y"]) * 0.01, F.lit(0.0)) if near is not None else F.lit(0.0)
        scored = F.transform(every, lambda c, i: F.struct((error(c) + drawn(c)).alias("score"), i.alias("i"), error(c).alias("error"), c["x"].alias("x"), c["y"].alias("y")))
        best = F.array_min(scored)
        return F.transform(F.array(best), lambda b: F.struct(
            (o["lat"] + F.degrees(b["y"] / EARTH_M)).alias("lat"), (o["lng"] + F.degrees(b["x"] / (EARTH_M * F.cos(F.radians(o["lat"]))))).alias("lng"), b["error"].alias("residual_m"), n.alias("anchors")))[0]

    return F.when(n >= 2, F.transform(F.array(origin), solved)[0])
