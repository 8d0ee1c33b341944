"""Geography on the sphere and in the plane, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The radius of radius searches and of bounding boxes, in metres.
RADIUS_SEARCH_M = 6_371_000.0
RADIUS_BOX_M = 6_371_008.8
MOST_RADIUS_M = 200_000.0


def cosine_distance(lat: Column, lng: Column, at_lat: float, at_lng: float) -> Column:
    """Great-circle distance in metres by the law of cosines, its argument clamped."""
    a, b = F.radians(lat), F.lit(math.radians(at_lat))
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lng) - F.lit(math.radians(at_lng)))
    clamped = F.when(c > 1, 1.0).when(c < -1, -1.0).otherwise(c)  # a missing point has no distance
    return F.lit(RADIUS_SEARCH_M) * F.acos(clamped)


def haversine(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres by the haversine formula."""
    a, b = F.radians(lat), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng)) / 2), 2)
    return F.lit(2 * RADIUS_SEARCH_M) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def bounding_box(lat: float, lng: float, radius_m: float) -> tuple[float, float, float, float, bool]:
    """(south, west, north, east, wraps): the exact box around a circle; with a pole in the
    circle it holds all longitudes; ``wraps`` if it crosses the antimeridian."""
    r = min(radius_m, MOST_RADIUS_M) / RADIUS_BOX_M
    south, north = lat - math.degrees(r), lat + math.degrees(r)
    if south <= -90 or north >= 90:
        return max(south, -90.0), -180.0, min(north, 90.0), 180.0, False
    half = math.degrees(math.asin(math.sin(r) / math.cos(math.radians(lat))))
    west, east = lng - half, lng + half
    wraps = west < -180 or east > 180
    return south, (west + 540) % 360 - 180, north, (east + 540) % 360 - 180, wraps


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float, bool]) -> Column:
    """Whether a point lies in a bounding box."""
    south, west, north, east, wraps = box
    across = (lng >= west) | (lng <= east) if wraps else (lng >= west) & (lng <= east)
    return (lat >= south) & (lat <= north) & across


def within(lat: Column, lng: Column, at_lat: float, at_lng: float, radius_m: float) -> Column:
    """Whether a point is within a radius (of at most 200 km): the box first, then the distance."""
    r = min(radius_m, MOST_RADIUS_M)
    return in_box(lat, lng, bounding_box(at_lat, at_lng, r)) & (cosine_distance(lat, lng, at_lat, at_lng) <= r)


def bearing(lat: Column, lng: Column, at_lat: float, at_lng: float) -> Column:
    """Initial bearing in degrees, 0 to 360, from the fixed point."""
    a, b, d = F.lit(math.radians(at_lat)), F.radians(lat), F.radians(lng) - F.lit(math.radians(at_lng))
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def in_wedge(angle: Column, start: float, end: float) -> Column:
    """Whether a bearing lies in a wedge; equal ends are the full circle, and it may wrap."""
    if start % 360 == end % 360:
        return F.lit(True)
    s, e = start % 360, end % 360
    return (angle >= s) & (angle <= e) if s < e else (angle >= s) | (angle <= e)


def in_ring(lat: Column, lng: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: whether a point lies in the ring of (lat, lng) corners."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lng < F.lit((x2 - x1) / (y2 - y1)) * (lat - y1) + x1)
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def in_polygon(lat: Column, lng: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """In the outer ring and in none of the holes; no point is in nothing."""
    outer, *holes = rings
    inside = in_ring(lat, lng, outer)
    for hole in holes:
        inside = inside & ~in_ring(lat, lng, hole)
    return F.coalesce(inside, F.lit(False))
