"""Points in zones against plain ray casting; the walk over contacts."""

import math
import random

from tidewell.operators import privacy, zones
from tidewell.session import Scratch

POINT = "point long, lat double, lng double"
RING = "zone string, polygon int, ring int, corners array<struct<lat:double,lng:double>>"


def cast(ring, lat, lng):
    inside = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) / (y2 - y1) * (lat - y1) + x1:
            inside = not inside
    return inside


def test_points_meet_zones_like_ray_casting(spark):
    draw = random.Random(9)
    rings = []
    for z in range(12):
        cy, cx, size = draw.uniform(-40, 60), draw.uniform(-100, 100), 10 ** draw.uniform(-3, 1)
        for p in range(draw.randint(1, 3)):
            y, x = cy + p * size, cx - p * size
            corners = [(y + size * draw.uniform(0.3, 1) * math.sin(a), x + size * draw.uniform(0.3, 1) * math.cos(a)) for a in [i * 0.7 for i in range(9)]]
            rings.append((f"z{z}", p, 0, corners))
            rings.append((f"z{z}", p, 1, [(y + size * 0.1 * dy, x + size * 0.1 * dx) for dy, dx in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))]))
    rings.append(("square", 0, 0, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]))
    rings.append(("line", 0, 0, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]))
    rings.append(("beyond", 0, 0, [(0.0, 0.0), (0.0, 1.0), (95.0, 0.5)]))
    rings.append(("broken hole", 0, 0, [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]))
    rings.append(("broken hole", 0, 1, [(0.5, 0.5), (0.6, 0.6)]))
    points = [(i, *(c + draw.gauss(0, 10 ** draw.uniform(-4, 0.5)) for c in draw.choice(draw.choice(rings)[3]))) for i in range(1500)]
    points += [(2000, None, 1.0), (2001, 91.0, 0.0), (2002, float("nan"), 0.5), (2003, 0.5, 0.5)]
    scratch = Scratch(spark)
    got = zones.points_in_zones(spark.createDataFrame(points, POINT), spark.createDataFrame(rings, RING), scratch)
    found = sorted((r.point, r.zone) for r in got.collect())
    want = set()
    for i, lat, lng in points[:1500] + [points[-1]]:
        for zone, p, r, corners in rings:
            ok = r == 0 and len({c for c in corners if abs(c[0]) <= 90}) >= 3
            holes = [c for z, q, s, c in rings if (z, q) == (zone, p) and s > 0 and len(set(c)) >= 3]
            if ok and abs(lat) <= 90 and abs(lng) <= 180 and cast([c for c in corners if abs(c[0]) <= 90], lat, lng) and not any(cast(h, lat, lng) for h in holes):
                want.add((i, zone))
    assert found == sorted(want) and len({z for _, z in want}) > 8
    assert zones.points_in_zones(spark.createDataFrame(points, POINT), spark.createDataFrame(rings[-4:-3], RING), scratch).count() == 0
    scratch.clear()


def test_a_walk_withholds_what_is_others(spark):
    contacts = spark.createDataFrame([(1, "mail", "a"), (2, "mail", "b"), (3, "phone", "c"), (4, "phone", "d")], "contact long, type string, value string")
    links = spark.createDataFrame([(10, 1), (10, 3), (11, 3), (11, 2), (12, 4), (10, 1)], "actor long, contact long")
    held = spark.createDataFrame([(10, "identity", 100), (11, "evidence", 101), (12, "identity", 102)], "actor long, kind string, id long")
    asked = spark.createDataFrame([(1, "mail", "a"), (2, "phone", "c"), (2, "mail", "a"), (3, "mail", "nobody"), (4, None, None)], "request int, type string, value string")
    scratch = Scratch(spark)
    got = sorted(tuple(r) for r in privacy.subject_records(asked, contacts, links, held, scratch).collect())
    assert [g for g in got if g[0] == 1] == [(1, "actor", 10, None), (1, "contact", 1, "mail:a"), (1, "contact", 3, None), (1, "identity", 100, None)]
    assert [g for g in got if g[0] == 2] == [
        (2, "actor", 10, None), (2, "actor", 11, None), (2, "contact", 1, "mail:a"), (2, "contact", 2, None), (2, "contact", 3, "phone:c"), (2, "evidence", 101, None), (2, "identity", 100, None)
    ]
    assert not [g for g in got if g[0] > 2]
    edges = spark.createDataFrame([("a", 1, "a", 2), ("a", 2, "a", 3), ("a", 3, "a", 1)], "from_kind string, from_id long, to_kind string, to_id long")
    ring = privacy.walk(spark.createDataFrame([(1, "a", 1)], "request int, kind string, id long"), edges, scratch, 9)
    assert sorted((r.id, r.hop) for r in ring.collect()) == [(1, 0), (2, 1), (3, 2)]
    scratch.clear()
