"""Clusters with a bound: components against one loop over all events."""

import random

from tidewell.operators import clusters
from tidewell.plans.clusters import photo_events
from tidewell.session import Scratch


def check(spark, events, stored, most=clusters.MOST_MEMBERS):
    rows = [(n, x) for n, members in events for x in members]
    scratch = Scratch(spark)
    got = clusters.merged(spark.createDataFrame(rows, "number int, node string"), spark.createDataFrame(list(stored.items()), clusters.CLUSTERS), scratch, most)
    found = {r.node: r.cluster for r in got.collect()}
    assert found == clusters.merge_in_order(events, stored, most)
    scratch.clear()
    return found


def test_the_loop_itself():
    merge = clusters.merge_in_order
    ids = merge([(2, ["b", "c"]), (1, ["a", "b"]), (3, ["d"])], {})
    assert ids == dict.fromkeys("abc", clusters.proposed(["a", "b"])) and "d" not in ids
    # an event that would be too large is dropped as a whole, a later smaller one isn't
    events = [(1, list("abc")), (2, list("cde")), (3, ["c", "d"])]
    assert set(merge(events, {}, 4)) == set("abcd")
    # stored clusters keep the least id
    assert merge([(1, ["x", "y", "z"])], {"x": "property:2", "y": "property:1", "w": "property:2"}) == dict.fromkeys("wxyz", "property:1")


def test_components_equal_one_loop(spark):
    draw = random.Random(11)
    events = [(n, [f"n{draw.randrange(200)}" for _ in range(draw.randint(1, 4))]) for n in range(160)]
    stored = {f"n{i}": f"property:s{i // 3:03}" for i in range(60, 100)}
    found = check(spark, events, stored, 7)
    sizes = {}
    for c in found.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) <= 7 and len(sizes) > 10
    check(spark, [(1, ["a", "b"])], {})
    check(spark, [], {"a": "property:1"})


def test_the_bound_on_given_tables(spark, small):
    events, stored = photo_events(spark, small)
    plain = {}
    for r in events.collect():
        plain.setdefault(r.number, []).append(r.node)
    before = {r.node: r.cluster for r in stored.collect()}
    check(spark, list(plain.items()), before, 5)


def test_weak_pairs(spark):
    members = spark.createDataFrame([(c + str(i), c) for c, n in (("a", 2), ("b", 2), ("c", 3), ("d", 2), ("e", 2), ("f", 2)) for i in range(n)], clusters.CLUSTERS)
    weak = (1, 0, 1, False, "high")
    rows = [("a", *weak), ("a", *weak), ("b", *weak), ("b", 2, 1, 1, False, "high"), ("c", *weak), ("d", 1, 0, 1, None, "high"), ("e", 1, 0, 1, False, "medium")]
    evidence = spark.createDataFrame(rows, "cluster string, matched int, exact int, perceptual int, consistent boolean, location string")
    assert [r.cluster for r in clusters.weak_pairs(members, evidence).collect()] == ["a"]
