"""Rules on identities, offers and crawls."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions.keys import fnv1a_bucket
from tidewell.operators import rules
from tidewell.operators.changes import upsert

T0 = datetime.datetime(2024, 1, 1)


def fnv1a(key):
    h = 0xCBF29CE484222325
    for byte in key.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return h % 100


def test_split_hash_matches_its_definition(spark):
    keys = ["", "a", "12345", "ключ", "x" * 3000, "\x00\xff"]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    assert [r.b for r in rows.select(fnv1a_bucket("k").alias("b")).collect()] == [*map(fnv1a, keys), None]


@pytest.mark.parametrize("hours", [6, 11])
def test_chains_run_over_midnight(spark, hours):
    times = {1: [0, 5, 7, 12, 14, 23, 25, 30, 30], 2: [3], 3: list(range(0, 200, 5))}
    rows = [(k, T0 + datetime.timedelta(hours=h)) for k, hs in times.items() for h in hs] + [(None, T0), (4, None)]
    got = rules.spaced_chains(spark.createDataFrame(rows, "k long, ts timestamp_ntz"), "k", "ts", hours).collect()

    def chain(hs):
        taken = []
        for h in sorted(set(hs), reverse=True):
            if not taken or taken[-1] - h >= hours:
                taken.append(h)
        return len(taken)

    assert {r.k: r.streak for r in got} == {k: chain(hs) for k, hs in times.items()}
    assert rules.spaced_chains(spark.createDataFrame([], "k long, ts timestamp_ntz"), "k", "ts").count() == 0


def test_names_and_identities(spark):
    rows = spark.createDataFrame([("ann", "ann lee"), ("ann", "bob"), ("", "bob"), (None, "bob")], "a string, b string")
    assert [r.d for r in rows.select(rules.names_differ(F.col("a"), F.col("b")).alias("d")).collect()] == [False, True, False, False]
    none, same, other = (F.lit(None).cast("string"),) * 2, (F.lit("x"), F.lit("x")), (F.lit("x"), F.lit("y"))
    cases = [
        (dict(platform=same, subject=same, contact=other, username=none, name=none), (True, "platform_subject_id", 1.0)),
        (dict(platform=other, subject=same, contact=same, username=none, name=none), (True, "verified_contact", 0.9)),
        (dict(platform=other, subject=same, contact=none, username=same, name=same), (False, "display_name_only", 0.1)),
        (dict(platform=none, subject=none, contact=none, username=same, name=none), (False, "no_shared_identifier", None)),
    ]
    for pairs, wanted in cases:
        assert tuple(spark.range(1).select(rules.match_strength(**pairs).alias("m")).first().m) == wanted


def test_hourly_price_is_the_listings_own(spark):
    cases = [
        ("4 000 ⃀ / час", 4000.0, True), ("20 USD per hour", None, True), ("Посуточно 999 грн, 350 грн/час", 999.0, False),
        ("2500 сом за час", 2500.0, True), ("1 2 500 ⃀ / час", 2500.0, True), ("20 usd per hourly", None, False), (None, None, False),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, t string, p double").orderBy("i")
    assert [r.h for r in rows.select("i", rules.is_hourly(F.col("t"), F.col("p")).alias("h")).orderBy("i").collect()] == [c[2] for c in cases]


def test_tags_are_distinct_and_few(spark):
    places = F.array(*[F.lit(f"p{i % 11}") for i in range(20)])
    row = spark.range(1).select(
        rules.tags(F.lit(2), F.lit("sale"), F.lit(None).cast("boolean"), places, F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.lit(True), F.lit(50)).alias("t")
    )
    assert row.first().t == ["2 rooms", "for sale", "owner", *[f"p{i}" for i in range(9)]]


def test_rotation_covers_all_targets(spark):
    targets = spark.range(30).withColumnRenamed("id", "place")
    seen = [{r.place for r in rules.rotating(targets, F.col("place"), 30 * slot).collect()} for slot in range(5)]
    assert all(len(s) == 12 for s in seen) and set().union(*seen) == set(range(30))
    assert rules.rotating(targets.limit(7), F.col("place"), 99).count() == 7


def test_last_item_takes_the_first_place(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z"), (None, 3, "n")], "k string, at int, v string")
    got = {tuple(r) for r in rules.last_at_first_place(rows, ["k"], "at").collect()}
    assert got == {("a", 0, "z"), ("b", 1, "y"), (None, 3, "n")}


def test_lookup_by_either_column(spark):
    rows = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "1"), (4, None)], "id long, url string")
    wanted = spark.createDataFrame([("1",), ("u2",), ("4",)], "value string")
    assert {r.id for r in rules.lookup(rows, wanted, ["id", "url"]).collect()} == {1, 2, 3, 4}


def test_upsert_of_rows_with_null_keys(spark):
    schema = "a string, b int, v int"
    old = spark.createDataFrame([(None, 1, 5), ("x", None, 6), ("y", 1, 7)], schema)
    new = spark.createDataFrame([(None, 1, 8), ("x", None, 6), (None, 2, 9)], schema)
    got = {(r.a, r.b, r.v, r.change) for r in upsert(old, new, ["a", "b"], ["v"]).collect()}
    assert got == {(None, 1, 8, "updated"), ("x", None, 6, "same"), ("y", 1, 7, "kept"), (None, 2, 9, "inserted")}
