"""Listings: filters, winners, cursors, keys, clone relations."""

import datetime

from pyspark.sql import functions as F

from tidewell.operators import identity as I
from tidewell.operators import listing as L
from tidewell.operators.changes import changed_rows, closed_keys, upsert

SCHEMA = "id long, dkey string, created_at timestamp_ntz, price double, currency string, deal string, room_only boolean, flag boolean, area double, country string"
DAY = datetime.datetime(2024, 1, 1)


def rows(spark):
    data = [
        (1, "a", DAY, 100.0, "USD", "sale", False, True, 10.0, "UA"),
        (2, "a", DAY, 4000.0, "UAH", "sale", False, False, 0.0, "UA"),
        (3, "a", None, 100.0, "XXX", "longRent", True, None, None, "PL"),
        (4, "b", None, None, "USD", "longRent", False, None, 20.0, "PL"),
        (5, "c", DAY + datetime.timedelta(days=1), 50.0, "EUR", "sale", False, True, 20.0, None),
    ]
    return spark.createDataFrame(data, SCHEMA).withColumn("price_usd", L.to_usd(F.col("price"), F.col("currency")))


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_winner_is_newest_then_highest_id(spark):
    assert sorted(ids(L.winners(rows(spark)))) == [2, 4, 5]


def test_filters_drop_unknown_currency_only_for_price(spark):
    assert sorted(ids(L.matching(rows(spark), L.ListingFilter(price=(90, 110))))) == [1, 2]
    assert sorted(ids(L.matching(rows(spark), L.ListingFilter(include_rooms=True)))) == [1, 2, 3, 4, 5]
    assert sorted(ids(L.matching(rows(spark), L.ListingFilter()))) == [1, 2, 4, 5]


def test_three_valued_flags(spark):
    f = lambda **k: sorted(ids(L.matching(rows(spark), L.ListingFilter(include_rooms=True, **k))))
    assert f(true_flags=("flag",)) == [1, 5]
    assert f(false_flags=("flag",)) == [2]
    assert f(not_false_flags=("flag",)) == [1, 3, 4, 5]
    assert f(price_per_m2=(1, 20)) == [1, 5]


def test_cursor_walks_every_row_once_in_every_mode(spark):
    df = rows(spark)
    for mode in L.ORDERS:
        column = L.ORDERS[mode][0]
        whole = ids(df.orderBy(*L.ordering(mode)))
        seen, after = [], None
        while part := L.page(df, mode, 2, after).collect():
            seen += [r.id for r in part]
            after = (part[-1][column], part[-1].id)
        assert seen == whole and len(whole) == 5


def test_cursor_scope_depends_on_filters():
    a, b = L.ListingFilter(countries=("UA",)), L.ListingFilter(countries=("PL",))
    assert a.scope() == L.ListingFilter(countries=("UA",)).scope() != b.scope()
    assert L.ListingFilter.from_params({"countries": "UA,PL", "priceTo": "5", "utm": "x"}).price == (None, 5.0)


def test_upsert_and_sync(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (3, "c", 1)], "id long, v string, seen int")
    new = spark.createDataFrame([(2, None, 3), (3, "d", 2), (4, "e", 1)], "id long, v string, seen int")
    got = {r.id: (r.v, r.seen, r.change) for r in upsert(old, new, ["id"], ["v", "seen"], ["seen"]).collect()}
    assert got == {1: ("a", 5, "kept"), 2: ("b", 9, "updated"), 3: ("d", 2, "updated"), 4: ("e", 1, "inserted")}
    assert ids(closed_keys(old, new, ["id"])) == [1]
    assert sorted(ids(changed_rows(old, new, ["id"], ["seen"]))) == [2, 3, 4]


def test_listing_key_rules(spark):
    names = "source string, country string, source_id string, city string, deal string, ptype string, rooms int, area double, phone string, address string, title string, description string, photo0 string, photo1 string, cluster string"
    base = {"source": "olx", "country": "ua", "source_id": "9", "city": "Odesa", "deal": "sale", "ptype": "flat"}
    photo = "https://cdn.example.com/photo/"
    cases = [
        ({"cluster": " c1 "}, "cluster:c1"),
        ({"phone": "+380 (44) 123-45-67", "address": "Main st. 12", "rooms": 2, "area": 40.04}, "cross:contact-address:"),
        ({"title": "Nice flat", "description": "long " * 30}, "cross:content:"),
        ({"photo0": photo + "1?w=2", "photo1": photo + "2"}, "olx:photos:"),
        ({"phone": "12345"}, "olx:UA:9"),
    ]
    columns = [f.split()[0] for f in names.split(", ")]
    df = spark.createDataFrame([tuple((base | c).get(n) for n in columns) for c, _ in cases], names)
    for got, (_, wanted) in zip(df.select(I.listing_key(df.columns).alias("k")).collect(), cases, strict=True):
        assert got.k.startswith(wanted)


def test_clone_relation_and_lineage(spark):
    side = "created_at timestamp_ntz, by_agency boolean, price double, currency string, rooms int, area double, title string, country string, city string"
    names = ", ".join(f"{p}{f}" for p in ("a_", "b_") for f in side.split(", "))
    own = (DAY, False, 100.0, "USD", 2, 50.0, "two room flat", "UA", "Odesa")
    copy = (DAY + datetime.timedelta(days=2), True, 130.0, "USD", 2, 51.0, "two room flat", "UA", "Odesa")
    df = spark.createDataFrame([copy + own, own + copy, own + own], names)
    got = I.clone_relation(df)
    got = got.withColumn("relation", I.lineage(got, F.lit(False), F.lit(None).cast("boolean"))).collect()
    assert [r.score for r in got] == [90, 75, 45]
    assert [r.relation for r in got] == ["likely_derived", "possible_original", "undetermined"]
    assert [r.direction for r in got] == ["higher", "lower", "similar"]
