"""Masking round trips, amounts and own prices, places from distances."""

import math
import random
import re

from pyspark.sql import functions as F

from tidewell.functions.geo import RADIUS_SEARCH_M
from tidewell.operators import masking, place, prices

PATTERNS = [
    re.compile(masking.PLACEHOLDER), re.compile(masking.CONTACTS[0][4:], re.I | re.A), re.compile(masking.CONTACTS[1][4:], re.I | re.A),
    re.compile(r"(?<![^\W])@[A-Za-z][A-Za-z0-9_]{3,31}(?![A-Za-z0-9_])"), re.compile(masking.CONTACTS[3], re.A),
]


def plain(text):
    values = []
    for p in PATTERNS:
        text = p.sub(lambda m: values.append(m.group(0)) or f"[[{len(values)}]]", text)
    return text, values


def test_masking_gives_back_any_text(spark):
    draw = random.Random(6)
    parts = ["mail a.b@c-d.org now", "call +38 (044) 123-45-67!", "@handle_one", "see https://x.y/z?q=1,", "[[2]]", "[ [ 13 ] ]", "word", "12 345", "www.site.de", "@no", "[[99999]]", "ü@ö.de", "1234567890"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randint(0, 8))) for _ in range(300)] + [None, "", "[[1]]" * 40 + "a@b.cd " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = masking.restored(masking.mask(df, "t"), "masked", "contacts", "again").collect()
    for r in rows:
        assert r.again == (r.t or "")
        assert (r.masked, r.contacts) == plain(r.t or "")


def test_what_a_translator_does_to_placeholders(spark):
    rows = [("x [[ 1 ]] y [ [2] ] [[7]]", ["a@b.cd", "@name"]), ("all gone", ["a@b.cd", "@name"]), ("[[2]] [[2]]", ["one", "two"]), ("", [])]
    df = spark.createDataFrame(rows, "t string, v array<string>")
    assert [r.out for r in masking.restored(df, "t", "v", "out").collect()] == ["x a@b.cd y @name [[7]]", "all gone\na@b.cd\n@name", "two two\none", ""]


def test_amounts(spark):
    cases = {"27 400": 27400, "8 тис": 8000, "4,150": 4150, "725": 725, "12,5": 12.5, "3.250,75": 3250.75, "2k": 2000, "1,5 тыс.": 1500, "x": None, "05": 5, "1 23": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.v for r in df.select("p", prices.parsed(F.col("p")).alias("v")).collect()} == cases


def test_own_price(spark):
    texts = {
        "Залог 800 $. Квартира, цена 950 $": ("950", 3), "Flat 640 USD, flat 640 EUR": ("640", 1), "rooms 3, floor 5": None, "Deposit 900 USD": ("900", -2), "": None,
        "Rent: 31 500 грн per month; commission 100 $": ("31 500", 3), "€ 77 or 88 €": ("77", 1),
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in prices.own_price(df, "t").collect():
        want = texts.get(r.t)
        assert (r.price and (r.price.piece, r.price.score)) == want, r
        assert not want or r.t[r.price.start : r.price.stop] == want[0]


def test_places(spark):
    def way(a, b):
        (p, q), (r, s) = ([math.radians(x) for x in c] for c in (a, b))
        return 2 * RADIUS_SEARCH_M * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))

    home = (46.41, 30.72)
    known = [(46.4, 30.7), (46.42, 30.74), (46.43, 30.7)]
    rows = [(1, [(*k, way(home, k)) for k in known]), (2, [(*known[0], 5.0)]), (3, [(*known[0], 5.0), (None, 1.0, 5.0), (46.0, 30.0, 0.0)]), (4, None), (5, [(*known[0], 100.0), (*known[0], 100.0)])]
    df = spark.createDataFrame(rows, "id int, a array<struct<lat:double,lng:double,d:double>>")
    found = {r.id: r.f for r in df.select("id", place.located(F.col("a")).alias("f")).collect()}
    assert way(home, (found[1].lat, found[1].lng)) < 2 and found[1].anchors == 3
    assert found[2] is None and found[3] is None and found[4] is None
    assert found[5].residual_m == 100.0  # circles of one middle have no crossing
    # two circles cross twice: the prior decides
    two = spark.createDataFrame([(1, [(*k, way(home, k)) for k in known[:2]])], "id int, a array<struct<lat:double,lng:double,d:double>>")
    prior = F.struct(F.lit(home[0] + 0.001).alias("lat"), F.lit(home[1]).alias("lng"))
    f = two.select(place.located(F.col("a"), prior).alias("f")).first().f
    assert way(home, (f.lat, f.lng)) < 20
