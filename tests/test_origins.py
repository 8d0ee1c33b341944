"""Originals of postings, duplicates and payment patterns, and the composites on empty and blank rows."""

import datetime

from pyspark.sql import functions as F

from tidewell.operators import origins, statistics
from tidewell.session import Scratch



def now(day="2024-06-01"):
    return F.lit(day).cast("timestamp_ntz")


def posting(cluster, id_, source, text="t" * 130, kind="direct", company="Acme, Ltd.", title="Cook", url="https://acme.example/jobs/1", day=1):
    return cluster, id_, source, kind, company, title, text, url, url + "#apply", datetime.datetime(2024, 5, day)


def test_job_originals(spark):
    rows = [
        posting("one", 1, "companies"), posting("one", 2, "board", company="ACME"), posting("one", 3, "other", title=" cook "),
        posting("two", 4, "companies"), posting("two", 5, "companies"), posting("two", 6, "board"),
        posting("agency", 7, "companies", kind="agency"), posting("agency", 8, "board"), posting("short", 9, "companies", text="t" * 119), posting("short", 10, "board", text="t" * 119),
        posting("front", 11, "companies", url="https://acme.example/"), posting("front", 12, "board", url="https://acme.example/"), posting("alone", 13, "companies"),
        posting("text", 14, "companies"), posting("text", 15, "board", text="u" * 130), ("nulls", 16, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "cluster string, id int, source string, employer_type string, company string, title string, description string, url string, apply_url string, posted_at timestamp_ntz")
    found = {r.cluster: (r.status, r.candidate, r.compared) for r in origins.job_originals(df, "cluster", now()).collect()}
    none = ("insufficient_evidence", None, None)
    assert found == {"one": ("candidate", 1, 2), "two": ("ambiguous", None, None), **{c: none for c in ("agency", "short", "front", "alone", "text", "nulls")}}
    later = origins.job_originals(df.where("cluster = 'one'"), "cluster", now("2024-04-01")).first()
    assert later.status == "insufficient_evidence"


def test_duplicates_and_patterns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, dkey string")
    edges = spark.createDataFrame([(3, 1), (1, 2), (3, 9), (4, 3)], "a int, b int")
    got = sorted(tuple(r) for r in origins.duplicates(rows.selectExpr("id AS seed"), rows, edges).collect())
    assert got == [(1, 1, "fingerprint"), (1, 2, "fingerprint"), (1, 3, "lineage"), (2, 1, "fingerprint"), (2, 2, "fingerprint"), (3, 1, "lineage"), (3, 3, "fingerprint"), (3, 4, "lineage"), (4, 3, "lineage")]
    seen = spark.createDataFrame([("x", "p", "r1"), ("x", "p", "r2"), ("x", "p", "r2"), ("x", "q", "r1"), ("y", "p", "r1"), ("y", "", "r2"), ("x", "s", None)], "actor string, property string, recipient string")
    assert [tuple(r) for r in origins.changed_destinations(seen).collect()] == [("x", 1, 2)]
    fees = [("x", "c1", "s", 1, True), ("x", "c1", "s", 2, True), ("x", None, "s", 3, True), ("x", None, "t", 3, True), ("y", "c", "s", 4, True), ("y", "d", "s", 5, None), ("y", "e", "s", 6, False)]
    df = spark.createDataFrame(fees, "actor string, cluster string, source string, id int, fee boolean")
    assert [tuple(r) for r in origins.fee_patterns(df).collect()] == [("x", 3)]


def test_composites_of_nothing_and_of_nulls(spark):
    schema = (
        "gender string, age int, provider string, source string, origin string, city string, country string, sectors array<string>, professions array<string>, activity_at timestamp_ntz, "
        "salary_min_usd double, salary_max_usd double, years int"
    )
    scratch = Scratch(spark)
    empty = statistics.candidate_snapshot(spark.createDataFrame([], schema), now(), scratch).collect()
    assert {(r.dimension, r.label): r.n for r in empty if r.section == "tag"} == {(d, x): 0 for d, x in [("gender", g) for g in ("female", "male", "unknown")] + [("age", n) for _, n in statistics.AGES] + [("age", "__unknown__")]}
    assert [(r.label, r.priced, r.median) for r in sorted((r for r in empty if r.section == "salary_by_experience"), key=lambda r: r.label)] == [(str(i), 0, None) for i in range(5)]
    rows = [(None,) * 13, ("x", 30, "", None, "web", "", None, None, ["Any Role", "cook"], None, None, 900.0, 3), ("male", 55, "p", "s", None, "K", "UA", ["a", "b"], [], datetime.datetime(2024, 5, 20), 500.0, 700.0, 3)]
    found = {(r.section, r.dimension, r.label): r for r in statistics.candidate_snapshot(spark.createDataFrame(rows, schema), now(), scratch).collect()}
    assert found["tag", "gender", "unknown"].n == 2 and found["tag", "platform", "unknown"].n == 1 and found["tag", "platform", "web"].n == 1
    assert found["tag", "location", "__unknown__"].n == 2 and found["tag", "profession", "cook"].n == 1 and ("tag", "profession", "Any Role") not in found
    assert found["salary_by_experience", None, "1"].median == 750.0 and found["salary_by_profession", None, "cook"].lowest == 900.0
    assert found["activity", None, "2024-05-20"].n == 1
    listings = "country string, city string, district string, metro string, deal string, room_only boolean, by_agency boolean, commission boolean, commission_percent double, usd double, created_at timestamp_ntz, first_seen timestamp_ntz, dkey string"
    none = statistics.listing_snapshot(spark.createDataFrame([], listings), F.lit(True), scratch)
    assert {r.label: r.n for r in none.collect()} == dict.fromkeys(["total", "owners", "agencies", "commission", "no_commission", "raw_total", "duplicates_rejected"], 0)
    blank = statistics.listing_snapshot(spark.createDataFrame([(None,) * 13] * 2, listings), F.lit(True), scratch)
    assert {(r.section, r.label): r.n for r in blank.collect()}.items() >= {("total", "total"): 2, ("deal", "unknown"): 2}.items()
    scratch.clear()
