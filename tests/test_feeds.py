"""Feeds: single options, pages and plausible salaries."""

from pyspark.sql import functions as F

from tidewell.functions.money import plausible_annual_usd
from tidewell.operators import feeds
from tidewell.plans.feeds import vacancies


def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


def test_pages_follow_one_another(spark, small):
    rows = vacancies(spark, small).where("active")
    order = feeds.JOB_ORDERS["company"]
    pages = [feeds.page_with_total(rows, order(), at, 7).collect() for at in (0, 7)]
    whole = [r.id for r in rows.orderBy(*order()).limit(14).collect()]
    assert [r.id for p in pages for r in sorted(p, key=lambda r: r.place)] == whole
    assert {r.total for p in pages for r in p} == {rows.count()}
    assert feeds.page_with_total(rows.limit(0), order(), 0, 7).count() == 0


def test_remote_vacancies_of_excluded_countries_stay(spark):
    row = "true AS active, timestamp_ntz'1998-05-30' AS posted_at, 'RU' AS country, null AS risk_category"
    rows = spark.sql(f"SELECT 1 AS id, true AS remote, {row} UNION ALL SELECT 2, false, {row}")
    assert [r.id for r in rows.where(feeds.JobFilter().where(now())).collect()] == [1]
    assert rows.where(feeds.JobFilter(include_ru=True).where(now())).count() == 2


def test_periods_that_cannot_be_meant(spark):
    cases = [
        (90_000.0, "month", "USD", (90_000, "year")), (600.0, "hour", "EUR", (600, "year")), (20.0, "year", "usd", (38_400, "hour")),
        (5.0, "year", "USD", None), (450.0, "year", "KZT", (5_400, "month")), (3_000.0, "month", "UAH", (36_000, "month")),
        (-1.0, "month", "USD", None), (None, "year", "USD", None), (2_000_000.0, "year", "USD", None),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, amount double, period string, currency string")
    got = rows.select("id", plausible_annual_usd(F.col("amount"), F.col("period"), F.col("currency")).alias("p")).orderBy("id").collect()
    assert [tuple(r.p) if r.p else None for r in got] == [c[3] for c in cases]
