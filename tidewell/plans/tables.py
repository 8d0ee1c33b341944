"""The driver's tables seen as listings, and the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.money import to_usd
from tidewell.session import load

NOW = "2001-08-02 00:00:00"


def d4(column):
    """A double rounded half up to four decimals, by way of a decimal."""
    return F.col(column).cast("decimal(20,4)").cast("double").alias(column)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, customer, nation and region as listings; see LISTINGS for the same in SQL."""
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 and 5 rows by definition
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        F.broadcast(places), customer.c_nationkey == places.n_nationkey
    )
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    deal = (
        F.when(p == "1-URGENT", "sale").when(p == "3-MEDIUM", "shortRent").when(p == "4-NOT SPECIFIED", "roomRent").otherwise("longRent")
    )
    currency = F.when(k % 5 == 0, "UAH").when(k % 5 == 1, "EUR").when(k % 5 == 2, "XXX").otherwise("USD")
    rows = rows.select(
        k.alias("id"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"),
        F.col("r_name").alias("country"),
        F.col("n_name").alias("city"),
        deal.alias("deal"),
        F.col("c_mktsegment").alias("ptype"),
        F.when(k % 17 != 0, F.col("o_totalprice")).alias("price"),
        currency.alias("currency"),
        F.when(k % 11 != 0, k % 5 + 1).alias("rooms"),
        (20 + F.col("o_custkey") % 80).cast("double").alias("area"),
        F.when(k % 13 != 0, F.col("o_orderdate")).alias("created_at"),
        F.col("o_orderdate").alias("first_seen"),
        (F.col("o_orderstatus") == "F").alias("by_agency"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("commission"),
        F.when(k % 19 == 0, "sold").when(k % 23 == 0, "rented").otherwise("active").alias("status"),
        (k % 29 == 0).alias("commercial"),
        (k % 7 == 0).alias("room_only"),
        F.col("o_custkey").alias("contact"),
    )
    key = F.md5(F.concat_ws("|", "city", "deal", F.col("contact").cast("string"), F.coalesce(F.col("rooms").cast("string"), F.lit(""))))
    return rows.withColumn("dkey", key).withColumn("price_usd", to_usd(F.col("price"), F.col("currency")))


LISTINGS = """
WITH base AS (
  SELECT o_orderkey AS id, 's' || CAST(o_orderkey % 4 AS VARCHAR) AS source, r_name AS country, n_name AS city,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'sale' WHEN '3-MEDIUM' THEN 'shortRent' WHEN '4-NOT SPECIFIED' THEN 'roomRent' ELSE 'longRent' END AS deal,
    c_mktsegment AS ptype, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price,
    CASE o_orderkey % 5 WHEN 0 THEN 'UAH' WHEN 1 THEN 'EUR' WHEN 2 THEN 'XXX' ELSE 'USD' END AS currency,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 + 1 END AS rooms, CAST(20 + o_custkey % 80 AS DOUBLE) AS area,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS created_at, o_orderdate AS first_seen,
    o_orderstatus = 'F' AS by_agency, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS commission,
    CASE WHEN o_orderkey % 19 = 0 THEN 'sold' WHEN o_orderkey % 23 = 0 THEN 'rented' ELSE 'active' END AS status,
    o_orderkey % 29 = 0 AS commercial, o_orderkey % 7 = 0 AS room_only, o_custkey AS contact
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), listings AS (
  SELECT *, md5(city || '|' || deal || '|' || CAST(contact AS VARCHAR) || '|' || COALESCE(CAST(rooms AS VARCHAR), '')) AS dkey,
    price / CASE currency WHEN 'USD' THEN 1.0::DOUBLE WHEN 'EUR' THEN 0.9::DOUBLE WHEN 'UAH' THEN 40.0::DOUBLE END AS price_usd FROM base
), public AS (
  SELECT * FROM listings WHERE status NOT IN ('sold', 'rented', 'closed', 'outdated') AND NOT commercial
), winners AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM public) WHERE rn = 1
)
"""
