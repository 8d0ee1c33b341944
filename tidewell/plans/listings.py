"""Feeds, filters and winners."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewell.operators import listing as L
from tidewell.plans.registry import query
from tidewell.plans.tables import LISTINGS, NOW, d4, listings
from tidewell.session import load

SHOWN = ["id", "source", "country", "city", "deal", "price", "currency"]
_SHOWN = ", ".join(SHOWN)


@query(LISTINGS + f"SELECT {_SHOWN}, created_at FROM winners ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 60")
def feed_page_newest(spark, sf_dir):
    """First page of the public, deduplicated feed by time; the limit is the page."""
    rows = L.winners(L.public(listings(spark, sf_dir)))
    return L.page(rows, "newest", 60).select(*SHOWN, "created_at")


@query(LISTINGS + f"SELECT {_SHOWN} FROM winners ORDER BY price_usd ASC NULLS LAST, id DESC LIMIT 60")
def feed_page_price(spark, sf_dir):
    """First page by price in USD; the limit is the page."""
    return L.page(L.winners(L.public(listings(spark, sf_dir))), "priceAsc", 60).select(*SHOWN)


@query(
    LISTINGS
    + f"""SELECT {_SHOWN} FROM winners WHERE created_at < TIMESTAMP '1999-01-01' OR (created_at = TIMESTAMP '1999-01-01' AND id < 5000) OR created_at IS NULL
    ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 61"""
)
def feed_cursor_page(spark, sf_dir):
    """The page behind a cursor, with one row more that tells whether another follows."""
    after = (datetime.datetime(1999, 1, 1), 5000)
    rows = L.winners(L.public(listings(spark, sf_dir)))
    return L.page(rows, "newest", 61, after).select(*SHOWN)


@query(LISTINGS + "SELECT id, dkey FROM winners")
def canonical_winner(spark, sf_dir):
    """The winner of every duplicate group of public rows."""
    return L.winners(L.public(listings(spark, sf_dir))).select("id", "dkey")


@query(
    LISTINGS
    + """SELECT id, dkey FROM (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM public
    WHERE price_usd BETWEEN 1000 AND 60000 AND NOT (deal = 'longRent' AND room_only)) WHERE rn = 1"""
)
def dedupe_after_filter(spark, sf_dir):
    """Winners among the rows that pass a filter (not the same as filtering winners)."""
    rows = L.matching(L.public(listings(spark, sf_dir)), L.ListingFilter(price=(1000, 60000)))
    return L.winners(rows).select("id", "dkey")


@query(
    """SELECT doc_id, k AS content_key, n AS copies FROM (SELECT doc_id, md5(regexp_replace(lower(trim(text, E' \\t\\n\\r')), '\\s+', ' ', 'g')) AS k,
    row_number() OVER (PARTITION BY md5(regexp_replace(lower(trim(text, E' \\t\\n\\r')), '\\s+', ' ', 'g')) ORDER BY doc_id) AS rn,
    count(*) OVER (PARTITION BY md5(regexp_replace(lower(trim(text, E' \\t\\n\\r')), '\\s+', ' ', 'g'))) AS n FROM documents) WHERE rn = 1"""
)
def content_winner(spark, sf_dir):
    """One document of each normalised text, the smallest id, and how many share it."""
    from tidewell.functions.keys import content_key

    docs = load(spark, sf_dir, "documents").select("doc_id", content_key(F.col("text")).alias("content_key"))
    return docs.groupBy("content_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(LISTINGS + f"SELECT id FROM public WHERE COALESCE(created_at, first_seen) >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def visibility_filter(spark, sf_dir):
    """Public rows of at most 14 days."""
    return L.fresh(L.public(listings(spark, sf_dir)), NOW, 30).select("id")


@query(LISTINGS + "SELECT id, commission FROM public WHERE commission IS DISTINCT FROM false AND by_agency AND NOT (deal = 'longRent' AND room_only)")
def tri_state_filter(spark, sf_dir):
    """Three-valued flags: commission isn't known to be false."""
    f = L.ListingFilter(true_flags=("by_agency",), not_false_flags=("commission",))
    return L.matching(L.public(listings(spark, sf_dir)), f).select("id", "commission")


@query(LISTINGS + "SELECT id FROM public WHERE commission = false AND NOT (deal = 'longRent' AND room_only)")
def explicit_false_filter(spark, sf_dir):
    """Only rows that say no commission."""
    return L.matching(L.public(listings(spark, sf_dir)), L.ListingFilter(false_flags=("commission",))).select("id")


@query(LISTINGS + "SELECT id, rooms, area FROM public WHERE rooms BETWEEN 2 AND 3 AND area >= 40 AND country IN ('ASIA', 'EUROPE')")
def range_filters(spark, sf_dir):
    """Inclusive ranges; nulls fail."""
    f = L.ListingFilter(countries=("ASIA", "EUROPE"), ranges={"rooms": (2, 3), "area": (40, None)}, include_rooms=True)
    return L.matching(L.public(listings(spark, sf_dir)), f).select("id", "rooms", "area")


@query(LISTINGS + "SELECT id, CAST(CAST(price_usd AS DECIMAL(20,4)) AS DOUBLE) AS price_usd FROM public WHERE price_usd / (1.0 / 0.9) >= 5000 AND price_usd / (1.0 / 0.9) <= 50000 * 1.1")
def fx_price_range(spark, sf_dir):
    """Price range in euros with a tolerance of a tenth at the top."""
    f = L.ListingFilter(price=(5000, 50000), currency="EUR", tolerance=0.1, include_rooms=True)
    return L.matching(L.public(listings(spark, sf_dir)), f).select("id", d4("price_usd"))


@query(LISTINGS + "SELECT id FROM public WHERE area > 0 AND price_usd / area BETWEEN 100 AND 500")
def price_per_sqm(spark, sf_dir):
    """Price per square metre; rows without an area fail."""
    f = L.ListingFilter(price_per_m2=(100, 500), include_rooms=True)
    return L.matching(L.public(listings(spark, sf_dir)), f).select("id")


@query(LISTINGS + "SELECT id FROM public WHERE contains(lower(city || ' ' || ptype), 'build') AND NOT (deal = 'longRent' AND room_only)")
def substring_filter(spark, sf_dir):
    """Substring search over joined fields."""
    return L.matching(L.public(listings(spark, sf_dir)), L.ListingFilter(text="Build")).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size <= 5 AND l_quantity >= 30)")
def term_semi_join(spark, sf_dir):
    """Orders that have a matching related row (EXISTS with a range)."""
    part = load(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey")
    items = load(spark, sf_dir, "lineitem").where("l_quantity >= 30").select("l_orderkey", "l_partkey")
    hits = items.join(part, items.l_partkey == part.p_partkey, "left_semi")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(hits, F.col("id") == F.col("l_orderkey"), "left_semi")


@query("SELECT c_custkey AS contact FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def hide_anti_join(spark, sf_dir):
    """Contacts without any row of a kind (NOT EXISTS)."""
    risky = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contact")).join(risky, F.col("contact") == F.col("o_custkey"), "left_anti")


@query(
    LISTINGS
    + """SELECT w.contact, count(*) AS properties, max(w.created_at) AS newest FROM winners w GROUP BY w.contact HAVING count(*) >= 2"""
)
def owner_collection(spark, sf_dir):
    """Contacts with at least two properties after deduplication."""
    rows = L.winners(L.public(listings(spark, sf_dir)))
    return rows.groupBy("contact").agg(F.count("*").alias("properties"), F.max("created_at").alias("newest")).where("properties >= 2")


@query(
    LISTINGS
    + """, o AS (SELECT contact, count(*) AS properties FROM winners GROUP BY contact HAVING count(*) >= 2)
    SELECT contact, properties FROM o WHERE properties < 5 OR (properties = 5 AND contact > 100) ORDER BY properties DESC, contact LIMIT 40"""
)
def owner_cursor(spark, sf_dir):
    """Owner list behind a cursor of mixed order (properties descending, contact ascending)."""
    o = owner_collection(spark, sf_dir).select("contact", "properties")
    return o.where("properties < 5 OR (properties = 5 AND contact > 100)").orderBy(F.desc("properties"), "contact").limit(40)


@query(
    LISTINGS
    + """SELECT l.id, o.id AS other FROM public l JOIN winners o ON l.contact = o.contact AND l.dkey <> o.dkey
    QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY o.created_at DESC NULLS LAST, o.id DESC) <= 3"""
)
def other_of_contact(spark, sf_dir):
    """Up to three other properties of the same contact, newest first."""
    from pyspark.sql import Window

    rows = L.public(listings(spark, sf_dir))
    others = L.winners(rows).select("contact", F.col("dkey").alias("okey"), F.col("id").alias("other"), F.col("created_at").alias("at"))
    met = rows.select("id", "contact", "dkey").join(others, "contact").where("dkey <> okey")
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("at"), F.desc("other"))
    return met.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("id", "other")


@query(
    LISTINGS
    + """, hits AS (SELECT id, row_number() OVER (ORDER BY id % 97, id) AS rank FROM listings)
    SELECT p.id, hits.rank FROM public p JOIN hits ON p.id = hits.id"""
)
def rank_list_join(spark, sf_dir):
    """Rows joined with a ranked list of search hits; the list has ids alone."""
    from pyspark.sql import Window

    rows = listings(spark, sf_dir)
    hits = rows.select("id", (F.col("id") % 97).alias("r"))
    bucketed = hits.groupBy("r").agg(F.count("*").alias("n"))
    before = bucketed.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = hits.join(before, "r").withColumn("rank", F.row_number().over(Window.partitionBy("r").orderBy("id")) + F.col("before"))
    return L.public(rows).select("id").join(ranked.select("id", "rank"), "id")


_CHANGED = """, changed AS (SELECT * REPLACE (CASE WHEN id % 11 = 3 THEN md5('moved' || CAST(contact AS VARCHAR)) ELSE dkey END AS dkey,
    CASE WHEN id % 11 = 5 THEN created_at + INTERVAL 3 DAY ELSE created_at END AS created_at) FROM public WHERE id % 11 NOT IN (7, 9) OR contact % 2 = 0)"""


def changes_to_listings(rows):
    """A batch of changes by rule: a new key, a later time, or gone; and rows that stay as they are."""
    k = F.col("id") % 11
    moved = rows.where(k.isin(3, 4, 5) | (k.isin(7, 9) & (F.col("contact") % 2 != 0)))
    return moved.withColumns({
        "dkey": F.when(k == 3, F.md5(F.concat(F.lit("moved"), F.col("contact").cast("string")))).otherwise(F.col("dkey")),
        "created_at": F.when(k == 5, F.col("created_at") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("created_at")),
        "gone": k.isin(7, 9),
    })


def kept_feed(spark, sf_dir):
    """The feed's kept winners after two batches, the second of which is a repetition."""
    from tidewell.operators.readmodel import KeptWinners
    from tidewell.session import shared_path

    rows = L.public(listings(spark, sf_dir))
    table = KeptWinners(shared_path(spark, "feed"), parts=16)
    table.create(rows)
    changes = changes_to_listings(rows)
    table.apply(changes.where("id % 2 = 0"))
    table.apply(changes)
    return table


@query(
    LISTINGS
    + _CHANGED
    + "SELECT id, dkey, created_at FROM changed QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY created_at DESC NULLS LAST, id DESC) = 1"
)
def kept_winners(spark, sf_dir):
    """Winners of the kept table after batches of changes: those of a full recount."""
    return kept_feed(spark, sf_dir).winners(spark).select("id", "dkey", "created_at")


@query(
    LISTINGS
    + _CHANGED
    + f"""SELECT {_SHOWN}, created_at FROM (SELECT * FROM changed QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
    ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 60"""
)
def kept_feed_page(spark, sf_dir):
    """The feed's first page, read from the kept winners without any election; the limit is the page."""
    return L.page(kept_feed(spark, sf_dir).winners(spark), "newest", 60).select(*SHOWN, "created_at")


@query(
    LISTINGS
    + """SELECT id FROM (SELECT *, id % 6 <> 2 AS active, CASE WHEN id % 8 = 3 THEN 'propertyWanted' WHEN id % 8 = 4 THEN NULL ELSE 'propertyOffer' END AS kind, CASE WHEN source = 's3' THEN 'custom' ELSE source END AS src, CASE WHEN id % 5 = 1 THEN true WHEN id % 5 = 2 THEN false END AS curated FROM listings)
    WHERE active AND status NOT IN ('sold', 'rented', 'closed', 'outdated') AND NOT commercial AND COALESCE(kind, 'propertyOffer') <> 'propertyWanted' AND (src <> 'custom' OR COALESCE(curated, false))"""
)
def public_rows(spark, sf_dir):
    """All rows that may be shown: active offers, and curated ones of the custom source."""
    k = F.col("id")
    rows = listings(spark, sf_dir).withColumns({
        "active": k % 6 != 2, "listing_kind": F.when(k % 8 == 3, "propertyWanted").when(k % 8 == 4, F.lit(None)).otherwise("propertyOffer"),
        "source": F.when(F.col("source") == "s3", "custom").otherwise(F.col("source")), "curated": F.when(k % 5 == 1, True).when(k % 5 == 2, False),
    })
    return L.public(rows).select("id")
