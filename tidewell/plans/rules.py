"""Identities, tags, hourly prices, lookups, retention and crawl rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import rules as R
from tidewell.plans.registry import query
from tidewell.plans.tables import LISTINGS, listings
from tidewell.session import Scratch, load

_PROFILES = """WITH p AS (SELECT o_orderkey AS id, o_custkey AS contact, o_orderpriority AS platform, o_orderkey % 40 AS subject, o_clerk AS username, 'name ' || o_custkey % 9 AS name FROM {0}),
  w AS (SELECT *, lag(contact) OVER o AS contact0, lag(platform) OVER o AS platform0, lag(subject) OVER o AS subject0, lag(username) OVER o AS username0, lag(name) OVER o AS name0 FROM p WINDOW o AS (PARTITION BY subject // 4, contact % 50 ORDER BY id))
"""
_ORDERS = "(SELECT *, 'u' || CAST(o_custkey % 30 AS VARCHAR) AS o_clerk FROM (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders))"


@query(
    _PROFILES.format(_ORDERS)
    + """SELECT id, CASE WHEN platform = platform0 AND subject = subject0 THEN 'platform_subject_id' WHEN contact = contact0 THEN 'verified_contact'
    WHEN platform = platform0 AND username = username0 THEN 'platform_username' WHEN name = name0 THEN 'display_name_only' ELSE 'no_shared_identifier' END AS basis,
    CASE WHEN platform = platform0 AND subject = subject0 THEN 1.0::DOUBLE WHEN contact = contact0 THEN 0.9::DOUBLE WHEN platform = platform0 AND username = username0 THEN 0.7::DOUBLE WHEN name = name0 THEN 0.1::DOUBLE END AS confidence,
    COALESCE((platform = platform0 AND subject = subject0) OR contact = contact0 OR (platform = platform0 AND username = username0), false) AS merge FROM w"""
)
def identity_match(spark, sf_dir):
    """How strongly a profile matches the one before it in its block."""
    own = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact"), F.col("o_orderpriority").alias("platform"),
        (F.col("o_orderkey") % 40).alias("subject"), F.concat(F.lit("u"), (F.col("o_custkey") % 30).cast("string")).alias("username"),
        F.concat(F.lit("name "), (F.col("o_custkey") % 9).cast("string")).alias("name"),
    )
    block = Window.partitionBy(F.floor(F.col("subject") / 4), F.col("contact") % 50).orderBy("id")
    kinds = ("platform", "subject", "contact", "username", "name")
    pairs = own.select("*", *[F.lag(k).over(block).alias(f"{k}0") for k in kinds])
    texts = {k: (F.col(k).cast("string"), F.col(f"{k}0").cast("string")) for k in kinds}
    return pairs.select("id", R.match_strength(**texts).alias("m")).select("id", "m.basis", "m.confidence", "m.merge")


@query(
    """WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '' ELSE lower(c_mktsegment) END AS account, CASE c_custkey % 3 WHEN 0 THEN lower(substr(c_mktsegment, 1, 4)) WHEN 1 THEN lower(n_name) END AS claimed FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT id, COALESCE(account <> '' AND claimed <> '' AND NOT contains(account, claimed) AND NOT contains(claimed, account), false) AS mismatch FROM n"""
)
def name_mismatch(spark, sf_dir):
    """Contacts that go by another name than the account's."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    account = F.when(k % 5 == 0, "").otherwise(F.lower("c_mktsegment"))
    claimed = F.when(k % 3 == 0, F.lower(F.substring("c_mktsegment", 1, 4))).when(k % 3 == 1, F.lower("n_name"))
    return rows.select(k.alias("id"), R.names_differ(account, claimed).alias("mismatch"))


@query(
    r"""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS price,
      CASE l_orderkey % 5 WHEN 0 THEN 'flat, ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' usd per hour' WHEN 1 THEN '1 ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ⃀ / час'
      WHEN 2 THEN 'посуточно 999 грн, почасовая: 350 грн/час' WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' uah per hourly' ELSE 'за час' END AS text FROM lineitem),
    a AS (SELECT *, list_transform(regexp_extract_all(text, '(?i)(\d[\d ]*)\s*(?:[⃀₴€$₸]|сом(?:ов)?|сум(?:ов)?|сўм|грн|тг|тенге|руб|usd|eur|uah|kgs|uzs|kzt)?\s*(?:/|за|per)\s*(?:час|hour|hr)(?:[^\p{L}\p{N}_]|$)', 1), lambda x: regexp_replace(x, '\D', '', 'g')) AS amounts FROM t)
    SELECT id, line, array_to_string(amounts, ',') AS amounts, CASE WHEN price IS NULL THEN len(amounts) > 0 ELSE len(list_filter(amounts, lambda x: ends_with(x, CAST(CAST(round(price) AS BIGINT) AS VARCHAR)))) > 0 END AS hourly FROM a"""
)
def hourly_prices(spark, sf_dir):
    """Amounts for an hour, and whether they are the listing's own price."""
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("long").cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("flat, "), q, F.lit(" usd per hour")))
        .when(k % 5 == 1, F.concat(F.lit("1 "), q, F.lit(" ⃀ / час")))
        .when(k % 5 == 2, "посуточно 999 грн, почасовая: 350 грн/час")
        .when(k % 5 == 3, F.concat(q, F.lit(" uah per hourly")))
        .otherwise("за час")
    )
    price = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    rows = load(spark, sf_dir, "lineitem").select(k.alias("id"), F.col("l_linenumber").alias("line"), text.alias("text"), price.alias("price"))
    amounts = F.array_join(R.hourly_amounts(F.col("text")), ",").alias("amounts")
    return rows.select("id", "line", amounts, R.is_hourly(F.col("text"), F.col("price")).alias("hourly"))


@query(
    LISTINGS
    + """SELECT id, array_to_string(list_filter([CASE WHEN rooms <> 0 THEN CAST(rooms AS VARCHAR) || ' rooms' END,
    CASE deal WHEN 'sale' THEN 'for sale' WHEN 'longRent' THEN 'long-term rent' WHEN 'shortRent' THEN 'short-term rent' END,
    CASE WHEN by_agency THEN 'agency' ELSE 'owner' END, city, country, CASE WHEN room_only THEN 'room only' END, CASE WHEN id % 3 = 0 THEN 'pets ok' END, CASE WHEN id % 4 = 0 THEN 'deposit' END,
    CASE WHEN NOT commission THEN 'no commission' WHEN commission THEN CASE WHEN id % 6 <> 0 THEN 'commission ' || CAST(id % 6 AS VARCHAR) || '%' ELSE 'commission' END END], lambda x: x IS NOT NULL), '; ') AS tags FROM listings"""
)
def listing_tags(spark, sf_dir):
    """Tags of every listing from its facts."""
    k = F.col("id")
    own = R.tags(
        F.col("rooms"), F.col("deal"), F.col("by_agency"), F.array("city", "country"), F.col("room_only"), k % 3 == 0, k % 4 == 0,
        F.col("commission"), k % 6,
    )
    return listings(spark, sf_dir).select("id", F.array_join(own, "; ").alias("tags"))


@query(
    """WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS skills, lag(string_split(p_name, ' ')) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before, p_size % 7 AS phone, lag(p_size % 7) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS phone0 FROM part),
    s AS (SELECT id, phone = phone0 AS same, COALESCE(len(list_intersect(list_distinct(skills), list_distinct(before)))::DOUBLE / least(len(list_distinct(skills)), len(list_distinct(before))), 0) AS shared FROM w)
    SELECT id, COALESCE(same, false) AS merge, shared >= 0.6 AS corroborated, CASE WHEN COALESCE(same, false) THEN 'strong' WHEN shared >= 0.6 THEN 'weak' ELSE 'none' END AS strength FROM s"""
)
def candidate_match(spark, sf_dir):
    """A profile against the one before it in its block: identifiers merge, overlaps only corroborate."""
    block = Window.partitionBy("p_brand").orderBy("p_partkey")
    skills, phone = F.split("p_name", " "), F.col("p_size") % 7
    rows = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.coalesce(phone == F.lag(phone).over(block), F.lit(False)).alias("merge"),
        (R.overlap(skills, F.lag(skills).over(block)) >= 0.6).alias("corroborated"),
    )
    return rows.withColumn("strength", F.when(F.col("merge"), "strong").when(F.col("corroborated"), "weak").otherwise("none"))


@query(
    """WITH k AS (SELECT event_id AS place, user_id % 97 || ':' || event_type AS key, value FROM events)
    SELECT key, min(place) AS place, arg_max(value, place) AS value FROM k GROUP BY key"""
)
def last_wins_first_place(spark, sf_dir):
    """Of items with one key the last, at the place of the first."""
    key = F.concat_ws(":", (F.col("user_id") % 97).cast("string"), "event_type")
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("place"), key.alias("key"), "value")
    return R.last_at_first_place(rows, ["key"], "place")


@query(
    """WITH s AS (SELECT s_suppkey * 3 + s_suppkey % 2 AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier), n AS (SELECT count(*) AS n FROM s)
    SELECT id FROM s, n WHERE n <= 12 OR (place - (28800001 // 30 * 12) % n + n) % n < 12"""
)
def rotating_targets(spark, sf_dir):
    """The crawl targets whose turn it is."""
    targets = load(spark, sf_dir, "supplier").select(F.expr("s_suppkey * 3 + s_suppkey % 2").alias("id"))  # ids with gaps
    placed = R.placed(targets, ["id"], Scratch(spark))
    return R.rotating(placed, F.col("place"), 28_800_001).select("id")


@query(
    """SELECT event_type AS lane, count(*) FILTER (WHERE value < 20) AS waiting, count(*) FILTER (WHERE value >= 20 AND value < 30) AS running, count(*) FILTER (WHERE value >= 99) AS dead,
    count(*) FILTER (WHERE value < 20 AND ts < TIMESTAMP '2024-01-15') AS overdue, min(ts) FILTER (WHERE value < 20) AS oldest FROM events GROUP BY event_type"""
)
def queue_stats(spark, sf_dir):
    """Tasks of every lane by state, those overdue and the oldest that waits."""
    waits = F.col("value") < 20
    late = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lane")).agg(
        F.count_if(waits).alias("waiting"), F.count_if((F.col("value") >= 20) & (F.col("value") < 30)).alias("running"),
        F.count_if(F.col("value") >= 99).alias("dead"), F.count_if(waits & late).alias("overdue"), F.min(F.when(waits, F.col("ts"))).alias("oldest"),
    )


@query(
    """WITH u AS (SELECT c_custkey AS id FROM customer), a AS (SELECT o_custkey AS id, count(*) AS feeds, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
    SELECT u.id, COALESCE(feeds, 0) AS feeds, CASE WHEN feeds IS NULL THEN 'orphan' WHEN last < TIMESTAMP '1997-01-01' THEN 'stale' ELSE 'kept' END AS state FROM u LEFT JOIN a ON u.id = a.id"""
)
def subscription_retention(spark, sf_dir):
    """Subscribers by what retention does with them: aggregate, then left join, in place of a lateral query."""
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    feeds = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("feeds"), F.max("o_orderdate").alias("last"))
    state = F.when(F.col("feeds").isNull(), "orphan").when(F.col("last") < F.lit("1997-01-01").cast("timestamp_ntz"), "stale").otherwise("kept")
    return users.join(feeds, "id", "left").select("id", F.coalesce("feeds", F.lit(0)).alias("feeds"), state.alias("state"))


@query(
    """WITH wanted AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS value FROM labels WHERE toxic = 1 UNION SELECT url FROM pages WHERE page_id % 10 = 3)
    SELECT page_id, url FROM pages WHERE CAST(page_id AS VARCHAR) IN (SELECT value FROM wanted) OR url IN (SELECT value FROM wanted)"""
)
def lookup_id_or_url(spark, sf_dir):
    """Pages by id or URL: a union of two equality joins."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    ids = load(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("value"))
    wanted = ids.union(pages.where("page_id % 10 = 3").select("url")).distinct()
    return R.lookup(pages, wanted, ["page_id", "url"])


@query(
    LISTINGS
    + """, terms AS (SELECT id, 'country' AS kind, country AS term FROM listings UNION ALL SELECT id, 'city', city FROM listings UNION ALL SELECT id, 'metro', 'm' || CAST(contact % 25 AS VARCHAR) FROM listings
      UNION ALL SELECT id, 'metro', 'm' || CAST(id % 25 AS VARCHAR) FROM listings WHERE id % 2 = 0)
    SELECT DISTINCT id, kind, lower(trim(term)) AS term FROM terms WHERE trim(term) <> ''"""
)
def location_terms(spark, sf_dir):
    """The search terms of every listing's place, one row each: a scan, no union of scans."""
    metro = F.array(
        F.concat(F.lit("m"), (F.col("contact") % 25).cast("string")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("m"), (F.col("id") % 25).cast("string")))
    )
    kinds = F.map_from_arrays(F.array(F.lit("country"), F.lit("city"), F.lit("metro")), F.array(F.array("country"), F.array("city"), metro))
    rows = listings(spark, sf_dir).select("id", F.explode(kinds).alias("kind", "terms"))
    rows = rows.select("id", "kind", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(F.trim(t))))).alias("term"))
    return rows.where("term <> ''")


@query(
    LISTINGS
    + """, stations AS (SELECT DISTINCT 'm' || CAST(n_nationkey AS VARCHAR) AS term FROM nation WHERE n_regionkey = 3)
    SELECT id FROM listings WHERE 'm' || CAST(contact % 25 AS VARCHAR) IN (SELECT term FROM stations) OR (id % 2 = 0 AND 'm' || CAST(id % 25 AS VARCHAR) IN (SELECT term FROM stations))"""
)
def metro_match(spark, sf_dir):
    """Listings at one of the wanted stations, by their own or any other term."""
    stations = load(spark, sf_dir, "nation").where("n_regionkey = 3").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("term")).distinct()
    terms = location_terms(spark, sf_dir).where("kind = 'metro'")
    return terms.join(F.broadcast(stations), "term", "left_semi").select("id").distinct()  # at most 25 stations by definition


@query(
    """SELECT page_id FROM pages WHERE regexp_matches(html, '<img[^>]* src="[^" ]') OR (page_id % 4 = 0 AND len(list_filter([url, ''], lambda x: trim(x) <> '')) > 0)"""
)
def has_photos(spark, sf_dir):
    """Pages with a photo of their own or in a list."""
    rest = F.when(F.col("page_id") % 4 == 0, F.array("url", F.lit("")))
    listed = F.coalesce(F.exists(rest, lambda x: F.trim(x) != ""), F.lit(False))
    return load(spark, sf_dir, "pages").where(F.rlike("html", F.lit('<img[^>]* src="[^" ]')) | listed).select("page_id")


@query(
    LISTINGS + """, l AS (SELECT id, source, CASE WHEN id % 2 = 0 THEN 'a:' ELSE '' END || CAST(id AS VARCHAR) AS own FROM listings)
    SELECT own, source FROM l WHERE (source, own) IN (SELECT ('s' || CAST(doc_id % 4 AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'a:' ELSE '' END || CAST(doc_id AS VARCHAR)) FROM labels WHERE quality = 1)"""
)
def pair_key_filter(spark, sf_dir):
    """Rows whose (source, id) is among keys given as one string each: the source up to the first colon, the id all behind it."""
    own = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "a:").otherwise(""), F.col(c).cast("string"))
    keys = load(spark, sf_dir, "labels").where("quality = 1")
    keys = keys.select(F.concat_ws(":", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")), own("doc_id")).alias("key"))
    keys = keys.select(*R.pair_key("key", "source", "own"))
    rows = listings(spark, sf_dir).select(own("id").alias("own"), "source")
    return rows.join(keys, ["source", "own"], "left_semi").select("own", "source")


@query(
    LISTINGS + """SELECT id, COALESCE(created_at, first_seen) AS recency FROM listings ORDER BY recency DESC NULLS LAST, id LIMIT 200"""
)
def enrichment_queue(spark, sf_dir):
    """The 200 listings to enrich next: newest by the first time that is stated."""
    rows = listings(spark, sf_dir).select("id", F.coalesce("created_at", "first_seen").alias("recency"))
    return rows.orderBy(*R.newest_first("recency"), "id").limit(200)


@query(
    """WITH r AS (SELECT user_id AS source, event_id, ts, value >= 40 AS ok, CAST(floor(value) AS BIGINT) AS n FROM events)
    SELECT source, arg_max(ok, event_id) AS last_ok, max(ts) FILTER (WHERE ok) AS last_success, arg_max(n, event_id) FILTER (WHERE ok) AS last_count, count(*) FILTER (WHERE NOT ok) AS failures FROM r GROUP BY source"""
)
def source_diagnostics(spark, sf_dir):
    """Each source's last run; a failure leaves the last success as it is."""
    ok = F.col("value") >= 40
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(
        F.max_by(ok, "event_id").alias("last_ok"), F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max_by(F.when(ok, F.floor("value")), F.when(ok, F.col("event_id"))).cast("long").alias("last_count"), F.count_if(~ok).alias("failures"),
    )


@query(
    """WITH s AS (SELECT c_custkey AS id, 'sum ' || c_mktsegment AS summary FROM customer), d AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS detail FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
    SELECT s.id, COALESCE(detail, summary) AS text, detail IS NOT NULL AS enriched FROM s LEFT JOIN d ON s.id = d.id"""
)
def detail_or_summary(spark, sf_dir):
    """Summaries replaced by the last detail fetched, kept where there is none."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("sum "), "c_mktsegment").alias("summary"))
    details = load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("detail"))
    return rows.join(details, "id", "left").select("id", F.coalesce("detail", "summary").alias("text"), F.col("detail").isNotNull().alias("enriched"))


@query(
    LISTINGS
    + """, s AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS date_updates, count(*) FILTER (WHERE l_linestatus = 'F') AS reappearances, arg_max(l_shipdate, (l_linenumber, l_shipdate)) FILTER (WHERE l_returnflag = 'R') AS latest FROM lineitem GROUP BY l_orderkey),
    g AS (SELECT dkey, count(*) AS n FROM listings GROUP BY dkey), c AS (SELECT dkey, source, contact, count(*) AS n, min(first_seen) AS first_seen FROM listings GROUP BY ALL)
    SELECT l.id, c.first_seen, COALESCE(date_updates, 0) AS date_updates, COALESCE(reappearances, 0) AS reappearances, latest, c.n - 1 AS reposts, g.n - 1 AS duplicates
    FROM listings l JOIN g ON g.dkey = l.dkey JOIN c ON c.dkey = l.dkey AND c.source = l.source AND c.contact = l.contact LEFT JOIN s ON s.id = l.id"""
)
def activity_summary(spark, sf_dir):
    """Activity of every listing: correlated counts as aggregates, joined once each."""
    rows = listings(spark, sf_dir).select("id", "dkey", "source", "contact", "first_seen")
    again = F.col("l_returnflag") == "R"
    seen = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count_if(again).alias("date_updates"), F.count_if(F.col("l_linestatus") == "F").alias("reappearances"),
        F.max_by(F.when(again, F.col("l_shipdate")), F.when(again, F.struct("l_linenumber", "l_shipdate"))).alias("latest"),
    )
    contacts = rows.groupBy("dkey", "source", "contact").agg(F.count("*").alias("n"), F.min("first_seen").alias("earliest"))
    groups = contacts.groupBy("dkey").agg(F.sum("n").alias("all"))
    found = rows.join(contacts, ["dkey", "source", "contact"]).join(groups, "dkey").join(seen, "id", "left")
    return found.select(
        "id", F.col("earliest").alias("first_seen"), F.coalesce("date_updates", F.lit(0)).alias("date_updates"),
        F.coalesce("reappearances", F.lit(0)).alias("reappearances"), "latest", (F.col("n") - 1).alias("reposts"), (F.col("all") - 1).alias("duplicates"),
    )


@query(
    """WITH e AS (SELECT DISTINCT n_name AS city, r_name AS country FROM nation JOIN region ON r_regionkey = n_regionkey), locales AS (SELECT unnest(['en', 'uk']) AS locale),
    present AS (SELECT n_name AS city, 'en' AS locale, md5(n_name || '|' || CAST(n_regionkey AS VARCHAR)) AS hash FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_name, 'uk', 'old' FROM nation WHERE n_nationkey % 2 = 0),
    fresh AS (SELECT n_name AS city, locale, md5(n_name || '|' || CAST(n_regionkey AS VARCHAR)) AS hash FROM nation, locales),
    j AS (SELECT f.city, f.locale, CASE WHEN p.hash IS NULL THEN 'insert' WHEN p.hash <> f.hash THEN 'update' ELSE 'same' END AS change FROM fresh f LEFT JOIN present p ON p.city = f.city AND p.locale = f.locale)
    SELECT country, locale, count(*) AS expected, count(*) FILTER (WHERE change <> 'insert') AS present, count(*) FILTER (WHERE change = 'update') AS outdated FROM j JOIN e ON e.city = j.city GROUP BY country, locale"""
)
def projection_coverage(spark, sf_dir):
    """What a projection lacks: its rows compared with fresh ones by the hash of their input."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    hashed = F.md5(F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string")))
    locales = F.explode(F.array(F.lit("en"), F.lit("uk"))).alias("locale")
    fresh = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", F.col("r_name").alias("country"), hashed.alias("hash"), locales)
    english = nation.where("n_nationkey % 3 <> 0").select("n_name", F.lit("en").alias("locale"), hashed.alias("old"))
    present = english.unionByName(nation.where("n_nationkey % 2 = 0").select("n_name", F.lit("uk").alias("locale"), F.lit("old").alias("old")))
    both = fresh.join(present, ["n_name", "locale"], "left")
    return both.groupBy("country", "locale").agg(
        F.count("*").alias("expected"), F.count("old").alias("present"), F.count_if(F.col("old") != F.col("hash")).alias("outdated")
    )
