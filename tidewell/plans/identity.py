"""Listing keys, clone relations, provenance and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import geo
from tidewell.functions.text import words
from tidewell.operators import identity as I
from tidewell.operators import listing as L
from tidewell.plans.registry import query
from tidewell.plans.stats import _d
from tidewell.plans.tables import LISTINGS, NOW, d4, listings
from tidewell.plans.texts import POINTS, points
from tidewell.session import load

_KEY = """CASE WHEN rooms IS NOT NULL AND id % 2 = 0 THEN 'cross:contact-address:' || md5(upper(country) || '|' || lower(city) || '|' || deal || '|' || ptype || '|' || '5550' || lpad(CAST(contact AS VARCHAR), 8, '0')
  || '|' || regexp_replace('street, ' || lower(city) || ' ' || CAST(contact AS VARCHAR), '[[:space:][:punct:]]+', ' ', 'g') || '|' || CAST(rooms AS VARCHAR) || '|' || CAST(CAST(area AS DECIMAL(20,1)) AS VARCHAR) || '|') ELSE source || ':' || upper(country) || ':' || CAST(id AS VARCHAR) END"""


@query(LISTINGS + f"SELECT id, {_KEY} AS listing_key FROM listings")
def listing_keys(spark, sf_dir):
    """The duplicate key of every listing, by the first rule that applies."""
    rows = listings(spark, sf_dir).withColumn("source_id", F.col("id").cast("string"))
    rows = rows.withColumn("phone", F.when(F.col("id") % 2 == 0, F.concat(F.lit("+555 0-"), F.lpad(F.col("contact").cast("string"), 8, "0"))))
    rows = rows.withColumn("address", F.concat(F.lit("Street, "), F.col("city"), F.lit(" "), F.col("contact").cast("string")))
    return rows.select("id", I.listing_key(rows.columns).alias("listing_key"))


_PAIRS = (
    LISTINGS
    + """, pr AS (SELECT a.id AS a_id, b.id AS b_id, a.created_at AS a_at, b.created_at AS b_at, a.by_agency AS a_ag, b.by_agency AS b_ag, a.price AS a_p, b.price AS b_p, a.currency AS a_c, b.currency AS b_c,
    a.rooms AS a_r, b.rooms AS b_r, a.area AS a_ar, b.area AS b_ar, a.city AS a_city, b.city AS b_city, a.source = b.source AS same_source FROM listings a JOIN listings b ON a.contact = b.contact AND a.deal = b.deal AND a.id > b.id),
    q AS (SELECT *, CASE WHEN a_at IS NULL OR b_at IS NULL THEN 'unknown' WHEN a_at > b_at + INTERVAL 15 MINUTE THEN 'later' WHEN a_at < b_at - INTERVAL 15 MINUTE THEN 'earlier' ELSE 'ambiguous' END AS chronology,
      CASE WHEN a_ag = b_ag THEN 'same' WHEN a_ag THEN 'owner_to_agency' ELSE 'agency_to_owner' END AS seller, CASE WHEN a_p > 0 AND b_p > 0 AND a_c = b_c THEN (a_p - b_p) / b_p * 100 END AS delta,
      (CASE WHEN a_r = b_r THEN 1 ELSE 0 END + CASE WHEN abs(a_ar - b_ar) <= greatest(2, b_ar * 0.05) THEN 1 ELSE 0 END + CASE WHEN a_city = b_city THEN 1 ELSE 0 END) >= ceil((CASE WHEN a_r IS NULL OR b_r IS NULL THEN 2 ELSE 3 END) / 2.0) AS consistent FROM pr),
    s AS (SELECT *, least(100, 35 + CASE WHEN consistent THEN 10 ELSE 0 END + CASE WHEN seller <> 'same' THEN 10 ELSE 0 END + CASE WHEN abs(delta) >= 15 THEN 20 ELSE 0 END + CASE WHEN chronology = 'later' THEN 15 ELSE 0 END + CASE WHEN a_city <> b_city THEN 30 ELSE 0 END) AS score FROM q)
    """
)


def _relations(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("title", F.col("city"))
    keep = ["id", "created_at", "by_agency", "price", "currency", "rooms", "area", "title", "country", "city", "source"]
    a = rows.select("contact", "deal", *[F.col(c).alias(f"a_{c}") for c in keep])
    b = rows.select("contact", "deal", *[F.col(c).alias(f"b_{c}") for c in keep])
    return I.clone_relation(a.join(b, ["contact", "deal"]).where("a_id > b_id"))


@query(_PAIRS + "SELECT a_id, b_id, chronology, seller, consistent, score FROM s")
def clone_relations(spark, sf_dir):
    """Clone relation and score of every pair of listings that share a contact and deal."""
    return _relations(spark, sf_dir).select("a_id", "b_id", "chronology", "seller", "consistent", F.col("score").cast("int").alias("score"))


@query(
    _PAIRS
    + """SELECT relation, count(*) AS n FROM (SELECT CASE WHEN same_source AND NOT conflict THEN 'repost' WHEN NOT conflict THEN 'cross_post' WHEN chronology = 'later' AND score >= 60 THEN 'likely_derived'
    WHEN chronology = 'earlier' AND score >= 60 THEN 'possible_original' ELSE 'undetermined' END AS relation FROM (SELECT *, seller <> 'same' OR COALESCE(abs(delta) >= 15, false) OR a_city <> b_city AS conflict FROM s)) GROUP BY relation"""
)
def lineage_counts(spark, sf_dir):
    """Pairs by their lineage relation."""
    r = _relations(spark, sf_dir)
    kind = I.lineage(r, F.col("a_source") == F.col("b_source"), F.lit(True))
    return r.select(kind.alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query(
    """WITH j AS (SELECT c_custkey % 500 AS cluster, o_orderstatus <> 'F' AS active, o_orderdate AS posted_at, o_orderdate + INTERVAL 20 DAY AS seen_at, o_orderpriority AS destination, o_custkey AS recruiter,
      CASE WHEN o_orderkey % 9 = 0 THEN 'gmail.com' WHEN o_orderkey % 50 = 0 THEN 'other.org' ELSE 'jobs.acme.com' END AS mail FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT cluster, count(*) AS n, count(*) FILTER (WHERE active AND posted_at < TIMESTAMP '2001-08-02' - INTERVAL 180 DAY AND NOT seen_at > TIMESTAMP '2001-08-02' - INTERVAL 30 DAY) AS stale,
      count(DISTINCT destination) AS d, count(DISTINCT recruiter) AS r, count(*) FILTER (WHERE mail = 'other.org') AS apart FROM j GROUP BY cluster)
    SELECT cluster, 'permanent_reposting' AS reason, n AS independent FROM g WHERE n >= 6 UNION ALL SELECT cluster, 'stale_job', 1 FROM g WHERE stale > 0 UNION ALL SELECT cluster, 'application_destination_changed', d FROM g WHERE d > 1
    UNION ALL SELECT cluster, 'recruiter_identity_rotation', r FROM g WHERE r >= 3 UNION ALL SELECT cluster, 'job_contact_domain_mismatch', 1 FROM g WHERE apart > 0"""
)
def job_provenance(spark, sf_dir):
    """Findings about every cluster of postings."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("o_orderkey")
    mail = F.when(k % 9 == 0, "gmail.com").when(k % 50 == 0, "other.org").otherwise("jobs.acme.com")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        (F.col("c_custkey") % 500).alias("cluster"), (F.col("o_orderstatus") != "F").alias("active"), F.col("o_orderdate").alias("posted_at"),
        (F.col("o_orderdate") + F.expr("interval 20 days")).alias("seen_at"), F.col("o_orderpriority").alias("destination"),
        F.col("o_custkey").cast("string").alias("recruiter"), mail.alias("contact_domain"), F.lit("acme.com").alias("company_domain"),
    )
    return I.provenance_findings(rows, "cluster", NOW)


@query(
    """SELECT a.doc_id AS original, b.doc_id AS copy FROM (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 200 GROUP BY 1) f JOIN documents a ON a.doc_id = f.doc_id
    JOIN documents b ON md5(b.text) = f.h AND b.doc_id <> a.doc_id AND b.source <> a.source"""
)
def copied_job(spark, sf_dir):
    """Long texts that stand under another source as well, against the first with the text."""
    d = load(spark, sf_dir, "documents").where(F.length("text") >= 200).select("doc_id", "source", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    met = d.join(first, "h").where((F.col("doc_id") != F.col("f.doc_id")) & (F.col("source") != F.col("f.source")))
    return met.select(F.col("f.doc_id").alias("original"), F.col("doc_id").alias("copy"))


@query(
    """SELECT l_suppkey AS contact, count(DISTINCT l_partkey) AS properties, count(DISTINCT l_returnflag) AS commissions, count(DISTINCT l_partkey) >= 6 AND count(DISTINCT l_returnflag) > 1 AS flagged FROM lineitem GROUP BY l_suppkey"""
)
def role_consistency(spark, sf_dir):
    """Self-declared owners with many properties and no constant commission."""
    out = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("contact")).agg(
        F.countDistinct("l_partkey").alias("properties"), F.countDistinct("l_returnflag").alias("commissions")
    )
    return out.withColumn("flagged", (F.col("properties") >= 6) & (F.col("commissions") > 1))


@query(
    LISTINGS
    + """, c AS (SELECT contact, count(DISTINCT dkey) AS n, count(*) FILTER (WHERE status <> 'active') AS closed FROM listings GROUP BY contact)
    SELECT contact, CASE WHEN closed >= 3 THEN 'phantom_risk' WHEN n = 1 THEN 'steady' WHEN n > 5 THEN 'multi_listing' ELSE 'none' END AS line FROM c"""
)
def listing_lines(spark, sf_dir):
    """The line that a contact's listings get: risk before steadiness before number."""
    c = listings(spark, sf_dir).groupBy("contact").agg(F.countDistinct("dkey").alias("n"), F.count_if(F.col("status") != "active").alias("closed"))
    line = F.when(F.col("closed") >= 3, "phantom_risk").when(F.col("n") == 1, "steady").when(F.col("n") > 5, "multi_listing")
    return c.select("contact", line.otherwise("none").alias("line"))


@query(
    """SELECT o_orderkey AS id, COALESCE(CASE WHEN o_orderkey % 3 = 0 THEN 'own' END, CASE WHEN o_orderkey % 5 = 0 THEN 'parsed' END, 'guessed') AS value,
    CASE WHEN o_orderkey % 3 = 0 THEN 'source' WHEN o_orderkey % 5 = 0 THEN 'text' ELSE 'model' END AS origin FROM orders"""
)
def field_provenance(spark, sf_dir):
    """First known value by priority, with its origin."""
    k = F.col("o_orderkey")
    found = I.first_known([("source", F.when(k % 3 == 0, "own")), ("text", F.when(k % 5 == 0, "parsed")), ("model", F.lit("guessed"))])
    return load(spark, sf_dir, "orders").select(k.alias("id"), found.alias("f")).select("id", "f.value", "f.origin")


@query(
    """SELECT o_orderkey AS id, CASE WHEN n IS NULL OR n = '' THEN o WHEN o IS NULL OR o = '' OR nr < orr THEN n ELSE o END AS kept FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'old' END AS o,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'new' END AS n, o_orderkey % 5 AS orr, o_orderkey % 7 AS nr FROM orders)"""
)
def sticky_merge(spark, sf_dir):
    """Old values stay unless blank or beaten by a stronger origin."""
    k = F.col("o_orderkey")
    old = F.when(k % 3 == 0, "").when(k % 3 == 1, "old")
    new = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "").otherwise("new")
    return load(spark, sf_dir, "orders").select(k.alias("id"), I.sticky(old, new, k % 5, k % 7).alias("kept"))


@query(
    POINTS
    + """, n AS (SELECT a.point, min(2 * 6371000.0::DOUBLE * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2))))) AS d
      FROM p a JOIN p b ON a.point <> b.point GROUP BY a.point)
    SELECT point, CAST(CAST(least(3000, greatest(300, 0.45 * d)) AS DECIMAL(20,2)) AS DOUBLE) AS radius FROM n"""
)
def zone_radii(spark, sf_dir):
    """Radii of zones that don't overlap: a share of the way to the nearest other centre, for all points; see ``scores.zone_radii``."""
    from tidewell.operators.scores import zone_radii as radii

    return radii(points(spark, sf_dir), "point").withColumnRenamed("id", "point")


@query(
    POINTS
    + """, b AS (SELECT point, fmod(degrees(atan2(sin(radians(lng) - radians(30.7::DOUBLE)) * cos(radians(lat)), cos(radians(46.4::DOUBLE)) * sin(radians(lat)) - sin(radians(46.4::DOUBLE)) * cos(radians(lat)) * cos(radians(lng) - radians(30.7::DOUBLE)))) + 360, 360) AS angle FROM p)
    SELECT point FROM b WHERE angle >= 300 OR angle <= 45"""
)
def bearing_wedge(spark, sf_dir):
    """Points in a wedge of bearings that goes over north."""
    angle = geo.bearing(F.col("lat"), F.col("lng"), 46.4, 30.7)
    return points(spark, sf_dir).where(geo.in_wedge(angle, 300, 45)).select("point")


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"


@query(f"WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), q AS (SELECT ['the', 'of', 'and', 'unseenword'] AS t) SELECT doc_id, len(list_intersect(w, t)) AS matched FROM d, q WHERE len(list_intersect(w, t)) >= 0.7 * 4")
def seventy_percent_terms(spark, sf_dir):
    """Texts that hold at least seven tenths of a query's words."""
    terms = F.array(*[F.lit(t) for t in ("the", "of", "and", "unseenword")])
    d = load(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(F.array_distinct(words(F.col("text"))), terms)).cast("long").alias("matched"))
    return d.where(F.col("matched") >= 0.7 * 4)


@query("SELECT p_partkey AS id, levenshtein(split_part(lower(p_name), ' ', 2), 'widgit') AS edits FROM part WHERE levenshtein(split_part(lower(p_name), ' ', 2), 'widgit') <= 2 AND substr(split_part(lower(p_name), ' ', 2), 1, 1) = 'w'")
def fuzzy_terms(spark, sf_dir):
    """Words within two edits of a query word of at least six letters, its first letter fixed."""
    word = F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2))
    edits = F.levenshtein(word, F.lit("widgit"))
    return load(spark, sf_dir, "part").where((edits <= 2) & (F.substring(word, 1, 1) == "w")).select(F.col("p_partkey").alias("id"), edits.cast("long").alias("edits"))


@query(
    """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn <= 2"""
)
def capped_lists(spark, sf_dir):
    """Lists cut to their two strongest entries; the cap is the feature."""
    counts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn <= 2").drop("rn")


@query(
    """SELECT event_id, event_type FROM (SELECT event_id, event_type, ts FROM events WHERE ts < TIMESTAMP '2024-01-31' - CASE WHEN event_type = 'view' THEN INTERVAL 1 HOUR ELSE INTERVAL 10 MINUTE END) ORDER BY ts, event_id LIMIT 100"""
)
def due_rows(spark, sf_dir):
    """Rows whose time to live by state has passed, oldest first; the limit is the batch."""
    ttl = F.when(F.col("event_type") == "view", F.expr("interval 1 hour")).otherwise(F.expr("interval 10 minutes"))
    rows = load(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz") - ttl)
    return rows.orderBy("ts", "event_id").limit(100).select("event_id", "event_type")


@query("SELECT user_id, sha256(string_agg(DISTINCT event_type, chr(31) ORDER BY event_type)) AS media_hash FROM events GROUP BY user_id")
def media_hashes(spark, sf_dir):
    """Hash of a set whose order doesn't matter."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), "\x1f")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.sha2(kinds, 256).alias("media_hash"))


@query(
    LISTINGS
    + f"""SELECT l.country, f.lang, count(*) AS n, {_d("avg(l.area)")} AS area FROM listings l JOIN (SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'AMERICA' WHEN 'de' THEN 'EUROPE' WHEN 'fr' THEN 'AFRICA' ELSE 'ASIA' END AS country FROM documents) f ON f.country = l.country GROUP BY ALL"""
)
def alias_join(spark, sf_dir):
    """Canonical names by a lookup table of aliases."""
    lang = F.col("lang")
    land = F.when(lang == "en", "AMERICA").when(lang == "de", "EUROPE").when(lang == "fr", "AFRICA").otherwise("ASIA")
    aliases = load(spark, sf_dir, "documents").select("lang", land.alias("country")).distinct()
    out = listings(spark, sf_dir).join(aliases, "country").groupBy("country", "lang").agg(F.count("*").alias("n"), F.avg("area").alias("area"))
    return out.select("country", "lang", "n", d4("area"))


@query(LISTINGS + "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest FROM (SELECT dkey, count(*) AS n FROM public GROUP BY dkey HAVING count(*) > 1)")
def duplicate_groups(spark, sf_dir):
    """How many duplicate groups there are, and how large."""
    g = L.public(listings(spark, sf_dir)).groupBy("dkey").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.max("n").alias("largest"))
