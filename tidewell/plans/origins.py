"""Originals of postings, duplicates of listings, payment patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import origins
from tidewell.plans.registry import query
from tidewell.plans.tables import LISTINGS, listings
from tidewell.session import load

# Documents as postings: texts that stand in several documents are one posting on several boards.
_JOBS = """jobs AS (SELECT lang || ':' || CAST(n_chars AS VARCHAR) AS cluster, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'companies' ELSE 'board' || CAST(doc_id % 3 AS VARCHAR) END AS source,
    CASE WHEN doc_id % 20 = 8 THEN 'agency' ELSE 'direct' END AS employer_type, CASE WHEN doc_id % 2 = 0 THEN 'Firm ' || lang || ', Ltd.' ELSE 'FIRM ' || lang END AS company, upper(lang) || CASE WHEN doc_id % 2 = 0 THEN '  role' ELSE ' Role' END AS title,
    text AS description, 'https://firm.example/jobs/' || substr(md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 10) || CASE WHEN doc_id % 3 = 0 THEN '#top' ELSE '' END AS page FROM documents)"""


def jobs(spark, sf_dir):
    """See _JOBS for the same in SQL."""
    k, lang = F.col("doc_id"), F.col("lang")
    page = F.concat(F.lit("https://firm.example/jobs/"), F.substring(F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))), 1, 10), F.when(k % 3 == 0, "#top").otherwise(""))
    return load(spark, sf_dir, "documents").select(
        F.concat_ws(":", lang, F.col("n_chars").cast("string")).alias("cluster"), k.alias("id"), F.when(k % 4 == 0, "companies").otherwise(F.concat(F.lit("board"), (k % 3).cast("string"))).alias("source"),
        F.when(k % 20 == 8, "agency").otherwise("direct").alias("employer_type"), F.when(k % 2 == 0, F.concat(F.lit("Firm "), lang, F.lit(", Ltd."))).otherwise(F.concat(F.lit("FIRM "), lang)).alias("company"),
        F.concat(F.upper(lang), F.when(k % 2 == 0, "  role").otherwise(" Role")).alias("title"), F.col("text").alias("description"), page.alias("url"), page.alias("apply_url"),
        F.when(k % 7 > 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 400).cast("int"))).alias("posted_at"),
    )


@query(
    f"""WITH {_JOBS}, j AS (SELECT *, CASE WHEN id % 7 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (id % 400) DAY END AS posted_at, regexp_replace(page, '#.*$', '') AS url, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS body FROM jobs),
    c AS (SELECT * FROM j WHERE source = 'companies' AND employer_type = 'direct' AND length(body) >= 120 AND (posted_at IS NULL OR posted_at <= TIMESTAMP '2024-12-01')),
    m AS (SELECT c.cluster, c.id, count(*) AS compared FROM c JOIN j o ON o.cluster = c.cluster AND o.source <> 'companies' AND o.url = c.url AND o.body = c.body GROUP BY ALL),
    g AS (SELECT cluster, count(*) AS n, min(id) AS id, arg_min(compared, id) AS compared FROM m GROUP BY cluster)
    SELECT j.cluster, CASE WHEN n IS NULL THEN 'insufficient_evidence' WHEN n = 1 THEN 'candidate' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN g.id END AS candidate, CASE WHEN n = 1 THEN compared END AS compared
    FROM (SELECT DISTINCT cluster FROM jobs) j LEFT JOIN g ON g.cluster = j.cluster"""
)
def job_originals(spark, sf_dir):
    """The probable original posting of every cluster."""
    return origins.job_originals(jobs(spark, sf_dir), "cluster", F.lit("2024-12-01").cast("timestamp_ntz"))


@query(
    LISTINGS
    + """, e AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey <> o_custkey AND o_orderpriority = '2-HIGH'), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    f AS (SELECT s.id AS seed, l.id, 'fingerprint' AS match FROM listings s JOIN listings l USING (dkey) UNION ALL SELECT s.id, l.id, 'lineage' FROM listings s JOIN both_ ON both_.a = s.id JOIN listings l ON l.id = both_.b)
    SELECT seed, id, min(match) AS match FROM f GROUP BY seed, id"""
)
def listing_duplicates(spark, sf_dir):
    """Every listing with those of its fingerprint and those that lineage links with it, in either direction."""
    rows = listings(spark, sf_dir).select("id", "dkey")
    edges = load(spark, sf_dir, "orders").where("o_orderkey <> o_custkey AND o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return origins.duplicates(rows.select(F.col("id").alias("seed")), rows, edges)


@query(
    """WITH o AS (SELECT DISTINCT l_suppkey AS actor, l_partkey AS property, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || CAST(l_linenumber % 2 AS VARCHAR) END AS recipient FROM lineitem),
    p AS (SELECT actor, property, count(*) AS n FROM o WHERE recipient <> '' GROUP BY ALL HAVING count(*) > 1) SELECT actor, count(*) AS properties, max(n) AS most FROM p GROUP BY actor"""
)
def payment_destinations(spark, sf_dir):
    """Actors whose properties name changing recipients."""
    recipient = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", (F.col("l_linenumber") % 2).cast("string")))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("actor"), F.col("l_partkey").alias("property"), recipient.alias("recipient"))
    return origins.changed_destinations(rows)


@query(
    LISTINGS
    + """SELECT contact AS actor, count(DISTINCT CASE WHEN id % 3 = 0 THEN dkey ELSE source || ' ' || CAST(id AS VARCHAR) END) AS properties FROM listings WHERE id % 4 = 1 GROUP BY contact HAVING properties >= 3"""
)
def viewing_fee_patterns(spark, sf_dir):
    """Actors that ask viewing fees for several properties."""
    k = F.col("id")
    rows = listings(spark, sf_dir).select(F.col("contact").alias("actor"), F.when(k % 3 == 0, F.col("dkey")).alias("cluster"), "source", "id", F.when(k % 5 > 0, k % 4 == 1).otherwise(F.when(k % 4 == 1, True)).alias("fee"))
    return origins.fee_patterns(rows)
