"""Originals, duplicates and payment patterns: what rows of one group say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import LEGAL_FORMS, without_words
from tidewell.functions.text import squeezed

#: The least length of a description, and properties that make fees a pattern.
LEAST_TEXT, LEAST_PROPERTIES = 120, 3


def page_url(url: Column) -> Column:
    """An http address of a page, without what follows '#'; null for a site's front page and anything else."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    return F.when(bare.rlike(r"^(?i)https?://[^/?#\s]+/[^?#\s]"), bare)


def job_originals(jobs: DataFrame, cluster: str, now: Column) -> DataFrame:
    """(cluster, status, candidate, compared): the posting of each cluster that is probably the employer's own.

    ``jobs``: cluster, id, source, employer_type, company, title, description, url, apply_url, posted_at. A candidate is a direct employer's posting from the
    source 'companies', not of the future, of at least 120 characters, whose page another source's posting of the same company, title and text
    applies to. One candidate in a cluster is told with the number of those; several are 'ambiguous', none is
    'insufficient_evidence'. Postings meet over cluster, page and text, so no group is paired with itself."""
    text = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " "))
    rows = jobs.select(
        cluster, "id", "source", "employer_type", "posted_at", page_url(F.col("url")).alias("page"), page_url(F.col("apply_url")).alias("applies"), F.length(text).alias("size"),
        F.sha2(text, 256).alias("content"), without_words(F.coalesce("company", F.lit("")), LEGAL_FORMS).alias("firm"), squeezed(F.coalesce("title", F.lit(""))).alias("role"),
    )
    key = [cluster, "page", "content", "firm", "role"]
    own = rows.where((F.col("source") == "companies") & (F.col("employer_type") == "direct") & (F.col("firm") != "") & F.col("page").isNotNull() & (F.col("size") >= LEAST_TEXT))
    own = own.where(F.col("posted_at").isNull() | (F.col("posted_at") <= now)).select(*key, "id")
    others = rows.where("source <> 'companies' AND applies IS NOT NULL").drop("page").withColumnRenamed("applies", "page").groupBy(*key).agg(F.count("*").alias("compared"))
    found = own.join(others, key).groupBy(cluster).agg(F.count("*").alias("n"), F.min_by(F.struct("id", "compared"), "id").alias("one"))
    every = jobs.select(cluster).distinct().join(found, cluster, "left")
    single = F.col("n") == 1
    status = F.when(F.col("n").isNull(), "insufficient_evidence").when(single, "candidate").otherwise("ambiguous")
    return every.select(cluster, status.alias("status"), F.when(single, F.col("one.id")).alias("candidate"), F.when(single, F.col("one.compared")).alias("compared"))


def duplicates(seeds: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, id, match): rows related to each seed: those of its fingerprint, and those it has a lineage edge with, either way; a row found by both counts as
    'fingerprint'. ``seeds``: seed (an id of ``rows``); ``rows``: id, dkey; ``edges``: a, b. The seed is among its own."""
    keyed = seeds.join(rows.select(F.col("id").alias("seed"), "dkey"), "seed")
    same = keyed.join(rows, "dkey").select("seed", "id", F.lit("fingerprint").alias("match"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = seeds.join(both, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("id")).join(rows.select("id"), "id", "left_semi").select("seed", "id", F.lit("lineage").alias("match"))
    return same.union(linked).groupBy("seed", "id").agg(F.min("match").alias("match"))


def changed_destinations(observations: DataFrame) -> DataFrame:
    """(actor, properties, most): actors with properties that name more than one recipient of payments: how many such properties, and the most recipients of
    one. ``observations``: actor, property, recipient; blank ones say nothing."""
    known = observations.where("property IS NOT NULL AND recipient IS NOT NULL AND cast(property AS string) <> '' AND cast(recipient AS string) <> ''")
    each = known.select("actor", "property", "recipient").distinct().groupBy("actor", "property").agg(F.count("*").alias("n")).where("n > 1")
    return each.groupBy("actor").agg(F.count("*").alias("properties"), F.max("n").alias("most"))


def fee_patterns(listings: DataFrame, least: int = LEAST_PROPERTIES) -> DataFrame:
    """(actor, properties): actors that ask a viewing fee for at least so many different properties. ``listings``: actor, cluster, source, id, fee; a listing
    without a cluster is a property of its own."""
    own = F.coalesce(F.col("cluster").cast("string"), F.concat_ws(" ", F.col("source").cast("string"), F.col("id").cast("string")))
    asked = listings.where(F.coalesce("fee", F.lit(False))).select("actor", own.alias("property")).distinct()
    return asked.groupBy("actor").agg(F.count("*").alias("properties")).where(F.col("properties") >= least)
