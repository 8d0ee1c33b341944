"""Upserts, snapshot syncs, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators.changes import changed_rows as changed
from tidewell.operators.changes import closed_keys, upsert
from tidewell.plans.registry import query
from tidewell.session import load


def _sides(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    slim = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("seen"))
    old = slim.where("id % 3 <> 0")
    new = slim.where("id % 2 = 0").withColumn("price", F.when(F.col("id") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return old, new


SIDES = """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS seen FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderdate AS seen FROM orders WHERE o_orderkey % 2 = 0)
"""


@query(
    SIDES
    + """SELECT COALESCE(n.id, o.id) AS id, COALESCE(n.price, o.price) AS price, greatest(n.seen, o.seen) AS seen,
    CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN n.price <> o.price THEN 'updated' ELSE 'same' END AS change FROM o FULL JOIN n ON o.id = n.id"""
)
def upsert_merge(spark, sf_dir):
    """A batch merged into the current rows; the time of last sight never goes back."""
    return upsert(*_sides(spark, sf_dir), ["id"], ["price", "seen"], ["seen"])


@query(SIDES + "SELECT id FROM o WHERE id NOT IN (SELECT id FROM n)")
def snapshot_sync_closed(spark, sf_dir):
    """Keys that a full snapshot no longer has."""
    return closed_keys(*_sides(spark, sf_dir), ["id"]).select("id")


@query(SIDES + "SELECT id, price FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.price = n.price)")
def changed_rows_only(spark, sf_dir):
    """Rows of the batch that are new or differ from what is stored."""
    return changed(*_sides(spark, sf_dir), ["id"], ["seen"]).select("id", "price")


@query(
    """SELECT user_id, count(*) AS kept FROM events e WHERE ts >= TIMESTAMP '2024-01-08' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id AND l.toxic = 1) GROUP BY user_id"""
)
def retention_purge(spark, sf_dir):
    """Rows that survive a cutoff, by user: young ones, and those under a hold."""
    events, labels = load(spark, sf_dir, "events"), load(spark, sf_dir, "labels")
    held = labels.where("toxic = 1").select(F.col("doc_id").alias("event_id")).distinct().withColumn("held", F.lit(True))
    old = F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")
    kept = events.join(held, "event_id", "left").where(~old | F.col("held"))
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"))


@query(
    """SELECT user_id, count(*) FILTER (WHERE age <= 7) AS fresh, count(*) FILTER (WHERE age > 7 AND age <= 14) AS stale, count(*) FILTER (WHERE age > 14) AS expired
    FROM (SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS age, event_type FROM events GROUP BY user_id, event_type) GROUP BY user_id"""
)
def age_out(spark, sf_dir):
    """Each user's states by the age of their last event."""
    last = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("last"))
    return last.groupBy("user_id").agg(
        F.count_if(age <= 7).alias("fresh"), F.count_if((age > 7) & (age <= 14)).alias("stale"), F.count_if(age > 14).alias("expired")
    )
