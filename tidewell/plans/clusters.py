"""Property clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import clusters
from tidewell.plans.registry import query
from tidewell.session import Scratch, load


def photo_events(spark, sf_dir):
    """Each part with the two before it of its name, as a listing with its matches; every tenth part has a cluster already."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), "p_name", "p_size")
    w = Window.partitionBy("p_name").orderBy("number")
    near = part.select("number", F.lag("number", 1).over(w).alias("one"), F.lag("number", 3).over(w).alias("three"))
    near = near.select("number", F.explode(F.array_compact(F.array("number", "one", "three"))).alias("node"))
    stored = part.where("number % 10 = 0").select(F.col("number").cast("string").alias("node"), F.concat(F.lit("property:old"), F.lpad(F.col("number").cast("string"), 9, "0")).alias("cluster"))
    return near.select("number", F.col("node").cast("string").alias("node")), stored


@query()
def property_clusters(spark, sf_dir):
    """Clusters of at most thirty members after all events, in order, on top of those stored."""
    events, stored = photo_events(spark, sf_dir)
    return clusters.merged(events, stored, Scratch(spark))


@query(
    """WITH c AS (SELECT o_orderkey AS node, CAST(o_custkey AS VARCHAR) || ':' || CAST(year(o_orderdate) AS VARCHAR) AS cluster FROM orders),
    e AS (SELECT c.cluster, 1 + l_linenumber // 6 AS matched, CASE WHEN l_quantity > 47 THEN 1 ELSE 0 END AS exact, CASE WHEN l_quantity > 47 THEN 0 ELSE 1 END AS perceptual, CASE l_returnflag WHEN 'A' THEN false WHEN 'R' THEN CASE WHEN l_linenumber = 1 THEN NULL ELSE false END WHEN 'N' THEN false END AS consistent,
      CASE WHEN l_discount > 0.09 THEN 'low' WHEN l_discount > 0.05 THEN 'high' ELSE 'very_high' END AS location FROM lineitem JOIN c ON l_orderkey = node),
    t AS (SELECT cluster FROM c GROUP BY cluster HAVING count(*) = 2), w AS (SELECT cluster FROM e GROUP BY cluster HAVING bool_and(COALESCE(matched = 1 AND exact = 0 AND perceptual = 1 AND NOT consistent AND location IN ('high', 'very_high'), false)))
    SELECT cluster FROM t WHERE cluster IN (SELECT cluster FROM w)"""
)
def weak_cluster_pairs(spark, sf_dir):
    """Clusters of two that hang on one alike photo against all facts."""
    c = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.concat_ws(":", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("cluster"))
    same = F.col("l_quantity") > 47
    agree = F.when(F.col("l_returnflag").isin("A", "N"), False).when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") != 1), False)
    items = load(spark, sf_dir, "lineitem").join(c, F.col("l_orderkey") == F.col("node"))
    evidence = items.select(
        "cluster", F.expr("1 + l_linenumber div 6").alias("matched"), F.when(same, 1).otherwise(0).alias("exact"), F.when(same, 0).otherwise(1).alias("perceptual"), agree.alias("consistent"),
        F.when(F.col("l_discount") > 0.09, "low").when(F.col("l_discount") > 0.05, "high").otherwise("very_high").alias("location"),
    )
    return clusters.weak_pairs(c, evidence)
