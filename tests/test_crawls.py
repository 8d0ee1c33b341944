"""Outcomes of scans: the rule by hand, streamed like batched; missed crawls against a loop."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidewell.operators import crawls

SCHEMA = "source string, scan long, at timestamp_ntz, observed long, known long, terminal boolean, limited boolean, errored boolean"


def scan(n, hour, observed=0, known=5, terminal=True, limited=False, errored=False, source="s"):
    return (source, n, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hour), observed, known, terminal, limited, errored)


def test_emptiness_has_to_be_earned(spark):
    rows = [scan(1, 0), scan(2, 1), scan(3, 6), scan(4, 7, errored=True), scan(5, 12), scan(6, 18), scan(7, 19, observed=2), scan(8, 25), scan(9, 30, known=0), scan(10, 31, limited=True), scan(11, 32, terminal=False)]
    df = spark.createDataFrame([(*r[:2], r[2].to_pydatetime(), *r[3:]) for r in rows], SCHEMA)
    found = {r.scan: (r.state, r.streak) for r in crawls.outcomes(df).collect()}
    assert found == {
        1: ("suspect-empty", 1), 2: ("suspect-empty", 1), 3: ("suspect-empty", 2), 4: ("failed", 0), 5: ("confirmed-empty", 3), 6: ("suspect-empty", 1), 7: ("complete", 0),
        8: ("suspect-empty", 1), 9: ("complete", 0), 10: ("partial", 0), 11: ("partial", 0),
    }
    nulls = spark.createDataFrame([(None, 1, None, None, None, None, None, None)], SCHEMA)
    assert crawls.outcomes(nulls).first().state == "partial"
    assert crawls.outcomes(df.where("false")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    draw = random.Random(4)
    rows = [scan(n, n * 2.5, observed=draw.choice([0, 0, 0, 3]), errored=draw.random() < 0.1, source=draw.choice("ab")) for n in range(60)]
    df = spark.createDataFrame([(*r[:2], r[2].to_pydatetime(), *r[3:]) for r in rows], SCHEMA)
    for i in range(4):
        df.where(F.col("scan").between(15 * i, 15 * i + 14)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "1 day")
    q = crawls.outcome_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.source, r.scan, r.state, r.streak) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.source, r.scan, r.state, r.streak) for r in crawls.outcomes(df).collect())


def test_three_complete_crawls_miss_a_listing(spark):
    seen = [("s", 1, 10), ("s", 1, 25), ("s", 2, 10), ("s", 3, 30), ("s", 4, 1), ("t", 1, 1)]
    starts = [("s", 5), ("s", 10), ("s", 20), ("s", 30), ("s", 40)]
    out = crawls.missed_runs(spark.createDataFrame(seen, "source string, id long, at long"), spark.createDataFrame(starts, "source string, at long"))
    found = {(r.source, r.id): (r.missed, r.active) for r in out.collect()}
    assert found == {("s", 1): (2, True), ("s", 2): (3, False), ("s", 3): (1, True), ("s", 4): (3, False), ("t", 1): (0, True)}
