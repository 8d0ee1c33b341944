"""Kept winners: batches against a full recount, and what they leave alone."""

import os
import random

from tidewell.operators.readmodel import KeptWinners

SCHEMA = "id long, dkey string, created_at long, price double"


def recount(rows):
    best = {}
    for id_, key, at, price in rows.values():
        rank = (at is not None, at or 0, id_)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, (id_, key, at, price))
    return sorted(v for _, v in best.values())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_equal_a_recount(spark, tmp_path):
    draw = random.Random(3)
    table = KeptWinners(str(tmp_path / "feed"), parts=8)
    rows = {i: (i, f"k{draw.randrange(12)}", draw.choice([None, 1, 2, 3]), 1.0) for i in range(60)}
    table.create(spark.createDataFrame(list(rows.values()), SCHEMA))
    for number in range(4):
        batch = []
        for i in draw.sample(range(75), 12):
            gone = draw.random() < 0.3
            row = (i, f"k{draw.randrange(14)}", draw.choice([None, 1, 2, 3, 4]), float(number))
            batch += [(*row[:3], -1.0, False, 0), (*row, gone, 1)]
            rows.pop(i, None)
            if not gone:
                rows[i] = row
        df = spark.createDataFrame(batch, SCHEMA + ", gone boolean, seq int")
        table.apply(df, "seq")
        assert sorted(tuple(r) for r in table.winners(spark).select("id", "dkey", "created_at", "price").collect()) == recount(rows)
        assert sorted(r.id for r in table.members(spark).collect()) == sorted(rows)
    assert table.apply(df, "seq") == {"rows": 0, "keys": 0, "parts": 0}


def test_only_partitions_of_touched_keys_are_written(spark, tmp_path):
    table = KeptWinners(str(tmp_path / "feed"), parts=16)
    table.create(spark.range(200).selectExpr("id", "concat('k', id % 40) AS dkey", "id AS created_at", "1.0D AS price"))
    before = files(tmp_path / "feed" / "winners")
    told = table.apply(spark.createDataFrame([(3, "k3", 999, 1.0, False), (5, "k5", 5, 1.0, False)], SCHEMA + ", gone boolean"))
    after = files(tmp_path / "feed" / "winners")
    assert told == {"rows": 1, "keys": 1, "parts": 1}
    assert len({os.path.dirname(f) for f in set(before) ^ set(after)}) == 1
    # the last member of a key takes the key along
    table.apply(spark.range(200).where("id % 40 = 7").selectExpr("id", "'k7' AS dkey", "id AS created_at", "1.0D AS price", "true AS gone"))
    assert table.winners(spark).where("dkey = 'k7'").count() == 0
    assert table.winners(spark).count() == 39


def test_streamed_batches_can_be_replayed(spark, tmp_path):
    table = KeptWinners(str(tmp_path / "feed"), order=("created_at DESC", "id DESC"))
    table.create(spark.createDataFrame([(1, "a", 1, 1.0)], SCHEMA))
    for i, rows in enumerate([[(2, "a", 5, 1.0, False, 1)], [(2, "b", 5, 1.0, False, 2), (1, "a", 1, 1.0, True, 2)]]):
        spark.createDataFrame(rows, SCHEMA + ", gone boolean, seq int").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(SCHEMA + ", gone boolean, seq int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a lost checkpoint brings all batches again
        q = source.writeStream.foreachBatch(table.sink("seq")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp{_}")).start()
        q.awaitTermination(120)
    assert [tuple(r)[:2] for r in table.winners(spark).select("id", "dkey").collect()] == [(2, "b")]
