"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.changes import upsert


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``ts`` as a timestamp for watermarks."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and type; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", size, slide or size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )


def session_counts(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Events of each user's session."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("begun"), "user_id", "n")
    )


def new_keys(stream: DataFrame, seen: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First sight of each key that a static table doesn't have."""
    fresh = stream.join(seen.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left").where("known IS NULL")
    return fresh.drop("known").withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


CHANGES = "user_id long, event_id long, event_type string, state string"


def state_changes(stream: DataFrame) -> DataFrame:
    """The events at which a user's type changes, with keyed state across batches. A
    user's events have to arrive in order, as those of one file do."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for event, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            if kind != before:
                out.append((key[0], event, kind, "first" if before is None else "changed"))
            before = kind
        state.update((before,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "state"])

    return stream.groupBy("user_id").applyInPandasWithState(step, CHANGES, "last string", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(spark: SparkSession, path: str, keys: list[str], values: list[str], order: str):
    """A foreachBatch function that merges each batch into a parquet table of numbered
    versions; a batch that is replayed writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        from tidewell.operators.changes import last_per_key

        latest = last_per_key(batch, keys, order).select(*keys, *values)
        if number:
            latest = upsert(spark.read.parquet(f"{path}/v{number - 1}"), latest, keys, values).drop("change")
        latest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
