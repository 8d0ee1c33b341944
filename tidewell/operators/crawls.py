"""What crawls allow: outcomes of scans by source, and listings that several complete crawls missed.

The same step serves the batch form, in which each source's scans are sorted and streamed, and the stream with
keyed state, which expires when a source falls silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Independent empty scans that confirm emptiness, hours between two of them, complete crawls that may miss a
#: listing before it is inactive, and the largest share that one scan may take away.
CONFIRMATIONS, GAP_HOURS, MISSES, MOST_REMOVED = 3, 6, 3, 0.9
OUTCOME = "source string, scan long, at timestamp_ntz, state string, reason string, streak int, may_remove boolean"
_GAP = pd.Timedelta(hours=GAP_HOURS)


def outcome(empty: list[pd.Timestamp], at: pd.Timestamp, observed: int, known: int, terminal: bool, limited: bool, errored: bool) -> tuple[str, str, int]:
    """(state, reason, streak) of one scan. ``empty`` has the times of the suspect scans in a row before it and is kept up to date:
    a failed or partial scan says nothing and leaves them, any other but a suspect one ends the row."""
    if errored:
        return "failed", "scan_errored", 0
    if limited or not terminal:
        return "partial", "page_limit_reached" if limited else "chain_unfinished", 0
    if observed > 0 or known == 0:
        empty.clear()
        return "complete", "observed_listings" if observed > 0 else "empty_scope_no_inventory", 0
    streak, last = 1, at
    for before in reversed(empty):
        if last - before >= _GAP:
            streak, last = streak + 1, before
    if streak >= CONFIRMATIONS:
        empty.clear()
        return "confirmed-empty", "repeated_independent_empty_scans", streak
    empty.append(at)
    return "suspect-empty", "empty_but_inventory_known", streak


def _told(source: str, empty: list[pd.Timestamp], row: tuple) -> tuple:
    state, reason, streak = outcome(empty, row.at, int(row.observed), int(row.known), bool(row.terminal), bool(row.limited), bool(row.errored))
    return source, int(row.scan), row.at, state, reason, streak, state in ("complete", "confirmed-empty")


_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]


def outcomes(scans: DataFrame) -> DataFrame:
    """The outcome of every scan (source, scan, at, observed, known, terminal, limited, errored), by source in order of time and then of number.

    Scans of a source are streamed through one task, which holds the times of its suspect scans in a row: those of
    about twelve hours, as then emptiness is confirmed. Null sources are one source, null times and counts count as 0."""
    rows = scans.select(
        F.coalesce(F.col("source"), F.lit("")).alias("source"), "scan", F.coalesce("at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("observed", "known")], *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("terminal", "limited", "errored")],
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, empty = None, []
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.source != source:
                    source, empty = row.source, []
                out.append(_told(source, empty, row))
            yield pd.DataFrame(out, columns=_NAMES)

    return rows.repartition("source").sortWithinPartitions("source", "at", "scan").mapInPandas(run, OUTCOME)


def outcome_stream(scans: DataFrame, silent_days: int = 30) -> DataFrame:
    """``outcomes`` of a stream with a watermark on ``at``, in micro-batches that hold a source's scans in order. A source
    without scans for ``silent_days`` is forgotten, so state is bounded by the sources that are crawled."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        empty = [pd.Timestamp(x, unit="us") for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["at", "scan"])
        out = [_told(key[0], empty, row) for row in rows.itertuples(index=False)]
        state.update(([int(x.value // 1000) for x in empty],))
        last = int(rows["at"].max().value // 1_000_000) + silent_days * 86_400_000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_NAMES)

    shape = OUTCOME.replace("timestamp_ntz", "timestamp")
    return scans.groupBy("source").applyInPandasWithState(step, shape, "empty array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def missed_runs(seen: DataFrame, crawls: DataFrame) -> DataFrame:
    """(source, id, missed, active): how many of a source's complete ``crawls`` (source, at) began after a listing was last ``seen``
    (source, id, at), at most MISSES, at which it becomes inactive and is counted no further; being seen begins anew.

    Crawls are numbered by source, and a listing's last sight takes its place among them: one sort of both together,
    no pairs."""
    last = seen.groupBy("source", "id").agg(F.max("at").alias("at"))
    marks = crawls.select("source", "at").distinct().select("source", "at", F.lit(None).cast(last.schema["id"].dataType).alias("id"), F.lit(1).alias("crawl"))
    both = last.select("source", "at", "id", F.lit(0).alias("crawl")).unionByName(marks)
    # A crawl that began at the very time of a sight has seen the listing.
    later = Window.partitionBy("source").orderBy(F.desc("at"), F.asc("crawl"))
    counted = both.withColumn("missed", F.sum("crawl").over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    missed = F.least(F.lit(MISSES), F.coalesce("missed", F.lit(0))).cast("long")
    return counted.where("crawl = 0").select("source", "id", missed.alias("missed"), (missed < MISSES).alias("active"))


def removal_plan(counts: DataFrame) -> DataFrame:
    """``counts`` (stale, known, may_remove) with ``plan``: none, blocked (a scan that would take away more than nine tenths of what is known) or apply."""
    share = F.col("stale") / F.greatest(F.col("known"), F.lit(1))
    plan = F.when(~F.col("may_remove") | (F.col("stale") == 0), "none").when(share > MOST_REMOVED, "blocked").otherwise("apply")
    return counts.withColumn("plan", plan)
