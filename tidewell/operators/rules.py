"""Rules on identities, offers and crawls: what two profiles share, tags, hourly prices, terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import Scratch

#: Pattern of an hourly amount, with the currency words that may stand in it.
CURRENCY_TAIL = "(?:[⃀₴€$₸]|сом(?:ов)?|сум(?:ов)?|сўм|грн|тг|тенге|руб|usd|eur|uah|kgs|uzs|kzt)?"
HOURLY = rf"(?i)(\d[\d ]*)\s*{CURRENCY_TAIL}\s*(?:/|за|per)\s*(?:час|hour|hr)(?:[^\p{{L}}\p{{N}}_]|$)"
#: Tags of deals.
DEAL_TAGS = {"sale": "for sale", "longRent": "long-term rent", "shortRent": "short-term rent"}
MOST_TAGS = 12


def match_strength(platform: tuple, subject: tuple, contact: tuple, username: tuple, name: tuple) -> Column:
    """(merge, basis, confidence) of two profiles, each argument (left, right): the strongest
    identifier they share. A display name alone never merges."""

    def same(pair: tuple) -> Column:
        return F.coalesce((pair[0] == pair[1]) & (pair[0] != ""), F.lit(False))

    def found(merge: bool, basis: str, confidence: float | None) -> Column:
        return F.struct(F.lit(merge).alias("merge"), F.lit(basis).alias("basis"), F.lit(confidence).cast("double").alias("confidence"))

    return (
        F.when(same(platform) & same(subject), found(True, "platform_subject_id", 1.0))
        .when(same(contact), found(True, "verified_contact", 0.9))
        .when(same(platform) & same(username), found(True, "platform_username", 0.7))
        .when(same(name), found(False, "display_name_only", 0.1))
        .otherwise(found(False, "no_shared_identifier", None))
    )


def names_differ(account: Column, claimed: Column) -> Column:
    """Whether two stated names are of different people: neither contains the other. A name
    that isn't stated differs from none."""
    stated = (account != "") & (claimed != "")
    return F.coalesce(stated & ~F.contains(account, claimed) & ~F.contains(claimed, account), F.lit(False))


def overlap(left: Column, right: Column) -> Column:
    """Shared values over the size of the smaller set; 0 if one is empty or null."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    smaller = F.least(F.size(a), F.size(b))
    return F.coalesce(F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller), F.lit(0.0))


def hourly_amounts(text: Column) -> Column:
    """Digits of every amount that the text states for an hour."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HOURLY), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\D", ""))


def is_hourly(text: Column, price: Column) -> Column:
    """Whether the listing's price is an hourly one: it is the tail of such an amount, or there
    is no price and any amount."""
    amounts, digits = hourly_amounts(text), F.round(price).cast("long").cast("string")
    return F.when(price.isNull(), F.size(amounts) > 0).otherwise(F.exists(amounts, lambda a: F.endswith(a, digits)))


def tags(
    rooms: Column, deal: Column, by_agency: Column, places: Column, room_only: Column, pets: Column, deposit: Column,
    commission: Column, percent: Column,
) -> Column:
    """Tags of a listing from its facts, in a fixed order, distinct, at most MOST_TAGS."""
    deals = F.create_map(*[F.lit(x) for pair in DEAL_TAGS.items() for x in pair])
    paid = F.when(percent != 0, F.concat(F.lit("commission "), percent.cast("string"), F.lit("%"))).otherwise(F.lit("commission"))
    own = F.array(
        F.when(rooms != 0, F.concat(rooms.cast("string"), F.lit(" rooms"))),
        F.element_at(deals, deal),
        F.when(F.coalesce(by_agency, F.lit(False)), "agency").otherwise("owner"),
    )
    terms = F.array(
        F.when(room_only, "room only"), F.when(pets, "pets ok"), F.when(deposit, "deposit"),
        F.when(~commission, "no commission").when(commission, paid),
    )
    every = F.concat(own, F.coalesce(places, F.array().cast("array<string>")), terms)
    return F.slice(F.array_distinct(F.array_compact(every)), 1, MOST_TAGS)


def last_at_first_place(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The last row of each key, with ``place`` of its first: an aggregate, so a key that many
    rows have is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, place)]
    last = F.max_by(F.struct(*rest), place) if rest else F.lit(None)
    found = rows.groupBy(*keys).agg(F.min(place).alias(place), last.alias("last"))
    return found.select(*keys, place, *[F.col("last").getField(c).alias(c) for c in rest])


def pair_key(key: str, source: str, own: str) -> list[Column]:
    """A key 'source:id' taken apart at its first colon; ids may hold more. Without a colon the id is empty."""
    at = F.instr(F.col(key), ":")
    return [F.substring_index(key, ":", 1).alias(source), F.when(at > 0, F.substr(key, at + 1)).otherwise("").alias(own)]


def placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``place``, from 0, by ``order``: sorted by ranges over tasks, numbered within each, and moved on by the
    counts of the ranges before, of which the driver gets one a task. Gaps in the order don't matter; rows of equal order get
    different places."""
    ranged = rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range_"))
    ranged = scratch.put(ranged, "ranges")
    counts = sorted(ranged.groupBy("range_").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    if not before:
        return ranged.withColumn("place", F.lit(0).cast("long")).drop("range_")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.withColumn("place", (own + start).cast("long")).drop("range_")


def rotating(rows: DataFrame, order: Column, now_minutes: int, most: int = 12, slot_minutes: int = 30) -> DataFrame:
    """The ``most`` rows whose turn it is in the slot of time that ``now_minutes`` lies in; all
    rows if there are no more. ``rows`` is a list of crawl targets, ``order`` its places from 0."""
    n = rows.count()
    if n <= most:
        return rows
    start = now_minutes // slot_minutes * most % n
    return rows.where(F.pmod(order - F.lit(start), F.lit(n)) < most)


def spaced_chains(rows: DataFrame, key: str, time: str, hours: int = 6) -> DataFrame:
    """(key, streak): for each key the length of the greedy chain of its times, newest first, each
    at least ``hours`` before the one taken last. Null keys and times are left out.

    Distinct times are sorted by key and streamed: a task holds the last time taken and a
    count, however many times a key has."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")).alias("at")
    times = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("long").alias("key"), seconds).distinct()
    times = times.repartition("key").sortWithinPartitions("key", F.desc("at"))
    gap = hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        n = 0
        for batch in batches:
            out: list[tuple[int, int]] = []
            for own, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != now:
                    if now is not None:
                        out.append((now, n))
                    now, last, n = own, at, 1
                elif last - at >= gap:
                    last, n = at, n + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "streak"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], ["key", "streak"])

    return times.mapInArrow(run, "key long, streak long").withColumnRenamed("key", key)


def lookup(rows: DataFrame, wanted: DataFrame, columns: list[str], key: str = "value") -> DataFrame:
    """Rows that one of several columns leads to: a union of equality joins, so each is a hash
    join, in place of one join with OR. ``wanted``: (key) as strings, distinct."""
    found = [rows.join(wanted, rows[c].cast("string") == wanted[key], "left_semi") for c in columns]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.distinct()


def newest_first(*times: str) -> list[Column]:
    """Order by the first time that is stated, newest first, rows with none last."""
    return [F.desc_nulls_last(F.coalesce(*times))]
