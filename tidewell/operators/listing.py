"""Listing operators: visibility, filters, winners, feeds with keyset cursors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.keys import cursor_scope
from tidewell.functions.money import to_usd

#: Statuses that are never public, and the longest age of a public row in days.
CLOSED = ("sold", "rented", "closed", "outdated")
MOST_AGE_DAYS = 14


@dataclass(frozen=True)
class ListingFilter:
    """Filters of the public feed; a field that is None or empty filters nothing."""

    countries: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    deals: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    price: tuple[float | None, float | None] = (None, None)
    currency: str = "USD"
    tolerance: float = 0.0
    price_per_m2: tuple[float | None, float | None] = (None, None)
    true_flags: tuple[str, ...] = ()
    false_flags: tuple[str, ...] = ()
    not_false_flags: tuple[str, ...] = ()
    include_rooms: bool = False
    text: str | None = None

    @staticmethod
    def from_params(params: dict[str, str]) -> ListingFilter:
        """From a query string's pairs; keys that aren't filters are dropped."""
        several = {k: tuple(sorted(x for x in params.get(k, "").split(",") if x)) for k in ("countries", "sources", "deals")}
        spans = {}
        for name in ("rooms", "area", "floor"):
            low, high = params.get(f"{name}From"), params.get(f"{name}To")
            if low or high:
                spans[name] = (float(low) if low else None, float(high) if high else None)
        price = tuple(float(params[k]) if params.get(k) else None for k in ("priceFrom", "priceTo"))
        return ListingFilter(**several, ranges=spans, price=price, currency=params.get("currency", "USD"), text=params.get("q"))

    def scope(self) -> str:
        """What a cursor is bound to."""
        return cursor_scope(asdict(self))


def between(value: Column, bounds: tuple[float | None, float | None], tolerance: float = 0.0) -> Column:
    """Inclusive range; a null value fails, an open end doesn't limit."""
    low, high = bounds
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high * (1 + tolerance))
    return F.coalesce(out, F.lit(False))


def public(rows: DataFrame) -> DataFrame:
    """Rows that may be shown: active, open, not commercial, an offer and not a search, and from a source other than 'custom' unless they are curated. A table
    without one of the columns active, listing_kind or curated has no row that fails by it."""
    shown = ~F.coalesce(F.col("status"), F.lit("")).isin(*CLOSED) & ~F.coalesce(F.col("commercial"), F.lit(False))
    if "active" in rows.columns:
        shown = shown & F.coalesce(F.col("active"), F.lit(False))
    if "listing_kind" in rows.columns:
        shown = shown & (F.coalesce(F.col("listing_kind"), F.lit("propertyOffer")) != "propertyWanted")
    if "source" in rows.columns:
        curated = F.coalesce(F.col("curated"), F.lit(False)) if "curated" in rows.columns else F.lit(False)
        shown = shown & (~F.col("source").eqNullSafe(F.lit("custom")) | curated)
    return rows.where(shown)


def fresh(rows: DataFrame, now: str, days: int = MOST_AGE_DAYS, cap: int = MOST_AGE_DAYS) -> DataFrame:
    """Rows of at most ``days`` days; a missing creation time falls back to the first sight."""
    since = F.expr(f"timestamp_ntz'{now}' - interval {min(days, cap)} days")
    return rows.where(F.coalesce("created_at", "first_seen") >= since)


def matching(rows: DataFrame, f: ListingFilter) -> DataFrame:
    """Rows that pass the filter; an unknown currency fails a price filter only."""
    keep = F.lit(True)
    for column, values in (("country", f.countries), ("source", f.sources), ("deal", f.deals)):
        if values:
            keep = keep & F.col(column).isin(*values)
    for column, bounds in f.ranges.items():
        keep = keep & between(F.col(column), bounds)
    usd = to_usd(F.col("price"), F.col("currency"))
    if f.price != (None, None):
        units = to_usd(F.lit(1.0), F.lit(f.currency))
        low, high = f.price
        keep = keep & between(usd / units, (low, high), f.tolerance)
    if f.price_per_m2 != (None, None):
        keep = keep & between(F.when(F.col("area") > 0, usd / F.col("area")), f.price_per_m2)
    for flag in f.true_flags:
        keep = keep & F.col(flag).eqNullSafe(True)
    for flag in f.false_flags:
        keep = keep & F.col(flag).eqNullSafe(False)
    for flag in f.not_false_flags:
        keep = keep & ~F.col(flag).eqNullSafe(False)
    if not f.include_rooms:
        keep = keep & ~((F.col("deal") == "longRent") & F.col("room_only"))
    if f.text:
        keep = keep & F.lower(F.concat_ws(" ", "city", "ptype")).contains(f.text.lower())
    return rows.where(keep)


def winners(rows: DataFrame, key: str | Sequence[str] = "dkey") -> DataFrame:
    """One row per key: the newest, then the highest id."""
    keys = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


ORDERS = {
    "newest": ("created_at", False),
    "oldest": ("created_at", True),
    "priceAsc": ("price_usd", True),
    "priceDesc": ("price_usd", False),
}


def ordering(mode: str) -> list[Column]:
    """Nulls last in every mode; ties by id, descending."""
    column, ascending = ORDERS[mode]
    return [F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column), F.desc("id")]


def page(rows: DataFrame, mode: str, limit: int, after: tuple | None = None) -> DataFrame:
    """One page by keyset: the rows behind the cursor (value, id), at most ``limit`` of them.

    A cursor in the null tail has the value None. The physical plan is one top-k.
    """
    column, ascending = ORDERS[mode]
    if after is not None:
        value, last = after
        c = F.col(column)
        if value is None:
            behind = c.isNull() & (F.col("id") < last)
        else:
            further = c > F.lit(value) if ascending else c < F.lit(value)
            behind = further | ((c == F.lit(value)) & (F.col("id") < last)) | c.isNull()
        rows = rows.where(behind)
    return rows.orderBy(*ordering(mode)).limit(limit)
