"""Money: currencies, plausible prices, salaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fallback units of a currency for one US dollar.
UNITS_PER_USD = {"USD": 1.0, "EUR": 0.9, "UAH": 40.0}
#: Plausible USD prices by deal.
PLAUSIBLE_USD = {"sale": (3e3, 2e7), "longRent": (60.0, 3e4), "shortRent": (8.0, 1500.0), "roomRent": (15.0, 5000.0)}
#: Price bands by ratio to the group's median, upper bounds.
BANDS = (("green", 0.70), ("blue", 0.85), ("pink", 1.15), ("orange", 1.31), ("yellow", 1.45))


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """``table[key]`` as a chain of conditions; null, or ``otherwise``, where it has no entry."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def to_usd(amount: Column, currency: Column, units: dict[str, float] | None = None) -> Column:
    """Amount in USD; null for an unknown currency."""
    return amount / lookup(F.upper(currency), units or UNITS_PER_USD)


def plausible(usd: Column, deal: Column) -> Column:
    """The price, or null where it is out of the deal's bounds or the deal has none."""
    low = lookup(deal, {k: v[0] for k, v in PLAUSIBLE_USD.items()})
    high = lookup(deal, {k: v[1] for k, v in PLAUSIBLE_USD.items()})
    return F.when((usd >= low) & (usd <= high), usd)


def band(ratio: Column) -> Column:
    """Name of the price band of price / median."""
    (name, top), *rest = BANDS
    out = F.when(ratio.isNull(), F.lit(None)).when(ratio < top, name)
    for name, top in rest:
        out = out.when(ratio <= top if name == "pink" else ratio < top, name)
    return out.otherwise("red")


#: Currencies whose yearly figures are taken as such, and what a salary can be.
HARD_CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "CHF", "PLN", "JPY")
HOURS_PER_YEAR, MONTHS_PER_YEAR = 12 * 160, 12
LEAST_ANNUAL, MOST_ANNUAL, MOST_MONTHLY, MOST_HOURLY, LEAST_HOURLY = 500, 1_000_000, 80_000, 500, 8
HOURLY_AS_YEARLY, LOCAL_MONTHLY_AS_YEARLY = 400, 5_000


def plausible_annual_usd(amount: Column, period: Column, currency: Column) -> Column:
    """struct(usd, period): the salary by the year in whole dollars and the period it was taken for. An amount
    too high for its month or hour is a year's; a year's too low is an hour's wage in a hard currency and a month's in
    another. Null where the amount isn't positive or the year's pay isn't plausible."""
    hard = F.upper(currency).isin(*HARD_CURRENCIES)
    used = (
        F.when((period == "month") & (amount > MOST_MONTHLY), "year")
        .when((period == "hour") & (amount > MOST_HOURLY), "year")
        .when((period == "year") & hard & (amount < LEAST_HOURLY), F.lit(None))
        .when((period == "year") & hard & (amount < HOURLY_AS_YEARLY), "hour")
        .when((period == "year") & ~F.coalesce(hard, F.lit(False)) & (amount < LOCAL_MONTHLY_AS_YEARLY), "month")
        .otherwise(period)
    )
    usd = F.floor(amount * lookup(used, {"hour": HOURS_PER_YEAR, "month": MONTHS_PER_YEAR, "year": 1}) + 0.5).cast("long")
    return F.when((amount > 0) & usd.between(LEAST_ANNUAL, MOST_ANNUAL), F.struct(usd.alias("usd"), used.alias("period")))


def repair_action(price: Column, currency: Column, country: Column, deal: Column) -> Column:
    """What a price repair would do: keep, clear (not a price), currency (a
    hryvnia amount that is only plausible as dollars) or report."""
    usd = to_usd(price, currency)
    as_dollars = (F.upper(country) == "UA") & (F.upper(currency) == "UAH") & plausible(price, deal).isNotNull()
    return (
        F.when(price.isNull(), "keep")
        .when(price <= 0, "clear")
        .when(plausible(usd, deal).isNotNull(), "keep")
        .when(as_dollars, "currency")
        .otherwise("report")
    )
