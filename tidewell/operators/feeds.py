"""Filters, orders and pages of the vacancy and candidate feeds, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.money import UNITS_PER_USD
from tidewell.functions.text import words


def _lower(values: Sequence[str]) -> list[str]:
    return [v.lower() for v in values]


def _any_in(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in _lower(values)]))


def holds_words(column: str, text: str) -> Column:
    """Whether a text holds all words of another, whole and in any case; a query without words finds nothing."""
    asked = F.array_distinct(words(F.lit(text)))
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, words(F.coalesce(F.col(column), F.lit(""))))) == 0)


def has_key(keys: Sequence[str], source: str = "source", own: str = "source_id") -> Column:
    """Whether (source, id) is among keys 'source:id', each taken apart at its first colon; an empty list holds none. Keys come with a request and are
    literals of the plan; ``rules.pair_key`` joins a table of them."""
    pairs = [k.partition(":")[::2] for k in keys]
    return F.struct(F.col(source).cast("string"), F.col(own).cast("string")).isin(*[F.struct(F.lit(s), F.lit(i)) for s, i in pairs]) if pairs else F.lit(False)


@dataclass(frozen=True)
class JobFilter:
    """Options of a vacancy search; each that is unset lets every vacancy through, but for age (at most
    14 days), hidden risk categories, and RU and BY, which need their own option unless remote."""

    max_age_days: int = 14
    sources: Sequence[str] = ()
    countries: Sequence[str] = ()
    remote: bool | None = None
    work_mode: str | None = None
    relocation: str | None = None
    employment_kind: str | None = None
    salary_min: float | None = None
    has_salary: bool = False
    max_experience_years: float | None = None
    no_experience: bool = False
    hide_risky: bool = True
    foreigner_friendly: bool | None = None
    include_ru: bool = False
    include_by: bool = False
    cities: Sequence[str] = ()
    location: str | None = None
    skills: Sequence[str] = ()
    language: str | None = None
    language_level: str | None = None
    exclude_languages: Sequence[str] = ()
    q: str | None = None
    search_keys: Sequence[str] | None = None

    def where(self, now: Column) -> Column:
        """Whether a vacancy passes. Friendly to foreigners has a meaning of its own where the US is among the countries."""
        days = min(self.max_age_days or 14, 14)
        parts = [F.col("active"), F.col("posted_at") >= now - F.expr(f"INTERVAL {days} DAYS")]
        for name, values in (("source", self.sources), ("country", self.countries)):
            if values:
                parts.append(F.col(name).isin(*values))
        for name, value in (("remote", self.remote), ("work_mode", self.work_mode), ("relocation", self.relocation),
                            ("employment_kind", self.employment_kind),
                            ("usa_foreigner_friendly" if self.foreigner_friendly and "US" in self.countries else "foreigner_friendly", self.foreigner_friendly)):
            if value is not None:
                parts.append(F.col(name) == F.lit(value))
        if self.salary_min is not None:
            parts.append(F.col("salary_usd") >= self.salary_min)
        if self.has_salary:
            parts.append(F.col("salary_usd").isNotNull())
        if self.max_experience_years is not None:
            parts.append(F.col("years").isNull() | (F.col("years") <= self.max_experience_years))
        if self.no_experience:
            parts.append(F.col("no_experience"))
        if self.hide_risky:
            parts.append(F.col("risk_category").isNull())
        for code, wanted in (("RU", self.include_ru), ("BY", self.include_by)):
            if not wanted:
                parts.append(F.col("remote") | ~F.col("country").eqNullSafe(F.lit(code)))
        if self.cities:
            told = F.lower(F.concat_ws(" ", "location", "title"))
            in_words = [F.contains(told, F.lit(c)) for c in _lower(self.cities)]
            parts.append(F.lower("city").isin(*_lower(self.cities)) | F.greatest(F.lit(False), *in_words))
        if self.location:
            parts.append(F.contains(F.lower("location"), F.lit(self.location.lower())))
        parts += [F.array_contains("skills", skill) for skill in _lower(self.skills)]
        if self.language:
            key = f"{self.language}:{self.language_level}" if self.language_level else self.language
            parts.append(F.array_contains("language_keys", key.lower()))
        if self.exclude_languages:
            parts.append(~_any_in("language_keys", self.exclude_languages))
        if self.q:
            parts.append(holds_words("search_text", self.q))
        if self.search_keys is not None:
            parts.append(has_key(self.search_keys))
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out


@dataclass(frozen=True)
class CandidateFilter:
    """Options of a candidate search; profiles of the last three months, and not more than 48 hours ahead."""

    countries: Sequence[str] = ()
    city: str | None = None
    remote: bool | None = None
    experience_min: float | None = None
    age_min: int | None = None
    age_max: int | None = None
    salary_from: float | None = None
    salary_to: float | None = None
    gender: str | None = None
    professions: Sequence[str] = ()
    skills: Sequence[str] = ()
    languages: Sequence[str] = ()
    sources: Sequence[str] = field(default=())
    salary_currency: str = "USD"
    seniority: str | None = None
    query: str | None = None
    profile_id: str | None = None
    public_id: int | None = None
    #: Names that stand for a city, and professions for a group of them, both in lower case.
    city_aliases: dict[str, str] = field(default_factory=dict)
    profession_groups: dict[str, Sequence[str]] = field(default_factory=dict)

    def where(self, now: Column) -> Column:
        """Whether a candidate passes. Bounds of a salary are in its currency; one of an unknown currency doesn't limit."""
        created = F.col("created_at")
        out = F.col("active") & (created >= now - F.expr("INTERVAL 3 MONTHS")) & (created <= now + F.expr("INTERVAL 48 HOURS"))
        if self.countries:
            out &= F.col("country").isin(*[c.upper() for c in self.countries])
        if self.city:
            named = self.city.strip().lower()
            out &= F.lower("city") == self.city_aliases.get(named, named).lower()
        if self.remote is not None:
            out &= F.col("remote") == self.remote
        for name, low, high in (("years", self.experience_min, None), ("age", self.age_min, self.age_max)):
            if low is not None:
                out &= F.col(name) >= low
            if high is not None:
                out &= F.col(name) <= high
        units = UNITS_PER_USD.get(self.salary_currency.upper())
        if self.salary_from is not None and units:
            out &= F.coalesce("salary_max_usd", "salary_min_usd") >= self.salary_from / units
        if self.salary_to is not None and units:
            out &= F.coalesce("salary_min_usd", "salary_max_usd") <= self.salary_to / units
        if self.gender:
            out &= F.col("gender") == self.gender.lower()
        trades = [t for p in self.professions for t in (p, *self.profession_groups.get(p.lower(), ()))]
        for name, values in (("professions", trades), ("languages", self.languages)):
            if values:
                out &= _any_in(name, values)
        for skill in _lower(self.skills):
            out &= F.array_contains("skills", skill)
        if self.sources:
            out &= F.col("source").isin(*_lower(self.sources)) | F.col("origin").isin(*_lower(self.sources))
        if self.seniority:
            out &= F.col("seniority") == self.seniority.strip().lower()
        if self.query:
            out &= holds_words("search_text", self.query)
        if self.profile_id:
            out &= F.col("source_id") == self.profile_id
        if self.public_id is not None:
            out &= F.col("public_id") == self.public_id
        return out


JOB_ORDERS: dict[str, Callable[[], list[Column]]] = {
    "date": lambda: [F.desc("posted_at"), F.asc("id")],
    "oldest": lambda: [F.asc("posted_at"), F.asc("id")],
    "title": lambda: [F.lower("title").asc(), F.desc("posted_at"), F.asc("id")],
    "company": lambda: [F.lower("company").asc(), F.desc("posted_at"), F.asc("id")],
    "salary": lambda: [F.desc_nulls_last("salary_usd"), F.desc("posted_at"), F.asc("id")],
}


def _candidate_order(first: Callable[[], Column]) -> Callable[[], list[Column]]:
    return lambda: [first(), F.desc_nulls_last("activity_at"), F.desc("id")]


CANDIDATE_ORDERS: dict[str, Callable[[], list[Column]]] = {
    "newest": lambda: [F.desc_nulls_last("activity_at"), F.desc("created_at"), F.desc("id")],
    "name_asc": _candidate_order(lambda: F.lower("name").asc_nulls_last()),
    "name_desc": _candidate_order(lambda: F.lower("name").desc_nulls_last()),
    "experience_desc": _candidate_order(lambda: F.desc_nulls_last("years")),
    "experience_asc": _candidate_order(lambda: F.asc_nulls_last("years")),
    "age_desc": _candidate_order(lambda: F.desc_nulls_last("age")),
    "age_asc": _candidate_order(lambda: F.asc_nulls_last("age")),
    "salary_desc": _candidate_order(lambda: F.coalesce("salary_max_usd", "salary_min_usd").desc_nulls_last()),
    "salary_asc": _candidate_order(lambda: F.coalesce("salary_min_usd", "salary_max_usd").asc_nulls_last()),
}


def page_with_total(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page, its rows' places and the total beside it. Only the rows up to the page's end are sorted
    (a top-k); the total is an aggregate, not a window over all rows."""
    top = rows.orderBy(*order).limit(offset + size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)
    return placed.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def first_of_each_order(rows: DataFrame, orders: dict[str, Callable[[], list[Column]]], size: int) -> DataFrame:
    """(sort, place, id): the first ``size`` rows by every order."""
    out = None
    for name, order in orders.items():
        top = rows.orderBy(*order()).limit(size)
        top = top.select(F.lit(name).alias("sort"), F.row_number().over(Window.orderBy(*order())).alias("place"), "id")
        out = top if out is None else out.union(top)
    return out
