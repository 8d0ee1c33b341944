"""The vacancy and candidate feeds: each option alone, orders, pages, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.money import plausible_annual_usd
from tidewell.operators import feeds
from tidewell.plans.registry import query
from tidewell.plans.tables import LISTINGS, listings
from tidewell.session import load

NOW_DATE = "1998-06-01 00:00:00"
WORK_MODES = ("office", "hybrid", "remote")
SKILLS = ("sql", "java", "go", "excel", "sales")

VACANCIES = f"""WITH vacancies AS (
  SELECT o_orderkey AS id, 's' || CAST(o_orderkey % 4 AS VARCHAR) AS source,
    CASE n_name WHEN 'RUSSIA' THEN 'RU' WHEN 'ROMANIA' THEN 'BY' ELSE substr(n_name, 1, 3) END AS country, n_name AS city,
    n_name || ' / ' || c_mktsegment AS location, c_mktsegment || ' ' || o_orderpriority AS title, c_name AS company,
    o_orderkey % 3 = 2 AS remote, CASE o_orderkey % 3 WHEN 0 THEN 'office' WHEN 1 THEN 'hybrid' ELSE 'remote' END AS work_mode,
    CASE WHEN o_orderkey % 5 = 0 THEN 'offered' END AS relocation, CASE WHEN o_orderkey % 8 < 6 THEN 'full' ELSE 'part' END AS employment_kind,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS salary_usd, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 12 END AS years,
    o_orderkey % 10 = 0 AS no_experience, CASE WHEN o_orderkey % 13 = 0 THEN 'gambling' END AS risk_category, o_orderkey % 6 = 0 AS foreigner_friendly, o_orderkey % 9 = 0 AS usa_foreigner_friendly,
    CAST(o_orderkey AS VARCHAR) || ':x' AS source_id, n_name || ' / ' || c_mktsegment || ' ' || o_orderpriority || ' ' || c_name AS search_text,
    [['sql', 'java', 'go', 'excel', 'sales'][CAST(o_orderkey % 5 + 1 AS INTEGER)], ['sql', 'java', 'go', 'excel', 'sales'][CAST(o_custkey % 5 + 1 AS INTEGER)]] AS skills,
    CASE o_orderkey % 4 WHEN 0 THEN ['en', 'en:b2'] WHEN 1 THEN ['de', 'de:c1', 'en'] WHEN 2 THEN ['uk'] ELSE CAST([] AS VARCHAR[]) END AS language_keys,
    o_orderdate AS posted_at, o_orderstatus <> 'P' AS active, TIMESTAMP '{NOW_DATE}' AS now
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def vacancies(spark, sf_dir):
    """orders as vacancies; see VACANCIES for the same in SQL."""
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k, names = F.col("o_orderkey"), F.array(*[F.lit(s) for s in SKILLS])
    keys = F.when(k % 4 == 0, F.array(F.lit("en"), F.lit("en:b2"))).when(k % 4 == 1, F.array(F.lit("de"), F.lit("de:c1"), F.lit("en")))
    return rows.select(
        k.alias("id"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"),
        F.when(F.col("n_name") == "RUSSIA", "RU").when(F.col("n_name") == "ROMANIA", "BY").otherwise(F.substring("n_name", 1, 3)).alias("country"),
        F.col("n_name").alias("city"), F.concat_ws(" / ", "n_name", "c_mktsegment").alias("location"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("title"), F.col("c_name").alias("company"),
        (k % 3 == 2).alias("remote"), F.element_at(F.array(*[F.lit(m) for m in WORK_MODES]), (k % 3 + 1).cast("int")).alias("work_mode"),
        F.when(k % 5 == 0, "offered").alias("relocation"), F.when(k % 8 < 6, "full").otherwise("part").alias("employment_kind"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("salary_usd"), F.when(k % 7 != 0, k % 12).alias("years"),
        (k % 10 == 0).alias("no_experience"), F.when(k % 13 == 0, "gambling").alias("risk_category"), (k % 6 == 0).alias("foreigner_friendly"),
        (k % 9 == 0).alias("usa_foreigner_friendly"), F.concat(k.cast("string"), F.lit(":x")).alias("source_id"),
        F.concat_ws(" ", "n_name", F.lit("/"), "c_mktsegment", "o_orderpriority", "c_name").alias("search_text"),
        F.array(F.element_at(names, (k % 5 + 1).cast("int")), F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int"))).alias("skills"),
        keys.when(k % 4 == 2, F.array(F.lit("uk"))).otherwise(F.array().cast("array<string>")).alias("language_keys"),
        F.col("o_orderdate").alias("posted_at"), (F.col("o_orderstatus") != "P").alias("active"),
    )


def _now():
    return F.lit(NOW_DATE).cast("timestamp_ntz")


_SHOWN = "active AND posted_at >= now - INTERVAL 14 DAYS"
_RU = "(remote OR country IS DISTINCT FROM 'RU')"
_BY = "(remote OR country IS DISTINCT FROM 'BY')"
_SAFE = "risk_category IS NULL"
_USUAL = f"{_SHOWN} AND {_SAFE} AND {_RU} AND {_BY}"

#: Each option alone: the filter and the same in SQL.
JOB_OPTIONS = {
    "none": ({}, _USUAL),
    "max_age_days": ({"max_age_days": 3}, f"{_USUAL} AND posted_at >= now - INTERVAL 3 DAYS"),
    "max_age_days_over": ({"max_age_days": 90}, _USUAL),
    "sources": ({"sources": ["s1", "s2"]}, f"{_USUAL} AND source IN ('s1', 's2')"),
    "countries": ({"countries": ["CHI", "PER", "RU"]}, f"{_USUAL} AND country IN ('CHI', 'PER', 'RU')"),
    "remote": ({"remote": True}, f"{_USUAL} AND remote"),
    "work_mode": ({"work_mode": "hybrid"}, f"{_USUAL} AND work_mode = 'hybrid'"),
    "relocation": ({"relocation": "offered"}, f"{_USUAL} AND relocation = 'offered'"),
    "employment_kind": ({"employment_kind": "part"}, f"{_USUAL} AND employment_kind = 'part'"),
    "salary_min": ({"salary_min": 150000.0}, f"{_USUAL} AND salary_usd >= 150000"),
    "has_salary": ({"has_salary": True}, f"{_USUAL} AND salary_usd IS NOT NULL"),
    "max_experience_years": ({"max_experience_years": 4}, f"{_USUAL} AND (years IS NULL OR years <= 4)"),
    "no_experience": ({"no_experience": True}, f"{_USUAL} AND no_experience"),
    "risky": ({"hide_risky": False}, f"{_SHOWN} AND {_RU} AND {_BY}"),
    "foreigner_friendly": ({"foreigner_friendly": True}, f"{_USUAL} AND foreigner_friendly"),
    "include_ru": ({"include_ru": True}, f"{_SHOWN} AND {_SAFE} AND {_BY}"),
    "include_by": ({"include_by": True}, f"{_SHOWN} AND {_SAFE} AND {_RU}"),
    "cities": ({"cities": ["China", "build"]}, f"{_USUAL} AND (lower(city) IN ('china', 'build') OR contains(lower(location || ' ' || title), 'china') OR contains(lower(location || ' ' || title), 'build'))"),
    "location": ({"location": "Mach"}, f"{_USUAL} AND contains(lower(location), 'mach')"),
    "skills": ({"skills": ["SQL", "go"]}, f"{_USUAL} AND list_has_all(skills, ['sql', 'go'])"),
    "language": ({"language": "en"}, f"{_USUAL} AND list_contains(language_keys, 'en')"),
    "language_level": ({"language": "de", "language_level": "C1"}, f"{_USUAL} AND list_contains(language_keys, 'de:c1')"),
    "exclude_languages": ({"exclude_languages": ["uk", "de"]}, f"{_USUAL} AND NOT list_has_any(language_keys, ['uk', 'de'])"),
    "usa_friendly": ({"countries": ["US", "NAT"], "foreigner_friendly": True}, f"{_USUAL} AND country IN ('US', 'NAT') AND usa_foreigner_friendly"),
    "usa_unfriendly": ({"countries": ["US", "NAT"], "foreigner_friendly": False}, f"{_USUAL} AND country IN ('US', 'NAT') AND NOT foreigner_friendly"),
    "q": ({"q": "Household, high"}, f"{_USUAL} AND list_has_all(regexp_split_to_array(lower(search_text), '[^\\p{{L}}\\p{{N}}]+'), ['household', 'high'])"),
    "q_without_words": ({"q": " -- "}, "false"),
    "search_keys": ({"search_keys": [f"s{i % 4}:{i}:x" for i in range(0, 3000, 3)] + ["s1:2:x", "nocolon"]}, f"{_USUAL} AND id < 3000 AND id % 3 = 0"),
    "no_search_keys": ({"search_keys": []}, "false"),
}


def _option_counts(rows, options, kind):
    """(option, n) of every option in one pass over the rows."""
    counts = rows.agg(*[F.count_if(kind(**args).where(_now())).alias(name) for name, (args, _) in options.items()])
    return counts.unpivot([], list(options), "option", "n")


def _option_sql(ctes, table, options):
    sums = ", ".join(f"count(*) FILTER (WHERE {sql}) AS {name}" for name, (_, sql) in options.items())
    return f"{ctes} SELECT option, n FROM (UNPIVOT (SELECT {sums} FROM {table}) ON {', '.join(options)} INTO NAME option VALUE n)"


@query(_option_sql(VACANCIES, "vacancies", JOB_OPTIONS))
def vacancy_feed_options(spark, sf_dir):
    """How many vacancies each option of the filter lets through."""
    return _option_counts(vacancies(spark, sf_dir), JOB_OPTIONS, feeds.JobFilter)


@query(
    VACANCIES
    + f"""SELECT id, title, salary_usd, place, total FROM (SELECT *, row_number() OVER (ORDER BY salary_usd DESC NULLS LAST, posted_at DESC, id) AS place,
  count(*) OVER () AS total FROM vacancies WHERE {_USUAL} AND work_mode <> 'x' AND (years IS NULL OR years <= 8)) WHERE place > 20 AND place <= 40"""
)
def vacancy_feed(spark, sf_dir):
    """The second page of vacancies by salary, with the total beside it."""
    rows = vacancies(spark, sf_dir).where(feeds.JobFilter(max_experience_years=8).where(_now()))
    page = feeds.page_with_total(rows, feeds.JOB_ORDERS["salary"](), 20, 20)
    return page.select("id", "title", "salary_usd", "place", "total")


_JOB_SORTS = {
    "date": "posted_at DESC, id", "oldest": "posted_at, id", "title": "lower(title), posted_at DESC, id",
    "company": "lower(company), posted_at DESC, id", "salary": "salary_usd DESC NULLS LAST, posted_at DESC, id",
}


def _sorts_sql(ctes, table, where, sorts):
    parts = [
        f"SELECT '{name}' AS sort, row_number() OVER (ORDER BY {order}) AS place, id FROM {table} WHERE {where} QUALIFY place <= 10"
        for name, order in sorts.items()
    ]
    return ctes + " UNION ALL ".join(parts)


@query(_sorts_sql(VACANCIES, "vacancies", _USUAL, _JOB_SORTS))
def vacancy_sorts(spark, sf_dir):
    """The first ten vacancies by each of the feed's orders."""
    rows = vacancies(spark, sf_dir).where(feeds.JobFilter().where(_now()))
    return feeds.first_of_each_order(rows, feeds.JOB_ORDERS, 10)


_BRACKETS = "CASE WHEN years IS NULL THEN 'unknown' WHEN years < 1 THEN '0' WHEN years < 3 THEN '1-2' WHEN years < 6 THEN '3-5' ELSE '6+' END"


@query(
    VACANCIES
    + f""", shown AS (SELECT * FROM vacancies WHERE active), parts AS (
  SELECT id, unnest([{{'part': 'source', 'label': source}}, {{'part': 'country', 'label': country}}, {{'part': 'work_mode', 'label': work_mode}},
    {{'part': 'relocation', 'label': coalesce(relocation, 'unknown')}}, {{'part': 'employment', 'label': employment_kind}}, {{'part': 'experience', 'label': {_BRACKETS}}}]) AS p FROM shown
  UNION ALL SELECT id, unnest(list_transform(list_distinct(skills), lambda s: {{'part': 'skill', 'label': s}})) FROM shown
  UNION ALL SELECT id, unnest(list_transform(list_filter(language_keys, lambda l: NOT contains(l, ':')), lambda l: {{'part': 'language', 'label': l}})) FROM shown)
SELECT p.part AS part, p.label AS label, count(*) AS n FROM parts GROUP BY ALL"""
)
def vacancy_stats(spark, sf_dir):
    """Counts of active vacancies by source, country, work mode, relocation, employment, experience, skill
    and language, from one pass: a vacancy is dealt to a label of each part."""
    years = F.col("years")
    bracket = F.when(years.isNull(), "unknown").when(years < 1, "0").when(years < 3, "1-2").when(years < 6, "3-5").otherwise("6+")
    single = {"source": F.col("source"), "country": F.col("country"), "work_mode": F.col("work_mode"),
              "relocation": F.coalesce("relocation", F.lit("unknown")), "employment": F.col("employment_kind"), "experience": bracket}

    def tagged(part, label):
        return F.struct(F.lit(part).alias("part"), label.alias("label"))

    many = F.concat(
        F.array(*[tagged(part, label) for part, label in single.items()]),
        F.transform(F.array_distinct("skills"), lambda s: tagged("skill", s)),
        F.transform(F.filter("language_keys", lambda x: ~F.contains(x, F.lit(":"))), lambda x: tagged("language", x)),
    )
    return vacancies(spark, sf_dir).where("active").select(F.inline(many)).groupBy("part", "label").agg(F.count("*").alias("n"))


CANDIDATES = f"""WITH candidates AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 <> 0 THEN c_name END AS name, upper(substr(n_name, 1, 3)) AS country, n_name AS city, o_orderkey % 3 = 0 AS remote,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 20 END AS years, CASE WHEN o_orderkey % 6 <> 0 THEN 17 + o_custkey % 50 END AS age,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS salary_min_usd, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 2 END AS salary_max_usd,
    CASE o_orderkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, [lower(c_mktsegment), 'p' || CAST(o_orderkey % 3 AS VARCHAR)] AS professions,
    [['sql', 'java', 'go', 'excel', 'sales'][CAST(o_orderkey % 5 + 1 AS INTEGER)], ['sql', 'java', 'go', 'excel', 'sales'][CAST(o_custkey % 5 + 1 AS INTEGER)]] AS skills,
    CASE WHEN o_orderkey % 2 = 0 THEN ['en', 'de'] ELSE ['uk'] END AS languages, 's' || CAST(o_orderkey % 4 AS VARCHAR) AS source, 's' || CAST(o_custkey % 4 AS VARCHAR) AS origin,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS activity_at, o_orderdate AS created_at, o_orderstatus <> 'P' AS active, TIMESTAMP '{NOW_DATE}' AS now,
    CASE o_orderkey % 4 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' END AS seniority, c_name || ' ' || c_mktsegment || ' ' || n_name AS search_text, 'p-' || CAST(o_orderkey AS VARCHAR) AS source_id, o_orderkey AS public_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def candidates(spark, sf_dir):
    """orders as candidates; see CANDIDATES for the same in SQL."""
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k, c, names = F.col("o_orderkey"), F.col("o_custkey"), F.array(*[F.lit(s) for s in SKILLS])
    return rows.select(
        k.alias("id"), F.when(k % 31 != 0, F.col("c_name")).alias("name"), F.upper(F.substring("n_name", 1, 3)).alias("country"), F.col("n_name").alias("city"),
        (k % 3 == 0).alias("remote"), F.when(k % 7 != 0, k % 20).alias("years"), F.when(k % 6 != 0, 17 + c % 50).alias("age"),
        F.when(k % 5 != 0, F.col("o_totalprice")).alias("salary_min_usd"), F.when(k % 4 != 0, F.col("o_totalprice") * 2).alias("salary_max_usd"),
        F.when(k % 3 == 0, "female").when(k % 3 == 1, "male").alias("gender"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("p"), (k % 3).cast("string"))).alias("professions"),
        F.array(F.element_at(names, (k % 5 + 1).cast("int")), F.element_at(names, (c % 5 + 1).cast("int"))).alias("skills"),
        F.when(k % 2 == 0, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("uk"))).alias("languages"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"), F.concat(F.lit("s"), (c % 4).cast("string")).alias("origin"),
        F.when(k % 9 != 0, F.col("o_orderdate")).alias("activity_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("active"),
        F.when(k % 4 == 0, "junior").when(k % 4 == 1, "senior").alias("seniority"), F.concat_ws(" ", "c_name", "c_mktsegment", "n_name").alias("search_text"),
        F.concat(F.lit("p-"), k.cast("string")).alias("source_id"), k.alias("public_id"),
    )


_FRESH = "active AND created_at >= now - INTERVAL 3 MONTHS AND created_at <= now + INTERVAL 48 HOURS"
CANDIDATE_OPTIONS = {
    "none": ({}, _FRESH),
    "countries": ({"countries": ["chi", "PER"]}, f"{_FRESH} AND country IN ('CHI', 'PER')"),
    "city": ({"city": "China"}, f"{_FRESH} AND lower(city) = 'china'"),
    "remote": ({"remote": False}, f"{_FRESH} AND NOT remote"),
    "experience_min": ({"experience_min": 5}, f"{_FRESH} AND years >= 5"),
    "age_range": ({"age_min": 25, "age_max": 34}, f"{_FRESH} AND age BETWEEN 25 AND 34"),
    "salary_from": ({"salary_from": 200000.0}, f"{_FRESH} AND coalesce(salary_max_usd, salary_min_usd) >= 200000"),
    "salary_to": ({"salary_to": 90000.0}, f"{_FRESH} AND coalesce(salary_min_usd, salary_max_usd) <= 90000"),
    "gender": ({"gender": "Female"}, f"{_FRESH} AND gender = 'female'"),
    "professions": ({"professions": ["Building", "p2"]}, f"{_FRESH} AND list_has_any(professions, ['building', 'p2'])"),
    "skills": ({"skills": ["sql", "Java"]}, f"{_FRESH} AND list_has_all(skills, ['sql', 'java'])"),
    "languages": ({"languages": ["DE"]}, f"{_FRESH} AND list_has_any(languages, ['de'])"),
    "sources": ({"sources": ["S1"]}, f"{_FRESH} AND (source = 's1' OR origin = 's1')"),
    "city_alias": ({"city": " Third City", "city_aliases": {"third city": "nation_3"}}, f"{_FRESH} AND city = 'NATION_3'"),
    "currency": ({"salary_from": 100000.0, "salary_to": 180000.0, "salary_currency": "eur"}, f"{_FRESH} AND coalesce(salary_max_usd, salary_min_usd) >= 100000 / 0.9::DOUBLE AND coalesce(salary_min_usd, salary_max_usd) <= 180000 / 0.9::DOUBLE"),
    "unknown_currency": ({"salary_from": 1e9, "salary_currency": "ABC"}, _FRESH),
    "profession_group": ({"professions": ["Makers"], "profession_groups": {"makers": ("building", "p1")}}, f"{_FRESH} AND list_has_any(professions, ['makers', 'building', 'p1'])"),
    "seniority": ({"seniority": " Senior"}, f"{_FRESH} AND seniority = 'senior'"),
    "query": ({"query": "household nation 3"}, f"{_FRESH} AND list_has_all(regexp_split_to_array(lower(search_text), '[^\\p{{L}}\\p{{N}}]+'), ['household', 'nation', '3'])"),
    "profile_id": ({"profile_id": "p-9"}, f"{_FRESH} AND source_id = 'p-9'"),
    "public_id": ({"public_id": 10}, f"{_FRESH} AND public_id = 10"),
}


@query(_option_sql(CANDIDATES, "candidates", CANDIDATE_OPTIONS))
def candidate_feed_options(spark, sf_dir):
    """How many candidates each option of the filter lets through."""
    return _option_counts(candidates(spark, sf_dir), CANDIDATE_OPTIONS, feeds.CandidateFilter)


_CANDIDATE_SORTS = {"newest": "activity_at DESC NULLS LAST, created_at DESC, id DESC"} | {
    name: f"{first} NULLS LAST, activity_at DESC NULLS LAST, id DESC"
    for name, first in {
        "name_asc": "lower(name) ASC", "name_desc": "lower(name) DESC", "experience_desc": "years DESC", "experience_asc": "years ASC",
        "age_desc": "age DESC", "age_asc": "age ASC", "salary_desc": "coalesce(salary_max_usd, salary_min_usd) DESC",
        "salary_asc": "coalesce(salary_min_usd, salary_max_usd) ASC",
    }.items()
}


@query(_sorts_sql(CANDIDATES, "candidates", _FRESH, _CANDIDATE_SORTS))
def candidate_sorts(spark, sf_dir):
    """The first ten candidates by each of the feed's orders."""
    rows = candidates(spark, sf_dir).where(feeds.CandidateFilter().where(_now()))
    return feeds.first_of_each_order(rows, feeds.CANDIDATE_ORDERS, 10)


@query(CANDIDATES + "SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct([source, origin])) AS label FROM candidates) GROUP BY label")
def source_or_origin_counts(spark, sf_dir):
    """Candidates by source or origin; one with both alike counts once."""
    labels = F.explode(F.array_distinct(F.array("source", "origin"))).alias("label")
    return candidates(spark, sf_dir).select(labels).groupBy("label").agg(F.count("*").alias("n"))


@query(
    CANDIDATES
    + """SELECT CASE WHEN years < 1 THEN '0' WHEN years < 3 THEN '1-2' WHEN years < 6 THEN '3-5' ELSE '6+' END AS bracket,
  CAST(floor(median(age) + 0.5) AS BIGINT) AS median_whole, floor(median(age / 7.0::DOUBLE) * 10 + 0.5) / 10 AS median_tenths FROM candidates WHERE years IS NOT NULL GROUP BY bracket"""
)
def candidate_medians(spark, sf_dir):
    """Medians by experience, to a whole number and to a tenth, halves rounded up."""
    years = F.col("years")
    bracket = F.when(years < 1, "0").when(years < 3, "1-2").when(years < 6, "3-5").otherwise("6+").alias("bracket")
    half_up = lambda c: F.floor(c + 0.5)
    return candidates(spark, sf_dir).where(years.isNotNull()).groupBy(bracket).agg(
        half_up(F.median("age")).cast("long").alias("median_whole"), (half_up(F.median(F.col("age") / 7.0) * 10) / 10).alias("median_tenths")
    )


@query(CANDIDATES + "SELECT id FROM candidates WHERE created_at >= now - INTERVAL 180 DAYS")
def candidate_purge(spark, sf_dir):
    """Candidates that a purge of those not seen for 180 days leaves."""
    return candidates(spark, sf_dir).where(F.col("created_at") >= _now() - F.expr("INTERVAL 180 DAYS")).select("id")


@query(
    LISTINGS
    + """SELECT id, by_agency OR coalesce(commission, false) OR coalesce(rooms > 4, false) AS by_agency,
  CASE WHEN deal = 'longRent' AND room_only THEN 'roomRent' ELSE deal END AS deal, room_only OR deal = 'roomRent' AS room_only FROM listings"""
)
def listing_semantics(spark, sf_dir):
    """A commission, or one above 0 %, makes a listing an agency's; a room let for long is a room rent, and a room
    rent is a room only. ``rooms`` above 4 stands for the commission in per cent."""
    percent = F.coalesce(F.col("rooms") - 4 > 0, F.lit(False))
    room = (F.col("deal") == "longRent") & F.col("room_only")
    return listings(spark, sf_dir).select(
        "id", (F.col("by_agency") | F.coalesce("commission", F.lit(False)) | percent).alias("by_agency"),
        F.when(room, "roomRent").otherwise(F.col("deal")).alias("deal"), (F.col("room_only") | (F.col("deal") == "roomRent")).alias("room_only"),
    )


@query(
    LISTINGS
    + """SELECT w.id, w.dkey, p.price, p.city FROM (SELECT id, dkey FROM winners ORDER BY price_usd DESC NULLS LAST, id DESC LIMIT 60) w JOIN listings p USING (id)"""
)
def page_then_payload(spark, sf_dir):
    """A page of keys first, the payload of its 60 rows after: the sort carries keys alone."""
    rows = listings(spark, sf_dir)
    public = rows.where(~F.col("status").isin("sold", "rented", "closed", "outdated") & ~F.col("commercial"))
    best = Window.partitionBy("dkey").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    keys = public.select("id", "dkey", "price_usd", "created_at").withColumn("rn", F.row_number().over(best)).where("rn = 1")
    page = keys.orderBy(F.desc_nulls_last("price_usd"), F.desc("id")).limit(60).select("id", "dkey")  # 60 rows
    return rows.select("id", "price", "city").join(F.broadcast(page), "id").select("id", "dkey", "price", "city")


@query(
    "SELECT c_custkey AS contact, count(o_orderkey) AS n, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
)
def latest_per_contact(spark, sf_dir):
    """Each contact with its number of listings and the latest; grouped first, joined after."""
    per = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    joined = load(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("contact"), F.coalesce("n", F.lit(0)).alias("n"), "latest")


_PAY = """SELECT id, period, CASE WHEN annual BETWEEN 500 AND 1000000 THEN annual END AS annual_usd, CASE WHEN annual BETWEEN 500 AND 1000000 THEN used END AS used FROM (
  SELECT *, CAST(floor(amount * CASE used WHEN 'hour' THEN 1920 WHEN 'month' THEN 12 WHEN 'year' THEN 1 END + 0.5) AS BIGINT) AS annual FROM (
  SELECT *, CASE WHEN amount <= 0 THEN NULL WHEN period = 'month' AND amount > 80000 THEN 'year' WHEN period = 'hour' AND amount > 500 THEN 'year'
    WHEN period = 'year' AND currency IN ('USD', 'EUR') AND amount < 8 THEN NULL WHEN period = 'year' AND currency IN ('USD', 'EUR') AND amount < 400 THEN 'hour'
    WHEN period = 'year' AND currency NOT IN ('USD', 'EUR') AND amount < 5000 THEN 'month' ELSE period END AS used FROM (
  SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'hour' WHEN 1 THEN 'month' ELSE 'year' END AS period,
    CASE l_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'KZT' ELSE 'EUR' END AS currency, l_extendedprice / CASE WHEN l_partkey % 2 = 0 THEN 200 ELSE 2 END AS amount FROM lineitem)))"""


@query(_PAY)
def annual_salaries(spark, sf_dir):
    """Salaries by the year, with periods that can't be meant put right."""
    k = F.col("l_orderkey")
    period = F.when(F.col("l_linenumber") % 3 == 0, "hour").when(F.col("l_linenumber") % 3 == 1, "month").otherwise("year")
    currency = F.when(k % 3 == 0, "USD").when(k % 3 == 1, "KZT").otherwise("EUR")
    amount = F.col("l_extendedprice") / F.when(F.col("l_partkey") % 2 == 0, 200).otherwise(2)
    pay = plausible_annual_usd(amount, period, currency)
    rows = load(spark, sf_dir, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("id"), period.alias("period"), pay.alias("pay"))
    return rows.select("id", "period", F.col("pay.usd").alias("annual_usd"), F.col("pay.period").alias("used"))


_AGREE = """SELECT field, count(*) FILTER (WHERE verdict = 'agree') AS agree, count(*) FILTER (WHERE verdict = 'disagree') AS disagree,
  count(*) FILTER (WHERE verdict = 'encoderOnly') AS encoder_only, count(*) FILTER (WHERE verdict = 'sourceOnly') AS source_only FROM (
  SELECT field, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL THEN 'encoderOnly' WHEN a IS NULL THEN 'sourceOnly'
    WHEN abs(a - b) <= greatest(0.5, abs(b) * 0.005) THEN 'agree' ELSE 'disagree' END AS verdict FROM (
  SELECT l_returnflag AS field, CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice END AS a,
    CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice * (1 + l_discount / 10) END AS b FROM lineitem)) GROUP BY field"""


@query(_AGREE)
def agreement_counters(spark, sf_dir):
    """For each field, how often two readings agree (within 0.5 or half a per cent), disagree, or only one has a value."""
    a = F.when(F.col("l_partkey") % 4 != 0, F.col("l_extendedprice"))
    b = F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice") * (1 + F.col("l_discount") / 10))
    near = F.abs(a - b) <= F.greatest(F.lit(0.5), F.abs(b) * 0.005)
    both = a.isNotNull() & b.isNotNull()
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("field")).agg(
        F.count_if(both & near).alias("agree"), F.count_if(both & ~near).alias("disagree"),
        F.count_if(a.isNotNull() & b.isNull()).alias("encoder_only"), F.count_if(a.isNull() & b.isNotNull()).alias("source_only"),
    )


@query(
    LISTINGS
    + """SELECT id, status = 'active' AND NOT (source = 's1' AND country = 'ASIA' AND first_seen < TIMESTAMP '1998-01-01') AS active FROM listings"""
)
def crawl_deactivation(spark, sf_dir):
    """Listings of one source and country not seen since the crawl began are no longer active."""
    missed = (F.col("source") == "s1") & (F.col("country") == "ASIA") & (F.col("first_seen") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return listings(spark, sf_dir).select("id", ((F.col("status") == "active") & ~missed).alias("active"))


_CURRENT = """, k AS (SELECT id, created_at, source, active, CASE id % 4 WHEN 0 THEN 'User' || CAST(id % 700 AS VARCHAR) || '@Mail.example' WHEN 1 THEN '' END AS contact, CASE WHEN id % 8 = 2 THEN 'web' ELSE 'board' END AS origin,
    city || '|' || COALESCE(CAST(age AS VARCHAR), '') AS rest, CASE WHEN id % 8 = 6 THEN 'See https://x.example/' || CAST(id AS VARCHAR) || ' Experienced ' || lower(city) || ' person who has worked in ' || city || ' for years' ELSE 'short' END AS told,
    COALESCE(name, '') AS name FROM candidates),
  p AS (SELECT *, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS plain, substr(regexp_replace(regexp_replace(lower(told), 'https?://[^ \\t\\n\\r\\f]+', '', 'g'), '[^a-zа-яёіїґ0-9]+', '', 'g'), 1, 400) AS letters FROM k),
  d AS (SELECT *, CASE WHEN COALESCE(contact, '') <> '' THEN 'c:' || lower(contact) WHEN origin = 'web' AND length(plain) >= 4 THEN 'p:' || lower(source) || ':' || plain || ':' || rest WHEN length(letters) >= 40 THEN 't:' || letters
    ELSE 'k:' || source || ':' || CAST(id AS VARCHAR) END AS dkey FROM p)"""


def fingerprinted(spark, sf_dir):
    """Candidates with their fingerprint; see _CURRENT for the same in SQL."""
    from tidewell.operators.identity import candidate_key

    k, text = F.col("id"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    contact = F.when(k % 4 == 0, text("User", (k % 700).cast("string"), "@Mail.example")).when(k % 4 == 1, "")
    told = text("See https://x.example/", k.cast("string"), " Experienced ", F.lower("city"), " person who has worked in ", F.col("city"), " for years")
    rest = text(F.col("city"), "|", F.coalesce(F.col("age").cast("string"), F.lit("")))
    key = candidate_key(contact, F.when(k % 8 == 2, "web").otherwise("board"), F.col("source"), F.coalesce("name", F.lit("")), rest, F.when(k % 8 == 6, told).otherwise("short"), k.cast("string"))
    return candidates(spark, sf_dir).select("id", "created_at", "active", key.alias("dkey"))


@query(CANDIDATES + _CURRENT + "SELECT id, dkey FROM d")
def candidate_keys(spark, sf_dir):
    """The fingerprint of every candidate."""
    return fingerprinted(spark, sf_dir).select("id", "dkey")


@query(
    CANDIDATES
    + _CURRENT
    + """, b AS (SELECT id, created_at, CASE WHEN id % 13 = 5 THEN 'c:merged' || CAST(id % 90 AS VARCHAR) ELSE dkey END AS dkey FROM d WHERE active AND id % 13 <> 7)
    SELECT id, dkey FROM b QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY created_at DESC, id DESC) = 1"""
)
def current_candidates(spark, sf_dir):
    """The current candidate of every fingerprint after a batch that moves some to other keys and closes some: old and new keys are elected anew."""
    from tidewell.operators.readmodel import KeptWinners
    from tidewell.session import shared_path

    rows = fingerprinted(spark, sf_dir)
    table = KeptWinners(shared_path(spark, "candidates"), order=("created_at DESC", "id DESC"), parts=16)
    table.create(rows.where("active").drop("active"))
    k = F.col("id") % 13
    batch = rows.where(k.isin(5, 6, 7) & F.col("active")).withColumn("dkey", F.when(k == 5, F.concat(F.lit("c:merged"), (F.col("id") % 90).cast("string"))).otherwise(F.col("dkey")))
    table.apply(batch.withColumn("gone", k == 7).drop("active"))
    return table.winners(spark).select("id", "dkey")
