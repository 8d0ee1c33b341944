"""The two statistics composites: of listings and of vacancies, each from one base that is written once.

Both return long rows (section, deal, dimension, label, n, priced, median, average, lowest, highest): one row a figure or
group. Sections that need no price leave the price columns null. Rows of the result are bounded by the number of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.money import band
from tidewell.operators.quantiles import percentiles
from tidewell.session import Scratch

#: How many labels of a dimension are shown, buckets of a price histogram, and the fewest prices it needs.
SHOWN = {"country": 12, "city": 12, "district": 60, "microdistrict": 60, "metro": 60}
BUCKETS, LEAST_PRICES = 24, 8
DEALS = ("sale", "longRent", "shortRent")
#: Of vacancies, professions and skills shown, places of each profession, salaries a day, country and profession, and in all.
TOP, PLACES, SAMPLES, POINTS = 20, 6, 3, 1500
COLUMNS = ("section", "deal", "dimension", "label", "n", "priced", "median", "average", "lowest", "highest")


def deal_key(deal: Column, room_only: Column) -> Column:
    """Rooms are a deal of their own; deals that aren't known are 'unknown'."""
    return F.when(F.coalesce(room_only, F.lit(False)), "roomRent").when(deal.isin(*DEALS), deal).otherwise("unknown")


def _long(rows: DataFrame, section: str, **given: Column | str) -> DataFrame:
    types = {"n": "long", "priced": "long", "section": "string", "deal": "string", "dimension": "string", "label": "string"}
    made = {k: F.col(v) if isinstance(v, str) else v for k, v in given.items()} | {"section": F.lit(section)}
    return rows.select(*[made.get(c, F.lit(None)).cast(types.get(c, "double")).alias(c) for c in COLUMNS])


def _counts(rows: DataFrame, section: str, **counts: Column) -> DataFrame:
    """A row a counter, all from one pass."""
    one = rows.agg(*[c.alias(k) for k, c in counts.items()])
    return _long(one.unpivot([], list(counts), "label", "n"), section, label="label", n="n")


def _groups(long: DataFrame, keys: list[str], value: str, shares: list[float], scratch: Scratch) -> DataFrame:
    """(keys, n, priced, average, lowest, highest, p) of every group of ``long``."""
    stats = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(value).alias("priced"), F.avg(value).alias("average"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    p = percentiles(long, keys, value, shares, scratch)
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    return stats.alias("s").join(p.alias("p"), on, "left").select("s.*", "p.p")


def _ranked(rows: DataFrame, within: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def listing_snapshot(members: DataFrame, shown: Column, scratch: Scratch) -> DataFrame:
    """Totals, deals, price bands and histograms, places with and without the deal, activity by day and quality.

    ``members``: all public rows with dkey's winner marked by ``shown``; columns country, city, district, metro, deal,
    room_only, by_agency, commission, commission_percent, usd, created_at, first_seen. Only winners are counted; the others
    are ``duplicates_rejected``. A price band is the price against its deal's median; a histogram has 24 buckets
    between the 2nd and the 98th percentile, empty ones included."""
    base = members.select(
        "country", "city", "district", "metro", "by_agency", "commission", "commission_percent", F.col("usd").cast("double").alias("usd"),
        deal_key(F.col("deal"), F.col("room_only")).alias("deal"), F.coalesce("first_seen", "created_at").alias("seen"), shown.alias("shown"),
    )
    base = scratch.put(base, "snapshot")
    rows = base.where("shown")
    percent = F.coalesce(F.col("commission_percent").cast("double"), F.lit(0.0))
    totals = _counts(
        rows, "total", total=F.count("*"), owners=F.count_if(~F.col("by_agency")), agencies=F.count_if("by_agency"),
        commission=F.count_if(F.coalesce("commission", F.lit(False)) | (percent > 0)),
        no_commission=F.count_if(~F.coalesce("commission", F.lit(True)) | (F.col("commission_percent") == 0)),
    )
    quality = _counts(base, "quality", raw_total=F.count("*"), duplicates_rejected=F.count_if(~F.col("shown")))

    def cell(deal: Column, dimension: str, label: Column) -> Column:
        return F.struct(deal.alias("deal"), F.lit(dimension).alias("dimension"), label.alias("label"))

    def trimmed(c: str) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    nothing = F.lit(None).cast("string")
    cells = [cell(F.col("deal"), "deal", F.col("deal"))] + [cell(d, g, trimmed(g)) for g in ("country", "city", "district", "metro") for d in (nothing, F.col("deal"))]
    long = rows.select("usd", F.explode(F.filter(F.array(*cells), lambda c: c["label"].isNotNull())).alias("g")).select("usd", "g.*")
    groups = scratch.put(_groups(long, ["deal", "dimension", "label"], "usd", [0.5, 0.02, 0.98], scratch), "groups")
    prices = {"n": "n", "priced": "priced", "median": F.col("p")[0], "average": "average", "lowest": "lowest", "highest": "highest"}
    deals = groups.where("dimension = 'deal'")
    ranked = _ranked(groups.where("dimension <> 'deal'"), ["deal", "dimension"], F.desc("n"), F.asc("label"))
    most = F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), F.col("dimension"))
    places = _long(ranked.where(F.col("position") <= most), "place", deal="deal", dimension="dimension", label="label", **prices)
    # A row a deal, so at most five: a broadcast of fixed size.
    bounds = F.broadcast(deals.select("deal", F.col("p")[0].alias("mid"), F.col("p")[1].alias("lo"), F.col("p")[2].alias("hi"), F.col("priced").alias("all")))
    priced = rows.where("usd IS NOT NULL").select("deal", "usd").join(bounds, "deal")
    banded = priced.where("usd > 0 AND mid > 0").groupBy("deal", band(F.col("usd") / F.col("mid")).alias("label")).agg(F.count("*").alias("n"))
    wide = (F.col("all") >= LEAST_PRICES) & (F.col("hi") > F.col("lo"))
    place = F.least(F.lit(BUCKETS), F.floor((F.col("usd") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int") + 1)
    filled = priced.where(wide & F.col("usd").between(F.col("lo"), F.col("hi"))).groupBy("deal", place.alias("bucket")).agg(F.count("*").alias("n"))
    dense = bounds.where(wide).select("deal", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(BUCKETS))).alias("bucket")).join(filled, ["deal", "bucket"], "left")
    edge = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / BUCKETS
    activity = rows.where("seen IS NOT NULL").groupBy(F.date_format("seen", "yyyy-MM-dd").alias("label")).agg(F.count("*").alias("n"))
    return (
        totals.unionByName(quality).unionByName(_long(deals, "deal", deal="deal", label="label", **prices)).unionByName(places)
        .unionByName(_long(banded, "band", deal="deal", label="label", n="n"))
        .unionByName(_long(dense, "histogram", deal="deal", label=F.col("bucket").cast("string"), n=F.coalesce("n", F.lit(0)), lowest=edge(F.col("bucket") - 1), highest=edge(F.col("bucket"))))
        .unionByName(_long(activity, "activity", label="label", n="n"))
    )


def vacancy_snapshot(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Salary in all, by source, country and profession (with its places), experience, work mode, relocation, employment, languages,
    skills, and salaries sampled over time; in section 'trend' ``lowest`` is the salary, ``label`` the title and ``dimension`` the time.

    ``rows``: filtered vacancies (source, country, city, posted_at, title, work_mode, relocation, employment_kind, salary_usd, years,
    no_experience, profession, foreigner_friendly, languages, skills). Medians are 0 where no salary is known."""
    kept = ("source", "country", "city", "posted_at", "title", "work_mode", "relocation", "employment_kind", "profession", "foreigner_friendly", "languages", "skills", "no_experience")
    base = scratch.put(rows.select(*kept, F.col("salary_usd").cast("double").alias("usd"), F.col("years").cast("double").alias("years")), "vacancies")
    land = F.coalesce("country", F.lit("OTHER"))

    def cell(dimension: str, profession: Column, label: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), profession.alias("deal"), label.alias("label"))

    nothing, profession = F.lit(None).cast("string"), F.col("profession")
    cells = [
        cell("all", nothing, F.lit("all")), cell("source", nothing, F.col("source")), cell("country", nothing, land), cell("profession", nothing, profession),
        cell("profession_country", profession, land), cell("profession_city", profession, F.nullif(F.col("city"), F.lit(""))),
    ]
    long = base.select("usd", "years", F.explode(F.filter(F.array(*cells), lambda c: c["label"].isNotNull())).alias("g")).select("usd", "years", "g.*")
    keys = ["dimension", "deal", "label"]
    groups = scratch.put(_groups(long, keys, "usd", [0.5], scratch), "groups")
    none = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    median = none(F.col("p")[0])
    prices = {"n": "n", "priced": "priced", "median": median}
    whole = _long(groups.where("dimension = 'all'"), "salary", label="label", **prices, average=none("average"), lowest=none("lowest"), highest=none("highest"))
    plain = _long(groups.where("dimension IN ('source', 'country')"), "group", dimension="dimension", label="label", **prices)
    trades = _ranked(groups.where("dimension = 'profession'"), ["dimension"], F.desc("n"), F.desc("priced"), F.asc("label")).where(F.col("position") <= TOP)
    worked = percentiles(long.where("dimension IN ('profession', 'all')"), ["dimension", "label"], "years", [0.5], scratch).select(F.col("dimension").alias("d"), F.col("label").alias("l"), F.col("p")[0].alias("years"))
    worked = scratch.put(worked, "years")
    # At most TOP professions: bounded. ``average`` has the median of years.
    top = trades.select(F.col("label").alias("trade"))
    trades = trades.join(worked.where("d = 'profession'"), F.col("label") == F.col("l"), "left")
    places = groups.where("dimension LIKE 'profession\\_%' AND priced > 0").join(F.broadcast(top), F.col("deal") == F.col("trade"), "left_semi")
    places = _ranked(places, ["deal"], F.desc("n"), F.desc("priced"), F.desc(F.col("p")[0]), F.asc("dimension"), F.asc("label")).where(F.col("position") <= PLACES)
    y, fresh = F.col("years"), F.coalesce("no_experience", F.lit(False))
    counts = _counts(
        base, "experience", known=F.count("years"), none=F.count_if(fresh | (y == 0)), up_to_one=F.count_if(~fresh & (y > 0) & (y <= 1)), one_to_three=F.count_if(~fresh & (y > 1) & (y <= 3)),
        three_to_five=F.count_if((y > 3) & (y <= 5)), five_plus=F.count_if(y > 5), unknown=F.count_if(y.isNull()), foreigner_friendly=F.count_if("foreigner_friendly"),
    )
    typical = _long(worked.where("d = 'all'"), "experience", label=F.lit("median"), median="years")
    label = lambda part, c: F.struct(F.lit(part).alias("dimension"), F.coalesce(c, F.lit("unknown")).alias("label"))
    listed = F.concat(
        F.array(*[label(c, F.col(c)) for c in ("work_mode", "relocation", "employment_kind")]),
        F.transform(F.filter(F.coalesce("languages", F.array().cast("array<string>")), lambda x: x != ""), lambda x: label("language", x)),
        F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda x: label("skill", x)),
    )
    tags = base.select(F.inline(listed)).groupBy("dimension", "label").agg(F.count("*").alias("n"))
    tags = _ranked(tags, ["dimension"], F.desc("n"), F.asc("label")).where((F.col("dimension") != "skill") | (F.col("position") <= TOP))
    day = Window.partitionBy(F.to_date("posted_at"), F.coalesce("country", F.lit("")), "profession").orderBy(F.desc("posted_at"), F.asc("title"), F.asc("usd"))
    trend = base.where("usd IS NOT NULL").select("posted_at", "usd", "country", "city", "title", "profession").withColumn("place", F.row_number().over(day)).where(F.col("place") <= SAMPLES)
    trend = trend.orderBy(F.desc("posted_at"), F.asc("title"), F.asc("usd"), F.asc("country"), F.asc("profession")).limit(POINTS)
    return (
        whole.unionByName(plain).unionByName(_long(trades, "profession", label="label", **prices, average="years"))
        .unionByName(_long(places, "place", deal="deal", dimension="dimension", label="label", **prices)).unionByName(counts).unionByName(typical)
        .unionByName(_long(tags, "tag", dimension="dimension", label="label", n="n"))
        .unionByName(_long(trend, "trend", deal="profession", dimension=F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"), label="title", lowest="usd"))
    )


#: Upper ends of ages and of years of experience, days of activity shown, and what isn't a profession.
AGES = ((18, "<18"), (25, "18–24"), (35, "25–34"), (45, "35–44"), (55, "45–54"), (None, "55+"))
YEARS, ACTIVE_DAYS, ANY_ROLE = (2, 4, 7, 11), 60, "Any Role"


def candidate_snapshot(rows: DataFrame, now: Column, scratch: Scratch) -> DataFrame:
    """Genders, ages, platforms, places, sectors, professions, activity of the last days, the median salary by experience (five buckets, empty ones
    too) and the salary range by profession.

    ``rows``: filtered current candidates (gender, age, provider, source, origin, city, country, sectors, professions, activity_at, salary_min_usd,
    salary_max_usd, years). A salary of one end counts for both; the middle of a range counts for medians."""
    low, high = F.coalesce("salary_min_usd", "salary_max_usd"), F.coalesce("salary_max_usd", "salary_min_usd")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    bucket = F.when(F.col("years") < YEARS[0], 0)
    for i, top in enumerate(YEARS[1:], 1):
        bucket = bucket.when(F.col("years") < top, i)
    age = F.when(F.col("age").isNull(), "__unknown__")
    for top, name in AGES:
        age = age.when(F.col("age") < top, name) if top else age.otherwise(name)
    none = F.array().cast("array<string>")
    base = scratch.put(rows.select(
        F.when(F.col("gender").isin("female", "male"), F.col("gender")).otherwise("unknown").alias("gender"), age.alias("age"),
        F.coalesce(blank("provider"), F.col("source"), F.col("origin"), F.lit("unknown")).alias("platform"), F.coalesce(blank("city"), F.col("country"), F.lit("__unknown__")).alias("location"),
        F.coalesce("sectors", none).alias("sectors"), F.filter(F.coalesce("professions", none), lambda p: p != ANY_ROLE).alias("professions"), F.col("activity_at"),
        F.least(low, high).cast("double").alias("low"), F.greatest(low, high).cast("double").alias("high"), ((low + high) / 2).cast("double").alias("pay"),
        F.when(F.col("years").isNotNull(), bucket.otherwise(len(YEARS))).alias("bucket"),
    ), "candidates")
    tag = lambda kind, c: F.struct(F.lit(kind).alias("dimension"), c.alias("label"))
    tags = F.concat(
        F.array(*[tag(c, F.col(c)) for c in ("gender", "age", "platform", "location")]),
        F.transform("sectors", lambda x: tag("sector", x)), F.transform("professions", lambda x: tag("profession", x)),
    )
    counts = base.select(F.inline(tags)).groupBy("dimension", "label").agg(F.count("*").alias("n"))
    # Genders and ages are told even where nobody has them.
    fixed = [("gender", g) for g in ("female", "male", "unknown")] + [("age", n) for _, n in AGES] + [("age", "__unknown__")]
    shown = base.sparkSession.createDataFrame(fixed, "dimension string, label string")
    missing = shown.join(counts, ["dimension", "label"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    recent = base.where((F.col("activity_at") >= now - F.expr(f"INTERVAL {ACTIVE_DAYS} DAYS")) & (F.col("activity_at") <= now))
    activity = recent.groupBy(F.date_format("activity_at", "yyyy-MM-dd").alias("label")).agg(F.count("*").alias("n"))
    paid = base.where("bucket IS NOT NULL AND pay IS NOT NULL").select("bucket", "pay")
    medians = percentiles(paid, ["bucket"], "pay", [0.5], scratch)
    buckets = base.sparkSession.range(len(YEARS) + 1).select(F.col("id").cast("int").alias("bucket"))
    medians = buckets.join(medians, "bucket", "left").select(F.col("bucket").cast("string").alias("label"), F.coalesce("values", F.lit(0)).alias("priced"), F.col("p")[0].alias("median"))
    ranges = base.where("low IS NOT NULL").select("low", "high", F.explode("professions").alias("label")).groupBy("label")
    ranges = ranges.agg(F.count("*").alias("n"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    return (
        _long(counts.unionByName(missing), "tag", dimension="dimension", label="label", n="n").unionByName(_long(activity, "activity", label="label", n="n"))
        .unionByName(_long(medians, "salary_by_experience", label="label", priced="priced", median="median"))
        .unionByName(_long(ranges, "salary_by_profession", label="label", n="n", lowest="lowest", highest="highest"))
    )
