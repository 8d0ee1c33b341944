"""Statistics snapshots and market comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.money import BANDS, PLAUSIBLE_USD, band, plausible, repair_action
from tidewell.operators import listing as L
from tidewell.operators.scores import market_comparison as compare
from tidewell.plans.registry import query
from tidewell.plans.tables import LISTINGS, d4, listings
from tidewell.operators import market, statistics
from tidewell.operators.quantiles import percentiles
from tidewell.plans.feeds import CANDIDATES, NOW_DATE, VACANCIES, candidates, vacancies
from tidewell.session import Scratch, load

_BOUNDS = " ".join(f"WHEN '{d}' THEN price_usd BETWEEN {lo} AND {hi}" for d, (lo, hi) in PLAUSIBLE_USD.items())
PRICED = LISTINGS + f", priced AS (SELECT *, CASE WHEN CASE deal {_BOUNDS} END THEN price_usd END AS usd FROM winners)\n"


def priced(spark, sf_dir):
    """Winners with their plausible price."""
    rows = L.winners(L.public(listings(spark, sf_dir)))
    return rows.withColumn("usd", plausible(F.col("price_usd"), F.col("deal")))


def _d(sql: str) -> str:
    return f"CAST(CAST({sql} AS DECIMAL(20,4)) AS DOUBLE)"


@query(
    PRICED
    + f"""SELECT count(*) AS total, count(*) FILTER (WHERE by_agency) AS agencies, count(*) FILTER (WHERE created_at IS NULL) AS undated,
    count(usd) AS priced, count(DISTINCT city) AS cities, {_d("min(usd)")} AS lowest, {_d("max(usd)")} AS highest FROM priced"""
)
def stats_totals(spark, sf_dir):
    """All counters of the snapshot in one pass."""
    out = priced(spark, sf_dir).agg(
        F.count("*").alias("total"),
        F.count_if("by_agency").alias("agencies"),
        F.count_if(F.col("created_at").isNull()).alias("undated"),
        F.count("usd").alias("priced"),
        F.countDistinct("city").alias("cities"),
        F.min("usd").alias("lowest"),
        F.max("usd").alias("highest"),
    )
    return out.select("total", "agencies", "undated", "priced", "cities", d4("lowest"), d4("highest"))


@query(
    PRICED
    + f"""SELECT deal, count(*) AS n, {_d("quantile_cont(usd, 0.5)")} AS median, {_d("quantile_cont(usd, 0.02)")} AS p02, {_d("quantile_cont(usd, 0.98)")} AS p98
    FROM priced GROUP BY deal"""
)
def stats_deal_types(spark, sf_dir):
    """Count, median and outer percentiles by deal."""
    scratch = Scratch(spark)
    rows = scratch.put(priced(spark, sf_dir).select("deal", "usd"), "prices")
    out = rows.groupBy("deal").agg(F.count("*").alias("n")).join(percentiles(rows, ["deal"], "usd", [0.5, 0.02, 0.98], scratch), "deal", "left")
    out = out.select("deal", "n", *[F.col("p")[i].alias(c) for i, c in enumerate(("median", "p02", "p98"))])
    return out.select("deal", "n", d4("median"), d4("p02"), d4("p98"))


_BAND = "CASE " + " ".join(f"WHEN r {'<=' if n == 'pink' else '<'} {t} THEN '{n}'" for n, t in BANDS) + " ELSE 'red' END"


@query(
    PRICED
    + f""", m AS (SELECT deal, city, median(usd) AS median FROM priced GROUP BY ALL),
    b AS (SELECT p.deal, usd / m.median AS r FROM priced p JOIN m USING (deal, city) WHERE usd IS NOT NULL)
    SELECT deal, {_BAND} AS band, count(*) AS n FROM b GROUP BY ALL"""
)
def stats_price_bands(spark, sf_dir):
    """Rows by the band of their price against the group's median (aggregate, then join)."""
    scratch = Scratch(spark)
    rows = scratch.put(priced(spark, sf_dir).where("usd IS NOT NULL").select("deal", "city", "usd"), "prices")
    medians = percentiles(rows, ["deal", "city"], "usd", [0.5], scratch).select("deal", "city", F.col("p")[0].alias("median"))
    banded = rows.join(medians, ["deal", "city"]).select("deal", band(F.col("usd") / F.col("median")).alias("band"))
    return banded.groupBy("deal", "band").agg(F.count("*").alias("n"))


@query(
    PRICED
    + """, b AS (SELECT deal, quantile_cont(usd, 0.02) AS lo, quantile_cont(usd, 0.98) AS hi FROM priced WHERE usd IS NOT NULL GROUP BY deal HAVING count(*) >= 8),
    h AS (SELECT deal, least(24, floor((usd - lo) / (hi - lo) * 24)::BIGINT + 1) AS bucket, count(*) AS n FROM priced JOIN b USING (deal)
      WHERE usd BETWEEN lo AND hi AND hi > lo GROUP BY ALL)
    SELECT deal, g AS bucket, COALESCE(n, 0) AS n FROM b CROSS JOIN generate_series(1, 24) t(g) LEFT JOIN h ON h.deal = b.deal AND h.bucket = g WHERE hi > lo""".replace(
        "SELECT deal, g AS", "SELECT b.deal, g AS"
    )
)
def stats_histogram_dense(spark, sf_dir):
    """24 price buckets for each deal, empty ones included, the top value clamped."""
    scratch = Scratch(spark)
    rows = scratch.put(priced(spark, sf_dir).where("usd IS NOT NULL").select("deal", "usd"), "prices")
    bounds = percentiles(rows, ["deal"], "usd", [0.02, 0.98], scratch)
    bounds = bounds.where("values >= 8").select("deal", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")).where("hi > lo")
    at = F.least(F.lit(24), F.floor((F.col("usd") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 24) + 1)
    filled = rows.join(bounds, "deal").where("usd BETWEEN lo AND hi").groupBy("deal", at.alias("bucket")).agg(F.count("*").alias("n"))
    dense = bounds.select("deal", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))).alias("bucket"))
    return dense.join(filled, ["deal", "bucket"], "left").select("deal", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


_DIMS = "(VALUES ('country', country), ('city', city), ('ptype', ptype), ('source', source), ('rooms', CAST(rooms AS VARCHAR))) v(dim, label)"


@query(
    PRICED
    + f"""SELECT COALESCE(deal, 'all') AS deal, dim, label, count(*) AS n, CAST(GROUPING(deal) AS INTEGER) AS is_total
    FROM priced CROSS JOIN LATERAL {_DIMS} WHERE label IS NOT NULL GROUP BY GROUPING SETS ((dim, label), (deal, dim, label))"""
)
def stats_geo_grouping_sets(spark, sf_dir):
    """Five dimensions unpivoted, counted with and without the deal by grouping sets."""
    long = priced(spark, sf_dir).selectExpr(
        "deal", "stack(5, 'country', country, 'city', city, 'ptype', ptype, 'source', source, 'rooms', cast(rooms AS string)) AS (dim, label)"
    )
    long = long.where("label IS NOT NULL")
    sets = long.groupingSets([["dim", "label"], ["deal", "dim", "label"]], "deal", "dim", "label")
    out = sets.agg(F.count("*").alias("n"), F.grouping("deal").cast("int").alias("is_total"))
    return out.select(F.coalesce("deal", F.lit("all")).alias("deal"), "dim", "label", "n", "is_total")


@query(
    PRICED
    + """SELECT country, city, n FROM (SELECT country, city, n, row_number() OVER (PARTITION BY country ORDER BY n DESC, city) AS rn
    FROM (SELECT country, city, count(*) AS n FROM priced GROUP BY ALL)) WHERE rn <= 3"""
)
def stats_geo_topn(spark, sf_dir):
    """The three largest cities of each country."""
    counts = priced(spark, sf_dir).groupBy("country", "city").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country").orderBy(F.desc("n"), "city")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stats_activity_daily(spark, sf_dir):
    """Activity by day."""
    events = load(spark, sf_dir, "events")
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    PRICED
    + f""", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, city, ptype, deal, dkey ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM priced WHERE usd IS NOT NULL) WHERE rn = 1)
    SELECT t.id, count(*) AS comparables, {_d("median(c.usd)")} AS median, {_d("t.usd / median(c.usd)")} AS ratio
    FROM priced t JOIN one c ON t.country = c.country AND t.city = c.city AND t.ptype = c.ptype AND t.deal = c.deal AND t.dkey <> c.dkey
      AND abs(t.area - c.area) <= greatest(5, t.area * 0.15) WHERE t.usd IS NOT NULL GROUP BY t.id, t.usd HAVING count(*) >= 3"""
)
def market_comparison(spark, sf_dir):
    """Each listing's price against the median of its segment's comparables."""
    rows = priced(spark, sf_dir)
    out = compare(rows, ["country", "city", "ptype", "deal"], "dkey", "usd", "area")
    return out.select("id", "comparables", d4("median"), d4("ratio"))


@query(
    LISTINGS
    + """SELECT CASE WHEN price IS NULL THEN 'keep' WHEN price <= 0 THEN 'clear' WHEN ok THEN 'keep' WHEN country = 'EUROPE' AND currency = 'UAH' AND ok_raw THEN 'currency' ELSE 'report' END AS action, count(*) AS n
    FROM (SELECT *, CASE deal %s END AS ok, CASE deal %s END AS ok_raw FROM listings) GROUP BY ALL"""
    % (_BOUNDS, _BOUNDS.replace("price_usd", "price"))
)
def price_repair_plan(spark, sf_dir):
    """What a price repair would do, by action."""
    rows = listings(spark, sf_dir).withColumn("land", F.when(F.col("country") == "EUROPE", "UA").otherwise("XX"))
    plan = rows.select(repair_action(F.col("price"), F.col("currency"), F.col("land"), F.col("deal")).alias("action"))
    return plan.groupBy("action").agg(F.count("*").alias("n"))


@query(
    LISTINGS
    + """SELECT source, country, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status <> 'active') AS inactive FROM listings GROUP BY ALL"""
)
def source_totals(spark, sf_dir):
    """Rows by source and country, active and not."""
    active = F.col("status") == "active"
    return listings(spark, sf_dir).groupBy("source", "country").agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive")
    )


@query(LISTINGS + "SELECT CAST(floor(min(price_usd) * 40) AS BIGINT) AS lowest, CAST(ceil(max(price_usd) * 40) AS BIGINT) AS highest FROM public")
def price_range_only(spark, sf_dir):
    """Price range in the visitor's currency, rounded outwards."""
    usd = F.col("price_usd")
    return L.public(listings(spark, sf_dir)).agg(
        F.floor(F.min(usd) * 40).alias("lowest"), F.ceil(F.max(usd) * 40).alias("highest")
    )


_ROUNDED = ("median", "average", "lowest", "highest")


def _figures(rows):
    """Rounded by the same operations on doubles as ``_e``, so ties fall alike."""
    return rows.select(*[((F.floor(F.col(c) * 10000 + 0.5)) / 10000).alias(c) if c in _ROUNDED else F.col(c) for c in statistics.COLUMNS])


def _e(sql: str) -> str:
    return f"floor(({sql}) * 10000 + 0.5) / 10000"


_DK = "CASE WHEN room_only THEN 'roomRent' WHEN deal IN ('sale', 'longRent', 'shortRent') THEN deal ELSE 'unknown' END"
_NO = "CAST(NULL AS DOUBLE)"
_SIX = f"CAST(NULL AS BIGINT) AS priced, {_NO} AS median, {_NO} AS average, {_NO} AS lowest, {_NO} AS highest"
_PRICES = f"count(*) AS n, count(usd) AS priced, {_e('quantile_cont(usd, 0.5)')} AS median, {_e('avg(usd)')} AS average, {_e('min(usd)')} AS lowest, {_e('max(usd)')} AS highest"


def _counters(section, table, **counts):
    sums = ", ".join(f"{sql} AS {name}" for name, sql in counts.items())
    return f"SELECT '{section}' AS section, NULL AS deal, NULL AS dimension, label, n, {_SIX} FROM (UNPIVOT (SELECT {sums} FROM {table}) ON {', '.join(counts)} INTO NAME label VALUE n)"


_SNAPSHOT = (
    LISTINGS
    + f""", m AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY created_at DESC NULLS LAST, id DESC) = 1 AS shown, {_DK} AS dk, ptype AS district,
    CASE WHEN id % 3 = 0 THEN source ELSE ' ' END AS metro, CASE id % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 0.0 END AS pct FROM public),
  v AS (SELECT *, CASE WHEN CASE dk {_BOUNDS} END THEN price_usd END AS usd FROM m WHERE shown),
  g AS (SELECT dk AS deal, dimension, label, usd FROM v CROSS JOIN LATERAL (VALUES ('country', country), ('city', city), ('district', district), ('metro', nullif(trim(metro), ''))) x(dimension, label)
    WHERE label IS NOT NULL),
  places AS (SELECT deal, dimension, label, {_PRICES} FROM g GROUP BY ALL UNION ALL SELECT NULL, dimension, label, {_PRICES} FROM g GROUP BY ALL),
  b AS (SELECT dk AS deal, quantile_cont(usd, 0.5) AS mid, quantile_cont(usd, 0.02) AS lo, quantile_cont(usd, 0.98) AS hi, count(usd) AS c FROM v GROUP BY ALL),
  r AS (SELECT b.deal AS deal, usd, usd / mid AS r, lo, hi, c FROM v JOIN b ON dk = b.deal WHERE usd IS NOT NULL),
  h AS (SELECT deal, least(24, CAST(floor((usd - lo) / (hi - lo) * 24) AS INTEGER) + 1) AS bucket, count(*) AS n FROM r WHERE c >= 8 AND hi > lo AND usd BETWEEN lo AND hi GROUP BY ALL)
"""
    + _counters("total", "v", total="count(*)", owners="count(*) FILTER (WHERE NOT by_agency)", agencies="count(*) FILTER (WHERE by_agency)",
                commission="count(*) FILTER (WHERE commission OR pct > 0)", no_commission="count(*) FILTER (WHERE NOT commission OR pct = 0)")
    + " UNION ALL " + _counters("quality", "m", raw_total="count(*)", duplicates_rejected="count(*) FILTER (WHERE NOT shown)")
    + f""" UNION ALL SELECT 'deal', dk, NULL, dk, {_PRICES} FROM v GROUP BY dk
  UNION ALL SELECT 'place', deal, dimension, label, n, priced, median, average, lowest, highest FROM places
    QUALIFY row_number() OVER (PARTITION BY deal, dimension ORDER BY n DESC, label) <= CASE WHEN dimension IN ('district', 'microdistrict', 'metro') THEN 60 ELSE 12 END
  UNION ALL SELECT 'band', deal, NULL, {_BAND} AS label, count(*), {_SIX} FROM r WHERE usd > 0 GROUP BY ALL
  UNION ALL SELECT 'histogram', b.deal, NULL, CAST(g AS VARCHAR), COALESCE(h.n, 0), NULL, NULL, NULL, {_e("lo + (g - 1) * (hi - lo) / 24")}, {_e("lo + g * (hi - lo) / 24")}
    FROM b CROSS JOIN generate_series(1, 24) t(g) LEFT JOIN h ON h.deal = b.deal AND h.bucket = g WHERE c >= 8 AND hi > lo
  UNION ALL SELECT 'activity', NULL, NULL, strftime(COALESCE(first_seen, created_at), '%Y-%m-%d'), count(*), {_SIX} FROM v WHERE COALESCE(first_seen, created_at) IS NOT NULL GROUP BY ALL"""
)


@query(_SNAPSHOT)
def stats_snapshot(spark, sf_dir):
    """The whole statistics snapshot of the feed, all parts from one written base."""
    rows = L.public(listings(spark, sf_dir))
    newest = Window.partitionBy("dkey").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    k = F.col("id") % 4
    rows = rows.withColumns({
        "shown": F.row_number().over(newest) == 1, "district": F.col("ptype"), "metro": F.when(F.col("id") % 3 == 0, F.col("source")).otherwise(" "),
        "commission_percent": F.when(k == 0, 3.0).when(k == 1, 0.0), "usd": plausible(F.col("price_usd"), statistics.deal_key(F.col("deal"), F.col("room_only"))),
    })
    return _figures(statistics.listing_snapshot(rows, F.col("shown"), Scratch(spark)))


_MED = "COALESCE(quantile_cont(salary_usd, 0.5), 0)"
_PAID = f"count(*) AS n, count(salary_usd) AS priced, {_e(_MED)} AS median"
_FRESH = "COALESCE(no_experience, false)"


@query(
    VACANCIES
    + f""", f AS (SELECT *, split_part(title, ' ', 1) AS profession, COALESCE(country, 'OTHER') AS land, list_filter(language_keys, lambda l: NOT contains(l, ':')) AS languages FROM vacancies WHERE active),
  g AS (SELECT profession, 'profession_country' AS dimension, land AS label, salary_usd FROM f UNION ALL SELECT profession, 'profession_city', city, salary_usd FROM f WHERE city <> ''),
  t AS (SELECT profession AS label, count(*) AS n, count(salary_usd) AS priced, {_MED} AS mid, quantile_cont(years, 0.5) AS y FROM f GROUP BY ALL ORDER BY n DESC, priced DESC, label LIMIT 20),
  p AS (SELECT profession, dimension, label, count(*) AS n, count(salary_usd) AS priced, {_MED} AS mid FROM g GROUP BY ALL),
  c AS (SELECT unnest([{{'d': 'work_mode', 'l': COALESCE(work_mode, 'unknown')}}, {{'d': 'relocation', 'l': COALESCE(relocation, 'unknown')}}, {{'d': 'employment_kind', 'l': COALESCE(employment_kind, 'unknown')}}]) AS x FROM f
    UNION ALL SELECT unnest(list_transform(languages, lambda l: {{'d': 'language', 'l': l}})) FROM f UNION ALL SELECT unnest(list_transform(skills, lambda l: {{'d': 'skill', 'l': l}})) FROM f),
  s AS (SELECT x.d AS dimension, x.l AS label, count(*) AS n FROM c GROUP BY ALL)
SELECT 'salary' AS section, CAST(NULL AS VARCHAR) AS deal, CAST(NULL AS VARCHAR) AS dimension, 'all' AS label, {_PAID}, {_e("COALESCE(avg(salary_usd), 0)")} AS average, {_e("COALESCE(min(salary_usd), 0)")} AS lowest, {_e("COALESCE(max(salary_usd), 0)")} AS highest FROM f
UNION ALL SELECT 'group', NULL, 'source', source, {_PAID}, NULL, NULL, NULL FROM f GROUP BY source
UNION ALL SELECT 'group', NULL, 'country', land, {_PAID}, NULL, NULL, NULL FROM f GROUP BY land
UNION ALL SELECT 'profession', NULL, NULL, label, n, priced, {_e("mid")}, {_e("y")}, NULL, NULL FROM t
UNION ALL SELECT 'place', profession, dimension, label, n, priced, {_e("mid")}, NULL, NULL, NULL FROM (SELECT * FROM p WHERE priced > 0 AND profession IN (SELECT label FROM t)
  QUALIFY row_number() OVER (PARTITION BY profession ORDER BY n DESC, priced DESC, mid DESC, dimension, label) <= 6)
UNION ALL """
    + _counters("experience", "f", known="count(years)", none=f"count(*) FILTER (WHERE {_FRESH} OR years = 0)", up_to_one=f"count(*) FILTER (WHERE NOT {_FRESH} AND years > 0 AND years <= 1)",
                one_to_three=f"count(*) FILTER (WHERE NOT {_FRESH} AND years > 1 AND years <= 3)", three_to_five="count(*) FILTER (WHERE years > 3 AND years <= 5)",
                five_plus="count(*) FILTER (WHERE years > 5)", unknown="count(*) FILTER (WHERE years IS NULL)", foreigner_friendly="count(*) FILTER (WHERE foreigner_friendly)")
    + f""" UNION ALL SELECT 'experience', NULL, NULL, 'median', NULL, NULL, {_e("quantile_cont(years, 0.5)")}, NULL, NULL, NULL FROM f WHERE years IS NOT NULL
UNION ALL SELECT 'tag', NULL, dimension, label, n, {_SIX} FROM (SELECT * FROM s QUALIFY dimension <> 'skill' OR row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label) <= 20)
UNION ALL SELECT 'trend', profession, strftime(posted_at, '%Y-%m-%d %H:%M:%S'), title, NULL, NULL, NULL, NULL, {_e("salary_usd")}, NULL FROM (SELECT * FROM (SELECT * FROM f WHERE salary_usd IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY CAST(posted_at AS DATE), COALESCE(country, ''), profession ORDER BY posted_at DESC, title, salary_usd) <= 3) ORDER BY posted_at DESC, title, salary_usd, country, profession LIMIT 1500)"""
)
def vacancy_snapshot(spark, sf_dir):
    """The whole vacancy statistics: medians of all groups by one selection from one written base."""
    rows = vacancies(spark, sf_dir).where("active").withColumn("profession", F.split_part("title", F.lit(" "), F.lit(1)))
    rows = rows.withColumn("languages", F.filter("language_keys", lambda x: ~F.contains(x, F.lit(":"))))
    return _figures(statistics.vacancy_snapshot(rows, Scratch(spark)))


_SEG = "c.country = t.country AND lower(c.city) = lower(t.city) AND c.ptype = t.ptype AND c.dk = t.dk AND (t.district IS NULL OR c.district = t.district)"
_NEAR = "c.area BETWEEN t.area - greatest(5, t.area * 0.15) AND t.area + greatest(5, t.area * 0.15)"


@query(
    LISTINGS
    + f""", m AS (SELECT id, dkey, country, city, ptype, {_DK} AS dk, CASE WHEN contact % 3 > 0 THEN 'd' || CAST(contact % 2 AS VARCHAR) END AS district, rooms,
    CASE WHEN id % 9 > 0 THEN area + (id % 5) * 0.5 END AS area, price_usd AS usd, created_at, COALESCE(created_at, first_seen) >= TIMESTAMP '1996-01-01' AS fresh FROM public),
  p AS (SELECT * FROM m WHERE usd IS NOT NULL), s AS (SELECT DISTINCT country, city, ptype, dk, district, rooms, CASE WHEN rooms IS NULL THEN area END AS area FROM p WHERE rooms IS NOT NULL OR area IS NOT NULL),
  met AS (SELECT t.*, c.dkey, c.usd, c.created_at, c.id FROM s t JOIN p c ON c.fresh AND {_SEG} AND t.rooms IS NOT NULL AND c.rooms = t.rooms
    UNION ALL SELECT t.*, c.dkey, c.usd, c.created_at, c.id FROM s t JOIN p c ON c.fresh AND {_SEG} AND t.rooms IS NULL AND {_NEAR}),
  one AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY country, city, ptype, dk, district, rooms, area, dkey ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
  g AS (SELECT country, city, ptype, dk, district, rooms, area, count(*) AS n, floor(quantile_cont(usd, 0.5) * 100 + 0.5) / 100 AS mid FROM one GROUP BY ALL),
  r AS (SELECT p.id, p.usd, p.rooms, COALESCE(g.n, 0) AS n, CASE WHEN g.n >= 3 THEN mid END AS median FROM p LEFT JOIN g ON p.country = g.country AND p.city = g.city AND p.ptype = g.ptype AND p.dk = g.dk
    AND p.district IS NOT DISTINCT FROM g.district AND p.rooms IS NOT DISTINCT FROM g.rooms AND CASE WHEN p.rooms IS NULL THEN p.area END IS NOT DISTINCT FROM g.area WHERE p.rooms IS NOT NULL OR p.area IS NOT NULL)
SELECT id, CASE WHEN rooms IS NULL THEN 'area' ELSE 'rooms' END AS segment_kind, n AS comparables, median, usd / median AS ratio, COALESCE(usd / median < 1, false) AS good_price FROM r"""
)
def market_segments(spark, sf_dir):
    """Every listing against the median of its segment: by rooms, or by a window of areas where rooms aren't known."""
    rows = L.public(listings(spark, sf_dir))
    rows = rows.withColumns({
        "deal_key": statistics.deal_key(F.col("deal"), F.col("room_only")), "usd": F.col("price_usd"),
        "district": F.when(F.col("contact") % 3 > 0, F.concat(F.lit("d"), (F.col("contact") % 2).cast("string"))),
        "area": F.when(F.col("id") % 9 > 0, F.col("area") + (F.col("id") % 5) * 0.5),
    })
    fresh = F.coalesce("created_at", "first_seen") >= F.lit("1996-01-01").cast("timestamp_ntz")
    return market.compare(rows, Scratch(spark), fresh)


_AGE = "CASE WHEN age IS NULL THEN '__unknown__' " + " ".join(f"WHEN age < {t} THEN '{n}'" for t, n in statistics.AGES if t) + " ELSE '55+' END"
_YEARS = "CASE " + " ".join(f"WHEN years < {t} THEN {i}" for i, t in enumerate(statistics.YEARS)) + " ELSE 4 END"
_FIXED = ", ".join(f"('{d}', '{x}')" for d, x in [("gender", g) for g in ("female", "male", "unknown")] + [("age", n) for _, n in statistics.AGES] + [("age", "__unknown__")])


@query(
    CANDIDATES
    + f""", f AS (SELECT *, CASE WHEN id % 5 = 2 THEN '' WHEN id % 5 = 3 THEN NULL ELSE 'board' || CAST(id % 3 AS VARCHAR) END AS provider, COALESCE(salary_min_usd, salary_max_usd) AS lo, COALESCE(salary_max_usd, salary_min_usd) AS hi,
      [CASE WHEN id % 2 = 0 THEN 'trade' ELSE 'industry' END] AS sectors, CASE WHEN id % 8 = 0 THEN ['Any Role'] ELSE professions END AS roles FROM candidates WHERE active),
  t AS (SELECT unnest([{{'d': 'gender', 'l': CASE WHEN gender IN ('female', 'male') THEN gender ELSE 'unknown' END}}, {{'d': 'age', 'l': {_AGE}}}, {{'d': 'platform', 'l': COALESCE(nullif(provider, ''), source, origin, 'unknown')}}, {{'d': 'location', 'l': COALESCE(nullif(city, ''), country, '__unknown__')}}]) AS x FROM f
    UNION ALL SELECT unnest(list_transform(sectors, lambda s: {{'d': 'sector', 'l': s}})) FROM f UNION ALL SELECT unnest(list_transform(list_filter(roles, lambda s: s <> 'Any Role'), lambda s: {{'d': 'profession', 'l': s}})) FROM f),
  c AS (SELECT x.d AS dimension, x.l AS label, count(*) AS n FROM t GROUP BY ALL), fixed(dimension, label) AS (VALUES {_FIXED}),
  m AS (SELECT {_YEARS} AS bucket, count(*) AS k, quantile_cont((lo + hi) / 2, 0.5) AS mid FROM f WHERE years IS NOT NULL AND lo IS NOT NULL GROUP BY ALL),
  r AS (SELECT unnest(list_filter(roles, lambda s: s <> 'Any Role')) AS label, least(lo, hi) AS a, greatest(lo, hi) AS b FROM f WHERE lo IS NOT NULL)
SELECT 'tag' AS section, CAST(NULL AS VARCHAR) AS deal, dimension, label, n, {_SIX} FROM (SELECT * FROM c UNION ALL SELECT dimension, label, 0 FROM fixed WHERE (dimension, label) NOT IN (SELECT dimension, label FROM c))
UNION ALL SELECT 'activity', NULL, NULL, strftime(activity_at, '%Y-%m-%d'), count(*), {_SIX} FROM f WHERE activity_at >= now - INTERVAL 60 DAYS AND activity_at <= now GROUP BY ALL
UNION ALL SELECT 'salary_by_experience', NULL, NULL, CAST(g AS VARCHAR), NULL, COALESCE(k, 0), {_e("mid")}, NULL, NULL, NULL FROM generate_series(0, 4) s(g) LEFT JOIN m ON g = bucket
UNION ALL SELECT 'salary_by_profession', NULL, NULL, label, count(*), NULL, NULL, NULL, {_e("min(a)")}, {_e("max(b)")} FROM r GROUP BY label"""
)
def candidate_snapshot(spark, sf_dir):
    """The whole candidate statistics from one written base."""
    k = F.col("id")
    rows = candidates(spark, sf_dir).where("active").withColumns({
        "provider": F.when(k % 5 == 2, "").when(k % 5 == 3, F.lit(None)).otherwise(F.concat(F.lit("board"), (k % 3).cast("string"))),
        "sectors": F.array(F.when(k % 2 == 0, "trade").otherwise("industry")), "professions": F.when(k % 8 == 0, F.array(F.lit("Any Role"))).otherwise(F.col("professions")),
    })
    return _figures(statistics.candidate_snapshot(rows, F.lit(NOW_DATE).cast("timestamp_ntz"), Scratch(spark)))
