"""Masked contacts, a listing's own price, places from distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import masking, place, prices
from tidewell.plans.registry import query
from tidewell.plans.tables import LISTINGS, listings
from tidewell.plans.texts import POINTS, points
from tidewell.session import load

_PATTERNS = (
    r"()(\[\s*\[\s*\d{1,4}\s*\]\s*\])()", r"(?i)()\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b()", r"(?i)()((?:https?://|www\.)\S+)()", r"(^|[^\p{L}\p{N}_])(@[A-Za-z][A-Za-z0-9_]{3,31})\b()",
    r"(^|[^A-Za-z0-9_])(\+?\d[\d\s().-]{7,}\d)($|[^A-Za-z0-9_])",
)
_MARKED = "CASE WHEN doc_id % 9 = 4 THEN text || ' [[1]] @seller_{0} [ [7] ] www.example.org/a' ELSE text END"


@query(
    # Placeholders of the text come first: they are set apart by a mark of their own before numbers are given.
    "WITH RECURSIVE d AS (SELECT doc_id, " + _MARKED.format("' || CAST(doc_id AS VARCHAR) || '") + """ AS t FROM documents), w(doc_id, k, n, t) AS (SELECT doc_id, 1, 0, regexp_replace(t, '\\[\\s*\\[\\s*\\d{1,4}\\s*\\]\\s*\\]', chr(1), 'g') FROM d
    UNION ALL SELECT doc_id, CASE WHEN hit THEN k ELSE k + 1 END, CASE WHEN hit THEN n + 1 ELSE n END, CASE WHEN hit THEN regexp_replace(t, p, '\\1[[' || CAST(n + 1 AS VARCHAR) || ']]\\3') ELSE t END
      FROM (SELECT *, regexp_matches(t, p) AS hit FROM (SELECT *, ["""
    + ", ".join(["'()(' || chr(1) || ')()'", *[f"'{p}'" for p in _PATTERNS[1:]]])
    + """][k] AS p FROM w WHERE k <= 5)))
    SELECT doc_id, max(n) AS contacts, md5(arg_max(t, k)) AS masked_md5, true AS round_trip FROM w GROUP BY doc_id"""
)
def masked_contacts(spark, sf_dir):
    """Every text with its contacts masked, and whether restoring gives it back; some texts hold placeholders of their own."""
    text = F.when(F.col("doc_id") % 9 == 4, F.concat("text", F.lit(" [[1]] @seller_"), F.col("doc_id").cast("string"), F.lit(" [ [7] ] www.example.org/a"))).otherwise(F.col("text"))
    docs = load(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    back = masking.restored(masking.mask(docs, "text"), "masked", "contacts", "again")
    return back.select("doc_id", F.size("contacts").alias("contacts"), F.md5("masked").alias("masked_md5"), (F.col("again") == F.col("text")).alias("round_trip"))


_WHOLE = "CAST(floor(COALESCE(price, 900)) AS BIGINT)"
# Thousands in groups, in thousands, or plain.
_AMOUNT = f"CASE id % 3 WHEN 0 THEN CASE WHEN w >= 1000 THEN CAST(w // 1000 AS VARCHAR) || ' ' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END WHEN 1 THEN CAST(w // 1000 + 1 AS VARCHAR) || ' тис' ELSE CAST(w AS VARCHAR) END"
_HEAD = "CASE id % 4 WHEN 0 THEN 'Deposit 500 USD, rooms ' || CAST(COALESCE(rooms, 0) AS VARCHAR) || '. Price: ' WHEN 1 THEN 'In ' || city || ' for ' WHEN 2 THEN 'Комиссия 30 000 грн; паркинг $90. Аренда ' ELSE 'Floor 12, area 54.5. ' END"
_TAIL = "CASE id % 4 WHEN 0 THEN ' USD per month, parking 70 EUR' WHEN 1 THEN ' $. Залог 1 200 $' WHEN 2 THEN ' грн в месяц' ELSE ' sq. No price here, call 100 times.' END"


@query(
    LISTINGS
    + f""", a AS (SELECT id, rooms, city, {_WHOLE} AS w, {_HEAD} AS head, {_TAIL} AS tail FROM listings), m AS (SELECT *, {_AMOUNT} AS amount FROM a)
    SELECT id, CASE WHEN id % 4 < 3 THEN length(head) END AS start, CASE WHEN id % 4 < 3 THEN amount END AS piece, CASE WHEN id % 4 < 3 THEN CASE WHEN id % 3 = 1 THEN (w // 1000 + 1) * 1000.0 ELSE CAST(w AS DOUBLE) END END AS amount,
      CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS score FROM m"""
)
def own_prices(spark, sf_dir):
    """The listing's own price in a text that names other amounts; the twin knows how the text is made."""
    rows = listings(spark, sf_dir).select("id", "rooms", "city", F.floor(F.coalesce("price", F.lit(900.0))).cast("long").alias("w"))
    sql = lambda s: F.expr(s.replace("//", "div").replace("VARCHAR", "STRING"))
    text = F.concat(sql(_HEAD), sql(_AMOUNT), sql(_TAIL))
    found = prices.own_price(rows.select("id", text.alias("text")), "text")
    return found.select("id", F.col("price.start").alias("start"), F.col("price.piece").alias("piece"), F.col("price.amount").alias("amount"), F.col("price.score").alias("score"))


_R = "6371000.0::DOUBLE"


@query(
    POINTS
    + f""", a AS (SELECT point, lat, lng, unnest([1, 2, 3]) AS k FROM p), o AS (SELECT a.point, a.k, b.lat, b.lng,
      (2 * {_R} * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))) * (1 + (a.point % 5) * 0.01::DOUBLE) AS d
      FROM a JOIN p b ON b.point = a.point + a.k * 7), u AS (SELECT * FROM o WHERE d > 0), c AS (SELECT point, sum(lat) / count(*) AS lat0, sum(lng) / count(*) AS lng0, count(*) AS n FROM u GROUP BY point HAVING count(*) >= 2),
    l AS (SELECT u.point, k, radians(lng - lng0) * {_R} * cos(radians(lat0)) AS x, radians(lat - lat0) * {_R} AS y, d FROM u JOIN c USING (point)),
    q AS (SELECT i.point, i.k * 10 + j.k AS ord, i.x AS ax, i.y AS ay, i.d AS ad, j.x AS bx, j.y AS by_, j.d AS bd, sqrt((j.x - i.x) * (j.x - i.x) + (j.y - i.y) * (j.y - i.y)) AS dd FROM l i JOIN l j ON i.point = j.point AND i.k < j.k),
    v AS (SELECT *, (bx - ax) / dd AS ux, (by_ - ay) / dd AS uy, (ad * ad - bd * bd + dd * dd) / (2 * dd) AS al FROM q WHERE dd >= 0.001), z AS (SELECT *, ax + al * ux AS mx, ay + al * uy AS my, ad * ad - al * al AS h2 FROM v),
    cand AS (SELECT point, ord * 10 AS ord, mx - uy * sqrt(h2) AS x, my + ux * sqrt(h2) AS y FROM z WHERE h2 >= 0 UNION ALL SELECT point, ord * 10 + 1, mx + uy * sqrt(h2), my - ux * sqrt(h2) FROM z WHERE h2 >= 0
      UNION ALL SELECT point, ord * 10, (ax + ux * ad + bx - ux * bd) / 2, (ay + uy * ad + by_ - uy * bd) / 2 FROM z WHERE h2 < 0 UNION ALL SELECT point, 9999, sum(x / d) / sum(1 / d), sum(y / d) / sum(1 / d) FROM l GROUP BY point),
    s AS (SELECT cand.point, ord, cand.x, cand.y, sqrt(sum(pow(sqrt((cand.x - l.x) * (cand.x - l.x) + (cand.y - l.y) * (cand.y - l.y)) - d, 2)) / count(*)) AS err FROM cand JOIN l USING (point) GROUP BY ALL),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY point ORDER BY floor(err * 1e4 + 0.5), ord) = 1)
    SELECT point, CAST(n AS INTEGER) AS anchors, floor(err * 100 + 0.5) / 100 AS residual_m FROM b JOIN c USING (point)"""
)
def places_from_distances(spark, sf_dir):
    """Points found again from their distances to three others, some of them measured too long: how well the best candidate fits, to a centimetre."""
    from tidewell.functions.geo import haversine

    p = points(spark, sf_dir).select("point", "lat", "lng")
    asked = p.select("point", "lat", "lng", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).withColumn("to", F.col("point") + F.col("k") * 7)
    others = p.select(F.col("point").alias("to"), F.col("lat").alias("y"), F.col("lng").alias("x"))
    d = haversine(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")) * (1 + (F.col("point") % 5) * 0.01)
    anchors = asked.join(others, "to").groupBy("point").agg(F.array_sort(F.collect_list(F.struct("k", F.col("y").alias("lat"), F.col("x").alias("lng"), d.alias("d")))).alias("a"))
    found = anchors.select("point", place.located(F.col("a")).alias("f")).where("f IS NOT NULL")
    return found.select("point", F.col("f.anchors").alias("anchors"), (F.floor(F.col("f.residual_m") * 100 + 0.5) / 100).alias("residual_m"))
