"""Text search, extraction, redaction and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import geo
from tidewell.functions.keys import fnv1a_bucket
from tidewell.functions.text import REDACTIONS, redact, words
from tidewell.operators import payments
from tidewell.operators.scores import search_scores
from tidewell.plans.registry import query
from tidewell.session import load

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w, {_WORDS.format("source || ' ' || lang")} AS s FROM documents),
    x AS (SELECT doc_id, greatest(CASE WHEN list_contains(s, 'the') THEN 5.0 ELSE 0 END, CASE WHEN list_contains(w, 'the') THEN 2.0 ELSE 0 END)::DOUBLE AS a, greatest(CASE WHEN list_contains(s, 'en') THEN 5.0 ELSE 0 END, CASE WHEN list_contains(w, 'en') THEN 2.0 ELSE 0 END)::DOUBLE AS b FROM d)
    SELECT doc_id, CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) AS matched, a + b AS score FROM x WHERE a > 0 AND b > 0"""
)
def text_search_rank(spark, sf_dir):
    """Boosted search of two words over two fields: every word must match a field."""
    docs = load(spark, sf_dir, "documents")
    fields = {"title": (words(F.concat_ws(" ", "source", "lang")), 5.0), "body": (words(F.col("text")), 2.0)}
    return search_scores(docs, "doc_id", fields, ["the", "en"])


@query(f"SELECT b.item_id, d.doc_id FROM (SELECT item_id, list_distinct({_WORDS.format('text')}) AS q FROM benchmark) b JOIN (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) d ON list_has_all(d.w, b.q)")
def fulltext_all_terms(spark, sf_dir):
    """Documents that hold all distinct words of an item. They meet over the item's rarest word alone; then the row's
    own words are compared with the item's, so a common word brings nobody together."""
    items = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(words(F.col("text"))).alias("q"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(words(F.col("text"))).alias("w"))
    index = docs.select("doc_id", F.explode("w").alias("t"))
    counts = index.groupBy("t").agg(F.count("*").alias("n"))
    asked = items.select("item_id", F.explode("q").alias("t")).join(counts, "t", "left")
    rarest = asked.groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("r")).where("r.n > 0")
    met = index.join(rarest.select("item_id", F.col("r.t").alias("t")), "t").select("item_id", "doc_id")
    return met.join(items, "item_id").join(docs, "doc_id").where(F.size(F.array_except("q", "w")) == 0).select("item_id", "doc_id")


@query(f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 20")
def token_counts_top20(spark, sf_dir):
    """The twenty commonest words; the limit is the report."""
    counts = load(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(20)


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
    len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"""
)
def page_extract(spark, sf_dir):
    """Title, language, number of links and host of every page."""
    return load(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
    )


#: Sentences put behind the texts, so that the rules meet all kinds of phrase, near and far apart.
_SAID = (
    "Send the deposit before the viewing, please.", "A deposit is due at signing.", "Urgent! Many people ask. Transfer today.", "Please send a photo of your ID first.",
    "Bring your passport to the notary.", "What is the CVV and the sms code?", "There is a credit check at https://example.org/check first.", "An application fee of 10 applies.",
    "Предоплата до просмотра, срочно.", "Deposit. " + "The rooms are bright and quiet and the yard is green in spring. " * 3 + "Before viewing call us.",
)
_TEXT = "text || ' ' || CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_SAID)) + " ELSE '' END"


def _payment_sql() -> str:
    edge = "[^\\p{L}\\p{N}]"

    def found(name: str, whole: bool = False) -> str:
        return f"(?i)(^|{edge})({'|'.join(payments.PHRASES[name])})" + (f"($|{edge})" if whole else "")

    def near(name: str) -> str:
        return f"regexp_matches(around, '{found(name)}')"

    ctes, parts = [f"WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents)"], []
    for i, (reason, anchor, contexts, whole) in enumerate(payments.RULES):
        own = found(anchor, whole)
        # A hit may start with the character before it; a whole word's last one is shared with what follows, so both are looked at.
        ctes.append(f"""g{i} AS (SELECT doc_id, t, regexp_split_to_array(t, '{own}') AS gaps, regexp_extract_all(t, '{own}') AS hits FROM d),
  e{i} AS (SELECT doc_id, t, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM g{i}),
  a{i} AS (SELECT doc_id, t, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS raw FROM e{i}),
  p{i} AS (SELECT doc_id, t, raw + CASE WHEN regexp_matches(hit, '^{edge}') THEN 1 ELSE 0 END AS start, raw + length(hit) - CASE WHEN {str(whole).lower()} AND regexp_matches(hit, '{edge}$') THEN 1 ELSE 0 END AS stop FROM a{i}),
  w{i} AS (SELECT doc_id, start, substr(t, greatest(0, start - 90) + 1, stop + 90 - greatest(0, start - 90)) AS around FROM p{i})""")
        test = " OR ".join(near(c) if c != "link" else "regexp_matches(around, '(?i)https?://|(^|[^\\p{L}\\p{N}])www\\.')" for c in contexts) or "true"
        parts.append(f"SELECT doc_id, '{reason}' AS reason, start, {i} AS place FROM w{i} WHERE {test}")
    return ", ".join(ctes) + " SELECT doc_id, reason, arg_min(start, (place, start)) AS at FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id, reason"


@query(_payment_sql())
def payment_signals(spark, sf_dir):
    """Payment findings of every text: what was found first and where; phrases in four languages."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr(_TEXT).alias("said"))
    return payments.findings(docs, "said").select("doc_id", "reason", "at")


def _redacted(sql: str) -> str:
    for pattern, kind in REDACTIONS:
        sql = f"regexp_replace({sql}, '{pattern}', '{kind}', 'g')"
    return sql


@query(f"SELECT doc_id, md5({_redacted('text')}) AS redacted_md5, {_redacted('text')} <> text AS touched FROM documents")
def pii_redact(spark, sf_dir):
    """Addresses, links, handles and numbers replaced by their kind."""
    docs = load(spark, sf_dir, "documents").withColumn("clean", redact(F.col("text")))
    return docs.select("doc_id", F.md5("clean").alias("redacted_md5"), (F.col("clean") != F.col("text")).alias("touched"))


@query(
    """WITH b AS (SELECT doc_id, list_transform(range(1, 2 * octet_length(encode(CAST(doc_id AS VARCHAR))), 2), lambda i: CAST('0x' || substr(hex(encode(CAST(doc_id AS VARCHAR))), CAST(i AS INTEGER), 2) AS HUGEINT)) AS bytes FROM documents),
    h AS (SELECT doc_id, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: (h - h % 256 + CAST(xor(CAST(h % 256 AS BIGINT), CAST(x AS BIGINT)) AS HUGEINT)) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT) % 100 AS BIGINT) AS bucket FROM b)
    SELECT doc_id, bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'validation' ELSE 'test' END AS split FROM h"""
)
def stable_split(spark, sf_dir):
    """Train, validation and test by FNV-1a of the id."""
    bucket = fnv1a_bucket(F.col("doc_id").cast("string"))
    docs = load(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket"))
    split = F.when(F.col("bucket") < 80, "train").when(F.col("bucket") < 90, "validation").otherwise("test")
    return docs.withColumn("split", split)


def points(spark, sf_dir):
    """The first two components of each embedding as a point around (46.4, 30.7)."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("point"),
        (46.4 + F.col("embedding")[0].cast("double") * 0.5).alias("lat"),
        (30.7 + F.col("embedding")[1].cast("double") * 0.5).alias("lng"),
        F.col("label").cast("string").alias("kind"),
    )


POINTS = "WITH p AS (SELECT vec_id AS point, 46.4::DOUBLE + embedding[1]::DOUBLE * 0.5::DOUBLE AS lat, 30.7::DOUBLE + embedding[2]::DOUBLE * 0.5::DOUBLE AS lng, CAST(label AS VARCHAR) AS kind FROM embeddings)\n"
_COS = "6371000.0::DOUBLE * acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(46.4::DOUBLE)) + cos(radians(lat)) * cos(radians(46.4::DOUBLE)) * cos(radians(lng) - radians(30.7::DOUBLE)))))"


@query(POINTS + f"SELECT point, CAST(CAST({_COS} AS DECIMAL(20,2)) AS DOUBLE) AS metres FROM p WHERE {_COS} <= 8000")
def radius_filter(spark, sf_dir):
    """Points within eight kilometres: the exact box first, then the distance."""
    rows = points(spark, sf_dir).where(geo.within(F.col("lat"), F.col("lng"), 46.4, 30.7, 8000))
    d = geo.cosine_distance(F.col("lat"), F.col("lng"), 46.4, 30.7)
    return rows.select("point", d.cast("decimal(20,2)").cast("double").alias("metres"))


_RING = [(46.35, 30.6), (46.35, 30.8), (46.45, 30.85), (46.5, 30.7), (46.42, 30.58)]


def _ring_sql(ring) -> str:
    parts = []
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            parts.append(f"CASE WHEN ({y1}::DOUBLE > lat) <> ({y2}::DOUBLE > lat) AND lng < {(x2 - x1) / (y2 - y1)!r}::DOUBLE * (lat - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


_HOLE = [(46.38, 30.68), (46.38, 30.72), (46.42, 30.72), (46.42, 30.68)]


@query(POINTS + f"SELECT point FROM p WHERE {_ring_sql(_RING)} AND NOT {_ring_sql(_HOLE)}")
def point_in_polygon(spark, sf_dir):
    """Points in a polygon with a hole."""
    return points(spark, sf_dir).where(geo.in_polygon(F.col("lat"), F.col("lng"), [_RING, _HOLE])).select("point")


_HAV = "2 * 6371000.0::DOUBLE * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2))))"


@query(
    POINTS
    + f"""SELECT point, kind, place, CAST(rn AS INTEGER) AS place_rank FROM (SELECT a.point, b.kind, b.point AS place, {_HAV} AS d, row_number() OVER (PARTITION BY a.point, b.kind ORDER BY {_HAV}, b.point) AS rn
    FROM p a JOIN p b ON a.point <> b.point AND {_HAV} <= 4000) WHERE rn <= 3"""
)
def nearest_k_per_kind(spark, sf_dir):
    """The three nearest places of each kind within four kilometres: points and places meet in the cells of grids, the finest first."""
    from tidewell.operators.scores import nearest_per_kind

    out = nearest_per_kind(points(spark, sf_dir), 3, 4000.0)
    return out.select("point", "kind", "place", F.col("rn").alias("place_rank"))


@query(POINTS + "SELECT kind, count(*) AS total, count(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN 30.7 AND 180) AS located FROM p GROUP BY kind")
def map_points(spark, sf_dir):
    """Totals and located points by kind."""
    located = F.col("lat").between(-90, 90) & F.col("lng").between(30.7, 180)
    return points(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(located).alias("located"))


@query(f"SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(len({_WORDS.format('text')}))::BIGINT AS words FROM conversations GROUP BY conv_id")
def message_threads(spark, sf_dir):
    """Messages put together by thread, in order."""
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"),
        F.sum(F.size(words(F.col("text")))).alias("words"),
    )
