"""Ranked search over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.text import words
from tidewell.operators import search
from tidewell.plans.registry import query
from tidewell.session import Scratch, load

_W = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
FIELDS = {"title": (10.0, False), "source": (6.0, True), "description": (1.0, False)}


def index(spark, sf_dir, scratch):
    """The first line as title, the source as a name that takes no typos, and the whole text."""
    docs = load(spark, sf_dir, "documents")
    texts = {"title": F.substring_index("text", "\n", 1), "source": F.concat_ws(" ", "source", "lang"), "description": F.col("text")}
    return search.build(docs, "doc_id", {n: search.Field(words(texts[n]), *FIELDS[n]) for n in FIELDS}, scratch)


def asked(spark, sf_dir):
    """Three queries an item: its text, its text with a letter missing from each longer word, and its first two words."""
    items = load(spark, sf_dir, "benchmark")
    w = words(F.col("text"))
    typos = F.transform(w, lambda x: F.when(F.length(x) >= 7, F.concat(F.substring(x, 1, 3), F.substr(x, F.lit(5)))).otherwise(x))
    texts = F.array(F.col("text"), F.array_join(typos, " "), F.array_join(F.slice(w, 1, 2), " "))
    return items.select("item_id", F.posexplode(texts).alias("k", "text")).select((F.col("item_id") * 3 + F.col("k")).alias("query"), "text")


# DuckDB compares bytes: letters beyond ASCII become capitals, which lower-case words don't have.
_EDITS = "levenshtein(translate(token, 'ßäçèéêíñóöü', 'ABCDEFGHIJK'), translate(term, 'ßäçèéêíñóöü', 'ABCDEFGHIJK'))"


def _sql(need: str) -> str:
    boosts = " ".join(f"WHEN '{n}' THEN {b}" for n, (b, _) in FIELDS.items())
    return f"""WITH d AS (SELECT doc_id AS id, unnest([{{'f': 'title', 'w': {_W.format("split_part(text, chr(10), 1)")}}}, {{'f': 'source', 'w': {_W.format("source || ' ' || lang")}}}, {{'f': 'description', 'w': {_W.format("text")}}}]) AS x FROM documents),
  p AS (SELECT id, x.f AS field, len(x.w) AS dl, unnest(x.w) AS term FROM d), post AS (SELECT term, field, id, dl, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, field, count(*) AS fdf FROM post GROUP BY ALL),
  av AS (SELECT x.f AS field, avg(len(x.w)) AS avgdl FROM d GROUP BY ALL), qs AS (SELECT item_id, {_W.format("text")} AS w FROM benchmark),
  q AS (SELECT item_id * 3 AS query, w FROM qs UNION ALL SELECT item_id * 3 + 1, list_transform(w, lambda v: CASE WHEN length(v) >= 7 THEN substr(v, 1, 3) || substr(v, 5) ELSE v END) FROM qs UNION ALL SELECT item_id * 3 + 2, w[1:2] FROM qs),
  place AS (SELECT query, w, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM q), firsts AS (SELECT query, token, min(i) AS i FROM place GROUP BY ALL),
  tok AS (SELECT query, token FROM firsts QUALIFY row_number() OVER (PARTITION BY query ORDER BY i) <= 16), needs AS (SELECT query, count(*) AS need FROM tok GROUP BY ALL),
  voc AS (SELECT DISTINCT term FROM post), t1 AS (SELECT DISTINCT token FROM tok),
  ex AS (SELECT token, term, {_EDITS} AS edits FROM t1 JOIN voc ON token = term OR (length(token) >= 6 AND length(term) >= 4 AND abs(length(token) - length(term)) <= 2 AND token[1] = term[1] AND {_EDITS} <= 2)),
  m AS (SELECT query, id, token, post.field AS field, edits, CASE post.field {boosts} END * (1 - edits / least(length(token), length(ex.term))) * ln(1 + ((SELECT count(*) FROM documents) - fdf + 0.5) / (fdf + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS worth
    FROM tok JOIN ex USING (token) JOIN post ON post.term = ex.term JOIN df ON df.term = post.term AND df.field = post.field JOIN av ON av.field = post.field WHERE edits = 0 OR post.field <> 'source'),
  wd AS (SELECT query, id, token, max(worth) AS best FROM m GROUP BY ALL), s AS (SELECT query, id, count(*) AS n, sum(best) AS total FROM wd GROUP BY ALL),
  fl AS (SELECT query, id, field, count(*) AS n, sum(worth) AS total FROM m WHERE edits = 0 GROUP BY ALL), b AS (SELECT query, id, max(total) AS bonus FROM fl JOIN needs USING (query) WHERE n = need GROUP BY ALL),
  r AS (SELECT query, id, floor((total + 3 * COALESCE(bonus, 0)) * 10000 + 0.5) / 10000 AS score FROM s JOIN needs USING (query) LEFT JOIN b USING (query, id) WHERE n >= {need})
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM r QUALIFY rank <= 50000"""


@query(_sql("need"))
def search_ranked(spark, sf_dir):
    """Documents with all words of each query, typos allowed, by score."""
    scratch = Scratch(spark)
    return search.rank(index(spark, sf_dir, scratch), asked(spark, sf_dir), scratch)


@query(_sql("ceil(need * 0.7)"))
def search_most_words(spark, sf_dir):
    """Documents with at least seven tenths of each query's words."""
    scratch = Scratch(spark)
    return search.rank(index(spark, sf_dir, scratch), asked(spark, sf_dir), scratch, share=0.7)
