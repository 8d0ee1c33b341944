"""Sources: pages, feeds, registries, JSON payloads, resumable crawls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = r"(?s)<item>(.*?)</item>"


def json_recordset(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows with a fixed schema; other fields are dropped."""
    return rows.select(F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))


def typed_field(payload: Column, name: str, kind: str) -> Column:
    """A field of a JSON payload, null where it hasn't the type asked for."""
    return F.try_variant_get(F.try_parse_json(payload), f"$.{name}", kind)


def rss_items(html: Column) -> Column:
    """Array of (title, link) of a feed's items."""

    def tag(text: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?s)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1), F.lit(""))

    items = F.regexp_extract_all(html, F.lit(_ITEM), F.lit(1))
    return F.transform(items, lambda x: F.struct(tag(x, "title").alias("title"), tag(x, "link").alias("link")))


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD blocks of a page."""
    return F.regexp_extract_all(html, F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def split_message(text: Column, separator: str = r"\n\s*-{3,}\s*\n") -> Column:
    """A message as an array of the postings in it."""
    return F.filter(F.split(text, separator), lambda x: F.trim(x) != "")


def registry_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV with quotes and any of several header names for each column; absent ones are null."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    out = []
    for name, others in aliases.items():
        found = next((by_name[a.lower()] for a in [name, *others] if a.lower() in by_name), None)
        out.append((F.trim(F.col(f"`{found}`")) if found else F.lit(None).cast("string")).alias(name))
    return raw.select(*out)


def crawl_pages(fetch: Callable[[int], list[tuple]], first: int = 0, most: int = 1000) -> Iterator[tuple[int, list[tuple]]]:
    """Pages from ``first`` on until one is empty or repeats what came before; (page, items).
    A crawl that would go on after ``most`` pages is an error, so none ends early unnoticed."""
    seen: set = set()
    for page in count(first):
        items = fetch(page)
        mark = tuple(i[0] for i in items)
        if not items or mark in seen:
            return
        if page - first >= most:
            raise RuntimeError(f"more than {most} pages")
        seen.add(mark)
        yield page, items
