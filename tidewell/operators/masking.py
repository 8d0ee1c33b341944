"""Contacts masked by numbered placeholders, and put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The placeholder, with what a translator may do to it, and the contacts that are masked, in this order.
PLACEHOLDER = r"\[\s*\[\s*(\d{1,4})\s*\]\s*\]"
CONTACTS = (
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"(?i)(?:https?://|www\.)\S+",
    r"(?<![\p{L}\p{N}_])@[A-Za-z][A-Za-z0-9_]{3,31}\b",
    r"(?<![A-Za-z0-9_])(?:\+?\d[\d\s().-]{7,}\d)(?![A-Za-z0-9_])",
)


def _woven(gaps: Column, between: Column) -> Column:
    """gap, between, gap, ..., gap."""
    n = F.size(between)
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, n), between, lambda g, b: F.concat(g, b)), ""), F.element_at(gaps, n + 1))


def mask(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``masked``, the text with [[1]], [[2]], ... in place of contacts, and ``contacts``, what they stand for, in the order of the
    patterns and then of the text. A placeholder that the text itself holds is masked first, like a contact, so ``restored`` gives back any
    text. More than 9,999 of them stay as they are in the text. Null is an empty text."""
    kept = rows.columns
    none = F.array().cast("array<string>")
    out = rows.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("masked"), none.alias("contacts"))
    for pattern in (PLACEHOLDER, *CONTACTS):
        out = out.select(*kept, "contacts", F.split("masked", pattern, -1).alias("gaps"), F.regexp_extract_all("masked", F.lit(pattern), F.lit(0)).alias("hits"), F.size("contacts").alias("n"))
        marks = F.transform("hits", lambda h, i: F.when(F.col("n") + i < 9999, F.concat(F.lit("[["), (F.col("n") + i + 1).cast("string"), F.lit("]]"))).otherwise(h))
        out = out.select(*kept, _woven(F.col("gaps"), marks).alias("masked"), F.concat("contacts", F.slice("hits", 1, F.greatest(F.lit(0), F.least(F.size("hits"), 9999 - F.col("n"))))).alias("contacts"))
    return out


def restored(rows: DataFrame, text: str, contacts: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the contacts in place of their placeholders in ``text``. Placeholders of unknown numbers stay; contacts whose placeholder
    is lost are appended, a line each."""
    kept = rows.columns
    made = rows.select(*kept, F.split(text, PLACEHOLDER, -1).alias("gaps_"), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)).alias("hits_"))
    numbers = F.transform("hits_", lambda h: F.regexp_replace(h, "[^0-9]", "").cast("int"))
    made = made.select(*kept, "gaps_", "hits_", numbers.alias("numbers_"))
    size = F.size(contacts)
    back = F.zip_with("hits_", "numbers_", lambda h, k: F.when(k.between(1, size), F.get(F.col(contacts), k - 1)).otherwise(h))
    lost = F.filter(contacts, lambda v, i: ~F.array_contains(F.col("numbers_"), i + 1))
    tail = F.when(F.size(lost) > 0, F.concat(F.lit("\n"), F.array_join(lost, "\n"))).otherwise("")
    return made.select(*kept, F.concat(_woven(F.col("gaps_"), back), tail).alias(out))
