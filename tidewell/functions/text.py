"""Text: normal forms, tokens, redaction, contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that are redacted, in this order, and what stands for them.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"https?://[^ \t\n\r\f]+", "[URL]"),
    (r"@[A-Za-z][A-Za-z0-9_]{4,}", "[TELEGRAM]"),
    (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[PHONE]"),
)


def squeezed(text: Column) -> Column:
    """Lower case without blanks at the ends, others as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Array of the lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def redact(text: Column) -> Column:
    """E-mail addresses, URLs, handles and phone-like numbers replaced by their kind."""
    for pattern, kind in REDACTIONS:
        text = F.regexp_replace(text, pattern, kind)
    return text


def near(text: Column, first: str, second: str, gap: int) -> Column:
    """Whether two patterns stand within ``gap`` characters of one another, either way."""
    return text.rlike(f"(?is)({first}).{{0,{gap}}}({second})|({second}).{{0,{gap}}}({first})")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common entries of two arrays; null if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)


def transliterated(text: Column) -> Column:
    """Cyrillic letters of Russian and Ukrainian in Latin, one for one or two."""
    one = ("абвгґдезиійклмнопрстуфіїєё", "abvggdeziijklmnoprstufiiee")
    two = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ы": "y", "э": "e"}
    out = F.translate(F.lower(text), one[0] + "ьъ", one[1])
    for a, b in two.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
