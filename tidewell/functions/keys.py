"""Keys: hashes, Hamming distance, identity keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import squeezed

#: Legal forms that a company's name is told without, and what a title is told without.
LEGAL_FORMS = ("llc", "ltd", "inc", "gmbh", "corp", "corporation", "co", "plc", "ag", "sa", "srl", "oy", "ab", "as", "llp", "ооо", "зао", "оао", "пао", "тоо", "мчж")
RANKS = (
    "senior", "junior", "middle", "lead", "principal", "staff", "intern", "trainee", "remote", "hybrid", "onsite", r"full[-\s]?time", r"part[-\s]?time", "contract",
    r"стаж\p{L}*", r"удал[её]нн\p{L}*",
)


def without_words(text: Column, patterns: tuple[str, ...], kept: str = "") -> Column:
    """Lower-case words of letters, digits and ``kept``, one space between them, without whole words of a pattern."""
    whole = r"(?<![\p{L}\p{N}])(" + "|".join(patterns) + r")(?![\p{L}\p{N}])"
    bare = F.regexp_replace(F.lower(text), whole, " ") if patterns else F.lower(text)
    return F.trim(F.regexp_replace(bare, rf"[^\p{{L}}\p{{N}}{kept}]+", " "))


def role_key(country: Column, company: Column, title: Column, locality: Column) -> Column:
    """SHA-256 over the country in capitals, the company without its legal form, the title without rank, terms and what stands in
    brackets, and the locality; null where nothing is left of company or title."""
    name, role = without_words(company, LEGAL_FORMS), without_words(F.regexp_replace(title, r"\([^)]*\)", " "), RANKS, "+#")
    parts = [F.upper(F.coalesce(country, F.lit(""))), name, role, without_words(F.coalesce(locality, F.lit("")), ())]
    return F.when((name != "") & (role != ""), F.sha2(F.concat_ws("\0", *parts), 256))


def half(hex64: Column, low: bool) -> Column:
    """One half of 16 hex digits as a whole number below 2^32."""
    return F.conv(F.substring(hex64, 9 if low else 1, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes of 16 hex digits."""
    return F.bit_count(half(a, False).bitwiseXOR(half(b, False))) + F.bit_count(half(a, True).bitwiseXOR(half(b, True)))


def content_key(text: Column) -> Column:
    """MD5 of the squeezed text."""
    return F.md5(squeezed(text))


def cursor_scope(filters: dict) -> str:
    """Hash of a request's filters: a cursor counts only for the same ones."""
    return hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fnv1a_bucket(key: Column | str) -> Column:
    """FNV-1a (64 bits) of UTF-8, modulo 100: a stable split. The hash goes in two halves of 32
    bits; its prime is 2^40 + 435."""
    digits = F.hex(F.encode(F.col(key) if isinstance(key, str) else key, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    halves = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, at: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("long"))
        product = low * 435
        high = h["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    bucket = F.aggregate(places, halves, step, lambda h: (h["high"] * (2**32 % 100) + h["low"]) % 100)
    return F.when(digits.isNotNull(), bucket)
