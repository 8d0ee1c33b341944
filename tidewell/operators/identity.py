"""Identity of listings, roles and people: keys, clone relations, lineage, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.money import lookup
from tidewell.functions.text import jaccard, squeezed, words

#: Fixed values of the listing key: least lengths of phone, address, title, description, photo.
KEY_LENGTHS = {"phone": 9, "address": 8, "title": 8, "description": 120, "photo": 24, "photo_key": 129, "message": 40}
#: Fixed values of the clone score.
CLONE_POINTS = {"exact": 35, "perceptual": 30, "close_hash": 5, "facts": 10, "seller": 10, "price": 20, "later": 15}
LOCATION_POINTS = {"medium": 10, "high": 20, "very_high": 30}
PRICE_CONFLICT, PRICE_SIMILAR, CHRONOLOGY_MINUTES, COPY_SCORE = 15, 8, 15, 60
#: Mail providers that say nothing about a company.
FREE_MAIL = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "mail.ru", "yandex.ru", "icloud.com", "proton.me", "protonmail.com", "inbox.ru", "list.ru", "bk.ru", "ukr.net")
#: Fixed values of salaries: hours and months of a year, plausible bounds in USD.
HOURS, MONTHS = 2080, 12
MOST_MONTHLY, MOST_HOURLY, LEAST_HOURLY = 60_000, 500, 1
LEAST_ANNUAL, MOST_ANNUAL = 600, 2_000_000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def listing_key(columns: Sequence[str]) -> Column:
    """Duplicate key of a listing, by the first rule that applies: its cluster; phone, address
    and facts; title and description; photos or text within a source; else its own
    id. Columns that the table lacks count as missing."""
    have = set(columns)
    c = {
        n: _text(n) if n in have else F.lit("")
        for n in ("source", "country", "source_id", "city", "deal", "ptype", "price", "currency", "rooms", "floor", "cluster", "photo_key")
    }
    text = {n: squeezed(_text(n)) if n in have else F.lit("") for n in ("title", "description")}
    address = F.trim(F.regexp_replace(F.lower(_text("address")), r"[\s\p{Punct}]+", " ")) if "address" in have else F.lit("")
    phone = F.regexp_replace(_text("phone"), "[^0-9]+", "") if "phone" in have else F.lit("")
    area = F.coalesce(F.round(F.col("area").cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string"), F.lit("")) if "area" in have else F.lit("")
    photos = [
        F.lower(F.regexp_replace(F.substring_index(_text(n), "?", 1), ";s=.*$", "")) if n in have else F.lit("") for n in ("photo0", "photo1")
    ]
    source, country, currency = F.lower(c["source"]), F.upper(c["country"]), F.upper(c["currency"])
    where = [country, F.lower(c["city"]), c["deal"], c["ptype"]]
    content = [*where, c["price"], currency, c["rooms"], area, text["title"], text["description"]]
    n = KEY_LENGTHS

    def hashed(prefix: str, parts: list[Column]) -> Column:
        return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *parts)))

    by_phone = (F.length(phone) >= n["phone"]) & (F.length(address) >= n["address"]) & (c["rooms"] != "") & ((area != "") | (c["floor"] != ""))
    by_text = (F.length(text["title"]) >= n["title"]) & (F.length(text["description"]) >= n["description"])
    by_photos = (source == "olx") & (F.length(photos[0]) >= n["photo"]) & (F.length(photos[1]) >= n["photo"]) & (photos[0] != photos[1])
    telegram = source == "telegram"
    return (
        F.when(F.trim(c["cluster"]) != "", F.concat(F.lit("cluster:"), F.trim(c["cluster"])))
        .when(by_phone, hashed("cross:contact-address:", [*where, phone, address, c["rooms"], area, c["floor"]]))
        .when(by_text, hashed("cross:content:", content))
        .when(by_photos, hashed("olx:photos:", [country, *photos]))
        .when(telegram & (F.length(c["photo_key"]) >= n["photo_key"]), hashed("telegram:photos:", [country, c["photo_key"]]))
        .when(telegram & (F.length(text["description"]) >= n["message"]), hashed("telegram:content:", content))
        .otherwise(F.concat_ws(":", source, country, c["source_id"]))
    )


def candidate_key(contact: Column, origin: Column, source: Column, name: Column, rest: Column, text: Column, own_id: Column) -> Column:
    """Fingerprint of a candidate: contact, else a web profile's name and facts, else the
    first letters of the text, else its own id."""
    plain = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    letters = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", ""), "[^a-zа-яёіїґ0-9]+", ""), 1, 400)
    return (
        F.when(F.coalesce(contact, F.lit("")) != "", F.concat(F.lit("c:"), F.lower(contact)))
        .when((origin == "web") & (F.length(plain) >= 4), F.concat_ws(":", F.lit("p"), F.lower(source), plain, rest))
        .when(F.length(letters) >= 40, F.concat(F.lit("t:"), letters))
        .otherwise(F.concat_ws(":", F.lit("k"), source, own_id))
    )


def location_conflict(a: str, b: str, fields: Sequence[str] = ("country", "city", "district", "metro", "complex")) -> Column:
    """How far two listings' places contradict each other; blank fields contradict nothing."""

    def differs(name: str) -> Column:
        x, y = squeezed(F.col(f"{a}{name}")), squeezed(F.col(f"{b}{name}"))
        return F.coalesce((x != "") & (y != "") & (x != y), F.lit(False)) if name in fields else F.lit(False)

    return (
        F.when(differs("country") | differs("city"), "very_high")
        .when(differs("district") & differs("metro"), "high")
        .when(differs("district") | differs("metro"), "medium")
        .when(differs("complex"), "low")
        .otherwise("none")
    )


def clone_relation(pairs: DataFrame, a: str = "a_", b: str = "b_", exact: bool = True, bits: str | None = None, fields: Sequence[str] = ("country", "city")) -> DataFrame:
    """Pairs with chronology, seller relation, price change, agreement of facts, location
    conflict, score (0 to 100) and which side may be a copy.

    Needs created_at, by_agency, price, currency, rooms, area and title of both sides, and
    ``fields``; unknown values are evidence for nothing.
    """
    ca, cb = F.col(f"{a}created_at").cast("timestamp"), F.col(f"{b}created_at").cast("timestamp")
    gap = (F.unix_timestamp(ca) - F.unix_timestamp(cb)) / 60
    chronology = (
        F.when(gap.isNull(), "unknown").when(gap > CHRONOLOGY_MINUTES, "later").when(gap < -CHRONOLOGY_MINUTES, "earlier").otherwise("ambiguous")
    )
    sa, sb = F.col(f"{a}by_agency"), F.col(f"{b}by_agency")
    seller = F.when(sa.isNull() | sb.isNull(), "unknown").when(sa == sb, "same").when(sa, "owner_to_agency").otherwise("agency_to_owner")
    pa, pb = F.col(f"{a}price"), F.col(f"{b}price")
    comparable = (pa > 0) & (pb > 0) & (F.upper(F.col(f"{a}currency")) == F.upper(F.col(f"{b}currency")))
    delta = F.when(comparable, (pa - pb) / pb * 100)
    direction = F.when(delta.isNull(), "unknown").when(F.abs(delta) < PRICE_SIMILAR, "similar").when(delta > 0, "higher").otherwise("lower")
    rooms = F.col(f"{a}rooms") == F.col(f"{b}rooms")
    area = F.abs(F.col(f"{a}area") - F.col(f"{b}area")) <= F.greatest(F.lit(2.0), F.col(f"{b}area") * 0.05)
    title = jaccard(words(F.col(f"{a}title")), words(F.col(f"{b}title"))) >= 0.55
    facts = F.array_compact(F.array(rooms, area, title))
    agreeing = F.size(F.filter(facts, lambda x: x))
    consistent = (F.size(facts) > 0) & (agreeing >= F.ceil(F.size(facts) / 2))
    out = pairs.select(
        "*", chronology.alias("chronology"), seller.alias("seller"), delta.alias("delta"), direction.alias("direction"),
        consistent.alias("consistent"), location_conflict(a, b, fields).alias("location"),
    )
    p = CLONE_POINTS
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = F.lit(p["exact"] if exact else p["perceptual"])
    if not exact and bits:
        score = score + points(F.col(bits) <= 3, p["close_hash"])
    score = score + points(F.col("consistent"), p["facts"]) + points(F.col("seller").isin("owner_to_agency", "agency_to_owner"), p["seller"])
    score = score + points(F.abs("delta") >= PRICE_CONFLICT, p["price"]) + points(F.col("chronology") == "later", p["later"])
    score = score + lookup(F.col("location"), LOCATION_POINTS, F.lit(0))
    out = out.withColumn("score", F.least(F.lit(100), score))
    return out.withColumn("a_is_copy", (F.col("chronology") == "later") & (F.col("score") >= COPY_SCORE)).withColumn(
        "b_is_copy", (F.col("chronology") == "earlier") & (F.col("score") >= COPY_SCORE)
    )


def lineage(relations: DataFrame, same_source: Column, same_contact: Column) -> Column:
    """Relation of a pair from its clone relation: repost, cross_post, likely_derived,
    possible_original or undetermined."""
    conflict = F.coalesce(
        F.col("seller").isin("owner_to_agency", "agency_to_owner") | (F.abs("delta") >= PRICE_CONFLICT), F.lit(False)
    ) | F.col("location").isin("high", "very_high")
    mine = F.coalesce(same_contact, F.lit(False))
    supported = F.col("consistent") | (F.col("seller") == "agency_to_owner") | mine
    return (
        F.when(mine & ~conflict & same_source, "repost")
        .when(mine & ~conflict, "cross_post")
        .when(F.col("a_is_copy") & conflict, "likely_derived")
        .when(F.col("b_is_copy") & conflict & supported, "possible_original")
        .otherwise("undetermined")
    )


def disappeared(copied: Column, removed: Column, copy_active: Column, days: int = 7) -> Column:
    """Whether an original went within ``days`` after its copy came, which stayed."""
    soon = (removed >= copied) & (removed <= copied + F.expr(f"interval {days} days"))
    return F.coalesce(soon, F.lit(False)) & F.coalesce(copy_active, F.lit(True))


def provenance_findings(postings: DataFrame, cluster: str, now: str) -> DataFrame:
    """(cluster, reason, independent): what a cluster's postings say: permanent reposting (six
    or more), stale (over 180 days, not refreshed for 30), changed destination, three or
    more recruiters, contact domain that isn't the company's (free mail apart)."""
    at = F.lit(now).cast("timestamp_ntz")
    stale = F.col("active") & (F.col("posted_at") < at - F.expr("interval 180 days")) & ~F.coalesce(F.col("seen_at") > at - F.expr("interval 30 days"), F.lit(False))
    mail, own = F.lower(F.col("contact_domain")), F.lower(F.col("company_domain"))
    apart = (mail != own) & ~F.endswith(mail, F.concat(F.lit("."), own)) & ~F.endswith(own, F.concat(F.lit("."), mail)) & ~mail.isin(*FREE_MAIL)
    agg = postings.groupBy(cluster).agg(
        F.count("*").alias("n"), F.count_if(stale).alias("stale"), F.countDistinct("destination").alias("destinations"),
        F.countDistinct("recruiter").alias("recruiters"), F.count_if(apart).alias("apart"),
    )
    one = F.lit(1).cast("long")
    found = [
        F.when(F.col("n") >= 6, F.struct(F.lit("permanent_reposting").alias("reason"), F.col("n").alias("independent"))),
        F.when(F.col("stale") > 0, F.struct(F.lit("stale_job").alias("reason"), one.alias("independent"))),
        F.when(F.col("destinations") > 1, F.struct(F.lit("application_destination_changed").alias("reason"), F.col("destinations").alias("independent"))),
        F.when(F.col("recruiters") >= 3, F.struct(F.lit("recruiter_identity_rotation").alias("reason"), F.col("recruiters").alias("independent"))),
        F.when(F.col("apart") > 0, F.struct(F.lit("job_contact_domain_mismatch").alias("reason"), one.alias("independent"))),
    ]
    return agg.select(cluster, F.explode(F.array_compact(F.array(*found))).alias("f")).select(cluster, "f.reason", "f.independent")


def snapshot_hash(parts: Sequence[Column]) -> Column:
    """SHA-256 over the parts, nulls as empty, joined by an unprintable mark."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def first_known(options: Sequence[tuple[str, Column]]) -> Column:
    """(value, origin) of the first option in order of priority that isn't null."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("origin"))) for name, c in options])


def sticky(old: Column, new: Column, old_rank: Column, new_rank: Column) -> Column:
    """The old value, unless it is blank or the new one isn't and has a better (lower) rank."""
    blank = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    return F.when(blank(new), old).when(blank(old) | (new_rank < old_rank), new).otherwise(old)
