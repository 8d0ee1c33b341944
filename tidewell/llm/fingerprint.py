"""Document fingerprints from prefix polynomial hashes.

A text's code points c0, c1, ... give two modular prefix arrays,
P[i] = sum of (c_k + 1) * base^k over k < i, modulo the Mersenne prime 2^31 - 1. They answer
whether two spans are equal in constant time and locate the longest common extension of
two positions by binary search. The fingerprint holds the length, the hash of the whole
text and two sketches of the hashes of all its windows, so that two fingerprints tell how
much their texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
BASES = (1_000_003, 2_147_000_123)
#: Window lengths and slots of the sketches: wide for all texts of at least SHORT code points.
WIDE, WIDE_SLOTS = 16, 64
NARROW, NARROW_SLOTS = 4, 32
SHORT = 64
EMPTY_SLOT = ".."


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^62, by folding."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class Powers:
    """Powers of a base and of its inverse, grown by doubling to the longest text met."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, PRIME)))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, PRIME)))])


POWERS = tuple(Powers(b) for b in BASES)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.n = len(codes)
        self.prefix = []
        for p in POWERS:
            p.reach(self.n + 1)
            sums = np.cumsum(_mod((codes + np.uint64(1)) * p.up[: self.n]))
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), _mod(sums)]))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash pair of text[i:j], the same wherever equal spans stand."""
        return tuple(
            (int(a[j]) - int(a[i])) * int(p.down[i]) % PRIME for a, p in zip(self.prefix, POWERS, strict=True)
        )

    def windows(self, length: int) -> np.ndarray:
        """62-bit hashes of all windows of ``length`` code points."""
        out = np.zeros(self.n - length + 1, dtype=np.uint64)
        for a, p in zip(self.prefix, POWERS, strict=True):
            gap = _mod(a[length:] + np.uint64(PRIME) - a[:-length])
            out = (out << np.uint64(31)) | _mod(gap * p.down[: len(gap)])
        return out

    def whole(self) -> str:
        """The hash of the whole text, 62 bits in 16 hex digits."""
        a, b = self.span(0, self.n)
        return f"{a << 31 | b:016x}"


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] have equal hashes."""
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _sketch(hashes: np.ndarray, slots: int) -> str:
    """One hash byte for each slot: the least of the mixed hashes that fall into it."""
    if not len(hashes):
        return EMPTY_SLOT * slots
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    bits = np.uint64(64 - slots.bit_length() + 1)
    edges = np.searchsorted(mixed, np.arange(slots, dtype=np.uint64) << bits)
    ends = np.append(edges[1:], len(mixed))
    low = mixed[np.minimum(edges, len(mixed) - 1)] & np.uint64(255)
    return "".join(f"{v:02x}" if s < e else EMPTY_SLOT for v, s, e in zip(low.tolist(), edges, ends, strict=True))


def fingerprint(h: PrefixHash) -> str:
    """Length, whole hash, wide and narrow sketch, joined by dashes. A text shorter than
    a window counts as one window."""
    parts = [f"{h.n:x}", h.whole()]
    for length, slots in ((WIDE, WIDE_SLOTS), (NARROW, NARROW_SLOTS)):
        parts.append(_sketch(h.windows(min(length, h.n)) if h.n else np.zeros(0, np.uint64), slots))
    return "-".join(parts)


def likeness(a: str, b: str) -> float:
    """Share of two texts' windows that they have in common (Dice), estimated from their
    fingerprints: 1 if they are equal, 0 if no slot agrees. Narrow windows are compared
    if either text has fewer than SHORT code points."""
    if a == b:
        return 1.0
    x, y = a.split("-"), b.split("-")
    at = 3 if min(int(x[0], 16), int(y[0], 16)) < SHORT else 2
    pairs = [(x[at][i : i + 2], y[at][i : i + 2]) for i in range(0, len(x[at]), 2)]
    used = [(s, t) for s, t in pairs if (s, t) != (EMPTY_SLOT, EMPTY_SLOT)]
    if not used:
        return 0.0
    share = sum(s == t for s, t in used) / len(used)
    both = sum(EMPTY_SLOT not in p for p in used) / len(used)
    share = max(0.0, (share - both / 256) / (1 - 1 / 256))  # unequal hashes agree in one byte of 256
    return min(1.0, 2 * share / (1 + share))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)
NULL_ID = -(2**63)


def with_successors(docs: DataFrame) -> DataFrame:
    """(bucket, id, text, extra): each row's successor by doc_id is the row after it.

    Buckets are ranges of doc_id between approximate quantiles, one for each shuffle
    partition. A bucket's rows stand sorted in one partition and are followed by the head
    of the next bucket as an ``extra`` row, the last bucket's by the head of the first.
    Each text is shuffled once and the heads twice; what is broadcast is an id
    for each bucket, as many as there are shuffle partitions. A null id (kept as the least
    64-bit integer) comes first; repeated ids stand together, ordered by a hash of their text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []))[: parts - 1]

    def bucketed(rows: DataFrame) -> DataFrame:
        if not bounds:
            return rows.withColumn("bucket", F.lit(0))
        marks = F.array(*[F.lit(b).cast("long") for b in bounds])
        return rows.withColumn("bucket", F.size(F.filter(marks, lambda m: m < F.col("id"))))

    heads = bucketed(ids).groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    prior = [(h["id"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    rows = bucketed(docs.select(key, F.col("text").cast("string").alias("text")))
    rows = rows.join(F.broadcast(spark.createDataFrame(prior, "id long, prior int")), "id", "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    again = F.struct(F.col("prior").alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.col("prior").isNull(), F.array(own)).otherwise(F.array(own, again))
    rows = rows.select("id", "text", F.explode(places).alias("c"))
    return (
        rows.select(F.col("c.bucket").alias("bucket"), "id", "text", F.col("c.extra").alias("extra"))
        .repartitionById(parts, F.col("bucket"))
        .sortWithinPartitions("bucket", "extra", "id", F.xxhash64("text"))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints every whole text and its edited text; one row for each row of ``docs``.

    The edited text has the last floor(n/2) code points replaced by the first as many of
    the next document's (see ``with_successors``). A null text counts as empty; two empty
    texts are alike (1), an empty and any other are not (0). ``near_*`` is the likeness of
    fingerprints, ``common_*`` the longest common prefix, found by binary search over the
    prefix arrays. A single row is its own successor, an empty table gives no rows, other
    columns are ignored, and a task holds two texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None  # (bucket, id, text, hash, fingerprint)
        for batch in batches:
            for bucket, i, text, extra in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if extra and (last is None or last[0] != bucket):
                    continue  # a second row with the head's id
                text = text or ""
                h = PrefixHash(text)
                f = fingerprint(h)
                if last is not None and last[0] == bucket:
                    rows.append(_row(last, (text, h, f)))
                last = None if extra else (bucket, i, text, h, f)
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows.clear()
        if rows:
            yield _batch(rows)

    return with_successors(docs).mapInArrow(run, SCHEMA)


def _row(own: tuple, after: tuple) -> tuple:
    _, i, text, h, f = own
    cut = h.n // 2
    edited = text[: h.n - cut] + after[0][:cut]
    e = PrefixHash(edited)
    g = fingerprint(e)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        (None if i == NULL_ID else i), h.n, digest, f, g, likeness(f, g), likeness(f, after[2]),
        common_extension(h, 0, e, 0), common_extension(h, 0, after[1], 0),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
