"""Near hashes: band joins on 64-bit hashes and array similarity of candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import half
from tidewell.functions.text import jaccard

BANDS = 8
MOST_BITS = 7
#: Members of a bucket that a task compares with as many others.
CHUNK = 16384
CHROME_LISTINGS = 40


def without_chrome(rows: DataFrame, hash_column: str, owner: str, most: int = CHROME_LISTINGS) -> DataFrame:
    """Rows whose exact hash isn't on ``most`` or more owners (pictures of the site itself)."""
    common = rows.groupBy(hash_column).agg(F.countDistinct(owner).alias("owners")).where(F.col("owners") >= most)
    return rows.join(common.select(hash_column), hash_column, "left_anti")


def _block_pairs(most_bits: int):
    """For the members of two chunks of a bucket, one block: (a, b, bits) of the pairs within ``most_bits`` that share no band before this one."""

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        band, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        hashes, chunks = table.column("h").to_numpy().view(np.uint64), table.column("chunk").to_numpy()
        # Those that agree on all bands before this one have met there.
        before = hashes >> np.uint64(64 - 8 * band) if band else np.arange(len(hashes), dtype=np.uint64)
        order = np.argsort(before, kind="stable")
        hashes, chunks, before = hashes[order], chunks[order], before[order]
        left = np.flatnonzero(chunks == low)
        right = left if low == high else np.flatnonzero(chunks == high)
        y = hashes[right]
        ends = np.searchsorted(before[right], before[left], "right")
        starts = np.searchsorted(before[right], before[left], "left")
        xs, ys = [], []
        for i, x in enumerate(left):
            # within one chunk only those that stand after; between two, all but those that have met
            for part in (slice(ends[i], None),) if low == high else (slice(0, starts[i]), slice(ends[i], None)):
                near = np.flatnonzero(np.bitwise_count(y[part] ^ hashes[x]) <= most_bits)
                xs.append(np.full(len(near), x))
                ys.append(right[near + (part.start or 0)])
        xs, ys = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (xs, ys))
        differ = hashes[xs] ^ hashes[ys]
        once = np.ones(len(xs), bool)
        for i in range(band):
            once &= (differ >> np.uint64(56 - 8 * i)) & np.uint64(255) != 0
        xs, ys, differ = xs[once], ys[once], differ[once]
        ids = table.column("id")
        return pa.table({"x": ids.take(pa.array(order[xs])), "y": ids.take(pa.array(order[ys])), "bits": np.bitwise_count(differ).astype(np.int32)})

    return pairs


def near_pairs(rows: DataFrame, id_column: str, hash_column: str, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b, bits), a < b: pairs of ids within ``most_bits`` of one another. With fewer
    differing bits than bands, two hashes share a band, so none is lost.

    Equal hashes are joined by hash classes first, so copies meet once: pairs are
    between classes' members only where the classes are near. A pair comes from the first band that it shares. The members
    of a bucket (there are at most 2,048) are dealt to chunks of some ``CHUNK``; a task compares two chunks, so no task holds a bucket.
    """
    if most_bits >= BANDS:
        raise ValueError(f"bands meet pairs of fewer than {BANDS} differing bits")
    classes = rows.where(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.min(id_column).alias("id"))
    number = F.shiftleft(half(F.col(hash_column), False), 32).bitwiseOR(half(F.col(hash_column), True))
    each = classes.select("id", number.alias("h"))
    parts = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("h", 56 - 8 * i).bitwiseAND(F.lit(255)).cast("int").alias("value")) for i in range(BANDS)]
    dealt = each.select("id", "h", F.inline(F.array(*parts)))
    # One row for each bucket: 2,048 at most, whatever the table.
    sizes = dealt.groupBy("band", "value").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = dealt.join(F.broadcast(sizes), ["band", "value"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    blocks = chunked.select("id", "h", "band", "value", "chunk", other)
    blocks = blocks.select("id", "h", "chunk", "band", "value", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    kind = rows.schema[id_column].dataType.simpleString()
    met = blocks.groupBy("band", "value", "low", "high").applyInArrow(_block_pairs(most_bits), f"x {kind}, y {kind}, bits int")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bits")


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: ids of ``sets`` (id, w: distinct words) whose Jaccard similarity is at least ``least``. Words are put in order, the rarest first;
    two such sets share a word among the first size - ceil(least x size) + 1 of each, so only these bring sets together."""
    counts = sets.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    ranked = sets.select("id", F.explode("w").alias("t")).join(counts, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("r"))
    words = F.transform("r", lambda x: x["t"])
    size = F.size("r")
    first = F.slice(words, 1, (size - F.ceil(size * least - 1e-9) + 1).cast("int"))
    left = ranked.select(F.col("id").alias("a"), words.alias("wa"), F.explode(first).alias("t"))
    right = ranked.select(F.col("id").alias("b"), words.alias("wb"), F.explode(first).alias("t"))
    met = left.join(right, "t").where((F.col("a") < F.col("b")) & (jaccard(F.col("wa"), F.col("wb")) >= least))
    return met.select("a", "b").distinct()


def linked_rows(rows: DataFrame, id_column: str, class_column: str, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links) of every row: the smallest id of its class, which ``pairs`` (a, b) name, and the number of
    other rows linked with it, those of its own class among them."""
    classes = rows.groupBy(class_column).agg(F.min(id_column).alias("class_id"), F.count("*").alias("n"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("class_id").alias("b"), F.col("n").alias("far"))
    near = both.join(sizes, "b").groupBy("a").agg(F.sum("far").alias("far"))
    linked = classes.join(near, F.col("class_id") == F.col("a"), "left")
    linked = linked.select(F.col(class_column).alias("of"), "class_id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    out = rows.join(linked, F.col(class_column).eqNullSafe(F.col("of")))
    return out.select(F.col(id_column).alias("id"), "class_id", "links")
