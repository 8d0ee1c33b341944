"""SimHash near-duplicates, found with BK-trees.

A document's fingerprint has a bit set where more than half of its shingles' hashes have
it. Fingerprints within ``radius`` bits are linked, and linked documents form groups. Of
``radius`` + 1 blocks of bits, two such fingerprints share at least one, so each value of
each block is a shard: its BK-tree is built where the shard's fingerprints meet
and is searched by them alone. A BK-tree's children are keyed by their Hamming distance
to the parent; a search follows only the edges within the radius of its own distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.components import connected_components
from tidewell.session import Scratch, materialize

SHINGLE, SEED, RADIUS, LEAF = 4, 42, 4, 48


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text: A-Z in lower case, words between ASCII blanks,
    shingles of so many words, repeats included (a text with fewer: all its words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[i:j], seed) for i, j in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): fp as a signed 64-bit integer. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((simhash(t.as_py() or "", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    slim = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"{key} long, fp long")


class BKTree:
    """BK-tree over distinct 64-bit integers; subtrees of at most LEAF of them are lists."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        self.points = points
        index = np.arange(len(points)) if index is None else index
        self.pivot, self.edges, self.leaf = None, [], None
        if len(index) <= LEAF:
            self.leaf = index
            return
        self.pivot, rest = index[0], index[1:]
        far = np.bitwise_count(points[rest] ^ points[self.pivot])
        order = np.argsort(far, kind="stable")
        rest, far = rest[order], far[order]
        cuts = np.flatnonzero(np.diff(far)) + 1
        keys = far[np.concatenate([[0], cuts])].tolist()
        self.edges = [(k, BKTree(points, part)) for k, part in zip(keys, np.split(rest, cuts), strict=True)]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(point, those of the queries within the radius), both as positions. All
        queries go down together; a branch gets those whose distance to its parent is
        within the radius of the branch's key."""
        if not len(queries):
            return
        points = self.points
        if self.leaf is not None:
            for p in self.leaf.tolist():
                hits = queries[np.bitwise_count(points[queries] ^ points[p]) <= radius]
                if len(hits):
                    yield p, hits
            return
        far = np.bitwise_count(points[queries] ^ points[self.pivot]).astype(np.int64)
        hits = queries[far <= radius]
        if len(hits):
            yield int(self.pivot), hits
        for key, child in self.edges:
            yield from child.near(queries[np.abs(far - key) <= radius], radius)


def shard_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a shard's distinct fingerprints: at most one
    pair for each, never all pairs of a group."""
    n = len(points)
    if n <= LEAF:
        close = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        if int(close.sum()) == n:
            return []
    parent = np.arange(n)

    def roots(at: np.ndarray) -> np.ndarray:
        top = parent[at]
        while True:
            above = parent[top]
            if (above == top).all():
                parent[at] = top
                return top
            top = above

    for p, hits in BKTree(points).near(np.arange(n), radius):
        tops = np.unique(roots(np.append(hits, p)))
        parent[tops[1:]] = tops[0]
    top = roots(np.arange(n))
    moved = np.flatnonzero(top != np.arange(n))
    return list(zip(points[moved].view(np.int64).tolist(), points[top[moved]].view(np.int64).tolist(), strict=True))


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect distinct fingerprints ``fp`` as all links within the
    radius do. Exact: no link between groups is lost, as every close pair shares a shard."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    shards = []
    for i in range(blocks):
        width = edges[i + 1] - edges[i]
        value = F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1))
        shards.append(value + F.lit(i << 56))
    dealt = distinct.select(F.explode(F.array(*shards)).alias("shard"), "fp")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        now = None

        def close() -> list[tuple[int, int]]:
            points = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            return shard_links(points, radius) if len(points) > 1 else []

        for batch in batches:
            shard, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out: list[tuple[int, int]] = []
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if shard[i] != now:
                    out += close()
                    kept, now = [], shard[i]
                kept.append(fp[i:j].view(np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        out = close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _groups(classes: DataFrame, least: str, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, first): for distinct fingerprints, the smallest ``least`` of all that are reachable."""
    nodes = connected_components(link_fingerprints(classes.select("fp"), radius), scratch=scratch)
    nodes = scratch.put(nodes.withColumnRenamed("node", "fp"), "nodes")
    firsts = nodes.join(classes, "fp").groupBy("component").agg(F.min(least).alias("first"))
    linked = nodes.join(firsts, "component").select("fp", "component", "first")
    own = F.coalesce("component", "fp").alias("component")
    return classes.join(linked, "fp", "left").select("fp", own, F.coalesce("first", least).alias("first"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over
    links); one row for each row of ``docs``.

    Documents without words have the fingerprint zero and are linked like any other. Rows
    with a null doc_id get the component of their fingerprint, null if only such rows have
    it. Equal fingerprints are one class from the start, so exact copies cost no links. An
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    own = materialize(fingerprints(docs, "doc_id", shingle, seed), "fingerprints")
    classes = scratch.put(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = materialize(_groups(classes, "least", radius, scratch), "groups")
    scratch.clear()
    return own.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def first_of_groups(rows: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(row) of the first row, by ``id`` and then by ``row``, of each group of near-duplicates of
    numbered rows (row, id, text)."""
    scratch = Scratch(rows.sparkSession)
    hashes = fingerprints(rows.select("row", "text"), "row", shingle, seed)
    own = scratch.put(hashes.join(rows.select("row", "id"), "row"), "fingerprints")
    classes = scratch.put(own.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    firsts = own.join(_groups(classes, "least", radius, scratch), "fp").where("id = first")
    out = materialize(firsts.groupBy("component").agg(F.min("row").alias("row")).select("row"), "first-rows")
    scratch.clear()
    return out
