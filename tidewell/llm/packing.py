"""Packing: documents' token ids into sequences of one length, with little padding.

First-fit decreasing over a tournament tree of bin capacities, run independently in
randomised groups of documents. Texts cross the network once, dealt by a hash of
the row; a task tokenises its documents, cuts off whole sequences at once and packs the
remainders of one group after another, so it holds one group's remainders at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import encoder

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 4096
#: Each group has a task of its own up to so many; beyond, tasks take as many groups each, one after another.
MOST_TASKS = 100_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree over bins in order of opening; each inner node has the larger
    remaining capacity of its two children, so the first bin that fits an item is found
    in as many steps as the tree is high."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts an item into the first bin with room; returns (bin, capacity before)."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        before = most[at]
        most[at] = before - size
        leaf = at
        at //= 2
        while at:
            high = max(most[2 * at], most[2 * at + 1])
            if most[at] == high:
                break
            most[at] = high
            at //= 2
        return leaf - self.leaves, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, 0 < size <= capacity. Equal sizes keep their order."""
    tree = CapacityTree(len(sizes), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where, before = tree.place(sizes[i])
        out[i] = where, capacity - before
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    seed: int = 6,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    A document's ids are those of the byte-level BPE file ``vocabulary`` plus
    ``end_id``. Ids beyond whole multiples of ``length`` form the remainder that shares
    a sequence with others; whole multiples are sequences by themselves. A null
    or empty text is the one id ``end_id``; each of repeated rows is packed as a
    document of its own; an empty table gives no rows; other columns are ignored.
    Groups are dealt by a hash of the whole row's id and text, about ``group_docs`` rows
    each; rows beyond twice that (one row repeated very often) start another batch
    within the group, so no group is held whole. ``sequence_id`` is the group in its
    upper bits and the sequence's number there in the lower 32.
    """
    groups = max(1, -(-docs.count() // group_docs))
    dealt = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(groups)))
        .repartitionById(min(groups, MOST_TASKS), F.col("grp").cast("int"))
        .sortWithinPartitions("grp", "doc_id", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        tails: list[tuple] = []
        group, opened = None, 0

        def flush() -> None:
            nonlocal opened, tails
            for (doc, start, ids, total), (where, offset) in zip(
                tails, first_fit_decreasing([len(t[2]) // 4 for t in tails], length), strict=True
            ):
                rows.append((doc, start, len(ids) // 4, ids, total, (group << 32) + opened + where, offset))
            opened += len(tails)
            tails = []

        for batch in batches:
            docs_of, groups_of = (batch.column(i).to_pylist() for i in (0, 2))
            for doc, text, own in zip(docs_of, batch.column(1), groups_of, strict=True):
                if own != group or len(tails) >= 2 * group_docs:
                    flush()
                    if own != group:
                        group, opened = own, 0
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total - total % length
                for start in range(0, whole, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, piece, total, (group << 32) + opened, 0))
                    opened += 1
                if whole < total:
                    tails.append((doc, whole, ids[4 * whole :], total))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows.clear()
        flush()
        if rows:
            yield _batch(rows)

    return dealt.select("doc_id", "text", "grp").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by its CRC-32, unsigned."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def crc32(ids: bytes) -> int:
    """The checksum that ``with_checksums`` gives, for tests."""
    return zlib.crc32(ids)
