"""Substring deduplication over sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed; the hashes are joined over all
documents, and sentences covered by a repeated span are removed wherever the span isn't
the first. Sentences also begin at a capital letter after a blank, and those of more than
``longest`` words are cut behind words that a hash chooses, so a passage pasted into the
middle of another sentence falls into the same pieces everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import rows as numbering
from tidewell.session import Scratch

SPAN, LONGEST, LEAST_WORDS = 3, 16, 8
#: Runs of very short sentences are so many times as long; places are coded in one integer.
WIDER, CODE = 4, 1 << 10
#: Sentences of more than ``longest`` words end after every word whose CRC-32 this divides.
BREAK_IN = 6
ADDED = ("removed_sentences", "removed_chars")
_BREAK = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*|\s+(?=[A-ZÀ-ÖØ-Þ])")
_WORD = re.compile(r"\S+")
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def sentences(text: str, longest: int = LONGEST) -> tuple[list[int], list[int], list[int]]:
    """(starts, hashes, numbers of words) of a text's sentences. They cover the text: each
    ends where the next starts, and the first starts at 0. Hashes ignore case and the
    width of blanks."""
    marks = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    starts, hashes, words = [], [], []
    digest = xxhash.xxh64_intdigest
    for begin, end in zip(marks, marks[1:]):
        if begin == end:
            continue
        own = text[begin:end].lower().split()
        if len(own) <= longest:
            starts.append(begin)
            hashes.append(digest(" ".join(own)))
            words.append(len(own))
            continue
        places = [m.start() for m in _WORD.finditer(text, begin, end)]
        places[0] = begin
        i = 0
        for j, word in enumerate(own, 1):
            if j == len(own) or j - i >= 4 * longest or crc32(word.encode("utf-8", "surrogatepass")) % BREAK_IN == 0:
                starts.append(places[i])
                hashes.append(digest(" ".join(own[i:j])))
                words.append(j - i)
                i = j
    return starts, hashes, words


def _runs(hashes: np.ndarray, span: int) -> np.ndarray:
    n = len(hashes) - span + 1
    out = np.full(max(0, n), span, dtype=np.uint64)
    for i in range(span if n > 0 else 0):
        out = (out ^ hashes[i : i + n]) * _MIX[0]
        out = (out ^ (out >> np.uint64(29))) * _MIX[1]
    return out


def span_hashes(hashes: list[int], words: list[int], span: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run of ``span`` sentences with at least ``least`` words, and
    where a run has fewer, of the run of WIDER times as many sentences that starts there. A
    place is CODE times the first sentence's position plus the number of sentences."""
    h = np.array(hashes, dtype=np.uint64)
    total = np.cumsum([0, *words])
    out, places = [], []
    short = np.arange(len(h))
    for length in (span, span * WIDER):
        own = _runs(h, length)
        short = short[short < len(own)]
        enough = total[short + length] - total[short] >= least if length == span else np.ones(len(short), dtype=bool)
        out.append(own[short[enough]])
        places.append(short[enough] * CODE + length)
        short = short[~enough]
    return np.concatenate(out).view(np.int64), np.concatenate(places)


def _spans(docs: DataFrame, span: int, longest: int, least: int) -> DataFrame:
    """(h, row, id, at, again): every span; again: the same row has had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            parts = []
            for row, i, text in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), strict=True):
                _, hashes, words = sentences(text.as_py() or "", longest)
                h, at = span_hashes(hashes, words, span, least)
                if len(h):
                    first = np.unique(h, return_index=True)[1]
                    again = np.ones(len(h), dtype=bool)
                    again[first] = False
                    parts.append((h, np.full(len(h), row, np.int64), np.full(len(h), i, np.int64), at, again))
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                whole = pa.RecordBatch.from_arrays(columns, ["h", "row", "id", "at", "again"])
                for at in range(0, whole.num_rows, 100_000):
                    yield whole.slice(at, 100_000)

    return docs.mapInArrow(run, "h long, row long, id long, at long, again boolean")


def remove_repeats(
    docs: DataFrame, span: int = SPAN, longest: int = LONGEST, least_words: int = LEAST_WORDS
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``removed_sentences`` and
    ``removed_chars`` (code points) added.

    A span's first occurrence is in the document with the smallest doc_id that has it, at
    its first place there. A run of ``span`` sentences with fewer than ``least_words`` words together is no span of
    its own, only part of longer ones. A document of fewer than ``span`` sentences has no spans and stays
    as it is, as do null and empty texts. Rows are told apart by a number of their own: those that
    share a doc_id, or have none (null comes first), or are equal in all columns are different
    documents, and the first of them in the table's order keeps the span. All columns of ``docs``
    are kept, whatever their names, but for those named as the added ones, in any case. An empty
    table gives no rows.

    The rows are written once, numbered. Then only hashes and numbers meet: the first owner of a
    hash is an aggregate with map-side combine, repeated hashes are written, and the join with them
    has an aggregate on one side, which adaptive execution can't split: a passage that a third of the documents share is one task's rows of numbers.
    Positions to cut are gathered per row. Texts are shuffled once, to meet their positions. Two spans
    with the same 64-bit hash are taken to be equal.
    """
    scratch = Scratch(docs.sparkSession)
    rows = numbering.numbered(docs, "rows")
    text = f"c{numbering.place(docs.columns, 'text')}"
    slim = rows.select("row", "id", F.col(text).cast("string").alias("text"))
    spans = scratch.put(_spans(slim, span, longest, least_words), "spans")
    once = spans.where("not again").groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    owners = scratch.put(once.where("n > 1").select("h", "first_id"), "owners")
    repeated = scratch.put(spans.where("not again").join(owners, "h").select("h", "row", "id", "at", "first_id"), "repeated")
    first = repeated.where("id = first_id").groupBy("h").agg(F.min("row").alias("first_row"))
    cuts = repeated.join(first, "h").where("row <> first_row").select("row", "at")
    cuts = cuts.union(spans.where("again").select("row", "at")).groupBy("row").agg(F.collect_set("at").alias("cuts"))
    cuts = Scratch(docs.sparkSession).put(cuts, "cuts")
    scratch.clear()
    cut = _cutter(longest)(F.col(text).cast("string"), F.col("cuts"))
    found = rows.join(cuts, "row", "left").withColumn("cut", cut)
    added = {name: F.col(f"cut.{name}") for name in ADDED}
    return numbering.restored(found, docs.columns, F.col("cut.text"), added)


def _cutter(longest: int):
    kind = pa.struct([("text", pa.string()), ("removed_sentences", pa.int64()), ("removed_chars", pa.int64())])

    @F.arrow_udf("text string, removed_sentences long, removed_chars long")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        rows = (dict(zip([f.name for f in kind], _cut(t.as_py(), c.as_py(), longest), strict=True)) for t, c in zip(texts, cuts, strict=True))
        return pa.array(rows, kind, size=len(texts))

    return cut


def _cut(text: str | None, places: list[int] | None, longest: int) -> tuple[str | None, int, int]:
    if not text or places is None or not len(places):
        return text, 0, 0
    starts = [*sentences(text, longest)[0], len(text)]
    dropped = {i for p in map(int, places) for i in range(p // CODE, p // CODE + p % CODE)}
    kept = [text[a:b] for i, (a, b) in enumerate(zip(starts, starts[1:])) if i not in dropped]
    new = "".join(kept)
    return new, len(dropped), len(text) - len(new)
