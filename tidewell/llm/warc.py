"""WARC archives: written with an index, read back by coalesced byte ranges.

Index first: every record's file, offset, length, URL and digest are written as a table
before anything is read. A reader selects index rows, sorts them by file and
offset, joins neighbouring ranges into one read and parses the records in it. Files are
gzip with one member for each record, as the WARC standard has it, and lie in a folder that
all executors share; they are reached through ``pyarrow.fs``, so the folder may be local,
HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize, shared_path

#: Ranges of one file that lie this close are read at once, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
URN = "urn:tidewell:page:"
PART_BYTES = 32 << 20
NULL_KEY = -(2**63)

INDEX = (
    "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, "
    "file string, offset long, length long"
)
RECORD = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, intact boolean"
)


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " ").strip()


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One uncompressed WARC record: an HTTP response, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <{URN}{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, values as written) and the block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha1, size, refers_to) of each page whose record is a revisit.

    Only digests and ids are shuffled, never payloads. The first page of each digest is an
    aggregate with map-side combine; only digests of several pages are kept and written, so
    the join that follows is between two plain exchanges and adaptive execution splits
    a digest that a large share of the pages has.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("sha1"), F.length(html).alias("size")
    )
    slim = slim.where(F.col("size") >= least)
    firsts = slim.groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").select("sha1", "size", "refers_to"), "digests")
    joined = slim.join(firsts, ["sha1", "size"])
    return joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_warc(pages: DataFrame, least: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes one record for each row of ``pages``; returns the index, itself written, and the folder.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest
    page_id is a response and the others revisit it; smaller payloads are all responses.
    A null html is an empty payload. Null page ids come after all others. Of rows with
    one page_id and one payload, the first is as the rule says and each further one revisits
    that page_id, so a payload is stored once. Line breaks within a URL are dropped, a null
    URL is empty; other columns are ignored; an empty table gives an empty index.

    A task writes files of its own under names that no other attempt uses; only the index
    rows of attempts that Spark has committed point to a file, so a lost executor's
    leftovers are never read.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_KEY)).alias("key")
    found = classify(pages, least).select(key, F.struct("sha1", "refers_to").alias("entry"))
    found = found.groupBy("key").agg(F.map_from_entries(F.collect_set("entry")).alias("found"))
    url = F.col("url").cast("string").alias("url")
    rows = pages.select(key, F.col("page_id").cast("long").alias("page_id"), url, html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).repartition(parts, "key").join(found, "key", "left")
    rows = rows.select(
        "page_id", "url", "payload", "sha1",
        F.element_at("found", F.col("sha1")).alias("refers_to"),
        F.coalesce(F.map_contains_key("found", F.col("sha1")), F.lit(False)).alias("revisit"),
    ).sortWithinPartitions("page_id", "sha1", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        out: list[tuple] = []
        sink, name, at, before = None, "", 0, None
        for batch in batches:
            for page, url, payload, sha1, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                repeat = before == (page, sha1) and len(payload) >= least
                before = (page, sha1)
                kind = "revisit" if revisit or repeat else "response"
                target = first if revisit else page if repeat else None
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = _gzip(record_bytes(page, url, payload, digest, len(payload), kind, target))
                if sink is None or at >= PART_BYTES:
                    if sink:
                        sink.close()
                    name, at = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(name, compression=None)
                sink.write(member)
                out.append((page, url, digest, len(payload), kind, target, name, at, len(member)))
                at += len(member)
            if len(out) >= 2000:
                yield _batch(out, INDEX)
                out.clear()
        if sink:
            sink.close()
        if out:
            yield _batch(out, INDEX)

    return materialize(rows.mapInArrow(run, INDEX), "warc-index"), folder


def read_warc(index: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Records of the index rows given, whichever were selected; a row for each.

    Rows are dealt by file and sorted by offset; ranges at most ``gap`` bytes apart
    are read at once, up to ``most`` bytes, then cut at the index's offsets. The payload of
    a revisit is null; its digest and length are what its header says. ``intact`` tells
    that the block's payload has the digest in the header and the index.
    """
    wanted = index.select("file", "offset", "length", "digest")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = wanted.repartition(parts, "file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(folder)
        source, name = None, None
        group: list[tuple[int, int, str]] = []

        def fetch() -> Iterator[tuple]:
            if not group:
                return
            start = group[0][0]
            source.seek(start)
            data = source.read(group[-1][0] + group[-1][1] - start)
            for offset, length, digest in group:
                yield _record(zlib.decompress(data[offset - start : offset - start + length], 31), digest)
            group.clear()

        for batch in batches:
            out: list[tuple] = []
            for file, offset, length, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = group[-1][0] + group[-1][1] if group else 0
                if file != name or group and (offset - end > gap or offset + length - group[0][0] > most):
                    out += fetch()
                if file != name:
                    if source:
                        source.close()
                    source, name = store.open_input_file(file), file
                group.append((offset, length, digest))
                if len(out) >= 500:
                    yield _batch(out, RECORD)
                    out = []
            if out:
                yield _batch(out, RECORD)
        out = list(fetch())
        if out:
            yield _batch(out, RECORD)

    return wanted.mapInArrow(run, RECORD)


def _id(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(URN)
    return None if text in ("", "null") else int(text)


def _record(raw: bytes, digest: str) -> tuple:
    headers, block = parse_record(raw)
    kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    size = int(headers["warc-payload-length"]) if payload is None else len(payload)
    own = said if payload is None else base32_sha1(payload)
    return (
        _id(headers["warc-record-id"]), headers["warc-target-uri"], payload, size, own, kind,
        _id(headers.get("warc-refers-to")), own == said == digest,
    )


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in columns], list(names))
