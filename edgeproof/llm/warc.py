"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit, which refers to the response with the same
payload) and a metadata record; the first and the last name the response in WARC-Concurrent-To.
Archives are written by Spark's text writer (a task's records one after another, gzip), which
commits whole files and works on any file system; they are read as binary files of bounded size,
each record found by its length, never by a separator.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh_path, scan

#: About this many bytes of records in a file.
FILE_BYTES = 32_000_000
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 5 hexadecimal digits are 4 letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, page: Column) -> Column:
    """A record's name: from its kind, its page and its payload."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), "digest").cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, ident: Column, content_type: str, body: Column, *headers: Column) -> Column:
    """One record without its closing line ends. Null headers are left out."""
    size = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    first = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind)
    return F.concat(F.concat_ws("\r\n", first, F.concat(F.lit("WARC-Record-ID: "), ident), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), *headers, F.lit(f"Content-Type: {content_type}"), size), F.lit(END), body)


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write every row of pages(page_id, url, html) as a capture under path.

    Of captures with equal payloads of at least `least` bytes, the one with the largest id is the
    response and the others revisit it. Null html is an empty payload, a null url gives no target,
    a null id comes before all others; repeated rows are repeated captures under one name.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    sized = rows.select("page_id", "digest", F.octet_length("html").alias("n"))
    total = sized.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    tops = sized.groupBy("digest").agg(F.max("page_id").alias("top"))
    named = sized.select("page_id", "digest").distinct().join(tops, "digest").select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "top")
    both = rows.join(named, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))

    url = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]+", "%20"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    again = (F.octet_length("html") >= least) & F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    mine, target = _urn("response", F.col("page_id")), _urn("response", F.col("top"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), mine)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    main = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), mine, "application/http;msgtype=response", F.when(again, head).otherwise(F.concat(head, F.col("html"))),
        url, digest, F.when(again, F.concat(F.lit("WARC-Refers-To: "), target)), F.when(again, F.lit(f"WARC-Profile: {REVISIT}")),
    )
    request = _record(F.lit("request"), _urn("request", F.col("page_id")), "application/http;msgtype=request", F.lit(f"GET / HTTP/1.1{END}"), url, concurrent)
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), _urn("metadata", F.col("page_id")), "application/warc-fields", about, url, concurrent)
    mean = max(1.0, float(total["n"] or 0) / max(1, total["k"])) + 1500
    out = both.select(F.concat_ws(END, request, main, metadata).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / mean))).text(path)


def inflate(data: bytes, piece: int = 1 << 16) -> bytes:
    """All members of a gzip file, or the bytes themselves if they are none. A member is fed in pieces,
    so that what lies behind its end is copied once a member, a piece at most."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts, at = [], 0
    while at < len(data) and data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            parts.append(z.decompress(data[at : at + piece]))
            at += piece
        parts.append(z.flush())
        at -= len(z.unused_data) + max(0, at - len(data))
    return b"".join(parts)


def parse(data: bytes):
    """(headers, content) of each record: header names in lower case."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


_RECORD = "kind string, id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, page_id long, payload string"


def read_records(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under path; a response's digest and size are taken from what
    was read, a revisit's digest from its header."""

    def run(batch):
        for data in column(batch, "content").to_pylist():
            rows: dict[str, list] = {c: [] for c in ("kind", "id", "concurrent_to", "refers_to", "uri", "digest", "payload_bytes", "page_id", "payload")}
            for h, body in parse(inflate(data)):
                kind, page, size, payload = h.get("warc-type"), None, None, None
                digest = h.get("warc-payload-digest", "").partition(":")[2] or None
                if kind == "response":
                    raw = body.partition(b"\r\n\r\n")[2]
                    size, digest = len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()
                    payload = raw.decode("utf-8", "replace") if with_payload else None
                elif kind == "metadata":
                    value = body.partition(b"pageId:")[2].strip()
                    page = int(value) if value else None
                for c, v in zip(rows, (kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, page, payload), strict=True):
                    rows[c].append(v)
            yield rows

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return scan(files, run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: request, main (response or revisit) and metadata record, joined
    through their concurrent-to identifiers. Captures written more than once give as many rows;
    records whose capture is missing give none; a missing request or metadata record is null."""
    key = F.coalesce("concurrent_to", "id")
    whole = F.struct("kind", "id", "uri", "digest", "payload_bytes", "refers_to", "payload")
    grouped = records.groupBy(key.alias("capture")).agg(
        F.max(F.when(F.col("kind") == "request", F.struct("id", "uri"))).alias("request"),
        F.max(F.when(F.col("kind").isin("response", "revisit"), whole)).alias("main"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("id", "page_id"))).alias("metadata"),
        F.count(F.when(F.col("kind").isin("response", "revisit"), 1)).alias("times"),
    )
    return grouped.where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "time")


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, payload size and digest, record type, and the page that a revisit refers to."""
    own = captures.select(F.col("metadata.page_id").alias("page_id"), "main.kind", "main.digest", "main.payload_bytes", "main.refers_to")
    origin = captures.where("main.kind = 'response'").select(F.col("main.id").alias("origin"), F.col("metadata.page_id").alias("origin_page"), F.col("main.payload_bytes").alias("origin_bytes")).distinct()
    linked = own.where("kind = 'revisit'").join(origin, F.col("refers_to") == F.col("origin"), "left").select("page_id", F.col("origin_bytes").alias("payload_bytes"), "digest", "kind", F.col("origin_page").alias("refers_to"))
    first = own.where("kind = 'response'").select("page_id", "payload_bytes", "digest", "kind", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(linked)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and resolve every capture."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return resolve(assemble(read_records(spark, path)))
