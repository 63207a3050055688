"""WARC archives with revisit resolution.

Headers alone (page, payload digest, length) are shuffled by digest; of equal
payloads the one with the smallest page_id stays a response and the others
become revisits of it. Payloads meet their decision by page, never by digest,
so a payload shared by a third of all pages is no hot key of wide rows. Records
are written with fresh headers by Spark's own file writer, which commits only
whole files and works on any store, and are read back by their Content-Length.
Revisit records carry no payload: their length and digest come from the join
with the response they refer to.

Null html is an empty payload. Rows with a null page_id are written and read
like others and come last in choosing the response. Repeated rows are separate
records with one decision: rows equal in page_id and payload are all responses
or all revisits. An empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir
from .common import whole

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, in eight groups of five hex digits each."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """Pages with the digest and length of their payload."""
    payload = F.encode(whole(F.col("html")), "UTF-8")
    return pages.select("page_id", "url", "html", base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def resolved(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Record type of each page and payload, and the page that it revisits.

    Smallest page per digest is a map-side minimum, so a common payload sends
    one row per task; the join back is on narrow rows that may be split.
    """
    heads = heads.select("page_id", "digest", "bytes").distinct()
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id"))
    firsts = heads.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("digest", F.col("f").alias("first"))
    rows = heads.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("bytes") >= min_bytes)
    return rows.select(
        "page_id", "digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")


def _urn(*of: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(heads: DataFrame, decisions: DataFrame, date: str) -> DataFrame:
    """One string per page: its WARC record without the last line break, which the writer adds."""
    of = decisions.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "record_type", "refers_to")
    rows = heads.join(of, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    optional = lambda k, v: F.when(v.isNotNull(), line(k, v.cast("string"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _clean(F.col("url"))), optional("X-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")), optional("X-Refers-To-Page", F.col("refers_to")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(CRLF))
    return rows.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(whole(F.col("html"))), F.lit(CRLF)).alias("value"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Write gzip archives of pages (page_id, url, html) with equal payloads stored once."""
    heads = headers(pages)
    text = records(heads, resolved(heads, min_bytes), date)
    text.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and HTTP body of every record of one archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:end].decode().split(CRLF)[1:])
        start, size = end + 4, int(fields["Content-Length"])
        body = data.index(b"\r\n\r\n", start) + 4
        yield fields, data[body:start + size]
        at = start + size + 4


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives: its headers, and the length and digest of the payload it carries."""
    schema = "page_id long, record_type string, refers_to long, payload_digest string, stored_bytes long, intact boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    split = parse

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def framed(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for batch in batches:
            for content in batch["content"]:
                out: list[tuple] = []
                for h, payload in split(gzip.decompress(content)):
                    said, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    intact = kind == "revisit" or said == base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page")
                    out.append((page and int(page), kind, refers and int(refers), said, len(payload), intact))
                    if len(out) == 4096:
                        yield framed(out)
                        out = []
                yield framed(out)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInPandas(rows, schema)


def with_originals(archive: DataFrame) -> DataFrame:
    """Records with the full payload's length, that of a revisit from the response with its digest."""
    responses = archive.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("stored_bytes").alias("_bytes"))
    rows = archive.join(responses, "payload_digest", "left")
    return rows.select(
        "page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        (F.col("intact") & F.col("_bytes").isNotNull()).alias("intact"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write(pages, folder, min_bytes)
    return with_originals(read(spark, folder))
