"""WARC archives with revisit records for payloads that are stored already.

Headers alone are grouped by payload digest to find the record that keeps the payload; the others become revisit records that refer
to it. Spark's text writer writes the archives, with the blank lines that end a WARC record as its line separator.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.rows import plain
from panelspark.session import cut_lineage

#: Payloads below this are always stored.
MIN_REVISIT = 1000
#: Records of one archive file.
FILE_RECORDS = 5_000
#: Up to so many repeated digests (of about 50 bytes) are sent to all executors; more are joined by a shuffle of the pages.
SENT_DIGESTS = 200_000
#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id, digest):
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, *, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per page: page_id, url, html (null is empty), payload_bytes, payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id is the response, and so are
    repeated rows of it; the others revisit it. Null ids are the smallest; if a payload has no other id, all its pages are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = plain(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    headers = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(headers.where("n > 1 and original is not null").select("payload_digest", "original"))
    if repeated.count() <= SENT_DIGESTS:
        repeated = F.broadcast(repeated)
    revisit = F.coalesce(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.lit(False))
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, *, date: str, file_records: int = FILE_RECORDS) -> None:
    """Write :func:`records` as gzipped WARC files with fresh headers; ``date`` is the WARC-Date of all of them.

    Control characters in a URL, which would end a header, are percent-encoded.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))

    head = F.concat_ws(
        "", F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))), line("Refers-To-Page-ID", F.col("refers_to").cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    rows.select(F.concat(head, block).alias("value")).write.option("maxRecordsPerFile", file_records).text(path, compression="gzip", lineSep=CRLF * 2)


def _parsed(data: bytes):
    """(headers, block) of the records of one archive; lengths alone say where a record ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits).

    Digests of responses are computed again from what was read, and must agree with the headers.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, block in _parsed(gzip.decompress(content.as_py())):
                    cut = block.index(b"\r\n\r\n") + 4
                    http = dict(x.split(": ", 1) for x in block[: cut - 4].decode().split(CRLF)[1:])
                    kind, digest, payload = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if kind == "response":
                        payload = block[cut:]
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                    url = headers.get("WARC-Target-URI")
                    page, refers = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
                    out.append((int(page) if page else None, url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), int(http["Content-Length"]), digest, kind, int(refers) if refers else None, payload if payloads else None))
                cols = list(zip(*out)) if out else [()] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(read, RECORD)


def resolved(archive: DataFrame) -> DataFrame:
    """Page_id, url and html of every record, with the payloads of the responses that revisits refer to."""
    originals = archive.where("record_type = 'response'").groupBy("payload_digest").agg(F.any_value("payload").alias("original"))
    stored = archive.where("record_type = 'response'").select("page_id", "url", "payload")
    revisits = archive.where("record_type = 'revisit'").join(originals, "payload_digest").select("page_id", "url", F.col("original").alias("payload"))
    return stored.unionByName(revisits).select("page_id", "url", F.decode("payload", "UTF-8").alias("html"))
