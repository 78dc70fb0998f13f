"""Content-addressed archive of WARC records.

Two tables stand for the archive: `payloads` holds each distinct payload once under its SHA-256, `headers` the
exact header bytes of every record with the SHA-256 of its payload.  Original records come back through a join;
reading checks both digests of every stored payload against its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_classes, join_salted, present, written

#: Payloads from this size on are stored as one response and revisits of it.
REVISIT_BYTES = 1000
#: WARC-Date of records whose pages carry no date, and the profile of revisits.
NO_DATE, PROFILE = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def records(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """(page_id, url, html) -> one WARC record per row: page_id, header, payload_digest, sha256, payload_bytes, payload.

    The payload is the html in UTF-8, null as empty.  Of equal payloads of REVISIT_BYTES or more, every row with
    the largest page_id (null counts as smallest) is a response and the others are revisits that name it; smaller
    ones are all responses.  A null page_id or url makes an empty header value.  date: of all records, as in ISO 8601.
    Repeated rows are records of their own with one record id; columns other than the three are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), present(F.col("url")).alias("url"), F.encode(present(F.col("html")), "UTF-8").alias("payload"))
    base = base.withColumns({"sha256": F.sha2("payload", 256), "payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    big = base.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    owners = written(big.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1"), "owners")
    slim = base.select("page_id", "url", "sha256", "payload_digest", "payload_bytes")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return join_classes(slim, owners, "sha256", "copies", "left").withColumn("refers_to", refers).withColumn("header", header(date))


def header(date: str) -> Column:
    """The exact header of a record: a revisit carries no payload and names the response it repeats."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    safe = F.regexp_replace("url", r"[\r\n]", " ")
    return F.encode(F.concat(
        F.lit("WARC/1.1" + _END), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""), line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")), F.lit(_END),
    ), "UTF-8")


def write_archive(pages: DataFrame, date: str = NO_DATE) -> tuple[DataFrame, DataFrame]:
    """Write (headers, payloads) in the shared folder and return both as read back; an empty table makes empty ones."""
    made = records(pages, date)
    headers = written(made.select("header", "sha256"), "headers")
    blob = F.encode(present(F.col("html")), "UTF-8")
    payloads = pages.select(F.sha2(blob, 256).alias("sha256"), blob.alias("payload")).groupBy("sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    return headers, written(payloads, "payloads")


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, header, payload.

    payload is that of the response for revisits too.  A stored payload whose bytes don't have the digest it is
    stored under, or a header whose payload digest isn't that of its payload, stops the read.
    """
    text = F.decode("header", "UTF-8")
    field = lambda name, of: F.nullif(F.regexp_extract(text, rf"(?md)^{name}: {of}\r\n", 1), F.lit(""))
    parsed = headers.select(
        "sha256", "header", field("WARC-Record-ID", "<urn:page:(-?[0-9]*)>").cast("long").alias("page_id"), field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]*)>").cast("long").alias("refers_to"), field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("said"),
    )
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256")))
    stored = payloads.withColumns({"payload_digest": sound, "payload_bytes": F.octet_length("payload").cast("long")})
    met = join_salted(parsed, stored, "sha256", "copies")
    agreed = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), "sha256")))
    return met.select("page_id", "payload_bytes", agreed.alias("payload_digest"), "record_type", "refers_to", "header", "payload")


def original(read: DataFrame) -> DataFrame:
    """Whole records as bytes: header, the payload unless it is a revisit, and the closing blank lines."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return read.select("page_id", F.concat("header", body, F.encode(F.lit(_END * 2), "UTF-8")).alias("record"))
