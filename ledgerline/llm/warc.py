"""A content-addressed WARC archive: payload bytes once, exact record headers apart.

The archive is two tables in the shared folder: ``payloads(address, payload)``, address being
the SHA-256 of the bytes, and ``headers(page_id, address, header)`` with the header block of
every record as it stands in a WARC/1.1 file.  Reading recomputes each payload's digests, so a
damaged payload is refused, and joins headers to payloads.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._tools import BROADCAST_ROWS, cut, discard

# The WARC/1.1 profile of revisits, and the alphabets of Java's base 32 and of RFC 4648.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_JAVA_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Archive(NamedTuple):
    headers: DataFrame
    payloads: DataFrame


def base32(hex40: Column) -> Column:
    """The RFC 4648 base 32 form of 40 hexadecimal digits: five digits make four characters."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _JAVA_32, _RFC_32)


def write_archive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_from: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> Archive:
    """Archive every row of ``pages``; null payloads count as empty ones.

    Of records with equal payloads of at least ``revisit_from`` bytes, that with the largest
    page_id is a response and the others revisit it.  A record's id has the page_id and the row's
    number, so that repeated and null page_ids give records of their own.  Rows without a page_id cannot be referred
    to: they are responses.  Rows that repeat the largest page_id are responses too.  Line
    breaks in a URL are percent-encoded; a null URL gives an empty one.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    seen = cut(
        pages.select(
            F.col(page_id).alias("page_id"),
            F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
            F.sha2(body, 256).alias("address"),
            base32(F.sha1(body)).alias("sha1"),
            F.octet_length(body).cast("long").alias("n"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "warc-seen",
    )
    payloads = pages.select(F.sha2(body, 256).alias("address"), body.alias("payload")).groupBy("address").agg(
        F.first("payload").alias("payload")
    )
    # the record that others revisit: of the largest page_id, and of equal ones the first row
    target = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", (-F.col("row")).alias("back"))))
    largest = seen.groupBy("address").agg(target.alias("t")).select("address", F.col("t.page_id").alias("largest"), (-F.col("t.back")).alias("target_row"))
    record = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    revisit = (F.col("n") >= revisit_from) & (F.col("page_id") < F.col("largest"))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record(F.col("page_id"), F.col("row")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "),
                record(F.col("largest"), F.col("target_row")),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    headers = seen.join(largest, "address").select("page_id", "address", lines.alias("header"))
    archive = Archive(cut(headers, "warc-headers"), cut(payloads, "warc-payloads"))
    discard(seen)
    return archive


def _verified(payloads: DataFrame, *more: Column) -> DataFrame:
    sound = F.sha2("payload", 256) == F.col("address")
    return payloads.select(
        F.when(sound, F.col("address")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))).alias("address"),
        *more,
    )


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.nullif(F.regexp_extract(_field(name), r"<urn:page:(-?\d*):\d+>", 1), F.lit("")).cast("long")


#: Headers of one payload that meet it in one task; a payload with more is repeated as often as that takes.
HEADERS_A_TASK = 1_000


def read_records(archive: Archive) -> DataFrame:
    """(page_id, header, record binary, payload binary): every record's exact bytes and full payload.

    Headers and payloads meet by address.  The headers of a common payload are dealt over salts, and
    the payload repeated once for each, so that no task gets all of them.
    """
    common = archive.headers.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > HEADERS_A_TASK)
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    salts = F.coalesce(F.ceil(F.col("n") / HEADERS_A_TASK), F.lit(1)).cast("long")
    named = archive.headers.join(common, "address", "left").withColumn("salt", F.pmod(F.xxhash64("header"), salts))
    held = _verified(archive.payloads, F.col("payload")).join(common, "address", "left").select("address", "payload", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    block = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return named.join(held, ["address", "salt"]).select("page_id", "header", F.concat(F.encode("header", "UTF-8"), block, end).alias("record"), "payload")


def read_archive(archive: Archive) -> DataFrame:
    """A row per reconstructed record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Lengths and digests come from the reconstructed payload, not from the header; a damaged payload
    is refused, and so is a record whose header names another digest than its payload has.
    """
    digest = base32(F.sha1("payload"))
    parsed = read_records(archive).select(
        _page("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        _field("WARC-Payload-Digest").alias("named"),
    )
    same = F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    refused = F.raise_error(F.lit("header and payload disagree"))
    return parsed.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(refused)).drop("named")
