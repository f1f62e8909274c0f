"""Content-addressed web archive.

Payload bytes are stored once per strong digest (SHA-256; SHA-1 in base 32 is
kept for the record headers), record headers are stored exactly as written,
apart from the payloads, and records are rebuilt by joining headers with
payloads on the digest. Every payload read back is digested again and must
match its address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm.common import materialize
from stockroom.session import scratch_path

VERSION = "WARC/1.1"
# Records carry this date unless another is given: the input has none.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
# Digits of a base-32 number as conv() writes them, and of RFC 4648.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass
class Archive:
    """Folders of an archive: payloads (digest, sha1, payload) and headers
    (page_id, digest, sha1, record_type, header)."""

    spark: SparkSession
    path: str

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payloads")

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: eight groups of 20 bits, four digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _CONV_DIGITS, _RFC_DIGITS)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line ends inside a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archive(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0, date: str = DATE) -> Archive:
    """Write one record per row of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes,
    the one with the largest page_id (then url, null lowest; of wholly equal
    rows any one) is the response, the others are revisits that refer to it;
    smaller payloads are all responses. Null html is an empty payload, null
    ids and urls are written as absent headers, extra columns are ignored.
    Empty input makes an archive without records.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    facts = rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("bytes"),
                        base32_sha1(F.col("payload")).alias("sha1"), F.sha2("payload", 256).alias("digest"))
    # Wholly equal rows become one row with a count, then copies 0, 1, ...
    records = materialize(facts.groupBy("page_id", "url", "bytes", "sha1", "digest").agg(F.count("*").alias("copies")), "warc-facts")
    best = materialize(records.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best")), "warc-best")
    copies = records.join(best, "digest").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = (F.struct("page_id", "url") == F.col("best")) | (
        F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url")))
    is_response = (F.col("bytes") < min_revisit_bytes) | (F.coalesce(own, F.lit(False)) & (F.col("copy") == 0))
    typed = copies.withColumn("record_type", F.when(is_response, F.lit("response")).otherwise(F.lit("revisit")))
    revisit = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit(VERSION + CRLF), _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("copy"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url")),
        _field("X-Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("best.page_id"), F.col("digest"), F.lit(0)))),
        _field("X-Refers-To-Page-ID", F.when(revisit, F.col("best.page_id"))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
        F.lit(CRLF))
    typed.select("page_id", "digest", "sha1", "record_type", header.alias("header")).write.parquet(f"{path}/headers")
    # Equal payloads meet once per task before the shuffle.
    (rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest")
     .agg(F.first("payload").alias("payload"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    return Archive(spark, path)


def header_field(name: str, header: Column) -> Column:
    """Value of a header line (null if absent)."""
    found = F.regexp_extract(header, f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def verified_payloads(archive: Archive) -> DataFrame:
    """(digest, sha1, payload_bytes, payload) of the stored payloads, digested
    anew; a payload that does not match its address fails the job."""
    p = archive.payloads
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return p.select(checked.alias("digest"), base32_sha1(F.col("payload")).alias("sha1"),
                    F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def read_records(archive: Archive) -> DataFrame:
    """One row per record, from its header alone: page_id, target_uri,
    payload_digest, record_type, refers_to, and the payload's address."""
    h = F.col("header")
    return archive.headers.select(
        "digest", "header", header_field("X-Page-ID", h).cast("long").alias("page_id"),
        header_field("WARC-Target-URI", h).alias("target_uri"),
        F.regexp_replace(header_field("WARC-Payload-Digest", h), "^sha1:", "").alias("payload_digest"),
        header_field("WARC-Type", h).alias("record_type"),
        header_field("X-Refers-To-Page-ID", h).cast("long").alias("refers_to"))


def reconstruct(archive: Archive) -> DataFrame:
    """Original records: (page_id, record_type, target_uri, payload_digest,
    refers_to, record bytes, payload). A
    response's record is its header, its payload and the closing line ends; a
    revisit's has no block, its payload comes from the record it refers to."""
    j = read_records(archive).join(verified_payloads(archive).select("digest", "payload"), "digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return j.select("page_id", "record_type", "target_uri", "payload_digest", "refers_to",
                    F.concat(F.col("header").cast("binary"), block, F.lit((CRLF * 2).encode())).alias("record"), "payload")


def archive_report(pages: DataFrame, **options) -> DataFrame:
    """Write the archive, rebuild every record by the join and report
    (page_id, payload_bytes, payload_digest, record_type, refers_to) per row.
    Length and digest are taken from the rebuilt record's payload; the digest
    in its header must agree."""
    records = reconstruct(write_archive(pages, **options))
    sha1 = base32_sha1(F.col("payload"))
    agreed = F.when(sha1 == F.col("payload_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("header digest differs from payload "), F.col("payload_digest"))))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                          agreed.alias("payload_digest"), "record_type", "refers_to")
