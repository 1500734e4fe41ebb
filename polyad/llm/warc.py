"""WARC archive with content addressing.

A payload is stored once under its SHA-256; every record's exact header stands in a table of its own with the digest as
the link, and records come back through a join. Archive folder:

* payloads/ (Parquet): digest BINARY (SHA-256), payload BINARY, payload_bytes, payload_sha1, response_id, n (records)
* headers/  (Parquet): page_id, digest, share, header STRING (the record's header block with its empty line)

A record is put together again by a join of its header with its payload; what a reader is told of a record comes from
the bytes that were joined and from the header, which are held against each other: a payload that is missing, or whose SHA-256,
SHA-1 or length isn't what the archive says, raises.

Of the records whose payloads are equal and have `min_revisit` bytes or more, the one with the largest id is the response
and the others are revisits that refer to it; shorter payloads are always responses.

Defined cases: a null payload is empty; a null id or URL is written empty; the same row repeated gives the same record
each time (equal ids share a type); where all ids of a group are null, all are responses; an empty table gives an empty
archive; carriage returns and line feeds in a URL are percent-encoded, so that they can't end a header line. Nothing else ends one: other
line separators of Unicode stand in a URL as they are, and what follows them is read as part of the URL.

Scale: the payload bytes are shuffled once to be written, after equal ones in a task have become one (partial aggregation), so a payload
that a third of the rows share costs a row per task, and once to be read. Records of one payload are dealt to shares of about SHARE
records, and the payload goes to each of its shares, so no key of either join holds more; nothing is broadcast but the facts of hot payloads
(under a thousand rows of numbers and digests). Both tables are committed by Spark's writer, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, materialise, shared_dir, store, text_bytes

DATE = "2024-01-01T00:00:00Z"
#: Records that meet one copy of their payload.
SHARE = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, date: str = DATE) -> str:
    """Write a record for each row of df into the archive folder at path; returns path."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), text_bytes(F.col(payload_col)).alias("payload"))
    keyed = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("digest"))
    payloads = (
        keyed.groupBy("digest")
        .agg(F.first("payload").alias("payload"), F.max("page_id").alias("response_id"), F.count("*").alias("n"), F.min(F.length("payload")).alias("least"), F.max(F.length("payload")).alias("most"), F.min(F.sha1("payload")).alias("sha_least"), F.max(F.sha1("payload")).alias("sha_most"))
        # two payloads under one digest would differ in length or in the second digest: stop rather than lose one
        .select("digest", "payload", F.when((F.col("least") == F.col("most")) & (F.col("sha_least") == F.col("sha_most")), F.col("most").cast("long")).otherwise(F.raise_error(F.lit("digest collision"))).alias("payload_bytes"), F.col("sha_least").alias("payload_sha1"), "response_id", "n")
    )
    store(payloads, f"{path}/payloads")
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload_bytes", "payload_sha1", "response_id", "n")
    linked = join_skewed(materialise(keyed.select("page_id", "uri", "digest"), "warc-links"), stored, "digest", "n")
    revisit = (F.col("payload_bytes") >= min_revisit) & ~F.coalesce(F.col("page_id") == F.col("response_id"), F.col("response_id").isNull())
    safe_uri = F.regexp_replace(F.regexp_replace(F.coalesce("uri", F.lit("")), "\r", "%0D"), "\n", "%0A")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit("<urn:page:"), number("page_id"), F.lit(">")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe_uri),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("payload_sha1")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.lit("<urn:page:"), number("response_id"), F.lit(">")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    share = F.pmod(F.xxhash64("page_id", "uri"), F.ceil(F.col("n") / SHARE)).cast("int")
    store(linked.select("page_id", "digest", share.alias("share"), header.alias("header")), f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id, header, payload (whole, for revisits too), payload_bytes, payload_digest, record_type, refers_to.

    Lengths and SHA-1 are computed from the payload that was joined to the header. A damaged archive raises.
    """
    # (?d): a line feed alone ends a line
    field = lambda name: F.regexp_extract("header", rf"(?dm)^{name}: (.*?)\r?$", 1)
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SHARE).cast("int") - 1)).alias("share"))
    joined = spark.read.parquet(f"{path}/headers").join(stored, ["digest", "share"], "left")
    whole = joined.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), field("WARC-Type").alias("record_type"))
    length = F.when(F.col("record_type") == "revisit", F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    intact = (F.unhex(F.sha2("payload", 256)) == F.col("digest")) & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == field("WARC-Payload-Digest")) & (length.cast("string") == field("Content-Length"))
    refers = F.regexp_extract("header", r"(?dm)^WARC-Refers-To: <urn:page:(-?\d+)>\r?$", 1)
    size = F.when(F.coalesce(intact, F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("record damaged")))
    return whole.select("page_id", "header", "payload", size.alias("payload_bytes"), "payload_digest", "record_type", F.when(refers != "", refers.cast("long")).alias("refers_to"))


def export_warc(spark: SparkSession, path: str, out: str, compression: str = "gzip") -> None:
    """Write the archive's records as standard WARC files: header, block, and two line ends after each record.

    Spark's text writer puts the record's bytes as they are, with its line separator as the end of a record, so task
    commits and any Hadoop file system work as for other output.
    """
    rows = read_archive(spark, path)
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), block).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file's bytes, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(re.findall(r"^([\w-]+): (.*?)\r?$", data[at:end].decode(), re.M))
        size = int(fields["Content-Length"])
        yield fields, data[end : end + size]
        at = end + size + 4


def warc_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = write_archive(pages, shared_dir(spark, "warc"))
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""
