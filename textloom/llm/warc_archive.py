"""Content-addressed web archive: payloads once by digest, record headers apart.

``write_archive`` lays down two tables. ``payloads`` holds each different
payload once, under its SHA-256. ``records`` holds the exact header block of
every record (WARC/1.1, ``response`` or ``revisit``) with the digest of the
payload it stands for. ``read_archive`` parses the headers and joins the
payloads back; ``warc_bytes`` gives the original records byte for byte.

Digests are verified: when payloads are gathered under a digest, all must agree
in length and in a second hash, and each stored payload is hashed again when
the archive is read. A mismatch raises an error.

Copies of a payload meet in partial aggregates, so a payload that a third of
all pages share is sent once by each task, and stored once.

Defined results: a null html is an empty payload; payloads below
``min_revisit`` bytes are responses even when they repeat; of equal longer ones
the smallest page_id is the response, rows without id after all others; rows
that repeat an id are records of their own; line breaks in URLs are written as
spaces and null URLs as nothing; an empty table gives an empty archive. Extra
columns are left out, so they never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
NAME = "urn:textloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{NAME}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """The header block of a record, with the empty line that ends it."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    return F.concat(
        F.lit("WARC/1.1" + EOL),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(EOL),
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row of ``pages`` below ``path``."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    second = F.xxhash64("payload", "n")
    store = base.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("page_id").alias("first"), F.min(second).alias("low"), F.max(second).alias("high")
    )
    clash = F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest")))
    store.select("digest", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(clash.cast("binary")).alias("payload"), "first").write.option(
        "compression", "zstd"
    ).parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("digest").alias("d"), "first")
    keyed = base.select("page_id", "url", "digest", "n")
    records = keyed.join(first, keyed.digest == first.d)
    again = (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = records.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    records.select(F.col("digest"), _header(date).alias("header")).write.parquet(f"{path}/records")


def _field(name: str, value: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, header of every record.

    Each payload is hashed once, where it is stored, and compared with its
    digest; ``with_payload`` also joins its bytes to every record.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(good, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("long"))
    stored = stored.select(F.col("digest").alias("d"), checked.alias("payload_bytes"), *["payload"] * with_payload)
    records = spark.read.parquet(f"{path}/records")
    records = records.select(
        _field("WARC-Record-ID", f"<{NAME}(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", f"<{NAME}(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"),
        "header",
    )
    return records.join(stored, F.col("payload_digest") == F.col("d")).drop("d")


def warc_bytes(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, the columns ``keep`` and the record as it stands in a WARC file, of records read with their payloads."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", *keep, F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))
