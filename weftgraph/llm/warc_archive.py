"""Content-addressed WARC archive.

Two tables make an archive. ``payloads`` holds every distinct payload once,
under its SHA-256; ``headers`` holds one row per record with the exact header
bytes and the digest of what they head. A record's bytes are never stored
twice and are rebuilt by joining both tables. Digests are computed again when
the archive is read, and a payload that does not match fails the read.

Of records with equal payloads (of at least ``min_revisit`` bytes) that with
the largest id is the response and the others are revisits of it.

Scale: payloads are shuffled once, by digest, and copies shrink to one before
that; everything else moves ids and digests only. All work is JVM-side.

Defined results: a null payload is an empty one. A null id counts as smaller
than any other and is written as an empty record id. Rows that repeat both id
and payload are records of the same kind, so all rows that hold a group's
largest id are responses. Payloads of any length are stored whole. Columns other than the three named are ignored. An
empty table makes an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import only

_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
#: WARC-Date of records whose source has no fetch time.
UNDATED = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def write_archive(records: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Write records (record_id long, url string, payload binary) under path."""
    rows = only(records, record_id="record_id", url="url", payload="payload").withColumn("payload", F.coalesce("payload", F.lit(b"")))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    stored = rows.groupBy("sha256").agg(F.max("record_id").alias("owner"), F.first("payload").alias("payload"))
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")

    spark = records.sparkSession
    owners = spark.read.parquet(f"{path}/payloads").select("sha256", "owner")
    slim = rows.select("record_id", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    headed = slim.join(owners, "sha256")
    revisit = (F.col("payload_bytes") >= min_revisit) & ~F.col("record_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = F.concat_ws(
        END,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("record_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(UNDATED)),
        # a line end in a url would end its header early
        F.concat(F.lit("WARC-Target-URI: "), F.translate(F.col("url"), "\r\n", "")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("owner")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit(""),
        F.lit(""),
    )
    headed.select(_bytes(lines).alias("header"), "sha256").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive as far as headers and verified digests tell.

    Columns: record_id, url, record_type, refers_to, payload_bytes,
    payload_digest, sha256. The last three come from the stored payload bytes.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("sha256").alias("key"), "payload")
    matches = F.sha2("payload", 256) == F.col("key")
    checked = payloads.select(
        "key",
        F.when(matches, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("key"))).cast("long")).alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    headers = spark.read.parquet(f"{path}/headers").select("sha256", F.decode("header", "UTF-8").alias("h"))
    field = lambda name: F.nullif(F.regexp_extract("h", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    number = lambda name: F.nullif(F.regexp_extract("h", rf"\r\n{name}: <urn:record:(-?\d*)>\r\n", 1), F.lit("")).cast("long")
    parsed = headers.select("sha256", number("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("stated"))
    joined = parsed.join(checked, F.col("sha256") == F.col("key"), "left")
    agreed = F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    digest = F.when(agreed, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("sha256"))))
    return joined.select("record_id", "url", "record_type", "refers_to", "payload_bytes", digest.alias("payload_digest"), "sha256")


def original_records(spark: SparkSession, path: str, revisits_full: bool = False) -> DataFrame:
    """Rebuild the records' bytes: header, payload and the closing line ends.

    A revisit has no payload of its own; with revisits_full its row carries the
    payload that it stands for beside its bytes.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("sha256").alias("key"), "payload")
    rows = spark.read.parquet(f"{path}/headers").join(payloads, F.col("sha256") == F.col("key"), "left")
    is_revisit = F.instr(F.decode("header", "UTF-8"), "\r\nWARC-Type: revisit\r\n") > 0
    own = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header"), own, F.lit(b"\r\n\r\n"))
    return rows.select("header", record.alias("record"), *([F.col("payload")] if revisits_full else []))
