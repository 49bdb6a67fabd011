"""Content-addressed WARC archives: exact record headers apart, each payload stored once.

An archive has two tables. ``payloads`` holds every distinct payload once, under the SHA-256 of its
bytes. ``headers`` holds one row per record with its header block, byte for byte, and the payload's
digest. A record is rebuilt by joining the two. All of it is DataFrame work: hashing, base-32,
header text and parsing are built-in expressions.

Of records with equal payloads the one with the largest id is the response; the others are revisits
that refer to it and, as in the WARC revisit profile, carry no block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.workspace import Workspace

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What some reader takes for the end of a line, percent-encoded in URLs.
_BREAKS = (("\r", "%0D"), ("\n", "%0A"), ("\v", "%0B"), ("\f", "%0C"), ("\x1c", "%1C"), ("\x1d", "%1D"), ("\x1e", "%1E"), ("\x85", "%C2%85"), ("\u2028", "%E2%80%A8"), ("\u2029", "%E2%80%A9"))
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base 32 of 40 hexadecimal digits, five of which make four digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def record_id(page_id: Column) -> Column:
    """A URN made from the page's id alone, so that revisits can name their response."""
    digits = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    cut = [F.substring(digits, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write the archive of ``pages``; payloads of fewer than ``least_bytes`` bytes never make revisits.

    A null payload is empty and a null URL is left out of the header; line breaks of any kind in a URL
    are percent-encoded. Payloads are whole, however long; other columns are ignored, whatever their
    names; an empty table makes an empty archive. Rows that repeat the largest id
    of a payload are each a response; a null id is a revisit beside any other id and a response
    otherwise.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    hashed = source.select("page", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), "payload")
    # a payload meets its copies within each task first; only one of them travels
    stored = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page").alias("response"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.min("sha1").alias("sha1"), F.max("sha1").alias("other"))
    same = (F.col("least") == F.col("most")) & (F.col("sha1") == F.col("other"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads share the digest "), F.col("digest"))))
    stored.select("digest", checked.alias("payload"), "response").write.option("compression", "zstd").parquet(f"{path}/payloads")
    responses = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "response")
    joined = hashed.drop("payload").join(responses, "digest")
    revisit = (F.col("bytes") >= least_bytes) & F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response"))
    joined = joined.withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.col("url")
    for char, code in _BREAKS:
        url = F.replace(url, F.lit(char), F.lit(code))
    header = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", record_id(F.col("page"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("WARC-Page-ID", F.col("page").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("response"))), line("WARC-Refers-To-Page-ID", F.col("response").cast("string")), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    joined.select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def field(header: Column, name: str) -> Column:
    """Value of a header field, null if absent. Lines end at CR LF only, whatever else a value holds."""
    return F.nullif(F.regexp_extract(header, rf"(?s)\r\n{name}: (.*?)\r\n", 1), F.lit(""))


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, bytes, sha1 base32): each payload's SHA-256 is computed again and must be its key."""
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    key = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return stored.select(key.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("sha1"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, block): every record rebuilt; a revisit's block is empty but its payload is the full one."""
    headers = spark.read.parquet(f"{path}/headers")
    joined = headers.join(verified_payloads(spark, path), "digest")
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", "payload", block.alias("block"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from headers and stored bytes."""
    headers = spark.read.parquet(f"{path}/headers")
    # only lengths and digests of the payloads travel
    facts = verified_payloads(spark, path).select("digest", "bytes", "sha1")
    h = F.col("header")
    agreed = F.when(field(h, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(F.raise_error(F.lit("a header names another payload digest")))
    return headers.join(facts, "digest").select(
        field(h, "WARC-Page-ID").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), agreed.alias("payload_digest"),
        field(h, "WARC-Type").alias("record_type"), field(h, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


def export(spark: SparkSession, path: str, to: str) -> None:
    """Write plain WARC files: Spark's text writer puts the blank lines that end a record."""
    text = F.concat(F.col("header"), F.decode("block", "UTF-8"))
    records(spark, path).select(text.alias("value")).write.option("lineSep", "\r\n\r\n").text(to)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record in plain or gzipped WARC files; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                heads, blocks = [], []
                for head, block in parse(raw.as_buffer().to_pybytes()):
                    heads.append(head.decode("utf-8", "replace"))
                    blocks.append(block)
                    if len(heads) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["header", "block"])
                        heads, blocks = [], []
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, block binary")


def parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block with its blank line, block) of each record, by Content-Length."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at) + 4
        length = next(int(x.split(b":", 1)[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield data[at:end], data[end : end + length]
        at = end + length
        while data.startswith(b"\r\n", at):
            at += 2


def account(rebuilt: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``records``, whose lengths and digests must agree with their headers."""
    h = F.col("header")
    digest = base32(F.sha1("payload"))
    sound = (field(h, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (field(h, "Content-Length") == F.octet_length("block").cast("string"))
    return rebuilt.select(
        field(h, "WARC-Page-ID").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, digest).otherwise(F.raise_error(F.lit("a record does not match its header"))).alias("payload_digest"),
        field(h, "WARC-Type").alias("record_type"), field(h, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archive into the shared folder, rebuild every record and tell what it holds; see ``write`` and ``account``.

    One row per row of ``pages``; an empty table gives an empty result.
    """
    path = Workspace(pages.sparkSession, "warc").path("archive")
    write(pages, path, id_col, url_col, payload_col, least_bytes)
    return account(records(pages.sparkSession, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
             max(page_id) OVER (PARTITION BY body) AS response FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM h
"""
