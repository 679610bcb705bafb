"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records back by joins.

``write_archive`` writes two Parquet tables under one folder: ``payloads`` (sha256, payload), each distinct
payload once, and ``headers`` (header, sha256, carries), the exact WARC/1.1 header block of every record and whether it carries
its payload. A digest is verified when payloads are stored (equal sha256 must mean equal length and sha1, else the write
fails) and again when they are read. ``reconstruct`` joins them to the original record bytes; revisits have no block, so they need no
payload and a payload that many pages share is not sent to each. ``export_warc`` writes the records as .warc.gz files of at most
``file_bytes`` before compression (a larger record has a file of its own); ``read_warc`` reads them back, cut by Content-Length, and
``page_digests`` reports from what it read alone: lengths and digests of the blocks, kinds and references from the headers.

Of the records with equal payloads of at least ``min_revisit`` bytes that with the smallest page_id is the response and the others
revisit it; records of smaller payloads are all responses. Null html is an empty payload, a null url an empty target, a null page_id has no
Page-ID field, and its row is a response. Rows that repeat a page_id give a record each; of repeated rows
with the smallest page_id all are responses. Empty tables give empty archives. CR or LF in a url would end a header line, so they are
percent-encoded there. Other columns than page_id, url and html are not read. Payloads are read whole, up to the 2 GB of a Spark value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, few_files, materialize, new_path, released, ship, table

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1 << 25
BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32HEX, BASE32)


def _records(pages: DataFrame, min_revisit: int) -> DataFrame:
    """Small columns of each record, without its payload."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"),
        F.octet_length(payload).cast("long").alias("length"),
        F.sha2(payload, 256).alias("sha256"),
        base32_sha1(payload).alias("sha1"),
    )
    first = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.min("length").alias("l0"), F.max("length").alias("l1"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"))
    same = (F.col("l0") == F.col("l1")) & (F.col("s0") == F.col("s1"))
    first = first.withColumn("first_id", F.when(same, F.col("first_id")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the sha256 "), F.col("sha256")))))
    revisit = (F.col("length") >= min_revisit) & (F.col("page_id") > F.col("first_id"))
    return rows.join(first, "sha256").select("page_id", "url", "length", "sha256", "sha1", F.when(revisit, F.col("first_id")).alias("refers_to"))


def _record_id(page_id: Column, sha256: Column) -> Column:
    """Rows that repeat a page_id with another payload are other records."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), sha256))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _header() -> Column:
    """Exact bytes of the header block, with the blank line that ends it. A revisit has no body of its own."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    is_revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("sha256")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("sha256")))).otherwise(""),
        F.coalesce(F.concat(F.lit("\r\nPage-ID: "), F.col("page_id").cast("string")), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(is_revisit, F.lit("0")).otherwise(F.col("length").cast("string")),
        F.lit("\r\n\r\n"),
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Write both tables of the archive under ``path``."""
    spark = pages.sparkSession
    few_files(_records(pages, min_revisit).select(_header().alias("header"), "sha256", F.col("refers_to").isNull().alias("carries"))).write.parquet(f"{path}/headers")
    headers = spark.read.parquet(f"{path}/headers")
    # one row of each payload: the least (page_id, url) that holds it, found on small columns only
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    body = pages.select(payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))
    if headers.agg(F.count(F.lit(1)) == F.count_distinct("sha256")).first()[0]:
        once = body  # no payload repeats: nothing to exchange
    else:
        # copies meet per task first, so a payload that a third of the pages hold is moved once a task at most
        once = body.groupBy("sha256").agg(F.first("payload").alias("payload"))
    few_files(once.select("sha256", "payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """header, sha256, record (its exact bytes in the archive)."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("sha256")
    stored = stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")))
    headers = spark.read.parquet(f"{path}/headers")
    whole = lambda body: F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record")
    full = headers.filter("carries").join(stored, "sha256").select("header", "sha256", whole(F.col("payload")))
    return full.union(headers.filter("NOT carries").select("header", "sha256", whole(F.lit(b""))))


def export_warc(records: DataFrame, out: str, file_bytes: int = FILE_BYTES) -> None:
    """.warc.gz files of the records, each of at most file_bytes before compression or of one record."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column("record"):
                if held and size + record.as_buffer().size > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
                held.append(record.as_py())
                size += len(held[-1])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    ship(records.sparkSession)
    files = records.select("record").mapInArrow(released(pack), "value binary")
    # the last line feed of a file is the writer's line end
    text = files.select(F.expr("substring(value, 1, length(value) - 1)").cast("string").alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(out)


def _parsed(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, block) of a file's records. Whole files are small, see export_warc."""
    plain, at = memoryview(zlib.decompress(content, 31)), 0
    data = plain.obj
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end].decode()
        n = int(next(x for x in head.split("\r\n") if x.startswith("Content-Length: ")).split(": ", 1)[1])
        if len(data) < end + n + 4 or plain[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        yield head, data[end : end + n]
        at = end + n + 4


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """header, block of the records of exported files, cut by Content-Length, so any bytes may be in a block."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("header", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                heads, blocks, size = [], [], 0
                for head, block in _parsed(content.as_py()):
                    heads.append(head)
                    blocks.append(block)
                    size += len(block)
                    if size > FILE_BYTES // 8:
                        yield pa.RecordBatch.from_pydict({"header": heads, "block": blocks}, kind)
                        heads, blocks, size = [], [], 0
                yield pa.RecordBatch.from_pydict({"header": heads, "block": blocks}, kind)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    return files.select("content").mapInArrow(released(parse), "header string, block binary")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok of the records (header, block) that were read back.

    Lengths and digests are those of the blocks; a revisit has them from the response it refers to."""
    read = records.select(
        _field("Page-ID").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Refers-To").alias("target"),
        F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]*)\r\n", 1).alias("said"), F.octet_length("block").cast("long").alias("bytes"), base32_sha1(F.col("block")).alias("digest"),
    )
    # written: the files are parsed once, and the join below exchanges both sides, so that a response with many revisits can be split
    read = materialize(read, "read")
    answers = read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.min("page_id").alias("refers_to"), F.first("bytes").alias("of_bytes"), F.first("digest").alias("of_digest"))
    rows = read.join(materialize(answers, "answers"), "target", "left")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("of_digest")).otherwise(F.col("digest"))
    return rows.select("page_id", F.when(revisit, F.col("of_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"), F.coalesce(F.col("said") == digest, F.lit(False)).alias("digest_ok"))


def op7_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, its record put together and written, and the written archive read back."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    export_warc(reconstruct(spark, path), f"{path}/files")
    for part in ("payloads", "headers"):
        drop_path(spark, f"{path}/{part}")
    return page_digests(read_warc(spark, f"{path}/files")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (
  SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS h, sha1(t) AS s, min(page_id) OVER (PARTITION BY t) AS lead
  FROM p)
SELECT page_id, payload_bytes,
  translate(to_base(CAST('0x' || substr(s, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(s, 11, 10) AS BIGINT), 32, 8)
    || to_base(CAST('0x' || substr(s, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(s, 31, 10) AS BIGINT), 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id > lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > lead THEN lead END AS refers_to
FROM d"""
