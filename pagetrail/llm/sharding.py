"""Histogram sort: shards of near-equal bytes from exactly counted key boundaries, DataFrame functions only.

The 63-bit sort key is 31 bits of md5(text) above 32 bits of md5(doc_id): equal texts lie side by side,
yet a group of copies larger than a shard is still cut, by document. Each round counts the exact bytes at
4096 probe boundaries inside every interval that still holds a splitter, in one aggregation; a splitter is
settled when the bytes in its interval are within the tolerance (at 0, when a single key is left). Rows are
then exchanged once, by shard and a slice of the document hash, to number the slots.

Null text counts as empty, a null doc_id as an empty id. Rows with equal id and text have equal keys and
stay in one shard. An empty table gives an empty result. With fewer keys than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

OVERHEAD = 8
KEY_BITS = 63
STEP = 12
SLICES = 64


def _md5_32(col):
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key): what sharding needs of each row, without the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    ident = F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.shiftleft(F.shiftright(_md5_32(text), 1), 32) + _md5_32(ident)).alias("key"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.0) -> list[int]:
    """For i in 1..shards-1 the first key of shard i, as a number of KEY_BITS bits.

    Shard i starts at the first key with at least i/shards of all bytes below it. tolerance: bytes, as a share
    of a mean shard, that a splitter may be off.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [1 << KEY_BITS] * (shards - 1)
    goal = [-(-i * total // shards) for i in range(1, shards)]
    slack = tolerance * total / shards
    # interval of each splitter: [prefix << width, (prefix + 1) << width), and the bytes below it
    place = {i: (0, 0) for i in range(shards - 1)}
    found: dict[int, int] = {}
    width = KEY_BITS
    while place:
        step = min(STEP, width)
        narrow = _count(rows, sorted({p for p, _ in place.values()}), width, step)
        width -= step
        for i, (prefix, below) in list(place.items()):
            for child, held in narrow[prefix]:
                # the first key with at least goal[i] bytes below it lies after the row that reaches the goal
                if below + held >= goal[i]:
                    break
                below += held
            place[i] = (child, below)
            if width == 0 or held <= slack:
                found[i] = (child + 1) << width
                del place[i]
    return [found[i] for i in range(shards - 1)]


def _count(rows: DataFrame, prefixes: list[int], width: int, step: int) -> dict[int, list[tuple[int, int]]]:
    """Exact bytes of each non-empty child interval, at most len(prefixes) << step rows, by parent."""
    if width < KEY_BITS:
        rows = rows.filter(_top(width).isin(prefixes))
    out: dict[int, list[tuple[int, int]]] = {p: [] for p in prefixes}
    for child, held in rows.groupBy(_top(width - step).alias("child")).agg(F.sum("size")).collect():
        out[child >> step].append((child, held))
    return {p: sorted(v) for p, v in out.items()}


def _top(drop: int):
    """The key without its lowest ``drop`` bits."""
    return F.shiftright("key", drop)


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: see the module's docstring."""
    rows = materialize(keyed(docs), "shard-keys")
    cuts = splitters(rows, shards, tolerance)
    shard = F.lit(0)
    for c in cuts:  # a row is in shard i when i splitters are at or below its key
        shard = shard + (F.lit(min(c, (1 << 63) - 1)) <= F.col("key")).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("slice", (F.shiftright("key", 33 - SLICES.bit_length()) % SLICES).cast("int"))
    # at most shards * SLICES counts: slots start after the slices before
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "slice", "base")
    w = Window.partitionBy("shard", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        placed.withColumn("rn", F.row_number().over(w))
        .join(F.broadcast(before), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return histogram_shards(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS tab),
keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
             lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) AS crc,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) >> 1 AS hi,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS lo
  FROM documents, crc),
runs AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY hi, lo RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY hi, lo) AS own
  FROM keyed),
placed AS (
  SELECT *, CAST(least(23, (CAST(upto - own AS HUGEINT) * 24) // total) AS INTEGER) AS shard FROM runs)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY lo >> 26, hi, lo, doc_id) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""
