"""Incremental forms of the upsert and of the page cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagetrail.operators.evaluate import upsert
from pagetrail.shared import children, exists, removed, written


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """K4 for a stream into a small table, which every micro-batch writes as a whole (a large one: upsert_buckets_stream): it replaces the rows of its keys.

    Of rows of a batch with equal keys the one with the largest ``order`` column stays, without it the largest row, so which one does
    not depend on the order of arrival. Every batch writes a version of its own beside the last, named by the batch, so a batch that is run again after a
    failure reads the same version and writes the same result."""
    spark = rows.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        last = F.max_by(F.struct("*"), F.struct(*([order] if order else []), "*")).alias("last")
        new = batch.groupBy(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]).agg(last).select("last.*")
        old = spark.read.schema(new.schema).parquet(f"{path}/v{epoch - 1}") if epoch else spark.createDataFrame([], new.schema)
        upsert(old, new, keys).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_buckets_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64, order: str | None = None) -> StreamingQuery:
    """K4 for a stream into a large table: a micro-batch rewrites only the buckets that its keys fall into.

    The table is cut into buckets by a hash of the keys. Batch e writes new versions of its buckets under v{e} and then, as the last thing, a manifest that names the version of
    every bucket; so a batch that fails half way leaves the table as it was, and run again it reads the manifest before its own and writes the same. Versions that neither the
    last manifest nor the one before names are deleted. Of rows of a batch with equal keys the one with the largest ``order`` column stays, without it the largest row.
    read_upserted() gives the table."""
    spark = rows.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        last = F.max_by(F.struct("*"), F.struct(*([order] if order else []), "*")).alias("last")
        new = written(batch.groupBy(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]).agg(last).select("last.*").withColumn("bucket", bucket), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        epochs = [e for e in _epochs(spark, path) if e < epoch]
        at = _manifest(spark, path, epochs[-1]) if epochs else {}
        if touched:
            old = _versions(spark, path, {b: v for b, v in at.items() if b in touched}, new.schema)
            upsert(old, new, keys).repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{epoch}")
        now = at | dict.fromkeys(touched, epoch)
        spark.createDataFrame([(b, v) for b, v in now.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifests/{epoch}")
        removed(spark, new._written_path)
        named = set(now.values()) | set(at.values())
        for name in children(spark, path):
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) not in named and int(name[1:]) < epoch:
                removed(spark, f"{path}/{name}")
        for e in epochs[:-1]:
            removed(spark, f"{path}/manifests/{e}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Batches whose manifest is whole, in order."""
    return sorted(int(n) for n in children(spark, f"{path}/manifests") if n.isdigit() and exists(spark, f"{path}/manifests/{n}/_SUCCESS"))


def _manifest(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{path}/manifests/{epoch}").collect()}


def _versions(spark: SparkSession, path: str, at: dict[int, int], schema: StructType) -> DataFrame:
    """The rows of the given buckets in the given versions."""
    own = [f for f in schema.fields if f.name != "bucket"]
    parts = [spark.read.schema(StructType(own)).parquet(*[f"{path}/v{v}/bucket={b}" for b, w in at.items() if w == v]).withColumn("bucket", F.regexp_extract("_metadata.file_path", "/bucket=([0-9]+)/", 1).cast("int")) for v in sorted(set(at.values()))]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_upserted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K4: the table that upsert_buckets_stream() keeps, as its last whole batch left it; empty before the first."""
    epochs = _epochs(spark, path)
    kind = StructType.fromDDL(f"{schema}, bucket int")
    return _versions(spark, path, _manifest(spark, path, epochs[-1]) if epochs else {}, kind).drop("bucket")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """A18 for a stream: calls by status in event-time windows, late rows within the delay counted."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"))
