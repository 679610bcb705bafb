"""Replies of an outside model for each page, kept in waves, so that a run that ends early loses one wave and none is asked twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.operators.models import RESULT, Answerer, call_model
from pagetrail.shared import exists, removed, written

from .readers import pages_left


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """K7: (pg, RESULT, wave, status) of every page that was asked, in all runs; a page that failed and was asked again has several rows."""
    schema = f"pg int, {RESULT}, wave int, status string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def cached_replies(spark: SparkSession, path: str) -> DataFrame:
    """K7: (pg, RESULT) of the pages that have a reply, one each: should two runs have asked a page at once, the one of fewest attempts."""
    ok = read_attempts(spark, path).filter("status = 'ok'")
    rest = F.struct("attempt", "text", *[c for c in ok.columns if c not in ("pg", "attempt", "text", "wave", "status")])
    return ok.groupBy("pg").agg(F.min(rest).alias("r")).select("pg", *[F.col(f"r.{f.split()[0]}") for f in RESULT.split(", ")])


def page_status(pages: DataFrame, path: str) -> DataFrame:
    """(pg, status, attempts, error): ok, failed or missing for every page; the error is that of the last failure."""
    seen = read_attempts(pages.sparkSession, path).groupBy("pg").agg(F.max(F.col("status") == "ok").alias("ok"), F.sum("attempt").alias("attempts"), F.max_by("error", "wave").alias("error"))
    status = F.when(F.col("ok"), "ok").when(F.col("ok").isNotNull(), "failed").otherwise("missing")
    return pages.select("pg").distinct().join(seen, "pg", "left").select("pg", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(~F.coalesce("ok", F.lit(False)), F.col("error")).alias("error"))


def fill_cache(pages: DataFrame, path: str, client: Answerer, wave_pages: int = 1000, **options) -> DataFrame:
    """Asks the client (see call_model) for every page (pg, prompt) that has no reply under ``path`` yet, and returns page_status().

    The pages that are left are dealt into waves of about wave_pages; each wave is one job that appends its replies and, beside them, an error row
    for each page that failed. A run that is killed has lost the wave at hand only; the next one asks for what is left and for the failures. Waves are told
    by a number that goes on counting, so that the last error of a page is known."""
    spark = pages.sparkSession
    left = pages_left(pages.select(F.col("pg").cast("int").alias("pg"), "prompt"), cached_replies(spark, path))
    waves = -(-left.count() // wave_pages)
    begun = read_attempts(spark, path).agg(F.max("wave")).first()[0]
    begun = 0 if begun is None else begun + 1
    mine = F.pmod(F.xxhash64("pg"), F.lit(max(1, waves)))
    todo = written(left.select("pg", "prompt", mine.alias("of")), "pages-left")
    for wave in range(waves):
        rows = call_model(todo.filter(F.col("of") == wave).drop("of"), client, **options).drop("prompt")
        rows = rows.withColumn("wave", F.lit(begun + wave)).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
        rows.write.mode("append").partitionBy("status").parquet(path)
    removed(spark, todo._written_path)
    return page_status(pages, path)
