"""Shared folder, written tables and input normalisation for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="pagetrail-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context, so that none needs it installed.

    Arrow batches are set to at most BATCH_ROWS rows, as documents are long: it bounds what a worker and the JVM hold."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_pagetrail_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="pagetrail-zip-")) / "pagetrail.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"pagetrail/{f.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._pagetrail_shipped = True


def released(run):
    """run for mapInArrow, with the memory it used given back at the task's end: Python workers outlive tasks and stages."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        few_files(df).write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside give their shuffle files back when they end, not when the driver happens to collect garbage.

    For writes, whose plan is never run again. The session keeps its own setting afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def few_files(df: DataFrame) -> DataFrame:
    """df in at most eight partitions for each core of the cluster: more and smaller files cost more than they save."""
    return df.coalesce(8 * df.sparkSession.sparkContext.defaultParallelism)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._written_path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id BIGINT, text STRING): the two columns the operators read; a null text counts as empty."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """Hash of a text, null counting as empty. With the id it tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text_key) is in gone; all columns kept, whatever they are called.

    The row travels as one struct, so no column of docs can clash with those of the join. Rows without id can be named."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), text_key(docs["text"]).alias("text_key"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    left = rows.join(gone, rows["id"].eqNullSafe(gone["gone_id"]) & (rows["text_key"] == gone["gone_key"]), "left_anti")
    return left.select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal digits, mod k; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))
