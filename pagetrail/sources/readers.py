"""Readers of the artefacts that the pipeline exchanges."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrail.shared import children, exists

FACT = "t string, m string, s string, p string, v double, u string, pg int"
SECTION = "id string, title string, level int, page_from int, page_to int, text string"
PAGE = (
    "pg int, model string, finish string, attempt int, usage struct<prompt:bigint,completion:bigint,cost:double>, "
    "objects array<struct<kind:string,title:string,has_numbers:boolean,rows:int,cols:int>>, "
    "records array<struct<t:string,m:string,s:string,p:string,v:string,u:string>>"
)


def read_json_array(spark: SparkSession, path: str, schema: str = SECTION) -> DataFrame:
    """A file that holds one JSON array; seq keeps its order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("seq", "x"))
    return rows.select("seq", "x.*")


def _fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str = FACT) -> DataFrame:
    """A record a line; trailing commas, lone brackets and blank lines do not count, so a printed array reads as well. A line that
    is no record fails the read."""
    line = F.regexp_replace(F.trim("value"), ",+$", "")
    rows = spark.read.text(path).select(line.alias("line")).filter(~F.col("line").isin("", "[", "]", "[]"))
    return rows.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_jsonl(spark: SparkSession, path: str, schema: str = FACT) -> DataFrame:
    """A record a line, blank lines skipped; a line that is no record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pages(spark: SparkSession, path: str, n_pages: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, objects, status) of a folder with one JSON file a page, named by the page's number, such as p003.json.

    A page's status is ok, damaged (its file is no JSON object of the schema, cut short or empty) or missing (no file); a damaged file gives neither
    facts nor objects. Facts without a number are dropped. A name without a number gives the page by what the file says; if that says
    nothing, the page is NULL and damaged. Of several files of a page the first by name counts."""
    name = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    files = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("value"), name.alias("name"))
    parsed = F.from_json("value", PAGE + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    own = F.regexp_extract("name", r"([0-9]+)[^0-9]*$", 1).try_cast("int")
    whole = files.withColumn("x", parsed).select("name", F.coalesce(own, F.col("x.pg")).alias("pg"), (F.col("x").isNotNull() & F.col("x._broken").isNull() & F.trim("value").startswith("{")).alias("ok"), "x")
    first = whole.groupBy("pg").agg(F.min_by(F.struct("ok", "x"), "name").alias("f")).select("pg", "f.ok", "f.x")
    ok = first.filter("ok")
    facts = ok.select("pg", F.explode("x.records").alias("r")).filter("r IS NOT NULL").select("r.t", "r.m", "r.s", "r.p", F.col("r.v").try_cast("double").alias("v"), "r.u", "pg").filter("v IS NOT NULL")
    objects = ok.select("pg", F.explode("x.objects").alias("o")).filter("o IS NOT NULL").select("pg", "o.*")
    # files without a byte are left out by the reader, but not by the folder
    found = [int(m[1]) for m in (re.search(r"([0-9]+)[^0-9]*$", re.sub(r"\.[^.]*$", "", c)) for c in children(spark, path)) if m and len(m[1]) < 10]
    there = spark.createDataFrame([(p,) for p in sorted(set(found))], "pg int").join(first, "pg", "left_anti").withColumn("ok", F.lit(False))
    first = first.unionByName(there, allowMissingColumns=True)
    every = spark.range(1, n_pages + 1).select(F.col("id").cast("int").alias("pg"))
    state = F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "ok").otherwise("damaged")
    good = lambda c: F.when(F.col("ok"), F.col(f"x.{c}")).alias(c)
    status = every.join(first, "pg", "full_outer").select("pg", good("model"), good("finish"), good("usage"), state.alias("status"))
    return facts, objects, status


def read_questions(spark: SparkSession, text: str) -> DataFrame:
    """Questions from YAML (if a parser is installed) or JSON text: a small list that a person keeps."""
    try:
        import yaml

        items = yaml.safe_load(text)
    except ImportError:
        items = json.loads(text)
    items = items["questions"] if isinstance(items, dict) else items
    schema = "id string, question string, type string, expect_values array<double>, expect_pages array<int>, expect_terms array<string>, forbid_terms array<string>, require_refusal boolean, manual boolean, note string"
    names = [f.name for f in T.StructType.fromDDL(schema)]
    cast = {"expect_values": lambda v: [float(x) for x in v] if v else None, "id": str}
    return spark.createDataFrame([tuple(cast.get(n, lambda v: v)(q.get(n)) for n in names) for q in items], schema)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artefact that may be absent: an empty table then."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_aggregates(spark: SparkSession, path: str, doc: str) -> DataFrame:
    """(doc, aggregates as JSON) of an aggregate document, for contexts; no row if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "doc string, aggregates string")
    body = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.aggregates").alias("aggregates"))
    return body.filter("aggregates IS NOT NULL").select(F.lit(doc).alias("doc"), "aggregates")


def inline(spark: SparkSession, rows: list[tuple], schema: str = FACT) -> DataFrame:
    """A literal relation, such as hand-read values."""
    return spark.createDataFrame(rows, schema)


def read_grids(tables: DataFrame) -> DataFrame:
    """S3: tables of ARRAY<ARRAY<STRING>> without empty cells and rows, white space collapsed."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    rows = F.transform("grid", lambda r: F.filter(F.transform(r, cell), lambda c: c != ""))
    return tables.withColumn("grid", F.filter(rows, lambda r: F.size(r) > 0))


def pages_left(pages: DataFrame, done: DataFrame) -> DataFrame:
    """The pages without a cached result."""
    return pages.join(done.select("pg").distinct(), "pg", "left_anti")
