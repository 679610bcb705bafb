"""An index of page intervals: points meet the intervals that hold them by equality alone.

Page numbers are cut into blocks of 1, 16, 256, ... pages. An interval is the union of at most 30 maximal blocks of each size, its
nodes; a page lies in one block of each size. So a page is in an interval exactly if one of its blocks is one of the interval's nodes, and the join
is an equality join on document, size and block: it neither compares a document's intervals with all of its pages nor leaves a range to test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASE, LEVELS = 16, 5


def _sizes() -> Column:
    return F.array(*[F.lit(BASE**k).cast("long") for k in range(LEVELS)])


def point_nodes(page: Column) -> Column:
    """ARRAY<STRUCT<level, block>>: the page's block of each size, rounded down for negative pages too; NULL for no page."""
    nodes = F.transform(_sizes(), lambda size, k: F.struct(k.alias("level"), F.floor(page / size).cast("long").alias("block")))
    return F.when(page.isNotNull(), nodes)


def interval_nodes(lo: Column, hi: Column) -> Column:
    """ARRAY<STRUCT<level, block>>: the maximal blocks inside lo..hi, both ends included; none if hi < lo or an end is NULL."""
    lo, hi = lo.cast("long"), hi.cast("long")

    def blocks(k: Column, first: Column, after: Column) -> Column:
        some = F.transform(F.sequence(first, after - 1), lambda x: F.struct(k.alias("level"), x.alias("block")))
        return F.when(first < after, some).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    def level(size: Column, k: Column) -> Column:
        first, after = F.ceil(lo / size).cast("long"), F.floor((hi + 1) / size).cast("long")
        # blocks of the next size that are inside take what lies in them; the largest size has none above
        a, b = F.ceil(lo / (size * BASE)).cast("long") * BASE, F.floor((hi + 1) / (size * BASE)).cast("long") * BASE
        larger = (a < b) & (k < LEVELS - 1)
        return F.concat(blocks(k, first, F.when(larger, F.least(after, a)).otherwise(after)), blocks(k, F.when(larger, F.greatest(first, b)).otherwise(after), after))

    return F.flatten(F.transform(_sizes(), level))


def disjoint(intervals: DataFrame, on: list[str], lo: str, hi: str) -> DataFrame:
    """(*on, lo, hi): the pages that some interval of a group holds, as intervals that do not meet."""
    rows = intervals.select(*on, lo, hi).filter(F.col(lo) <= F.col(hi))
    by = Window.partitionBy(*on).orderBy(lo, hi)
    reach = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", (reach.isNull() | (F.col(lo) > reach)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*on, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__island")


def on_some_page(points: DataFrame, intervals: DataFrame, on: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """The points that lie in some interval of their group, each once."""
    nodes = disjoint(intervals, on, lo, hi).select(*on, F.explode(interval_nodes(F.col(lo), F.col(hi))).alias("__node"))
    at = points.withColumn("__node", F.explode(point_nodes(F.col(point))))
    return at.join(nodes, [*on, "__node"], "left_semi").select(*points.columns)


def marked(points: DataFrame, intervals: DataFrame, on: list[str], key: list[str], point: str, lo: str, hi: str, name: str) -> DataFrame:
    """Every point once, with the column ``name``: whether it lies in some interval of its group; a NULL point lies in none. Points are told apart
    by on and key, and are computed once, where on_some_page() and the points that it leaves would take them twice."""
    nodes = disjoint(intervals, on, lo, hi).select(*on, F.explode(interval_nodes(F.col(lo), F.col(hi))).alias("__node"), F.lit(True).alias("__in"))
    at = points.withColumn("__node", F.explode_outer(point_nodes(F.col(point)))).join(nodes, [*on, "__node"], "left")
    rest = [F.first(c).alias(c) for c in points.columns if c not in (*on, *key)]
    return at.groupBy(*on, *key).agg(*rest, F.coalesce(F.max("__in"), F.lit(False)).alias(name)).select(*points.columns, name)


def stabbed(points: DataFrame, intervals: DataFrame, on: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """Every point with every interval of its group that holds it; both sides' columns."""
    nodes = intervals.withColumn("__node", F.explode(interval_nodes(F.col(lo), F.col(hi))))
    at = points.withColumn("__node", F.explode(point_nodes(F.col(point))))
    return at.join(nodes, [*on, "__node"]).drop("__node")
