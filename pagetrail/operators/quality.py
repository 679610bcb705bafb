"""Audits of fact tables and of what a page declares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import patterns as P


def range_rules(facts: DataFrame, ranges: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """F8: facts outside the plausible range of their unit."""
    rules = ranges or P.VALUE_RANGES
    broken = reduce(lambda e, r: e.when((F.col("u") == r[0]) & ~F.col("v").between(r[1], r[2]), F.lit(f"{r[0]} [{r[1]:g}; {r[2]:g}]")), rules[1:], F.when((F.col("u") == rules[0][0]) & ~F.col("v").between(*rules[0][1:]), F.lit(f"{rules[0][0]} [{rules[0][1]:g}; {rules[0][2]:g}]")))
    return facts.withColumn("rule", broken).filter("rule IS NOT NULL")


def cross_source(facts: DataFrame) -> DataFrame:
    """Cells that several rows state, and whether they disagree."""
    rows = facts.groupBy("m", "s", "p", "u").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("n_values"))
    return rows.filter("n > 1").withColumn("mismatch", F.col("n_values") > 1)


def duplicates(facts: DataFrame) -> DataFrame:
    """Repeated rows by page: how many more than one of a kind."""
    rows = facts.groupBy("pg", "m", "s", "p", "v", "u").count().filter("count > 1")
    return rows.groupBy("pg").agg(F.sum(F.col("count") - 1).alias("extra"))


def verdict(found: Column, declared: Column) -> Column:
    """How much of what a page declares was found."""
    return F.when(declared == 0, "none").when(found >= 0.8 * declared, "full").when(found >= 0.5 * declared, "partial").otherwise("low")


def coverage(pages: DataFrame, objects: DataFrame, parser: DataFrame, vision: DataFrame) -> DataFrame:
    """Every page with its objects, declared cells and facts of each source, zeros where there are none."""
    o = objects.groupBy("pg").agg(F.count(F.lit(1)).alias("objects"), F.count_if("has_numbers").alias("numeric"), F.count_distinct("kind").alias("kinds"), F.sum(F.when(F.col("has_numbers"), F.col("rows") * F.col("cols")).otherwise(0)).alias("declared"))
    p, v = (x.groupBy("pg").agg(F.count(F.lit(1)).alias(name)) for x, name in ((parser, "n_parser"), (vision, "n_vision")))
    rows = pages.join(o, "pg", "left").join(p, "pg", "left").join(v, "pg", "left").na.fill(0)
    return rows.withColumn("delta", F.col("n_vision") - F.col("n_parser")).withColumn("verdict", verdict(F.greatest("n_parser", "n_vision"), F.col("declared")))


def coverage_counts(covered: DataFrame) -> DataFrame:
    """A10: pages by verdict, and those with numbers but no fact."""
    return covered.groupBy("verdict").agg(F.count(F.lit(1)).alias("pages"), F.count_if((F.col("numeric") > 0) & (F.col("n_parser") + F.col("n_vision") == 0)).alias("gaps"))


def busiest_pages(covered: DataFrame, n: int = 15) -> DataFrame:
    """The n pages of coverage() with most objects that hold numbers, ties by page, for a report."""
    return covered.orderBy(F.desc("numeric"), "pg").limit(n)


def partial_pages(covered: DataFrame, n: int = 25) -> DataFrame:
    """The first n pages of coverage() of which a part was found, for a report."""
    return covered.filter("verdict = 'partial'").orderBy("pg").limit(n)


def by_kind(objects: DataFrame) -> DataFrame:
    """Objects by kind, the most frequent first."""
    return objects.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pg").alias("pages")).orderBy(F.desc("n"), "kind")


def table_sources(facts: DataFrame) -> DataFrame:
    """The pages of each table."""
    return facts.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("pg")).alias("pages"))


def controls(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected values (m, s, p, want) against every fact of that key; NULL segments match; all must agree."""
    f, e = facts.alias("f"), expected.alias("e")
    rows = e.join(f, (F.col("e.m") == F.col("f.m")) & F.col("e.s").eqNullSafe(F.col("f.s")) & (F.col("e.p") == F.col("f.p")), "left")
    return rows.groupBy("e.m", "e.s", "e.p", "e.want").agg(F.count("f.v").alias("n"), F.coalesce(F.bool_and(F.abs(F.col("f.v") - F.col("e.want")) <= 1e-9), F.lit(False)).alias("ok"))


def ratio_check(parts: DataFrame, wholes: DataFrame, stated: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """100 * part / whole against the stated percentage, by segment and period."""
    k = ["s", "p"]
    rows = stated.select(*k, F.col("v").alias("stated")).join(parts.select(*k, F.col("v").alias("part")), k).join(wholes.select(*k, F.col("v").alias("whole")), k).filter("whole <> 0")
    return rows.withColumn("computed", F.col("part") / F.col("whole") * 100).withColumn("ok", F.abs(F.col("computed") - F.col("stated")) <= tolerance)


def rollup_check(parts: DataFrame, totals: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """The sum of the parts of a period against its total."""
    rows = parts.groupBy("p").agg(F.sum("v").alias("summed"), F.count(F.lit(1)).alias("n")).join(totals.select("p", F.col("v").alias("total")), "p")
    return rows.withColumn("ok", F.abs(F.col("summed") - F.col("total")) <= tolerance)
