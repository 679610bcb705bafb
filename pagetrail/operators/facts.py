"""Fact tables in long format: picks, totals by trust, growth, shares and the checksum of segments.

A fact has doc-wide order seq, table t, metric m, segment s (NULL for totals), period p, value v, unit u, page pg, and
after reconciliation src and confirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOTAL_NAMES = ["общая выручка", "выручка", "консолидированная выручка"]


def project(facts: DataFrame) -> DataFrame:
    """the seven columns that are rendered."""
    return facts.select("t", "m", "s", "p", "v", "u", "pg")


def lookup(facts: DataFrame, **keys) -> DataFrame:
    """facts whose columns equal the keys; a NULL key finds NULLs."""
    for name, value in keys.items():
        facts = facts.filter(F.col(name).eqNullSafe(F.lit(value)))
    return facts


def first_pick(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (ask, metric, segment, period) the first fact in order whose metric contains the text, whose
    segment is equal (none if NULL is asked) and which has a value."""
    f, a = facts.alias("f"), asked.alias("a")
    on = F.contains(F.lower("f.m"), F.lower("a.metric")) & F.col("f.s").eqNullSafe(F.col("a.segment")) & (F.col("f.p") == F.col("a.period")) & F.col("f.v").isNotNull()
    best = F.min_by(F.struct("f.m", "f.s", "f.p", "f.v", "f.u", "f.pg", "f.seq"), F.col("f.seq"))
    return f.join(a, on).groupBy("a.ask").agg(best.alias("x")).select("ask", "x.*")


def trust() -> Column:
    """A2: confirmed by both sources, then a value with a fraction, then the earlier page (none or 0 counts as 999)."""
    page = F.when(F.coalesce(F.col("pg"), F.lit(0)) == 0, 999).otherwise(F.col("pg"))
    return F.struct((F.coalesce(F.col("confirmed"), F.lit(False)) | (F.coalesce(F.col("src"), F.lit("")) == "both")).alias("a"), (F.col("v") != F.floor("v")).alias("b"), (-page).alias("c"), (-F.col("seq")).alias("d"))


def total_by_trust(facts: DataFrame, unit: str, names: list[str] | None = None) -> DataFrame:
    """For each period the total (no segment, a listed name, the unit) that deserves most trust."""
    named = F.lower(F.trim("m")).isin(names or TOTAL_NAMES)
    rows = facts.filter(named & F.col("s").isNull() & F.col("v").isNotNull() & (F.col("u") == unit))
    return rows.groupBy("p").agg(F.max_by(F.struct("v", "pg", "src", "seq"), trust()).alias("x")).select("p", "x.*")


def growth(segments: DataFrame, totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Value of each segment in period cur against prev: absolute and relative change, contribution to the
    growth of the total, and share. What cannot be computed is NULL; segments without a current value do not appear.

    segments: s, p, v, u, pg; totals: p, v; pairs: cur, prev."""
    now = segments.join(pairs, F.col("p") == F.col("cur")).select("s", "cur", "prev", "v", "u", "pg")
    then = segments.select("s", F.col("p").alias("prev"), F.col("v").alias("v_prev"))
    t_now, t_then = (totals.select(F.col("p").alias(k), F.col("v").alias(v)) for k, v in (("cur", "t_cur"), ("prev", "t_prev")))
    rows = now.join(then, ["s", "prev"], "left").join(t_now, "cur", "left").join(t_then, "prev", "left")
    change, total_change = F.col("v") - F.col("v_prev"), F.col("t_cur") - F.col("t_prev")
    has_prev = F.col("v_prev").isNotNull() & (F.col("v_prev") != 0)
    return rows.select(
        F.col("s").alias("segment"), F.col("cur").alias("period"), F.col("v").alias("value"), F.col("u").alias("unit"), F.col("pg").alias("page"), F.col("v_prev").alias("prev"),
        F.when(has_prev, F.round(change, 3)).alias("yoy_abs"),
        F.when(has_prev, F.round(change / F.abs("v_prev") * 100, 2)).alias("yoy_pct"),
        F.when(has_prev & (total_change != 0), F.round(change / total_change * 100, 2)).alias("contrib_growth_pct"),
        F.when(F.col("t_cur") != 0, F.round(F.col("v") / F.col("t_cur") * 100, 2)).alias("share_pct"),
    )


def rank_segments(rows: DataFrame) -> DataFrame:
    """O2: growth() with each period's place by relative growth, the largest first and missing growth last; ties by name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("period").orderBy(F.desc_nulls_last("yoy_pct"), "segment")))


def growth_header(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """A3: the totals of each pair of periods (cur, prev) and their growth, NULL where one is missing or nothing grew.

    totals: p, v, pg, one row a period."""
    now, then = totals.select(F.col("p").alias("cur"), "v", "pg"), totals.select(F.col("p").alias("prev"), F.col("v").alias("v_prev"))
    change = F.col("v") - F.col("v_prev")
    rows = pairs.join(now, "cur", "left").join(then, "prev", "left")
    return rows.select(
        F.col("cur").alias("period"), F.col("prev").alias("prev_period"), F.col("v").alias("total_revenue"), F.col("pg").alias("total_revenue_page"),
        F.col("v_prev").alias("total_revenue_prev"), F.when(change != 0, F.round(change, 3)).alias("total_growth_abs"),
    )


def checksum(facts: DataFrame, totals: DataFrame, segments: list[str], metric: str, correction: str, tolerance_pct: float = 0.5, external: DataFrame | None = None) -> DataFrame:
    """A4: per period the sum of the top segments, raw and with the intersegment correction, against the total.

    The correction is minus the largest absolute value whose metric or segment names it, 0 without one, or comes from ``external``
    (p, v), so that the check need not rest on the data it checks. delta_raw_pct has its sign; complete: every segment has a value."""
    parts = facts.filter(F.col("s").isin(segments) & F.contains(F.lower("m"), F.lit(metric)) & F.col("v").isNotNull())
    parts = parts.groupBy("p", "s").agg(F.min_by("v", "seq").alias("v"))
    summed = parts.groupBy("p").agg(F.sum("v").alias("raw"), F.count(F.lit(1)).alias("n_parts"))
    found = facts.filter(F.contains(F.lower(F.concat_ws(" ", "m", "s")), F.lit(correction)) & F.col("v").isNotNull()).groupBy("p").agg((-F.max(F.abs("v"))).alias("fix"))
    fix = external.select("p", F.col("v").alias("fix")) if external is not None else found
    rows = summed.join(fix, "p", "left").join(totals.select("p", F.col("v").alias("total")), "p", "left")
    fix = F.coalesce("fix", F.lit(0.0))
    fixed = F.col("raw") + fix
    off = lambda x: F.when(F.col("total") != 0, (x - F.col("total")) / F.col("total") * 100)
    ok = F.coalesce(F.abs(off(fixed)) <= tolerance_pct, F.lit(False))
    return rows.select(F.col("p").alias("period"), "n_parts", F.round("raw", 3).alias("sum_raw"), F.round(fix, 3).alias("intersegment"), F.round(fixed, 3).alias("sum_adjusted"), "total", F.round(off(F.col("raw")), 3).alias("delta_raw_pct"), F.round(F.abs(off(fixed)), 3).alias("delta_pct"), (F.col("n_parts") == len(segments)).alias("complete"), ok.alias("ok"))
