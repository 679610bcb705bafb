"""Linkage of two fact sets extracted independently from the same pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import patterns as P
from pagetrail.functions.numbers import norm_period, norm_unit
from pagetrail.functions.text import canon_metric, jaccard, norm_text, split_metric, token_set
from pagetrail.shared import removed, written


def keyed(facts: DataFrame) -> DataFrame:
    """L1: id, pg and comparison keys of every fact; facts need a unique seq."""
    k = facts.withColumn("x", split_metric(F.col("m"), F.col("s")))
    cm = canon_metric(F.col("x.m"))
    return k.select(F.col("seq").alias("id"), "pg", norm_period(F.col("p")).alias("per"), norm_text(F.col("x.s")).alias("seg"), cm["name"].alias("cm"), cm["is_change"].alias("chg"), token_set(F.col("x.m")).alias("mt"), token_set(F.col("x.s")).alias("st"), norm_unit(F.col("u")).alias("unit"), F.col("v").cast("double").alias("v"))


def score() -> Column:
    """L2: how well two keyed facts a, b may be one cell: 0.7 metric + 0.3 segment, 0 for a veto."""
    a, b = (lambda c, x=x: F.col(f"{x}.{c}") for x in "ab")
    metric = F.when(a("cm") == b("cm"), 1.0).otherwise(F.greatest(jaccard(a("mt"), b("mt")), jaccard(F.array_union(a("mt"), a("st")), F.array_union(b("mt"), b("st")))))
    overlap = jaccard(a("st"), b("st"))
    # a segment on one side only may have moved into the metric of the other
    own = F.when(F.size(a("st")) > 0, a("st")).otherwise(b("st"))
    other = F.when(F.size(a("st")) > 0, b("mt")).otherwise(a("mt"))
    one_sided = F.when(jaccard(own, other) >= 0.5, 0.95).otherwise(0.45)
    segment = F.when((a("seg") != "") & (b("seg") != ""), F.when(a("seg") == b("seg"), 1.0).when(overlap < 0.5, None).otherwise(overlap)).when((a("seg") != "") | (b("seg") != ""), one_sided).otherwise(1.0)
    money = lambda u: u.isin(P.MONEY_UNITS)
    units_clash = (a("unit") != "") & (b("unit") != "") & (a("unit") != b("unit")) & (money(a("unit")) != money(b("unit")))
    veto = (a("per") != b("per")) | (a("chg") != b("chg")) | units_clash | (metric < 0.34) | segment.isNull()
    return F.when(veto, 0.0).otherwise(metric * 0.7 + segment * 0.3)


def same_value(a: Column, b: Column) -> Column:
    """L3: equal up to the rounding of printed figures: 0.051, or half a per cent."""
    d = F.abs(a - b)
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.coalesce((a == b) | (d <= 0.051) | ((scale > 0) & (d / scale <= 0.005)), F.lit(False))


def candidates(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Pairs on one page with a positive score. left, right: keyed facts."""
    rows = left.alias("a").join(right.alias("b"), F.col("a.pg") == F.col("b.pg")).withColumn("score", F.round(score(), digits)).filter("score > 0")
    return rows.select(F.col("a.pg").alias("pg"), F.col("a.id").alias("pi"), F.col("b.id").alias("vi"), "score", same_value(F.col("a.v"), F.col("b.v")).alias("same"))


SMALL_PAGE = 256


def assign(pairs: DataFrame, small_page: int = SMALL_PAGE) -> DataFrame:
    """Greedy one-to-one assignment on every page: best score first, then equal values, then ids.

    Pages of up to small_page candidates are folded, each by itself; larger ones go through rounds of mutually best pairs, which give the
    same assignment. Which way a page goes changes its cost only."""
    size = pairs.groupBy("pg").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small_page).select("pg")
    large = [r.pg for r in size.limit(LISTED + 1).collect()]
    if not large:
        return folded(pairs)
    if len(large) <= LISTED:
        own = F.coalesce(F.col("pg").isin(large), F.lit(None in large))
        return folded(pairs.filter(~own)).unionByName(mutual_rounds(pairs.filter(own)))
    pairs = written(pairs, "pairs")
    return folded(pairs.join(size, pairs["pg"].eqNullSafe(size["pg"]), "left_anti")).unionByName(mutual_rounds(pairs.join(size, pairs["pg"].eqNullSafe(size["pg"]), "left_semi")))


LISTED = 100
_ORDER = ["pg", "pi", "vi", "score", "same"]


def mutual_rounds(pairs: DataFrame) -> DataFrame:
    """Greedy assignment as joins. In a round, each pair that is the best of both its sides is taken, and whatever shares a side with one goes.

    Under a total order the greedy choice takes exactly those: no pair before it can touch its sides. Every round takes the best pair of each page at
    least; rounds end when no pair is left. A side with many candidates is pre-aggregated, never gathered."""
    best = F.struct((-F.col("score")).alias("a"), (~F.col("same")).alias("b"), "pi", "vi")
    rest, taken = written(pairs.select(*_ORDER), "pairs"), []
    while not rest.isEmpty():
        left = rest.groupBy("pg", "pi").agg(F.min(best).alias("l")).select("pg", "pi", F.col("l.vi").alias("vi"))
        right = rest.groupBy("pg", "vi").agg(F.min(best).alias("r")).select("pg", F.col("r.pi").alias("pi"), "vi")
        both = left.alias("l").join(right.alias("r"), F.col("l.pg").eqNullSafe(F.col("r.pg")) & (F.col("l.pi") == F.col("r.pi")) & (F.col("l.vi") == F.col("r.vi"))).select("l.pg", "l.pi", "l.vi")
        taken.append(written(_matching(rest, both, ["pi", "vi"], "left_semi"), "taken"))
        after = written(_matching(_matching(rest, taken[-1], ["pi"], "left_anti"), taken[-1], ["vi"], "left_anti"), "pairs")
        removed(rest.sparkSession, rest._written_path)
        rest = after
    return reduce(DataFrame.unionByName, [t.dropDuplicates(["pg", "pi", "vi"]) for t in taken], rest)


def _matching(rows: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    a, b = rows.alias("x"), other.select("pg", *on).distinct().alias("y")
    same = F.col("x.pg").eqNullSafe(F.col("y.pg"))
    for c in on:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return a.join(b, same, how)


def folded(pairs: DataFrame) -> DataFrame:
    """The assignment of each page by a fold over its sorted candidates in a higher-order function, for pages of few candidates."""
    item = F.struct((-F.col("score")).alias("a"), (~F.col("same")).alias("b"), "pi", "vi", "score", "same")
    kept = "array<struct<pi:bigint,vi:bigint,score:double,same:boolean>>"

    def step(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda k: (k["pi"] == x["pi"]) | (k["vi"] == x["vi"]))
        return F.when(free, F.concat(acc, F.array(F.struct(x["pi"].cast("long").alias("pi"), x["vi"].cast("long").alias("vi"), x["score"].alias("score"), x["same"].alias("same"))))).otherwise(acc)

    folded = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kept), step)
    return pairs.groupBy("pg").agg(folded.alias("x")).select("pg", F.explode("x").alias("x")).select("pg", "x.*")


def reconcile(left: DataFrame, right: DataFrame, matched: DataFrame) -> DataFrame:
    """Every fact of either side once, with its class. The left side wins; a mismatch keeps both values."""
    cols = ["t", "m", "s", "p", "v", "u", "pg"]
    a = left.select(F.col("seq").alias("pi"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = right.select(F.col("seq").alias("vi"), *[F.col(c).alias(f"b_{c}") for c in cols])
    m = matched.select("pi", "vi", "same")
    rows = a.join(m, "pi", "left").join(b, "vi", "full_outer")
    kind = F.when(F.col("pi").isNull(), "only_right").when(F.col("vi").isNull(), "only_left").when(F.col("same"), "confirmed").otherwise("mismatch")
    pick = [F.when(F.col("pi").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in cols]
    clash = F.col("kind") == "mismatch"
    out = rows.withColumn("kind", kind)
    return out.select("pi", "vi", *pick, "kind", (F.col("kind") == "confirmed").alias("confirmed"), F.when(clash, F.col("a_v")).alias("v_left"), F.when(clash, F.col("b_v")).alias("v_right"))


def merged_order() -> list[Column]:
    """O3: page, then table, metric, segment and period, with None for NULL."""
    return [F.col("pg"), *[F.coalesce(F.col(c), F.lit("None")) for c in ("t", "m", "s", "p")]]
