"""Grounding of answers in their context, scoring, and roll-ups by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.text import admits_missing, call_cost, citations, contains_all, contains_which, decimals, has_verdict, number_text, numbers_in, values_in


def unverified(answer: Column, context: Column, signed: bool = False) -> Column:
    """J11, Q8, F-free: the answer's numbers that no number of the context rounds to; all of them if it has none.

    signed=True also takes a typographic minus as a sign, on both sides."""
    dash = (lambda c: F.regexp_replace(c, r"[\x{2212}\x{2013}](?=[0-9])", "-")) if signed else (lambda c: c)
    return unverified_among(dash(answer), values_in(dash(context)))


def unverified_among(answer: Column, there: Column) -> Column:
    """unverified() for a context whose numbers are at hand."""
    own = values_in(answer)
    tolerance = lambda v: 0.5 * F.pow(F.lit(10.0), -F.least(decimals(v), F.lit(3))) + 1e-9
    return F.array_sort(F.array_distinct(F.transform(F.filter(own, lambda v: ~F.exists(there, lambda c: F.abs(c - v) <= tolerance(v))), number_text)))


def unverified_rows(answers: DataFrame, contexts: DataFrame, width: float = 1.0) -> DataFrame:
    """J11 for contexts too large for a row: (answer_id, v) of answers' numbers near no number of their context.

    answers: answer_id, ctx, v; contexts: ctx, c. An equality join on buckets of ``width`` (at least the tolerance),
    looked up in three neighbours, with the exact test as the rest of the condition."""
    tolerance = 0.5 * F.pow(F.lit(10.0), -F.least(decimals(F.col("v")), F.lit(3))) + 1e-9
    bucket = lambda c: F.floor(F.col(c) / width)
    a = answers.withColumn("b", F.explode(F.array(bucket("v") - 1, bucket("v"), bucket("v") + 1)))
    c = contexts.select("ctx", "c", bucket("c").alias("b"))
    fine = a.join(c, ["ctx", "b"]).filter(F.abs(F.col("c") - F.col("v")) <= tolerance).select("answer_id", "v").distinct()
    return answers.select("answer_id", "v").distinct().join(fine, ["answer_id", "v"], "left_anti")


def score_card(rows: DataFrame) -> DataFrame:
    """Text checked against expect_values, expect_pages, expect_terms, forbid_terms, require_refusal.

    A check that does not apply is NULL; forbidden terms that occur are listed."""
    got = F.transform(numbers_in(F.col("text")), lambda x: x.cast("double"))
    near = lambda want: F.exists(got, lambda g: F.abs(g - want) <= F.greatest(F.abs(want) * 0.005, F.lit(0.05)))
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    terms = F.when(some("expect_terms"), contains_all(F.col("text"), F.col("expect_terms")))
    return rows.select(
        "*",
        F.when(some("expect_values"), F.forall("expect_values", near)).alias("values_ok"),
        F.when(some("expect_pages"), F.arrays_overlap(citations(F.col("text")), F.col("expect_pages"))).alias("pages_ok"),
        F.when(F.coalesce(F.col("require_refusal"), F.lit(False)), F.coalesce(terms, F.lit(False)) & admits_missing(F.col("text"))).otherwise(terms).alias("terms_ok"),
        contains_which(F.col("text"), F.coalesce(F.col("forbid_terms"), F.array().cast("array<string>"))).alias("forbidden_hit"),
        has_verdict(F.col("text")).alias("verdict_leaked"),
    )


def passed(values_ok: Column, pages_ok: Column, terms_ok: Column, n_forbidden: Column, verdict_leaked: Column, n_unverified: Column) -> Column:
    """No check failed, nothing forbidden, no verdict, no unverified number."""
    fine = F.coalesce(values_ok, F.lit(True)) & F.coalesce(pages_ok, F.lit(True)) & F.coalesce(terms_ok, F.lit(True))
    return fine & (n_forbidden == 0) & ~verdict_leaked & (n_unverified == 0)


def judged(rows: DataFrame) -> DataFrame:
    """score_card() of answers with their unverified numbers (unverified), and whether each passed."""
    return score_card(rows).withColumn("passed", passed(F.col("values_ok"), F.col("pages_ok"), F.col("terms_ok"), F.size("forbidden_hit"), F.col("verdict_leaked"), F.size(F.coalesce("unverified", F.array().cast("array<string>")))))


def upper_median(col: str) -> Column:
    """The middle value, of two the larger: the discrete median from above, which counts values instead of gathering rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{col}` DESC)")


def mode_summary(rows: DataFrame) -> DataFrame:
    """By mode: runs, passes, checks that hold of those that apply, upper medians, cost."""
    ok = lambda c: [F.count_if(F.col(c)).alias(f"{c}_true"), F.count(c).alias(f"{c}_of")]
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passed"), *ok("values_ok"), *ok("pages_ok"), upper_median("tokens").alias("tokens_median"), upper_median("latency").alias("latency_median"), F.sum("cost").alias("cost"))


def savings(summary: DataFrame, baseline: str) -> DataFrame:
    """Tokens saved against the baseline mode, in per cent of it; NULL without a baseline row."""
    base = summary.filter(F.col("mode") == baseline).agg(F.max("tokens_median").alias("base"))  # one row
    return summary.crossJoin(F.broadcast(base)).select("mode", F.round(100 - 100 * F.col("tokens_median") / F.col("base"), 2).alias("saved_pct"))


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call by its model's prices (model, price_in, price_out); unknown models cost 0."""
    return calls.join(prices, "model", "left").withColumn("cost", call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out"))).drop("price_in", "price_out")


def pick_questions(questions: DataFrame, ids: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """The questions with the given ids, all without ids; of these the first ``limit`` by id."""
    rows = questions if ids is None else questions.filter(F.col("id").isin(list(ids)))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def question_titles(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results with their questions; those without one are left out."""
    return results.join(questions, "id")


def section_titles(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """Titles of the sections that an answer used; unknown ones are left out."""
    return answers.select("answer_id", F.posexplode("section_ids").alias("pos", "id")).join(sections.select("id", "title"), "id").select("answer_id", "pos", "id", "title")


def status_counts(calls: DataFrame) -> DataFrame:
    """Calls and tokens by status."""
    return calls.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("tokens_in"), F.sum("completion_tokens").alias("tokens_out"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K4: old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
