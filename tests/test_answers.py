"""Guards, contexts, widening, checksum and reports in the cases that differ most easily."""

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import numbers as N
from pagetrail.operators import context, evaluate, facts, sections
from pagetrail.sources import readers, writers


def test_a_verdict_alone_is_guarded(spark):
    rows = [(1, "Какова выручка?", "Рекомендую купить акции"), (2, "Стоит ли инвестировать?", "Выручка 5"), (3, "Какова выручка?", "Не рекомендую купить акции, не стоит покупать"), (4, "Рост?", "5")]
    answers = spark.createDataFrame([(*r, "5") for r in rows], "question_id int, question string, text string, prompt string")
    got = {r.question_id: r for r in context.guard(answers).collect()}
    assert [got[i].advice_guarded for i in (1, 2, 3, 4)] == [True, True, False, False] and [got[i].verdict_leaked for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[1].text == f"{context.WARNING}\n\nРекомендую купить акции\n\n{context.NOTICE}"
    assert got[2].text == f"Выручка 5\n\n{context.NOTICE}" and got[4].text == "5"


SECTIONS = [("d", 1, "a", "A", 1, 5, 5, "ta"), ("d", 2, "b", "B", 1, 5, 9, "tb"), ("d", 3, "c", "C", 2, 6, 7, "tc"), ("d", 4, "e", "E", 3, 6, 6, "te"), ("d", 5, "f", "F", 1, 10, 12, "tf")]
KINDS = "doc string, seq int, id string, title string, level int, page_from long, page_to long, text string"


def test_contexts(spark):
    s = spark.createDataFrame(SECTIONS, KINDS)
    q = spark.createDataFrame([(1, "Q1", "d", "full"), (2, "Q2", "d", "router"), (3, "Q3", "d", "router")], "question_id int, question string, doc string, mode string")
    f = spark.createDataFrame([("d", i, "t", "m", None, "2024", float(p), "u", p) for i, p in enumerate([5, 6, 11, 21])], "doc string, seq int, t string, m string, s string, p string, v double, u string, pg int")
    chosen = spark.createDataFrame([(2, "c"), (2, "e")], "question_id int, id string")
    got = {r.question_id: r for r in context.build(q, s, f, chosen, [21], spark.createDataFrame([("d", '{"x":1}')], "doc string, aggregates string")).collect()}
    # all top sections of the whole document, nested or not
    assert all(x in got[1].prompt for x in ("ta", "tb", "tf")) and "tc" not in got[1].prompt
    assert "tc" in got[2].prompt and 'id="e"' not in got[2].prompt and got[3].mode == "router->full" and "ta" in got[3].prompt
    pages = lambda i: [p for p in (5, 6, 11, 21) if f'"pg":{p}' in got[i].prompt]
    assert pages(1) == pages(3) == [5, 6, 11, 21] and pages(2) == [6, 21]
    assert got[2].prompt.startswith('<question>Q2</question>\n\n<numbers>\n{"numbers":[{"t":"t"') and ',"aggregates":{"x":1}}\n</numbers>\n\n<document>\n<section id="c"' in got[2].prompt and got[2].prompt.endswith("</section>\n</document>")


def test_widening_is_applied(spark):
    s = spark.createDataFrame(SECTIONS, KINDS)
    q = spark.createDataFrame([(i, "d") for i in (1, 2, 3)], "question_id int, doc string")
    replies = [(1, '{"sections": ["e", "c"], "confidence": 0.1}'), (2, '{"sections": ["e"], "confidence": 0.9}'), (3, "nothing")]
    decisions = context.route(spark.createDataFrame(replies, "question_id int, reply string"), s)
    got = context.choose(decisions, q, s).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.id, r["rank"]) for r in got] == [(1, "e", 1), (1, "c", 2), (1, "b", 3), (2, "e", 1)]


def test_checksum_signs_and_segments(spark):
    rows = [(0, "Выручка", "A", 90.0), (1, "Выручка", "B", 10.0), (2, "Выручка", "Межсегментные расчёты", -10.0), (3, "Общая выручка", None, 111.1)]
    f = spark.createDataFrame([(i, "t", m, s, "2024", v, "u", 1) for i, m, s, v in rows], "seq int, t string, m string, s string, p string, v double, u string, pg int")
    totals = f.filter("s IS NULL").select("p", "v")
    r = facts.checksum(f, totals, ["A", "B", "C"], "выручка", "межсегмент").first()
    assert (r.sum_raw, r.intersegment, r.sum_adjusted) == (100.0, -10.0, 90.0) and r.delta_raw_pct == pytest.approx(-9.991) and r.delta_pct == pytest.approx(18.992)
    assert r.complete is False and r.ok is False
    near = facts.checksum(f.filter("seq <> 2"), totals.withColumn("v", F.lit(100.1)), ["A", "B", "C"], "выручка", "межсегмент").first()
    assert near.intersegment == 0.0 and near.ok is True and near.complete is False


def test_medians_and_savings(spark):
    rows = [("a", float(v), 1.0) for v in (1, 2, 3, 10)] + [("b", 4.0, 1.0)]
    got = {r["mode"]: r.m for r in spark.createDataFrame(rows, "mode string, v double, w double").groupBy("mode").agg(evaluate.upper_median("v").alias("m")).collect()}
    assert got == {"a": 3.0, "b": 4.0}
    summary = spark.createDataFrame([("a", 50.0), ("b", 100.0)], "mode string, tokens_median double")
    assert {r["mode"]: r.saved_pct for r in evaluate.savings(summary, "b").collect()} == {"a": 50.0, "b": 0.0}
    assert {r["mode"]: r.saved_pct for r in evaluate.savings(summary, "none").collect()} == {"a": None, "b": None}


def test_leaves_equal_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for d in range(6):
        for i in range(30):
            lo = rng.randint(1, 40)
            rows.append((f"d{d}", i, f"{d}-{i}", "t", rng.randint(1, 5), lo, lo + rng.randint(0, 9), "x"))
    want = {r[2] for r in rows if not any(o[0] == r[0] and o[4] > r[4] and r[5] <= o[5] <= r[6] for o in rows)}
    assert {r.id for r in sections.leaf_sections(spark.createDataFrame(rows, KINDS)).collect()} == want
    with pytest.raises(Exception, match="levels go to"):
        sections.leaf_sections(spark.createDataFrame([("d", 1, "a", "t", 12, 1, 2, "x")], KINDS)).collect()


def test_compatibility_forms_are_numbers(spark):
    rows = spark.createDataFrame([("\u2461\u2074,5 млн",), ("\uff11\uff12",), ("\u2082\u2083 1",)], "raw string")
    assert [r[0] for r in rows.select(N.parse_number(F.col("raw"))).collect()] == [24.5, 12.0, 231.0]


def test_broken_input_and_long_reports_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"t": "a"},\n{"t": \n')
    with pytest.raises(Exception):  # noqa: B017 the engine's own error for a broken record
        readers.read_jsonl_tolerant(spark, str(tmp_path / "x.jsonl")).collect()
    assert writers.markdown(spark.range(2)).count("\n") == 3
    with pytest.raises(ValueError, match="more than 2"):
        writers.markdown(spark.range(3), limit=2)
