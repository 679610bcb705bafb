"""Interval index, section texts, model calls, page cache, rounds of pairs, linear folds, kept index, bucketed upsert, tick charts, reports."""

import json
import os
import random
import re
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.operators import context, evaluate, intervals, layout, linkage, models, quality, retrieval, sections
from pagetrail.plans import catalogue, views
from pagetrail.sources import page_cache, readers, writers
from pagetrail.streaming import incremental

from .test_answers import KINDS, SECTIONS

# ---------------------------------------------------------------- intervals and section texts


def test_interval_nodes_meet_exactly_the_pages_inside(spark):
    rng = random.Random(1)
    spans = [(i, a, a + rng.choice([0, 1, 15, 16, 17, 300, 5000, 70_000])) for i, a in enumerate(rng.choice([0, 1, 15, 16, 255, 256, rng.randint(-400, 70_000)]) for _ in range(150))]
    spans += [(900, 5, 4), (901, None, 4), (902, 5, None)]
    points = sorted({p for _, a, b in spans if a is not None and b is not None for p in (a - 1, a, a + 1, b - 1, b, b + 1)} | {rng.randint(-400, 80_000) for _ in range(100)}) + [None]
    s = spark.createDataFrame([("d", *r) for r in spans], "doc string, i int, lo long, hi long")
    p = spark.createDataFrame([("d", x) for x in points] + [("e", 7)], "doc string, pg int")
    want = sorted((x, i) for i, a, b in spans if a is not None and b is not None for x in points if x is not None and a <= x <= b)
    assert sorted((r.pg, r.i) for r in intervals.stabbed(p, s, ["doc"], "pg", "lo", "hi").collect()) == want
    assert sorted(r.pg for r in intervals.on_some_page(p, s, ["doc"], "pg", "lo", "hi").collect()) == sorted({x for x, _ in want})


def test_interval_joins_leave_no_range_to_test(spark, capsys):
    s = spark.createDataFrame(SECTIONS, KINDS)
    f = spark.createDataFrame([("d", 1, 6)], "doc string, seq int, pg int")
    for plan in (sections.facts_in_sections(f, s), sections.widen_to_parents(s, s.select("doc", "id", F.col("seq").alias("rank")))):
        plan.explain()
        text = capsys.readouterr().out
        assert "NestedLoop" not in text and "Cartesian" not in text and "block" in text
        assert not [line for line in text.splitlines() if "Join" in line and "doc" in line and "__node" not in line and "id" not in line.replace("plan_id", "")]


def test_section_texts(spark):
    pages = [("d", p, f"page {p}") for p in range(1, 13) if p != 6] + [("d", 11, "again"), ("e", 1, "one"), ("e", 2, None), ("e", 3, "three")]
    p = spark.createDataFrame(pages, "doc string, page int, text string")
    b = spark.createDataFrame([r[:2] + r[3:6] for r in SECTIONS] + [("d", 6, " Tail ", 2, 12), ("d", 7, "Last", 2, 12)], "doc string, seq int, title string, level int, page_from long")
    got = {(r.doc, r.seq): r for r in sections.build_sections(b, p).collect()}
    lines = lambda lo, hi: "\n".join(t for d, n, t in sorted(pages, key=lambda r: (r[1], r[2] or "")) if d == "d" and lo <= n <= hi)
    assert {k: r.text for k, r in got.items() if k[0] == "d"} == {k: lines(r.page_from, r.page_to) for k, r in got.items() if k[0] == "d"}
    assert got["d", 6].title == "Tail" and (got["d", 2].page_from, got["d", 2].page_to) == (5, 9) and "page 6" not in got["d", 2].text
    whole = got["e", 1]
    assert (whole.id, whole.title, whole.level, whole.page_from, whole.page_to, whole.text) == ("s001-документ", "Документ", 1, 1, 3, "one\n\nthree")
    parts = sections.section_texts(spark.createDataFrame([("d", 1, 1, 12)], "doc string, seq int, page_from int, page_to int"), p, part_pages=5).orderBy("part").collect()
    assert [r.part for r in parts] == [0, 1, 2] and "\n".join(r.text for r in parts) == lines(1, 12)
    assert sections.build_sections(b.limit(0), p.limit(0)).count() == 0


def long_document(spark, n):
    """n bookmarks of one document, a page each, of levels 1 to 4 in turn."""
    b = spark.range(1, n + 1).select(F.lit("d").alias("doc"), F.col("id").alias("seq"), F.lit("t").alias("title"), (1 + (F.col("id") - 1) % 4).cast("int").alias("level"), F.col("id").alias("page_from"), F.lit(n).cast("long").alias("last_page"))
    return sections.with_ids(sections.section_ends(b))


def in_time(call, seconds):
    """call()'s result; what takes work with the square of the rows takes minutes here."""
    began = time.monotonic()
    out = call()
    assert time.monotonic() - began < seconds
    return out


def test_section_ends_of_many_bookmarks(spark):
    got = in_time(lambda: long_document(spark, 20_000).select("level", "page_from", "page_to").collect(), 60)
    assert len(got) == 20_000 and all(r.page_to == min(r.page_from + max(4 - r.level, 0) if r.level > 1 else r.page_from + 3, 20_000) for r in got)


def test_leaves_of_many_bookmarks(spark):
    got = in_time(lambda: sections.leaf_sections(long_document(spark, 20_000)).select("level", "seq").collect(), 60)
    assert sorted(r.seq for r in got) == list(range(4, 20_001, 4))


def test_top_ranges_of_many_bookmarks(spark):
    got = in_time(lambda: sections.drop_nested(long_document(spark, 20_000)).select("seq").collect(), 60)
    assert sorted(r.seq for r in got) == list(range(1, 20_001, 4))


def test_outline_of_many_bookmarks(spark):
    got = in_time(lambda: sections.outline(long_document(spark, 20_000), 3).first(), 60)
    lines = got.outline.split("\n")
    assert len(lines) == 15_000 and lines[0] == "s001-t | t | стр. 1-4" and lines[-1] == "    s199-t | t | стр. 19999-20000"


def test_texts_of_many_bookmarks(spark):
    b = long_document(spark, 20_000).select("doc", "seq", "title", "level", "page_from")
    p = spark.range(1, 20_001).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.col("id").cast("string").alias("text"))
    got = in_time(lambda: sections.build_sections(b, p).select("seq", "level", "text").collect(), 90)
    assert len(got) == 20_000 and all(r.text == "\n".join(str(r.seq + i) for i in range(4 if r.level == 1 else 5 - r.level)) for r in got)


def test_facts_of_many_bookmarks(spark):
    f = spark.range(1, 20_101).select(F.lit("d").alias("doc"), F.col("id").alias("seq"), F.col("id").cast("int").alias("pg"))
    got = in_time(lambda: sections.facts_with_anchors(f, sections.leaf_sections(long_document(spark, 20_000)), [12, 21, 20_050]).select("seq", "part").collect(), 60)
    want = {i: 0 for i in range(4, 20_001, 4)} | {21: 1, 20_050: 1}
    assert len(got) == len(want) and {r.seq: r.part for r in got} == want


def test_facts_with_anchors_equal_a_loop(spark):
    rng = random.Random(8)
    s = [(rng.choice("abc"), i, lo, lo + rng.randint(-1, 20)) for i in range(40) for lo in [rng.randint(-5, 900)]]
    f = [(rng.choice(["a", "b", "c", "none", None]), i // 3, rng.choice([None, rng.randint(-10, 950), 12, 21]), f"v{i}" if i % 7 else None) for i in range(1500)]
    f = list({(r[0], r[1]): r for r in f}.values())
    hit = {r: any(d == r[0] and r[2] is not None and lo <= r[2] <= hi for d, _, lo, hi in s) for r in f}
    want = {(*r, 0 if hit[r] else 1) for r in f if hit[r] or r[2] in (12, 21)}
    out = sections.facts_with_anchors(spark.createDataFrame(f, "doc string, seq long, pg int, v string"), spark.createDataFrame(s, "doc string, seq int, page_from long, page_to long"), [12, 21])
    got = [tuple(r) for r in out.select("doc", "seq", "pg", "v", "part").collect()]
    assert len(got) == len(want) and set(got) == want and {r[-1] for r in got} == {0, 1}


def test_facts_and_sections_are_computed_once(spark, capsys):
    catalogue.QUERIES["facts_for_context"](spark, "/root/testdata/sf0.001").explain()
    scans = re.findall(r"FileScan parquet \[(\w+)#", capsys.readouterr().out)
    # the facts are a union of three over one view, whose exchange is made once
    assert scans.count("o_custkey") == 3 and scans.count("doc_id") == 1


def test_replies_meet_sections_by_place(spark, capsys):
    views.frame(spark, "/root/testdata/sf0.001", "replies").explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x and "conv_id" not in x]
    assert joins and not [x for x in joins if re.search(r"Inner.*\(k#|NestedLoop|Cartesian", x)]
    assert len([x for x in joins if "% n#" in x]) == 2


def test_level_one_sections_leave_no_gap(spark):
    rng = random.Random(2)
    marks, page = [], 1
    for i in range(40):
        marks.append(("d", i + 1, f"T{i}", 1 if i == 0 else rng.randint(1, 3), page))
        page += rng.randint(1, 4)
    p = spark.createDataFrame([("d", k, str(k)) for k in range(1, page + 1)], "doc string, page int, text string")
    out = sections.build_sections(spark.createDataFrame(marks, "doc string, seq int, title string, level int, page_from long"), p)
    top = out.filter("level = 1").orderBy("seq").collect()
    assert [n for r in top for n in range(r.page_from, r.page_to + 1)] == list(range(1, page + 1)) and out.select("id").distinct().count() == 40


# ---------------------------------------------------------------- model calls and page cache


def prompts(spark, n):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "pg int, prompt string").coalesce(1)


def test_calls_fail_as_rows(spark):
    def client(prompt):
        n = int(prompt[1:])
        if n == 0:
            time.sleep(30)
        if n == 1:
            raise RuntimeError("busy")
        return {2: {"text": ""}, 3: {"text": None}, 4: {"error": "quota", "status": 402}, 5: None, 6: {"choices": []}}.get(n, {"text": f"ok {n}", "prompt_tokens": n})

    began = time.monotonic()
    rows = models.call_model(prompts(spark, 9).union(spark.createDataFrame([(99, None)], "pg int, prompt string")), client, timeout_s=1.0).collect()
    assert time.monotonic() - began < 25
    got = {r.pg: r for r in rows}
    assert [r.pg for r in rows] == [*range(9), 99]
    assert got[0].error == "no reply within 1 s" and got[1].error == "busy" and got[4].error == "quota" and got[99].error == "no prompt" and got[99].attempt == 0
    assert all(got[i].error == "empty reply" for i in (2, 3, 6)) and got[5].error.startswith("no reply")
    assert all(got[i].text is None and got[i].prompt_tokens == 0 for i in range(7)) and (got[7].text, got[7].prompt_tokens, got[7].error) == ("ok 7", 7, None)


def test_attempts_and_models():
    calls = []

    def client(prompt, model):
        calls.append(model)
        if prompt == "refused" and model != "c":
            raise models.CallFailed("HTTP 404", 404)
        if prompt == "flaky" and len(calls) < 2:
            raise OSError("reset")
        if prompt == "down":
            raise OSError("down")
        return {"text": "fine"}

    def run(prompt):
        calls.clear()
        r = models.ask(client, prompt, ["a", "b", "c"], 2, 5.0, 0.0)
        return r["model"], r["attempt"], r["error"], list(calls)

    assert run("refused") == ("c", 5, None, ["a", "a", "b", "b", "c"])
    assert run("flaky") == ("a", 2, None, ["a", "a"])
    assert run("down") == (None, 2, "down", ["a", "a"])  # an outage is not mended by another model


def test_calls_run_at_once_but_not_more_than_workers(spark, tmp_path):
    folder = str(tmp_path)

    def client(prompt):
        mark = f"{folder}/{uuid.uuid4().hex}"
        open(mark, "w").close()
        seen = len(os.listdir(folder))
        time.sleep(0.2)
        os.remove(mark)
        return {"text": str(seen)}

    began = time.monotonic()
    most = max(int(r.text) for r in models.call_model(prompts(spark, 24), client, workers=6).collect())
    assert 2 <= most <= 6 and time.monotonic() - began < 24 * 0.2 + 10


def test_a_killed_run_is_taken_up(spark, tmp_path):
    calls, cache, flag = str(tmp_path / "calls"), str(tmp_path / "cache"), str(tmp_path / "healthy")
    os.makedirs(calls)

    def client(prompt):
        open(f"{calls}/{prompt}-{uuid.uuid4().hex}", "w").close()
        if prompt == "p7":
            return {"text": ""} if not os.path.exists(flag) else {"text": "late"}
        if prompt == "p33" and not os.path.exists(flag):
            raise SystemExit(9)  # the worker ends, and with it the job
        return {"text": f"reply to {prompt}", "prompt_tokens": 3}

    asked = lambda: sorted(int(n.split("-")[0][1:]) for n in os.listdir(calls))
    pages = prompts(spark, 60)
    with pytest.raises(Exception):  # noqa: B017 the engine's own error for a lost worker
        page_cache.fill_cache(pages, cache, client, wave_pages=10, workers=2)
    kept = {r.pg for r in page_cache.cached_replies(spark, cache).collect()}
    before = asked()
    assert 0 < len(kept) < 60 and 33 not in kept and page_cache.page_status(pages, cache).filter("status = 'missing'").count() > 0
    open(flag, "w").close()
    status = {r.pg: r for r in page_cache.fill_cache(pages, cache, client, wave_pages=10, workers=2).collect()}
    again = asked()
    for p in before:
        again.remove(p)
    assert not kept & set(again) and set(again) == set(range(60)) - kept
    assert {r.status for r in status.values()} == {"ok"} and page_cache.cached_replies(spark, cache).count() == 60
    n = len(asked())
    page_cache.fill_cache(pages, cache, client)
    assert len(asked()) == n
    assert page_cache.read_attempts(spark, cache).filter("pg = 7 AND status = 'ok'").first().text == "late"


def test_failed_pages_leave_an_error_and_are_redone(spark, tmp_path):
    cache = str(tmp_path / "cache")
    fail = lambda p: {"error": "overloaded"} if p == "p2" else {"text": p}
    got = {r.pg: (r.status, r.error) for r in page_cache.fill_cache(prompts(spark, 4), cache, fail).collect()}
    assert got == {0: ("ok", None), 1: ("ok", None), 2: ("failed", "overloaded"), 3: ("ok", None)}
    got = {r.pg: (r.status, r.attempts) for r in page_cache.fill_cache(prompts(spark, 5), cache, lambda p: {"text": p}).collect()}
    assert got == {0: ("ok", 1), 1: ("ok", 1), 2: ("ok", 2), 3: ("ok", 1), 4: ("ok", 1)}


def test_damaged_page_files(spark, tmp_path):
    good = '{"pg":1,"model":"m","finish":"stop","attempt":1,"objects":[{"kind":"table","has_numbers":true}, null],"records":[{"m":"a","v":"5"},{"m":"b","v":"x"},null]}'
    for name, text in (("p001.json", good), ("p002.json", good[:90]), ("p004.json", ""), ("p005.json", "[1, 2]"), ("p006.json", good.replace('"pg":1', '"pg":77'))):
        (tmp_path / name).write_text(text)
    facts, objects, status = readers.read_pages(spark, str(tmp_path), 6)
    assert {r.pg: r.status for r in status.collect()} == {1: "ok", 2: "damaged", 3: "missing", 4: "damaged", 5: "damaged", 6: "ok"}
    assert sorted((r.pg, r.v) for r in facts.collect()) == [(1, 5.0), (6, 5.0)] and objects.count() == 2
    assert {r.pg: r.model for r in status.collect()}[1] == "m"


# ---------------------------------------------------------------- answers end to end


def test_ask_routes_widens_falls_back_and_guards(spark):
    s = spark.createDataFrame(SECTIONS + [("x", 1, "foreign", "X", 1, 1, 3, "tx")], KINDS)
    kinds = "question_id int, question string, doc string, mode string"
    q = spark.createDataFrame([(1, "low", "d", "router"), (2, "down", "d", "router"), (3, "foreign", "d", "router"), (4, "Стоит ли инвестировать?", "d", "full"), (5, "found", "d", "vector"), (6, "empty", "d", "router")], kinds)
    f = spark.createDataFrame([("d", i, "t", "m", None, "2024", float(p or 0), "u", p) for i, p in enumerate([5, 6, 11, 21, None])], "doc string, seq int, t string, m string, s string, p string, v double, u string, pg int")
    aggregates = spark.createDataFrame([("d", '{"total":1}')], "doc string, aggregates string")

    def router(prompt):
        word = prompt.rsplit("<question>", 1)[1][:-11]
        assert "e | E | стр. 6-6" in prompt and "foreign |" not in prompt
        if word == "down":
            raise RuntimeError("no router")
        return {"text": {"low": '{"sections": ["e"], "confidence": 0.1}', "foreign": '{"sections": ["foreign"], "confidence": 0.9}'}.get(word, '{"sections": ["f"], "confidence": 0.9}'), "prompt_tokens": 10, "latency_s": 2.0}

    def model(prompt):
        return {"text": "" if "empty" in prompt else "Рекомендую купить 99 (стр. 5)" if "инвест" in prompt else "5", "prompt_tokens": 1, "completion_tokens": 1_000_000, "latency_s": 1.0, "model": "large"}

    searched = spark.createDataFrame([(5, "f")], "question_id int, id string")
    prices = spark.createDataFrame([("large", 10.0, 50.0)], "model string, price_in double, price_out double")
    got = {r.question_id: r for r in context.ask(q, s, f, router, model, [21], aggregates, searched, prices).collect()}
    assert {i: r["mode"] for i, r in got.items()} == {1: "router", 2: "full", 3: "full", 4: "full", 5: "vector", 6: "router"}
    # e, then b that holds it: nested e goes
    assert 'id="b"' in got[1].prompt and 'id="e"' not in got[1].prompt and 'id="f"' in got[5].prompt and "\nta\n" not in got[5].prompt
    assert all(',"aggregates":{"total":1}}' in r.prompt for r in got.values())
    assert '"pg":null' in got[4].prompt and '"pg":null' not in got[1].prompt and '"pg":21' in got[1].prompt and '"pg":11' not in got[1].prompt
    assert (got[4].unverified, got[4].verdict_leaked, got[4].advice_guarded, got[4].cited_pages) == (["99"], True, True, [5]) and context.NOTICE in got[4].text
    assert got[6].error == "empty reply" and got[6].text is None and (got[1].prompt_tokens, got[1].latency_s, got[4].prompt_tokens) == (11, 3.0, 1) and got[1].cost == pytest.approx(50.00001)


def test_a_document_is_put_together_once_for_its_questions(spark, tmp_path):
    n, m = 400, 300
    texts = [(i, f"{i},5 " + "x" * 400) for i in range(1, n + 1)]
    s = spark.createDataFrame([("d", i, f"s{i}", "T", 1, i, i, t) for i, t in texts], KINDS)
    f = spark.createDataFrame([("d", 1, "t", "m", None, "p", 7.25, "u", 3)], "doc string, seq int, t string, m string, s string, p string, v double, u string, pg int")
    q = spark.range(m).select(F.col("id").alias("question_id"), F.concat(F.lit("Q 9 "), F.col("id").cast("string")).alias("question"), F.lit("d").alias("doc"), F.lit("full").alias("mode"))
    home = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(home))
    out = context.ask(q, s, f, lambda p: {"text": "[]"}, lambda p: {"text": "7,25 и 12,5 и 999 и 9", "prompt_tokens": len(p)}, [], keep_prompts=False)
    got = out.collect()
    assert len(got) == m and "prompt" not in out.columns and all(r.unverified == ["999"] for r in got)
    assert all(r.prompt_tokens > sum(len(t) for _, t in texts) for r in got)
    size = sum(os.path.getsize(os.path.join(r, x)) for d in set(os.listdir(home)) - before for r, _, xs in os.walk(os.path.join(home, d)) for x in xs)
    assert size < 2_000_000  # the prompts have 50 MB


def test_no_prompt_of_a_whole_document_passes_from_spark_to_python(spark, monkeypatch):
    """Router prompts (an outline each) and those of whole documents were made by Spark, a copy a question."""
    s = spark.createDataFrame([("d", i, f"s{i}", f"T {i} " + "y" * 60, 1, i, i, f"{i},5 " + "x" * 200) for i in range(1, 200)] + [("e", 1, "e", "E", 1, 1, 1, "1,5")], KINDS)
    f = spark.createDataFrame([("d", 1, "t", "m", None, "p", 7.25, "u", 3), ("d", 2, "t", "m", "s", "p", 8.5, "u", 21), ("e", 1, "t", "m", None, "p", 2.25, "u", 1)], "doc string, seq int, t string, m string, s string, p string, v double, u string, pg int")
    modes = ["router", "full", "vector"]
    q = spark.createDataFrame([(i, None if i == 7 else f"Q{i} 3", "nowhere" if i % 10 == 9 else "de"[i % 2], modes[i % 3]) for i in range(60)], "question_id int, question string, doc string, mode string")
    aggregates = spark.createDataFrame([("d", '{"total":1}')], "doc string, aggregates string")
    router = lambda p: {"text": "?" if len(p) % 4 == 0 else '{"sections": ["s5", "e"], "confidence": 0.9}', "prompt_tokens": 1}
    model = lambda p: {"text": f"{len(p)} и 7,25 и 1,5 и 3 (стр. 3)", "prompt_tokens": len(p)}
    sent, call = [0], models.call_model

    def seen(prompts, *more, **options):
        sent.append(prompts.agg(F.max(F.length("prompt"))).first()[0] or 0)
        return call(prompts, *more, **options)

    asked = lambda keep: context.ask(q, s, f, router, model, [21], aggregates, keep_prompts=keep)
    cols = ["question_id", "mode", "text", "error", "unverified", "cited_pages", "pages", "chars", "tokens", "prompt_tokens"]
    want = sorted(map(str, asked(True).select(*cols).collect()))
    monkeypatch.setattr(context, "call_model", seen)
    got = sorted(map(str, asked(False).select(*cols).collect()))
    assert got == want and len(got) > 40 and max(sent) < 5000 and "no prompt" in str(got)


def test_an_id_of_another_document_is_unknown(spark):
    replies = spark.createDataFrame([(1, "d", '{"sections": ["x", "a"], "confidence": 1}')], "question_id int, doc string, reply string")
    known = spark.createDataFrame([("d", "a"), ("e", "x")], "doc string, id string")
    assert context.route(replies, known).first().ids == ["a"]


def test_fallback_filters_facts_by_page(spark):
    q = spark.createDataFrame([(1, "Q", "d", "full"), (2, "Q", "d", "router")], "question_id int, question string, doc string, mode string")
    f = spark.createDataFrame([("d", 1, "t", "m", None, "p", 1.0, "u", None), ("d", 2, "t", "m", None, "p", 2.0, "u", 99), ("d", 3, "t", "m", None, "p", 3.0, "u", 11)], "doc string, seq int, t string, m string, s string, p string, v double, u string, pg int")
    out = {r.question_id: r for r in context.build(q, spark.createDataFrame(SECTIONS, KINDS), f, spark.createDataFrame([(2, "zz")], "question_id int, id string"), []).collect()}
    found = lambda r: [v for v in (1.0, 2.0, 3.0) if f'"v":{v}' in r.prompt]
    assert found(out[1]) == [1.0, 2.0, 3.0] and out[2].mode == "router->full" and found(out[2]) == [3.0]


def test_pass_rule(spark):
    kinds = "id int, text string, expect_values array<double>, expect_pages array<int>, expect_terms array<string>, forbid_terms array<string>, require_refusal boolean, unverified array<string>"
    base = ("35,8 (стр. 3) рост", [35.8], [3], ["рост"], ["акции"], False, [])
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(kinds.split(", ")[1:], base, strict=True))
    rows = [base, change(expect_values=[1.0]), change(expect_pages=[9]), change(expect_terms=["нет"]), change(text="35,8 (стр. 3) рост акции"), change(unverified=["7"]), change(text="35,8 (стр. 3) рост. Рекомендую купить"), change(expect_values=None, expect_pages=None, expect_terms=None, unverified=None)]
    got = [r.passed for r in evaluate.judged(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kinds)).orderBy("id").collect()]
    assert got == [True, False, False, False, False, False, False, True]


# ---------------------------------------------------------------- pairs, folds, ticks


PAIR = "pg int, pi long, vi long, score double, same boolean"


def greedy(rows):
    out = set()
    for pg in {r[0] for r in rows}:
        used = set()
        for _, pi, vi, score, same in sorted((r for r in rows if r[0] == pg), key=lambda r: (-r[3], not r[4], r[1], r[2])):
            if ("p", pi) not in used and ("v", vi) not in used:
                used |= {("p", pi), ("v", vi)}
                out.add((pg, pi, vi, score, same))
    return out


def test_rounds_equal_the_fold(spark):
    rng = random.Random(9)
    rows = list({(pg, pi, vi): (pg, pi, vi, rng.choice([0.5, 0.7, 0.9]), rng.random() < 0.5) for pg in (*range(12), None) for pi, vi in [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(40)]}.values())
    rows += [(50, i // 2, (i + 1) // 2, 1.0 - i / 100, False) for i in range(16)]  # a chain: one pair a round
    df = spark.createDataFrame(rows, PAIR)
    for out in (linkage.folded(df), linkage.mutual_rounds(df), linkage.assign(df, small_page=30)):
        got = [tuple(r) for r in out.select("pg", "pi", "vi", "score", "same").collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(rows)
    assert linkage.assign(df.limit(0)).count() == 0


def test_a_page_of_many_candidates(spark):
    df = spark.range(100_000).select(F.lit(1).alias("pg"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("pi"), F.pmod(F.xxhash64(F.col("id") + 1_000_000), F.lit(700)).alias("vi"), F.round(F.pmod(F.xxhash64(F.col("id") * 3), F.lit(10_000)) / 10_000, 4).alias("score"), (F.col("id") % 2 == 0).alias("same")).dropDuplicates(["pi", "vi"])
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) > 80_000 and {tuple(r) for r in linkage.assign(df).collect()} == greedy(rows)


def chunked(text, most, overlap, sep="\n\n"):
    text = text.strip(" ")
    if len(text) <= most:
        return [text] if text else []
    out, cur = [], ""
    for p in text.split(sep):
        if cur and len(cur) + len(p) > most:
            out.append(cur)
            cur = cur[-overlap:] + sep + p
        else:
            cur = cur + sep + p if cur else p
    return [c for c in [*out, cur] if c]


def test_chunks_equal_a_loop_and_stay_linear(spark):
    rng = random.Random(11)
    texts = ["\n\n".join("x" * rng.choice([0, 1, 5, 30, 80]) for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["", " a ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", retrieval.chunk_texts(F.col("t"), 70, 8).alias("c")).collect()}
    assert all(got[i] == chunked(t, 70, 8) for i, t in enumerate(texts) if t is not None) and not got[len(texts) - 1]
    long = "\n\n".join(["y" * 90] * 100_000)
    began = time.monotonic()
    n = spark.createDataFrame([(long,)], "t string").select(F.size(retrieval.chunk_texts(F.col("t"), 70, 8))).first()[0]
    assert n == 100_000 and time.monotonic() - began < 60


def test_many_words_on_a_page(spark):
    w = spark.range(50_000).select(F.lit(1).alias("page"), F.col("id").alias("word"), (F.col("id") * 10.0).alias("x0"), (F.col("id") * 10.0 + 5).alias("x1"), F.lit(1.0).alias("y0"), F.lit(2.0).alias("y1"), F.lit("w").alias("text"))
    began = time.monotonic()
    assert layout.merge_adjacent(w).count() == 50_000 and time.monotonic() - began < 60


def test_folded_gives_nothing_for_nothing(spark):
    step = lambda cur, x: F.struct(F.array(x).alias("out"), (cur + x).alias("cur"))
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<int>")
    got = [r[0] for r in df.select(X.folded(F.col("a"), F.lit(0), step, lambda cur: F.array(cur))).collect()]
    assert got == [[1, 2, 3, 6], [0], [0]]


def test_ticks_have_a_status(spark):
    t = spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (1, 3, 90.0), (2, 4, 10.0), (3, 5, 10.0), (3, 6, 50.0), (4, 7, None)], "page long, tick long, x double")
    n = spark.createDataFrame([(1, 11.0, 5.0), (1, 14.0, 6.0), (1, 200.0, 7.0), (3, 10.0, 1.0), (9, 1.0, 1.0)], "page long, x double, value double")
    got = {r.tick: (r.value, r.status) for r in layout.tick_chart(t, n).collect()}
    assert got == {1: (5.0, "ok"), 2: (6.0, "ok"), 3: (None, "too_far"), 4: (None, "none_free"), 5: (1.0, "ok"), 6: (None, "none_free"), 7: (None, "no_place")}
    two = {r.tick: r.status for r in layout.tick_chart(t, n, expected=2).collect()}
    assert {k for k, v in two.items() if v == "tick_count"} == {1, 2, 3, 4, 7} and two[5] == "ok"
    filled = layout.demanded(layout.tick_chart(t.filter("tick IN (1, 2)"), n, expected=2))
    assert {r.value for r in filled.collect()} == {5.0, 6.0}
    with pytest.raises(Exception, match="page 2 tick 4 none_free"):
        layout.demanded(layout.tick_chart(t.filter("tick = 4"), n)).collect()


# ---------------------------------------------------------------- kept index, upsert, sinks


def test_a_kept_index_ends_early_and_follows_its_texts(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(200)], k=rng.randint(0, 40)))) for i in range(900)] + [(2000, None), (2001, "w150 w150 w199"), (2002, "w150")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w0 w150 w150"), (2, "none"), (3, "W3 w7"), (4, "w199"), (5, "w0")], "query_id int, query string")
    home = retrieval.open_index(docs, str(tmp_path), block_docs=16)
    order = lambda d: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in d.select("query_id", "rank", "doc_id", "score").collect())
    for k in (1, 8, 2000):
        assert order(retrieval.top_k_indexed(spark, home, asked, k, 6)) == order(retrieval.top_k(retrieval.bm25(docs, asked), k, 6))
    made = os.path.getmtime(f"{home}/corpus/_SUCCESS")
    assert retrieval.open_index(docs.repartition(3), str(tmp_path), block_docs=16) == home and os.path.getmtime(f"{home}/corpus/_SUCCESS") == made
    other = retrieval.open_index(docs.filter("doc_id <> 2001"), str(tmp_path), block_docs=16)
    assert other != home and not os.path.exists(home) and os.listdir(tmp_path) == [other.rsplit("/", 1)[1]]
    assert 2001 not in {r.doc_id for r in retrieval.top_k_indexed(spark, other, asked).collect()}


def test_dense_search_makes_no_row_for_each_pair(spark, capsys):
    rng = random.Random(5)
    rows = [(i, None if i == 7 else [None if i == 8 and c == 1 else float("nan") if i == 9 and c == 2 else rng.choice([-1.0, 0.5, 1.0, 2.0]) for c in range(4 if i % 50 else 5)]) for i in range(1, 500)]
    rows += [(i + 1000, v) for i, v in rows[:200]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 20 = 0 OR vec_id = 9")
    want = sorted(map(str, retrieval.top_k(retrieval.cosine(v, q), 8, 6).select("query_id", "doc_id", "score", "rank").collect()))
    got = retrieval.dense_top_k(v, q, 8, 6, cell_rows=100, cell_asked=10)
    assert len(want) > 100 and sorted(map(str, got.select("query_id", "doc_id", "score", "rank").collect())) == want
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_many_asked_terms_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a1 b2 c"), (2, "a3")], "query_id int, query string")
    rows = lambda: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.bm25(docs, asked).collect())
    few = rows()
    monkeypatch.setattr(retrieval, "LISTED_TERMS", 2)
    assert rows() == few and len(few) > 50


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    kinds = "id int, mode string, n int"
    want = {}
    for batch in ([(i, "a", 0) for i in range(200)], [(3, "a", 5), (3, "a", 9), (900, "b", 1)], [(3, "a", 7)], []):
        if batch:
            spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(src)
        incremental.upsert_buckets_stream(spark.readStream.schema(kinds).parquet(src), out, ["id", "mode"], ck, 16, "n").awaitTermination(60)
        want |= {r[:2]: r for r in sorted(batch)}
        assert sorted(map(tuple, incremental.read_upserted(spark, out, kinds).collect())) == sorted(want.values())
    versions = {v: len([b for b in os.listdir(f"{out}/{v}") if b.startswith("bucket=")]) for v in os.listdir(out) if v.startswith("v")}
    assert versions["v0"] == 16 and versions["v2"] == 1 and len(os.listdir(f"{out}/manifests")) == 2
    assert incremental.read_upserted(spark, str(tmp_path / "none"), kinds).count() == 0


def test_json_arrays_and_reports(spark, tmp_path):
    s = spark.createDataFrame([("b", "T, \"x\"", 1, 1, 2, None), ("a", "Ё", 2, 1, 1, "line\nfeed")], readers.SECTION)
    writers.write_json_array(s, str(tmp_path / "s"), ["id"])
    (part,) = [f for f in os.listdir(tmp_path / "s") if f.startswith("part-")]
    assert [r["id"] for r in json.loads((tmp_path / "s" / part).read_text())] == ["a", "b"]
    assert [tuple(r) for r in readers.read_json_array(spark, str(tmp_path / "s")).orderBy("seq").select(*s.columns).collect()] == [tuple(r) for r in s.orderBy("id").collect()]
    writers.write_json_array(s.limit(0), str(tmp_path / "none"), ["id"])
    assert readers.read_json_array(spark, str(tmp_path / "none")).count() == 0
    kinds = "id string, type string, mode string, passed boolean, values_ok boolean, pages_ok boolean, tokens long, latency double, cost double, unverified array<string>, error string"
    rows = [("q1", "fact", "full", True, True, None, 100, 2.0, 0.5, [], None), ("q1", "fact", "vector", False, False, True, 10, 1.0, 0.1, ["7", "8"], None), ("q2", "fact", "vector", False, None, None, 12, 3.0, 0.1, None, "busy")]
    report = writers.eval_report(spark.createDataFrame(rows, kinds))
    for line in ("| full | 1/1 | 1/1 | 0/0 | 100 | 2.0 | $0.50 |", "| vector | 0/2 | 0/1 | 1/1 | 12 | 3.0 | $0.20 |", "| q1 | fact | vector | failed | no | yes | 10 | 1.0 | $0.100 |", "| q1 | vector | 7, 8 |", "| q2 | vector | busy |"):
        assert line in report
    assert "## Errors" not in writers.eval_report(spark.createDataFrame(rows[:1], kinds))
    assert writers.savings_report(spark.createDataFrame(rows, kinds)) == "- `vector`: 88%" and writers.savings_report(spark.createDataFrame(rows[1:], kinds)) == ""
    (tmp_path / "agg.json").write_text('{"aggregates":[{"p":"2024","v":1.5}],"checksum":[]}')
    assert readers.read_aggregates(spark, str(tmp_path / "agg.json"), "d").first().aggregates == '[{"p":"2024","v":1.5}]' and readers.read_aggregates(spark, str(tmp_path / "no.json"), "d").count() == 0


def test_audit_report(spark):
    kinds = "seq long, t string, m string, s string, p string, v double, u string, pg int"
    a = spark.createDataFrame([(1, "t", "m", "A", "1", 5.0, "u", 1), (2, "t", "m", "B", "1", 6.0, "u", 1), (3, "t", "m", "C", "1", 7.0, "u", 2)], kinds)
    b = spark.createDataFrame([(10, "t", "m", "A", "1", 5.0, "u", 1), (11, "t", "m", "B", "1", 9.0, "u", 1), (12, "t", "m", "D", "1", 1.0, "u", 3), (13, "t", "m", "D", "1", 1.0, "u", 3)], kinds)
    matched = spark.createDataFrame([(1, 10, True), (2, 11, False)], "pi long, vi long, same boolean")
    merged = linkage.reconcile(a, b, matched)
    objects = spark.createDataFrame([(1, "table", True, 2, 1), (4, "chart", True, 1, 1), (4, "photo", False, 0, 0)], "pg int, kind string, has_numbers boolean, rows int, cols int")
    covered = quality.coverage(spark.range(1, 5).select(F.col("id").cast("int").alias("pg")), objects, a, b)
    controls = spark.createDataFrame([("m", "A", "1", 5.0, 1, True), ("m", "Z", "1", 5.0, 0, False)], "m string, s string, p string, want double, n long, ok boolean")
    ruled = quality.range_rules(a, [("u", 0.0, 6.5)]).select("seq", "v", "rule")
    layers = spark.createDataFrame([("tiny", 3, 2)], "reason string, n long, pages long")
    report = writers.audit_report(merged, covered, objects, controls, ruled, layers)
    for line in ("| confirmed | 1 |", "| only_right | 2 |", "| 1 | m | B | 1 | 6.0 | 9.0 |", "| 2 | m | C | 1 | 7.0 |", "| 3 | 2 |", "| m | Z | 1 | 5.0 | 0 | False |", "| 4 | 2 | 1 |", "| 3 | 7.0 |", "| 3 | 1 |", "| tiny | 3 | 2 |"):
        assert line in report, line
    short = writers.audit_report(merged, covered, objects, controls, ruled.limit(0), layers, limit=1)
    assert "## 5. Values out of range\n\nnone" in short and "in all" in short
