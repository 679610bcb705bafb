import random

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import context, evaluate, facts, layout, linkage, quality, retrieval, sections
from pagetrail.sources import readers, writers
from pagetrail.streaming.incremental import upsert_stream

SEC = "doc string, seq long, id string, title string, level int, page_from long, page_to long, text string"


def test_section_ends_and_leaves(spark):
    rows = [("d", 1, 1, 1), ("d", 2, 2, 2), ("d", 3, 2, 5), ("d", 4, 1, 9)]
    b = spark.createDataFrame(rows, "doc string, seq long, level int, page_from long").withColumns({"last_page": F.lit(12).cast("long"), "title": F.lit("T"), "text": F.lit("")})
    s = sections.with_ids(sections.section_ends(b))
    assert [r.page_to for r in s.orderBy("seq").collect()] == [8, 4, 8, 12]
    assert sorted(r.seq for r in sections.leaf_sections(s).collect()) == [2, 3, 4]
    assert sorted(r.seq for r in sections.drop_nested(s).collect()) == [1, 4]


def test_drop_nested_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(str(d), i, rng.randint(1, 9)) for d in range(40) for i in range(8)]
    data = [(d, i, "x", "t", 1, a, a + rng.randint(0, 4), "") for d, i, a in rows]
    got = {(r.doc, r.seq) for r in sections.drop_nested(spark.createDataFrame(data, SEC)).collect()}
    want = set()
    for d in {r[0] for r in data}:
        kept = []
        for r in sorted((x for x in data if x[0] == d), key=lambda x: (x[5], -(x[6] - x[5]), x[1])):
            if not any(k[5] <= r[5] and r[6] <= k[6] for k in kept):
                kept.append(r)
        want |= {(k[0], k[1]) for k in kept}
    assert got == want


def test_chunks(spark):
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 90, "d" * 10])
    got = spark.createDataFrame([(text,), ("",), ("short",)], "t string").select(retrieval.chunk_texts(F.col("t"), 70, 5).alias("c")).collect()
    pieces = got[0].c
    assert got[1].c == [] and got[2].c == ["short"]
    assert pieces[0] == "a" * 30 + "\n\n" + "b" * 30 and pieces[1] == "b" * 5 + "\n\n" + "c" * 90 and pieces[2] == "c" * 5 + "\n\n" + "d" * 10


def test_bm25_prefers_the_matching_text(spark):
    docs = spark.createDataFrame([(0, "выручка группы растёт"), (1, "совет директоров"), (2, "погода сегодня"), (3, None)], "doc_id long, text string")
    hits = retrieval.top_k(retrieval.bm25(docs, spark.createDataFrame([(1, "выручка выручка")], "query_id int, query string"))).collect()
    assert [(h.doc_id, h.rank) for h in hits] == [(0, 1)]


FACT = "seq long, t string, m string, s string, p string, v double, u string, pg int"


def test_totals_growth_and_corrupted_checksum(spark):
    rows = [(1, "t", "Выручка", "A", "2025", 60.0, "u", 1), (2, "t", "Выручка", "B", "2025", 50.0, "u", 1), (3, "t", "Коррекция межсегмент", None, "2025", 10.0, "u", 1), (4, "t", "Выручка", "A", "2024", 40.0, "u", 1)]
    f = spark.createDataFrame(rows, FACT)
    totals = spark.createDataFrame([("2025", 100.0), ("2024", 80.0)], "p string, v double")
    assert facts.checksum(f, totals, ["A", "B"], "выручка", "межсегмент").filter("period = '2025'").first().ok is True
    assert facts.checksum(f.filter("s IS NULL OR s <> 'B'"), totals, ["A", "B"], "выручка", "межсегмент").filter("period = '2025'").first().ok is False
    g = {r.segment: r for r in facts.growth(f.filter("s IS NOT NULL"), totals, spark.createDataFrame([("2025", "2024")], "cur string, prev string")).collect()}
    assert (g["A"].yoy_pct, g["A"].contrib_growth_pct, g["A"].share_pct) == (50.0, 100.0, 60.0) and g["B"].yoy_pct is None
    t = f.withColumns({"src": F.lit("parser"), "confirmed": F.col("seq") == 1, "s": F.lit(None).cast("string")})
    assert facts.total_by_trust(t.filter("p = '2025'"), "u", ["выручка"]).first().v == 60.0


def test_linkage_is_one_to_one(spark):
    a = spark.createDataFrame([(1, "t", "Выручка", "Такси", "2025", 5.0, "млн руб", 3), (2, "t", "Выручка", "Карты", "2025", 7.0, "млн руб", 3), (3, "t", "Прибыль", None, "2025", 1.0, "%", 3)], FACT)
    b = spark.createDataFrame([(10, "t", "Выручка — Такси", None, "2025", 5.04, "млн рублей", 3), (11, "t", "Выручка", "Карты", "2025", 9.0, "млн руб", 3), (12, "t", "MAU", None, "2025", 9.0, "млн", 3)], FACT)
    matched = linkage.assign(linkage.candidates(linkage.keyed(a), linkage.keyed(b)))
    kinds = {(r.pi, r.vi): r.kind for r in linkage.reconcile(a, b, matched).collect()}
    assert kinds == {(1, 10): "confirmed", (2, 11): "mismatch", (3, None): "only_left", (None, 12): "only_right"}


def test_merge_adjacent_and_ticks(spark):
    w = spark.createDataFrame([(1, 1, 0.0, 3.0, 10.0, 19.0, "1"), (1, 2, 4.0, 9.0, 10.04, 19.0, "441,1"), (1, 3, 30.0, 34.0, 10.0, 19.0, "x"), (1, 4, 0.0, 3.0, 40.0, 49.0, "y")], "page long, word long, x0 double, x1 double, y0 double, y1 double, text string")
    assert sorted(r.text for r in layout.merge_adjacent(w, line=1.2).collect()) == ["1441,1", "x", "y"]
    t = spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (1, 3, 90.0)], "page long, tick long, x double")
    n = spark.createDataFrame([(1, 11.0, 5.0), (1, 14.0, 6.0)], "page long, x double, value double")
    assert {(r.tick, r.value) for r in layout.assign_ticks(t, n).collect()} == {(1, 5.0), (2, 6.0)}
    assert {(r.tick, r.value) for r in layout.nearest(t, n).collect()} == {(1, 5.0), (2, 5.0)}


def test_merge_adjacent_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(p, i, float(rng.randint(0, 20)), 0.0, rng.randint(0, 3) * 0.8, 9.0, f"w{i}") for p in range(40) for i in range(8)]
    rows = [(p, i, a, a + rng.randint(1, 9), y, y1, t) for p, i, a, _, y, y1, t in rows]
    got = sorted((r.page, r.text) for r in layout.merge_adjacent(spark.createDataFrame(rows, "page long, word long, x0 double, x1 double, y0 double, y1 double, text string")).collect())
    want = []
    for p in range(40):
        out = []
        for _, _, a, b, y, _, t in sorted((r for r in rows if r[0] == p), key=lambda r: (round(r[4], 1), r[2], r[1])):
            if out and abs(y - out[-1][1]) < 1.2 and 0 <= a - out[-1][2] < 3.2:
                out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], b), out[-1][3] + t)
            else:
                out.append((a, y, b, t))
        want += [(p, o[3]) for o in out]
    assert got == sorted(want)


def test_assign_ticks_equals_a_loop(spark):
    rng = random.Random(5)
    ticks = [(p, i, float(rng.randint(0, 60))) for p in range(30) for i in range(5)]
    nums = [(p, float(rng.randint(0, 60)), float(rng.randint(0, 99))) for p in range(30) for _ in range(4)]
    got = {(r.page, r.tick, r.value) for r in layout.assign_ticks(spark.createDataFrame(ticks, "page long, tick long, x double"), spark.createDataFrame(nums, "page long, x double, value double")).collect()}
    want = set()
    for p in range(30):
        free = sorted(n[1:] for n in nums if n[0] == p)
        for _, tick, x in sorted((t for t in ticks if t[0] == p), key=lambda t: (t[2], t[1])):
            best = min(range(len(free)), key=lambda i: (abs(free[i][0] - x), i), default=None)
            if best is not None and abs(free[best][0] - x) <= 22:
                want.add((p, tick, free.pop(best)[1]))
    assert got == want


@pytest.mark.parametrize(("answer", "ctx", "want"), [("35,8", "35,76", []), ("36", "35,76", ["36"]), ("5", "", ["5"]), ("2025 год", "x 1", []), ("8,7", "−8,7", [])])
def test_grounding(spark, answer, ctx, want):
    row = spark.createDataFrame([(answer, ctx)], "a string, c string").select(evaluate.unverified(F.col("a"), F.col("c")).alias("u")).first()
    assert row.u == want


def test_scores_and_upsert(spark):
    q = spark.createDataFrame([("Выручка 1441,1 (стр. 21). нет данных", [1441.0], [21, 3], ["выручка"], ["покупать"], True)], "text string, expect_values array<double>, expect_pages array<int>, expect_terms array<string>, forbid_terms array<string>, require_refusal boolean")
    r = evaluate.score_card(q).first()
    assert (r.values_ok, r.pages_ok, r.terms_ok, r.forbidden_hit, r.verdict_leaked) == (True, True, True, [], False)
    old, new = (spark.createDataFrame(x, "id int, mode string, n int") for x in ([(1, "a", 1), (2, "a", 1)], [(2, "a", 9), (3, "b", 9)]))
    assert sorted(map(tuple, evaluate.upsert(old, new, ["id", "mode"]).collect())) == [(1, "a", 1), (2, "a", 9), (3, "b", 9)]


def test_rules_and_audits(spark):
    f = spark.createDataFrame([(1, "t", "m", None, "p", 3000.0, "млрд_руб", 1), (2, "t", "m", None, "p", 5.0, "%", 1), (3, "t", "m", None, "p", 5.0, "%", 1)], FACT)
    assert [r.seq for r in quality.range_rules(f).collect()] == [1]
    assert quality.duplicates(f).first().extra == 1
    assert quality.cross_source(f.filter("u = '%'")).first().mismatch is False


def test_route_and_answer(spark):
    replies = spark.createDataFrame([(1, '{"sections":["s1","zz"],"confidence":0.5}'), (2, "?"), (3, '{"sections":["s1"],"confidence":0.9}')], "question_id int, reply string")
    got = {r.question_id: r for r in context.route(replies, spark.createDataFrame([("s1",)], "id string")).collect()}
    assert got[1].ids == ["s1"] and got[1].widen and got[2].need_full and not got[3].widen
    s = spark.createDataFrame([("d", 1, "s1", "A", 1, 1, 5, "t1"), ("d", 2, "s2", "B", 1, 6, 9, "t2")], SEC)
    f = spark.createDataFrame([(1, "t", "m", None, "p", 5.0, "u", 2), (2, "t", "m", None, "p", 6.0, "u", 8)], FACT).withColumn("doc", F.lit("d"))
    q = spark.createDataFrame([(1, "Стоит ли инвестировать?", "d", "router"), (2, "Q", "d", "router")], "question_id int, question string, doc string, mode string")
    chosen = spark.createDataFrame([(1, "s1")], "question_id int, id string")

    def model(prompt):
        if "t2" in prompt:
            raise RuntimeError("busy")
        return {"text": "5 и 77 (стр. 2)", "prompt_tokens": 1, "completion_tokens": 2}

    out = {r.question_id: r for r in context.answer(q, s, f, chosen, model, []).collect()}
    assert out[1].unverified == ["77"] and out[1].advice_guarded and out[1].cited_pages == [2]
    assert out[2].mode == "router->full" and out[2].error == "busy"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"t":"a","m":"m","s":null,"p":"1","v":1.5,"u":"u","pg":3},\n\n{"t":"b","v":2}\n]\n')
    assert [r.t for r in readers.read_jsonl_tolerant(spark, str(tmp_path / "a.json")).orderBy("t").collect()] == ["a", "b"]
    (tmp_path / "s.json").write_text('[{"id":"x","title":"T","level":1,"page_from":1,"page_to":2,"text":"t"}]')
    assert readers.read_json_array(spark, str(tmp_path / "s.json")).first().id == "x"
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/1.json").write_text('{"pg":1,"model":"m","finish":"stop","attempt":1,"usage":{"prompt":1,"completion":2,"cost":0.1},"objects":[{"kind":"table","has_numbers":true}],"records":[{"m":"a","v":"5"},{"m":"b","v":"x"}]}')
    facts_, objects, status = readers.read_pages(spark, str(tmp_path / "pages"), 3)
    assert facts_.count() == 1 and objects.count() == 1 and [r.status for r in status.orderBy("pg").collect()] == ["ok", "missing", "missing"]
    assert readers.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    assert readers.read_questions(spark, '[{"id": 1, "question": "q", "expect_values": [5]}]').first().expect_values == [5.0]
    writers.write_jsonl(facts_, str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out")).first().v == 5.0
    assert writers.replace_between("a<x>b</x>c", "<x>", "</x>", "new") == "a<x>\nnew\n</x>c"
    assert "| 5.0 |" in writers.markdown(facts_.select("v"))


def test_upsert_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([(1, "a", 1), (2, "a", 1)], [(2, "a", 5)])):
        spark.createDataFrame(rows, "id int, mode string, n int").coalesce(1).write.mode("append").parquet(src)
        q = upsert_stream(spark.readStream.schema("id int, mode string, n int").parquet(src), str(tmp_path / "out"), ["id", "mode"], str(tmp_path / "ck"))
        q.awaitTermination(60)
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out/v{i}")).collect()))
    assert got == [(1, "a", 1), (2, "a", 5)]


def test_mean_colour(spark):
    row = spark.createDataFrame([([0x0A1400, 0x141E02],)], "p array<int>").select(layout.mean_colour(F.col("p")).alias("c")).first()
    assert row.c == [15, 25, 1]
