"""Index, label lines, bands, rankings, reports and look-ups in small cases."""

import json
import random

from pyspark.sql import functions as F

from pagetrail.operators import evaluate, facts, layout, linkage, quality, retrieval
from pagetrail.sources import readers, writers
from pagetrail.streaming import incremental


def test_a_stored_index_gives_the_same_scores(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("a b c d e f g-h".split(), k=rng.randint(0, 30)))) for i in range(60)] + [(60, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a a g-h"), (2, "unknown"), (3, "B c")], "query_id int, query string")
    retrieval.write_index(docs, str(tmp_path / "index"))
    rows = lambda d: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in d.collect())
    got = rows(retrieval.bm25_indexed(spark, str(tmp_path / "index"), asked))
    assert got == rows(retrieval.bm25(docs, asked)) and {q for q, _, _ in got} == {1, 3}


def test_chunks_are_found_by_title(spark):
    s = spark.createDataFrame([("d", 1, "s1", "Дивиденды", 1, 3, 4, "текст"), ("d", 2, "s2", "Риски", 1, 5, 6, "другой текст")], "doc string, seq long, id string, title string, level int, page_from long, page_to long, text string")
    docs = retrieval.chunk_documents(retrieval.chunks(s))
    assert docs.orderBy("doc_id").first().text == "Дивиденды\nстр. 3-4\nтекст"
    hits = retrieval.top_k(retrieval.bm25(docs, spark.createDataFrame([(1, "дивиденды")], "query_id int, query string"))).join(docs, "doc_id")
    assert [(r.section_id, r.place) for r in retrieval.section_ids(hits).collect()] == [("s1", 1)]


def test_label_lines(spark):
    text = ["Итого:", "Такси и", "", "каршеринг2", "12,5 млрд рублей", "7,1 млрд рублей", "стр.", "Прочее:", "3,0 млрд рублей", "одна", "4,0 млрд рублей"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)] + [("e", 0, "1,0 млрд рублей")], "doc string, line int, text string")
    got = {(r.doc, r.line): (r.value, r.label) for r in layout.label_lines(lines, r"^([0-9]+,[0-9]+)\s+млрд рублей$", ["млрд рублей"]).collect()}
    assert got == {("d", 4): ("12,5", "Такси и каршеринг"), ("d", 5): ("7,1", ""), ("d", 8): ("3,0", "Прочее"), ("d", 10): ("4,0", "одна"), ("e", 0): ("1,0", "")}


def test_band_orders(spark):
    w = spark.createDataFrame([(1, 1, 9.0, 10.0, "3"), (1, 2, 5.0, 10.0, "4,5"), (1, 3, 1.0, 20.0, "7"), (1, 4, 0.0, 20.0, "x"), (1, 5, 0.0, 99.0, "8"), (2, 1, 0.0, 10.0, "1%")], "page int, word int, x0 double, y0 double, text string")
    order = lambda by: [r.value for r in layout.band_sequence(w, 5, 30, 3, by).filter("page = 1").orderBy("place").collect()]
    assert order("y") == [4.5, 3.0, 7.0] and order("x") == [7.0, 4.5, 3.0] and order("stream") == [3.0, 4.5, 7.0]
    assert {(r.page, r.found, r.ok) for r in layout.band_sequence(w, 5, 30, 3).collect()} == {(1, 3, True), (2, 1, False)}
    assert layout.band_sequence(w, 5, 30, 3, allow_pct=False).filter("page = 2").count() == 0


def test_ranks_and_headers(spark):
    rows = spark.createDataFrame([("A", "1", 5.0), ("B", "1", None), ("C", "1", 9.0), ("D", "1", 5.0)], "segment string, period string, yoy_pct double")
    assert [r.segment for r in facts.rank_segments(rows).orderBy("place").collect()] == ["C", "A", "D", "B"]
    totals = spark.createDataFrame([("2024", 80.0, 3), ("2025", 100.0, 4), ("2026", 100.0, 5)], "p string, v double, pg int")
    pairs = spark.createDataFrame([("2025", "2024"), ("2026", "2025"), ("2024", "2023")], "cur string, prev string")
    got = {r.period: (r.total_revenue, r.total_revenue_page, r.total_revenue_prev, r.total_growth_abs) for r in facts.growth_header(totals, pairs).collect()}
    assert got == {"2025": (100.0, 4, 80.0, 20.0), "2026": (100.0, 5, 100.0, None), "2024": (80.0, 3, None, None)}
    doc = json.loads(writers.aggregates_document(rows, totals).first().value)
    assert len(doc["aggregates"]) == 4 and len(doc["checksum"]) == 3


def test_reports_and_picks(spark):
    covered = spark.createDataFrame([(1, 5, "partial"), (2, 9, "full"), (3, 9, "partial")], "pg int, numeric long, verdict string")
    assert [r.pg for r in quality.busiest_pages(covered, 2).collect()] == [2, 3] and [r.pg for r in quality.partial_pages(covered, 1).collect()] == [1]
    q = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, title string")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(evaluate.pick_questions(q, limit=2)) == [1, 2] and ids(evaluate.pick_questions(q, [3, 9])) == [3] and len(ids(evaluate.pick_questions(q))) == 3
    assert ids(evaluate.question_titles(spark.createDataFrame([(2, 1.0), (7, 1.0)], "id int, score double"), q)) == [2]
    used = spark.createDataFrame([(1, ["s2", "zz", "s1"])], "answer_id int, section_ids array<string>")
    titles = evaluate.section_titles(used, spark.createDataFrame([("s1", "A"), ("s2", "B")], "id string, title string")).orderBy("pos")
    assert [(r.pos, r.title) for r in titles.collect()] == [(0, "B"), (2, "A")]
    merged = readers.inline(spark, [("t", "m", None, "2", 1.0, "u", 1), ("t", "m", "Z", "1", 2.0, "u", 1), ("t", "m", "A", "1", 3.0, "u", 1)])
    assert [r.s for r in merged.orderBy(*linkage.merged_order()).collect()] == ["A", None, "Z"]


def test_grids_and_pages_left(spark):
    grid = spark.createDataFrame([(1, [["a  b", None, " "], [None], ["c"]])], "id int, grid array<array<string>>")
    assert readers.read_grids(grid).first().grid == [["a b"], ["c"]]
    pages = spark.createDataFrame([(1,), (2,)], "pg int")
    assert [r.pg for r in readers.pages_left(pages, spark.createDataFrame([(1,), (1,)], "pg int")).collect()] == [2]


def test_a_batch_keeps_its_last_row_and_counts_by_window(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 5, "new", "2024-01-01 00:10:00"), (1, 2, "old", "2024-01-01 00:20:00"), (2, 1, "only", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "id int, n int, status string, at string").withColumn("ts", F.to_timestamp("at")).drop("at").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id int, n int, status string, ts timestamp").parquet(src)
    incremental.upsert_stream(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "ck"), "n").awaitTermination(60)
    assert {(r.id, r.status) for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()} == {(1, "new"), (2, "only")}
    q = incremental.windowed_counts(stream.withColumn("status", F.lit("x"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
