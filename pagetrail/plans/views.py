"""Fixture views over the driver's tables: one SQL text for Spark and DuckDB; {name} stands for a table or view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.operators.sections import section_ends, with_ids

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "seg_year": """
        SELECT c.c_mktsegment AS s, CAST(year(o.o_orderdate) AS INT) AS yr, sum(o.o_totalprice) / 1e6 AS v
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
    "fact_rows": """
        SELECT 'Выручка' AS m, s, yr, round(v * 1.05, 1) AS v, CAST(row_number() OVER (PARTITION BY yr ORDER BY s) AS INT) AS k FROM {seg_year}
        UNION ALL
        SELECT 'Общая выручка' AS m, CAST(NULL AS STRING) AS s, yr, round(sum(v), 1) AS v, 0 AS k FROM {seg_year} GROUP BY yr
        UNION ALL
        SELECT 'Коррекция на межсегментную выручку' AS m, CAST(NULL AS STRING) AS s, yr, round(sum(round(v * 1.05, 1)) - round(sum(v), 1), 1) AS v, 9 AS k FROM {seg_year} GROUP BY yr""",
    "facts_a": """
        SELECT CAST(yr * 10 + k AS BIGINT) AS seq, 'orders' AS t, m, s, CAST(yr AS STRING) AS p, v, 'млн_руб' AS u, CAST(10 * (yr - 1994) + k AS INT) AS pg, 'src0' AS doc
        FROM {fact_rows}""",
    "facts_b": """
        SELECT seq, t, CASE WHEN pg % 5 = 0 AND s IS NOT NULL THEN m || ' — ' || s ELSE m END AS m, CASE WHEN pg % 5 = 0 THEN CAST(NULL AS STRING) ELSE s END AS s,
          p, round(CASE WHEN pg % 11 = 0 THEN v + 9 WHEN pg % 3 = 0 THEN v + 0.04 ELSE v END, 2) AS v, u, pg, doc
        FROM {facts_a} WHERE pg % 7 <> 0""",
    "facts_merged": """
        SELECT seq * 2 AS seq, t, m, s, p, v, u, pg, doc, CASE WHEN pg % 4 = 0 THEN 'both' ELSE 'parser' END AS src, pg % 4 = 0 AS confirmed FROM {facts_a}
        UNION ALL
        SELECT seq * 2 + 1 AS seq, t, m, s, p, v, u, pg, doc, 'vision' AS src, pg % 8 = 1 AS confirmed FROM {facts_b}""",
    "bookmarks": """
        SELECT doc, seq, title, level, text, CAST(1 + coalesce(sum(n_pages) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_from,
          CAST(sum(n_pages) OVER (PARTITION BY doc) AS BIGINT) AS last_page
        FROM (
          SELECT source AS doc, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS seq, 'Раздел ' || CAST(doc_id AS STRING) || ', ' || lang AS title,
            CAST(1 + (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS INT) AS level, text, greatest(ceil(n_chars / 1800.0), 1) AS n_pages
          FROM {documents}) x""",
    "cells": """
        SELECT l_orderkey, l_linenumber,
          CASE l_orderkey % 8 WHEN 0 THEN th || ' ' || rest || ',5' WHEN 1 THEN th || ' ' || rest WHEN 2 THEN '(' || th || ' ' || rest || ',5)' WHEN 3 THEN '−8,' || right(rest, 1)
            WHEN 4 THEN right(rest, 2) || ',3%' WHEN 5 THEN '1.' || rest || '.' || rest WHEN 6 THEN right(rest, 2) || ',7¹' ELSE '—' END AS raw,
          CASE l_returnflag WHEN 'A' THEN 'Выручка, млрд руб.' WHEN 'N' THEN 'млн рублей' ELSE 'тыс. руб., %' END AS head
        FROM (
          SELECT l_orderkey, l_linenumber, l_returnflag, CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) + 1 AS STRING) AS th, lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0') AS rest
          FROM {lineitem}) x""",
    "answers": """
        SELECT k AS answer_id,
          'Итог ' || CASE k % 3 WHEN 0 THEN '1 441,1' WHEN 1 THEN '35,8' ELSE '77,7' END || ' млрд за 2025 год, рост ' || CAST(k % 50 AS STRING) || ',5% (стр. ' || CAST(k % 200 + 1 AS STRING)
            || CASE WHEN k % 2 = 0 THEN '-' || CAST(k % 200 + 3 AS STRING) ELSE '' END || ').' || CASE k % 9 WHEN 0 THEN ' Рекомендую купить акции.' WHEN 1 THEN ' Не рекомендую продавать.' ELSE '' END AS text,
          CASE k % 7 WHEN 0 THEN 'Стоит ли инвестировать в компанию?' WHEN 1 THEN 'Should I buy it?' ELSE 'Какова выручка?' END AS question,
          'Выручка 1 441,1; доля 35,76; рост ' || CAST(k % 25 AS STRING) || ',5' AS context
        FROM (SELECT o_orderkey AS k FROM {orders}) x""",
    "labels_txt": """
        SELECT CASE p_partkey % 10 WHEN 0 THEN 'Скорр. показатель EBITDA' WHEN 1 THEN 'Рентабельность по скорректированной EBITDA' WHEN 2 THEN 'Чистая прибыль' WHEN 3 THEN 'Выручка (изменение г/г)' WHEN 4 THEN 'Доля в выручке'
            WHEN 5 THEN '«Подписчики», млн' WHEN 6 THEN 'Операционные расходы' WHEN 7 THEN 'Валовый оборот' WHEN 8 THEN 'Всё прочее — Ёлка' ELSE 'CAPEX, % от выручки' END
            || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' — ' || p_type END AS m,
          CASE p_size % 6 WHEN 0 THEN CAST(2000 + p_size AS STRING) WHEN 1 THEN CAST(1 + p_size % 4 AS STRING) || ' кв ' || CAST(2000 + p_size AS STRING) WHEN 2 THEN lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') || '.05.20' || lpad(CAST(p_size AS STRING), 2, '0')
            WHEN 3 THEN '2025-05-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') WHEN 4 THEN '1п2024' ELSE '2024_итоговый' END AS p,
          CASE p_partkey % 7 WHEN 0 THEN 'млрд рублей' WHEN 1 THEN 'МЛН РУБ' WHEN 2 THEN '%' WHEN 3 THEN 'п.п.' WHEN 4 THEN 'штук' WHEN 5 THEN 'чел.' ELSE p_brand END AS u
        FROM {part}""",
    "questions": """
        SELECT CAST(c.conv_id * 100 + c.turn AS BIGINT) AS question_id, c.text AS question, s.doc, CASE WHEN c.conv_id % 60 = 7 AND c.turn < 2 THEN 'full' ELSE 'router' END AS mode
        FROM {conversations} c JOIN (SELECT source AS doc, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM {documents}) x) s ON c.conv_id % s.n = s.k
        WHERE c.role = 'user'""",
    "replies": """
        SELECT question_id, doc, CASE len % 8 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Ответ: ' || body || ' вот' WHEN 2 THEN 'не знаю' WHEN 3 THEN '[' || CAST(len AS STRING) || ', 2, 3]' WHEN 4 THEN chr(123) || '"confidence": 1, "sections": []' || chr(125)
            WHEN 5 THEN 'ряд [4, ' || CAST(len AS STRING) || '] и всё' WHEN 6 THEN '```' || chr(10) || body || chr(10) || '``` и (ещё)' ELSE body END AS reply
        FROM (SELECT question_id, doc, len, chr(123) || '"confidence": 0.' || CAST(1 + len % 9 AS STRING) || ', "need_full": ' || CASE WHEN len % 5 = 0 THEN 'true' ELSE 'false' END || ', "sections": ["' || one || '", "нет такого", "' || two || '"]' || chr(125) AS body
          FROM (SELECT q.question_id, q.doc, CAST(length(q.question) AS INT) AS len, a.id AS one, b.id AS two FROM {questions} q JOIN {listed} a ON a.doc = q.doc AND a.k = length(q.question) % a.n JOIN {listed} b ON b.doc = q.doc AND b.k = 7 * length(q.question) % b.n) x) y""",
    "listed": """
        SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY doc) AS n FROM {sections} WHERE level <= 4""",
    "doc_aggregates": """
        SELECT 'src0' AS doc, p, v FROM {facts_a} WHERE m = 'Общая выручка'""",
    "words": """
        SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS word, l_linenumber * 5.0 + (l_quantity % 4) AS x0, l_linenumber * 5.0 + (l_quantity % 4) + 3.0 AS x1,
          floor(l_quantity / 20) * 10.0 + (l_quantity % 2) * 0.5 AS y0, floor(l_quantity / 20) * 10.0 + 9.0 AS y1, CAST(CAST(l_quantity AS INT) AS STRING) AS text
        FROM {lineitem}""",
    "boxes": """
        SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS box, l_linenumber % 2 = 1 AS is_text, CAST(l_quantity AS DOUBLE) AS x0, l_quantity + 10.0 AS x1, l_linenumber * 2.0 AS y0,
          l_linenumber * 2.0 + 12.0 AS y1, CAST((l_linenumber * 7) % 5 AS INT) AS paint, 'w' || CAST(l_linenumber AS STRING) AS text, CAST(l_linenumber % 4 AS INT) AS render_mode,
          CAST(l_quantity / 5.0 AS DOUBLE) AS size, CAST(65793 * (l_linenumber * 30) AS INT) AS colour, CAST(65793 * (CAST(l_quantity AS INT) * 4) AS INT) AS background
        FROM {lineitem}""",
    "objects": """
        SELECT CAST(l_orderkey % 200 + 1 AS INT) AS pg, CASE l_linenumber % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' WHEN 2 THEN 'photo' ELSE 'text_only' END AS kind,
          l_linenumber % 2 = 0 AS has_numbers, CAST(l_quantity AS INT) % 5 AS rows, 1 AS cols
        FROM {lineitem} WHERE l_orderkey % 200 < 150""",
    "eval_rows": """
        SELECT event_id AS id, event_type AS mode, CAST(floor(coalesce(value, 0) * 100) AS BIGINT) AS tokens, round(coalesce(value, 0) / 10, 3) AS latency, event_id % 3 <> 0 AS passed,
          CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS BOOLEAN) ELSE event_id % 2 = 0 END AS values_ok, CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS BOOLEAN) ELSE event_id % 4 <> 0 END AS pages_ok,
          CASE event_id % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'small' ELSE 'other' END AS model, CAST(event_id % 1000 AS BIGINT) AS prompt_tokens, CAST(event_id % 77 AS BIGINT) AS completion_tokens
        FROM {events}""",
}


PAGE_CHARS = 1800


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text): the bookmarked documents cut into pages, and web pages as documents of their own without bookmarks."""
    own = frame(spark, sf_dir, "bookmarks").select("doc", "page_from", F.coalesce("text", F.lit("")).alias("text"))
    web = frame(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc"), F.lit(1).cast("long").alias("page_from"), F.coalesce("html", F.lit("")).alias("text"))
    last = F.greatest(F.ceil(F.length("text") / PAGE_CHARS).cast("int") - 1, F.lit(0))
    rows = own.unionByName(web).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("doc", (F.col("page_from") + F.col("k")).alias("page"), F.substring("text", F.col("k") * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"))


DUCK_PAGE_TEXTS = f"""
    SELECT doc, page_from + k AS page, substr(text, {PAGE_CHARS} * k + 1, {PAGE_CHARS}) AS text FROM (
      SELECT doc, page_from, text, unnest(range(greatest(CAST(ceil(length(text) / {PAGE_CHARS}.0) AS BIGINT), 1))) AS k FROM (
        SELECT doc, page_from, coalesce(text, '') AS text FROM bookmarks UNION ALL SELECT 'p' || page_id, 1, coalesce(html, '') FROM pages))"""


LISTED_BOTH = "JOIN {listed} a ON a.doc = q.doc AND a.k = length(q.question) % a.n JOIN {listed} b ON b.doc = q.doc AND b.k = 7 * length(q.question) % b.n"
#: The same rows for Spark: a document's first listed section tells how many there are, so that the places are keys and no question meets all sections of its document.
KEYED_BOTH = "JOIN {listed} z ON z.doc = q.doc AND z.k = 0 JOIN {listed} a ON a.doc = q.doc AND a.k = length(q.question) % z.n JOIN {listed} b ON b.doc = q.doc AND b.k = 7 * length(q.question) % z.n"
SPARK_VIEWS = VIEWS | {"replies": VIEWS["replies"].replace(LISTED_BOTH, KEYED_BOTH)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name == "page_texts":
        return page_texts(spark, sf_dir)
    if name == "sections":
        return with_ids(section_ends(frame(spark, sf_dir, "bookmarks")))
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = sorted(set(re.findall(r"\{(\w+)\}", SPARK_VIEWS[name])))
    return spark.sql(SPARK_VIEWS[name], **{u: frame(spark, sf_dir, u) for u in used})


#: Sections for DuckDB, by a self-join where the engine uses windows.
DUCK_SECTIONS = """
    SELECT b.doc, b.seq, any_value(b.title) AS title, any_value(b.level) AS level, any_value(b.text) AS text, any_value(b.page_from) AS page_from,
      CAST(CASE WHEN min(n.page_from) IS NULL THEN any_value(b.last_page) ELSE greatest(any_value(b.page_from), min(n.page_from) - 1) END AS BIGINT) AS page_to,
      's' || lpad(CAST(b.seq AS VARCHAR), 3, '0') || '-' || substr(trim(regexp_replace(lower(any_value(b.title)), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-'), 1, 40) AS id
    FROM bookmarks b LEFT JOIN bookmarks n ON b.doc = n.doc AND n.seq > b.seq AND n.level <= b.level GROUP BY b.doc, b.seq"""


def duck(names: list[str], body: str, recursive: bool = False) -> str:
    """body for DuckDB, after WITH clauses for the views it uses."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in TABLES or name in done:
            return
        text = {"sections": DUCK_SECTIONS, "page_texts": DUCK_PAGE_TEXTS}.get(name) or VIEWS[name]
        for u in ["bookmarks"] if name in ("sections", "page_texts") else re.findall(r"\{(\w+)\}", text):
            need(u)
        done[name] = text if name in ("sections", "page_texts") else re.sub(r"\{(\w+)\}", r"\1", text)

    for n in names:
        need(n)
    parts = [f"{k} AS ({v})" for k, v in done.items()]
    head, sep, rest = body.strip().partition("WITH ")
    if not head and sep:
        return "WITH " + ",\n".join([*parts, rest])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
