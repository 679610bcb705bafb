"""Every query of the engine over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import numbers as N
from pagetrail.functions import patterns as P
from pagetrail.functions import text as X
from pagetrail.operators import context, evaluate, facts, layout, linkage, quality, retrieval, sections
from pagetrail.shared import shared_dir, written

from .views import duck, frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = duck(list(uses), oracle)
        return f

    return add


# ---------------------------------------------------------------- SQL fragments for DuckDB

W = r"[\p{L}\p{N}_]"
NUMBER = r"-?[0-9]{1,3}(?:[ \x{a0}\x{202f}\x{2009}][0-9]{3})+(?:[.,][0-9]+)?|-?[0-9]+(?:[.,][0-9]+)?"
TOKENS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_-]+'), lambda x: lower(x))"


def d_norm_text(x: str) -> str:
    t = f"replace(regexp_replace(lower({x}), '[\\x{{a0}}\\x{{202f}}\\x{{2009}}\\x{{2007}}\\x{{2060}}]', ' ', 'g'), 'ё', 'е')"
    return f"coalesce(trim(regexp_replace(regexp_replace({t}, '[«»\"''`().,:;*\\x{{2013}}\\x{{2014}}-]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def d_values(x: str) -> str:
    clean = rf"regexp_replace(coalesce({x}, ''), '(?i)стр\.?\s*[0-9]{{1,3}}(?:\s*[\x{{2013}}\x{{2014}}-]\s*[0-9]{{1,3}})?', ' ', 'g')"
    raw = rf"list_transform(regexp_extract_all({clean}, '{NUMBER}'), lambda x: replace(regexp_replace(x, '[ \x{{a0}}\x{{202f}}\x{{2009}}]', '', 'g'), ',', '.'))"
    return f"list_transform(list_filter({raw}, lambda x: NOT regexp_matches(x, '^(19|20)[0-9]{{2}}$')), lambda x: CAST(x AS DOUBLE))"


def d_number_text(v: str) -> str:
    return rf"regexp_replace(regexp_replace(CAST(CAST(round({v}, 3) AS DECIMAL(30,3)) AS VARCHAR), '0+$', ''), '\.$', '')"


def d_tokset(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) > 2))"


def d_jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"


def d_case(text: str, pairs: list[tuple[str, str]], default: str) -> str:
    rows = " ".join(f"WHEN regexp_matches({text}, '{words(p)}') THEN '{n}'" for p, n in pairs)
    return f"(CASE {rows} ELSE {default} END)"



def words(pattern: str) -> str:
    """A pattern in DuckDB's dialect: Unicode word characters spelled out; negation before it is taken out of the text by the query."""
    return pattern.replace(r"\w", W).replace("(?<!не )", "")


D_CHANGE = words(P.CHANGE_WORDS).replace(r"рост\b", rf"рост(?:{W}{{0}})")

# ---------------------------------------------------------------- retrieval

ASKED = [(1, "the of tion"), (2, "la de ciónes"), (3, "Licensed under the MIT License"), (4, "nicht ver und und")]
ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") AS q(query_id, query)"
BM25_SQL = f"""
WITH d AS (SELECT doc_id, {TOKENS.format("text")} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM {ASKED_SQL}) GROUP BY ALL),
tf AS (SELECT doc_id, any_value(len(toks)) AS len, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM terms JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


@query(BM25_SQL + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 8")
def bm25_topk(spark, d):
    return retrieval.top_k(retrieval.bm25(frame(spark, d, "documents"), _asked(spark)), 8, 6)


@query(BM25_SQL + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 8")
def bm25_stored(spark, d):
    """The same search in the index that is kept for these texts, built when it is not there."""
    home = retrieval.open_index(frame(spark, d, "documents"), f"{shared_dir(spark)}/index-{zlib.crc32(d.encode())}")
    return retrieval.top_k_indexed(spark, home, _asked(spark), 8, 6)


@query(BM25_SQL + """, hits AS (SELECT query_id, source AS section_id, min(rank) AS best FROM ranked JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY ALL)
SELECT query_id, section_id, CAST(best AS INTEGER) AS best, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, section_id) AS INTEGER) AS place FROM hits""")  # fmt: skip
def section_ids_for(spark, d):
    hits = bm25_topk(spark, d).join(frame(spark, d, "documents").select("doc_id", F.col("source").alias("section_id")), "doc_id")
    return retrieval.section_ids(hits)


@query(f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({TOKENS.format('text')})) AS INTEGER) AS n_terms FROM documents")
def tokenize_terms(spark, d):
    t = X.tokens(F.col("text"))
    return frame(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


CHUNK_SQL = r"""
WITH s AS (SELECT doc, seq, trim(text) AS t FROM sections),
folded AS (SELECT doc, seq, t, list_reduce(list_prepend('', string_split(t, chr(10))), lambda acc, p:
    CASE WHEN length(list_last(string_split(acc, chr(1)))) + length(p) > 600 AND list_last(string_split(acc, chr(1))) <> ''
           THEN acc || chr(1) || right(list_last(string_split(acc, chr(1))), 40) || chr(10) || p
         WHEN list_last(string_split(acc, chr(1))) = '' THEN acc || p ELSE acc || chr(10) || p END) AS f FROM s),
pieces AS (SELECT doc, seq, CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 600 THEN [t] ELSE list_filter(string_split(f, chr(1)), lambda x: x <> '') END AS ps FROM folded)
SELECT doc, seq, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS chunk_ix, md5(unnest(ps)) AS chunk_md5 FROM pieces"""


@query(CHUNK_SQL, ("sections",))
def chunk_documents(spark, d):
    c = retrieval.chunks(frame(spark, d, "sections"), 600, 40, "\n")
    return c.select("doc", "seq", "chunk_ix", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


CHUNK_SEARCH_SQL = CHUNK_SQL[: CHUNK_SQL.index("\nSELECT doc, seq, CAST(generate")] + """,
cut AS (SELECT doc, seq, generate_subscripts(ps, 1) - 1 AS ix, unnest(ps) AS piece FROM pieces),
chunk_docs AS (SELECT doc || ':' || seq || ':' || ix AS doc_id, id AS section_id, title || chr(10) || 'стр. ' || page_from || '-' || page_to || chr(10) || piece AS text FROM cut JOIN sections USING (doc, seq)),
""" + BM25_SQL.replace("WITH d", "d", 1).replace("FROM documents)", "FROM chunk_docs)").lstrip() + """
SELECT query_id, doc_id, section_id, score, CAST(rank AS INTEGER) AS rank FROM ranked JOIN chunk_docs USING (doc_id) WHERE rank <= 8"""


@query(CHUNK_SEARCH_SQL, ("sections",))
def chunk_search(spark, d):
    return _chunk_hits(spark, d).select("query_id", "doc_id", "section_id", "score", "rank")


def _chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = retrieval.chunk_documents(retrieval.chunks(frame(spark, d, "sections"), 600, 40, "\n"))
    return retrieval.top_k(retrieval.bm25(docs, _asked(spark)), 8, 6).join(docs.select("doc_id", "doc", "section_id"), "doc_id")


@query("""
WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (
SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * c.embedding[i]))
  / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
QUALIFY rank <= 8""")
def dense_topk(spark, d):
    v = frame(spark, d, "embeddings")
    return retrieval.dense_top_k(v, v.filter("vec_id % 100 = 0"), 8, 6)


# ---------------------------------------------------------------- numbers, units, labels

D_FOOT = r"regexp_replace(trim(raw), '[*†‡¹²³\x{2070}-\x{209f}]+$', '')"
PARSE_SQL = rf"""
WITH a AS (SELECT l_orderkey, l_linenumber, head, raw, trim(replace({D_FOOT}, chr(160), ' ')) AS s FROM cells),
b AS (SELECT *, starts_with(s, '(') AND ends_with(s, ')') AS bracketed, regexp_replace(s, '^\(|\)$', '', 'g') AS t FROM a),
c AS (SELECT *, bracketed OR regexp_matches(t, '^[−–—-]') AS negative, replace(regexp_replace(regexp_replace(regexp_replace(t, '^[−–—-]', ''), '%', '', 'g'), ' ', '', 'g'), ',', '.') AS u FROM b),
e AS (SELECT *, string_split(u, '.') AS g FROM c),
f AS (SELECT *, CASE WHEN len(g) <= 2 THEN u WHEN length(g[-1]) = 3 THEN array_to_string(g, '') ELSE array_to_string(g[1:-2], '') || '.' || g[-1] END AS n FROM e),
h AS (SELECT *, CASE WHEN regexp_matches(n, '^[0-9]+(\.[0-9]+)?$') THEN CAST(n AS DOUBLE) * (CASE WHEN negative THEN -1 ELSE 1 END) END AS v FROM f)"""
UNIT = "(CASE WHEN {0} ILIKE '%млрд%' THEN 'млрд_руб' WHEN {0} ILIKE '%млн%' THEN 'млн_руб' WHEN {0} ILIKE '%тыс%' THEN 'тыс_руб' WHEN contains({0}, '%') OR {0} ILIKE '%проц%' THEN '%' END)"


@query(PARSE_SQL + " SELECT l_orderkey, l_linenumber, v FROM h", ("cells",))
def parse_number_cells(spark, d):
    return frame(spark, d, "cells").select("l_orderkey", "l_linenumber", N.parse_number(F.col("raw")).alias("v"))


@query(r"""
WITH a AS (SELECT l_orderkey, l_linenumber, regexp_replace(trim(raw), '\*+$', '') AS s FROM cells),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^\(|\)$', '', 'g'), '[ \x{a0}\x{202f}\x{2009}\x{2007}\x{2060}]', '', 'g'), '[−–—‒]', '-', 'g'), '%+$', '') AS t FROM a),
c AS (SELECT *, replace(regexp_replace(t, '^-', ''), ',', '.') AS u FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(u, '^[0-9]+(\.[0-9]+)?$') THEN CAST(u AS DOUBLE) * (CASE WHEN starts_with(s, '(') OR starts_with(t, '-') THEN -1 ELSE 1 END) END AS v FROM c""", ("cells",))  # fmt: skip
def norm_num_cells(spark, d):
    return frame(spark, d, "cells").select("l_orderkey", "l_linenumber", N.norm_num(F.col("raw")).alias("v"))


@query(PARSE_SQL + f" SELECT l_orderkey, l_linenumber, v, CASE WHEN v IS NOT NULL THEN coalesce({UNIT.format('raw')}, {UNIT.format('head')}) END AS u FROM h", ("cells",))
def parse_cell_units(spark, d):
    return frame(spark, d, "cells").withColumn("x", N.parse_cell(F.col("raw"), F.col("head"))).select("l_orderkey", "l_linenumber", "x.v", "x.u")


@query(r"SELECT l_orderkey, l_linenumber, regexp_matches(raw, '^[−–(-]?[0-9][0-9 \x{a0}]*(?:[,.][0-9]+)?\)?$') AS is_value FROM cells", ("cells",))
def value_labels(spark, d):
    return frame(spark, d, "cells").select("l_orderkey", "l_linenumber", N.is_value(F.col("raw")).alias("is_value"))


@query(f"WITH v AS (SELECT doc_id, {d_values('text')} AS vs FROM documents) SELECT doc_id, CAST(len(vs) AS INTEGER) AS n, list_max(vs) AS largest, CAST(len(list_distinct(list_transform(vs, lambda x: {d_number_text('x')}))) AS INTEGER) AS n_distinct FROM v")
def numbers_in_text(spark, d):
    v = X.values_in(F.col("text"))
    return frame(spark, d, "documents").select("doc_id", F.size(v).alias("n"), F.array_max(v).alias("largest"), F.size(X.numbers_in(F.col("text"))).alias("n_distinct"))


@query(f"SELECT DISTINCT m, {d_norm_text('m')} AS norm, {d_case('rest', P.CANONICAL_METRICS, 'rest')} AS canon, is_change, array_to_string(list_sort({d_tokset('norm')}), ' ') AS tokens FROM (SELECT m, t AS norm, regexp_matches(t, '{D_CHANGE}') AS is_change, trim(regexp_replace(regexp_replace(t, '{D_CHANGE}', ' ', 'g'), '\\s+', ' ', 'g')) AS rest FROM (SELECT m, {d_norm_text('m')} AS t FROM labels_txt))", ("labels_txt",))
def canon_metric(spark, d):
    c = X.canon_metric(F.col("m"))
    tokens = F.array_join(F.array_sort(X.token_set(F.col("m"))), " ")
    return frame(spark, d, "labels_txt").select("m", X.norm_text(F.col("m")).alias("norm"), c["name"].alias("canon"), c["is_change"].alias("is_change"), tokens.alias("tokens")).distinct()


@query("""
SELECT DISTINCT p, CASE WHEN regexp_matches(p, '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$') THEN p[7:10] || '-' || p[4:5] || '-' || p[1:2] WHEN p = '2024_итоговый' THEN '2024fin' WHEN p = '1п2024' THEN '1h2024'
  ELSE replace(p, ' кв ', 'кв') END AS period FROM labels_txt""", ("labels_txt",))
def norm_period(spark, d):
    return frame(spark, d, "labels_txt").select("p", N.norm_period(F.col("p")).alias("period")).distinct()


@query("""
SELECT DISTINCT u, CASE lower(u) WHEN 'млрд рублей' THEN 'млрд_руб' WHEN 'млн руб' THEN 'млн_руб' WHEN '%' THEN '%' WHEN 'п.п.' THEN 'п.п.' WHEN 'штук' THEN 'шт' ELSE lower(u) END AS unit FROM labels_txt""", ("labels_txt",))
def norm_unit(spark, d):
    return frame(spark, d, "labels_txt").select("u", N.norm_unit(F.col("u")).alias("unit")).distinct()


# ---------------------------------------------------------------- sections


@query("SELECT doc, seq, id, level, page_from, page_to FROM sections", ("sections",))
def sections_tree(spark, d):
    return frame(spark, d, "sections").select("doc", "seq", "id", "level", "page_from", "page_to")


@query("SELECT doc, id FROM sections s WHERE NOT EXISTS (SELECT 1 FROM sections x WHERE x.doc = s.doc AND x.level > s.level AND x.seq <> s.seq AND x.page_from BETWEEN s.page_from AND s.page_to)", ("sections",))
def leaf_sections(spark, d):
    return sections.leaf_sections(frame(spark, d, "sections")).select("doc", "id")


@query("""SELECT doc, id FROM sections s WHERE NOT EXISTS (SELECT 1 FROM sections x WHERE x.doc = s.doc AND x.seq <> s.seq AND x.page_from <= s.page_from AND x.page_to >= s.page_to
  AND (x.page_from < s.page_from OR x.page_to > s.page_to OR x.seq < s.seq))""", ("sections",))
def drop_nested(spark, d):
    return sections.drop_nested(frame(spark, d, "sections")).select("doc", "id")


@query("SELECT doc, md5(string_agg(repeat('  ', level - 1) || id || ' | ' || title || ' | стр. ' || page_from || '-' || page_to, chr(10) ORDER BY seq)) AS outline_md5 FROM sections WHERE level <= 3 GROUP BY doc", ("sections",))
def outline(spark, d):
    return sections.outline(frame(spark, d, "sections"), 3).select("doc", F.md5(F.col("outline").cast("binary")).alias("outline_md5"))


@query("""
WITH cut AS (SELECT doc, seq, id, level, page_from, page_to FROM sections UNION ALL SELECT doc, 1, 's001-документ', 1, 1, max(page) FROM page_texts WHERE doc NOT IN (SELECT doc FROM bookmarks) GROUP BY doc)
SELECT s.doc, s.seq, any_value(s.id) AS id, any_value(s.level) AS level, any_value(s.page_from) AS page_from, any_value(s.page_to) AS page_to, CAST(0 AS INTEGER) AS part, CAST(count(*) AS BIGINT) AS n_pages, md5(string_agg(p.text, chr(10) ORDER BY p.page, p.text)) AS text_md5
FROM cut s JOIN page_texts p ON p.doc = s.doc AND p.page BETWEEN s.page_from AND s.page_to GROUP BY s.doc, s.seq""", ("sections", "page_texts"))
def section_texts(spark, d):
    """Sections with the texts of their pages; documents without bookmarks as a whole."""
    pages = frame(spark, d, "page_texts")
    out = sections.build_sections(frame(spark, d, "bookmarks").select("doc", "seq", "title", "level", "page_from"), pages)
    return out.select("doc", "seq", "id", "level", "page_from", "page_to", "part", (F.col("page_to") - F.col("page_from") + 1).alias("n_pages"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


WIDEN_SQL = CHUNK_SEARCH_SQL[: CHUNK_SEARCH_SQL.rindex("SELECT query_id, doc_id, section_id")] + """,
own AS (SELECT query_id, doc, id, min(rank) AS rank FROM ranked JOIN chunk_docs USING (doc_id) JOIN (SELECT doc, seq, id FROM sections) s ON doc_id LIKE s.doc || ':' || s.seq || ':%' WHERE ranked.rank <= 8 GROUP BY ALL),
tops AS (SELECT DISTINCT o.query_id, t.doc, t.id, t.seq FROM own o JOIN sections c USING (doc, id) JOIN sections t ON t.doc = c.doc AND t.level = 1 AND t.page_from <= c.page_from AND c.page_to <= t.page_to),
placed AS (SELECT query_id, doc, id, min({'part': part, 'place': place}) AS place FROM (SELECT query_id, doc, id, 0 AS part, rank AS place FROM own UNION ALL SELECT query_id, doc, id, 1, seq FROM tops) GROUP BY ALL)
SELECT query_id, doc, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, doc) AS INTEGER) AS rank FROM placed"""


@query(WIDEN_SQL, ("sections",))
def router_widen(spark, d):
    """The sections that hold the best chunks of each query, and the top sections around them."""
    own = _chunk_hits(spark, d).groupBy("query_id", "doc", F.col("section_id").alias("id")).agg(F.min("rank").alias("rank"))
    return sections.widened(own, frame(spark, d, "sections"), ["query_id"])


@query("""
WITH chosen AS (SELECT doc, page_from, page_to FROM sections s WHERE NOT EXISTS (SELECT 1 FROM sections x WHERE x.doc = s.doc AND x.level > s.level AND x.seq <> s.seq AND x.page_from BETWEEN s.page_from AND s.page_to)),
hit AS (SELECT * FROM facts_a f WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.doc = f.doc AND f.pg BETWEEN c.page_from AND c.page_to))
SELECT seq, m, s, p, v, u, pg, 0 AS part FROM hit UNION ALL SELECT seq, m, s, p, v, u, pg, 1 AS part FROM facts_a WHERE pg IN (12, 21) AND seq NOT IN (SELECT seq FROM hit)""", ("sections", "facts_a"))
def facts_for_context(spark, d):
    """Facts on the pages of leaf sections, then those of the anchor pages."""
    leaves = sections.leaf_sections(frame(spark, d, "sections"))
    return sections.facts_with_anchors(frame(spark, d, "facts_a"), leaves, [12, 21]).select("seq", "m", "s", "p", "v", "u", "pg", "part")


# ---------------------------------------------------------------- facts

YEARS = "(VALUES ('1996', '1995'), ('1997', '1996'), ('1998', '1997'), ('1999', '1998'), ('2000', '1999'), ('2001', '2000')) AS y(cur, prev)"


@query("""SELECT p, v, pg, src, seq FROM facts_merged WHERE lower(trim(m)) IN ('общая выручка', 'выручка', 'консолидированная выручка') AND s IS NULL AND v IS NOT NULL AND u = 'млн_руб'
QUALIFY row_number() OVER (PARTITION BY p ORDER BY (confirmed OR src = 'both') DESC, (v <> floor(v)) DESC, CASE WHEN coalesce(pg, 0) = 0 THEN 999 ELSE pg END, seq) = 1""", ("facts_merged",))
def total_by_trust(spark, d):
    return facts.total_by_trust(frame(spark, d, "facts_merged"), "млн_руб")


YOY_SQL = f"""
SELECT n.s AS segment, cur AS period, n.v AS value, n.u AS unit, n.pg AS page, o.v AS prev,
  CASE WHEN o.v <> 0 THEN round(n.v - o.v, 3) END AS yoy_abs, CASE WHEN o.v <> 0 THEN round((n.v - o.v) / abs(o.v) * 100, 2) END AS yoy_pct,
  CASE WHEN o.v <> 0 AND tc.v - tp.v <> 0 THEN round((n.v - o.v) / (tc.v - tp.v) * 100, 2) END AS contrib_growth_pct, CASE WHEN tc.v <> 0 THEN round(n.v / tc.v * 100, 2) END AS share_pct
FROM {YEARS} JOIN facts_a n ON n.p = cur AND n.s IS NOT NULL LEFT JOIN facts_a o ON o.p = prev AND o.s = n.s
LEFT JOIN facts_a tc ON tc.p = cur AND tc.m = 'Общая выручка' LEFT JOIN facts_a tp ON tp.p = prev AND tp.m = 'Общая выручка'"""


@query(YOY_SQL, ("facts_a",))
def yoy_contribution(spark, d):
    f = frame(spark, d, "facts_a")
    return facts.growth(f.filter("s IS NOT NULL"), f.filter("m = 'Общая выручка'").select("p", "v"), _years(spark))


def _years(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(str(y), str(y - 1)) for y in range(1996, 2002)], "cur string, prev string")


@query(f"SELECT segment, period, yoy_pct, CAST(row_number() OVER (PARTITION BY period ORDER BY yoy_pct DESC NULLS LAST, segment) AS INTEGER) AS place FROM ({YOY_SQL})", ("facts_a",))
def segment_ranking(spark, d):
    return facts.rank_segments(yoy_contribution(spark, d)).select("segment", "period", "yoy_pct", "place")


@query(f"""
SELECT cur AS period, prev AS prev_period, a.v AS total_revenue, a.pg AS total_revenue_page, b.v AS total_revenue_prev, CASE WHEN a.v <> b.v THEN round(a.v - b.v, 3) END AS total_growth_abs
FROM {YEARS} LEFT JOIN (SELECT * FROM facts_a WHERE m = 'Общая выручка') a ON a.p = cur LEFT JOIN (SELECT * FROM facts_a WHERE m = 'Общая выручка') b ON b.p = prev""", ("facts_a",))
def growth_header(spark, d):
    return facts.growth_header(frame(spark, d, "facts_a").filter("m = 'Общая выручка'"), _years(spark))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SEG_SQL = "('" + "', '".join(SEGMENTS) + "')"


@query(f"""
WITH raw AS (SELECT p, sum(v) AS raw, count(*) AS n_parts FROM facts_a WHERE s IN {SEG_SQL} GROUP BY p), fix AS (SELECT p, -max(abs(v)) AS fix FROM facts_a WHERE lower(concat_ws(' ', m, s)) LIKE '%межсегмент%' GROUP BY p),
t AS (SELECT p, v AS total FROM facts_a WHERE m = 'Общая выручка')
SELECT p AS period, n_parts, round(raw, 3) AS sum_raw, round(coalesce(fix, 0), 3) AS intersegment, round(raw + coalesce(fix, 0), 3) AS sum_adjusted, total, round((raw - total) / total * 100, 3) AS delta_raw_pct,
  round(abs(raw + coalesce(fix, 0) - total) / abs(total) * 100, 3) AS delta_pct, abs(raw + coalesce(fix, 0) - total) / abs(total) * 100 <= 0.5 AS ok, n_parts = {len(SEGMENTS)} AS complete
FROM raw LEFT JOIN fix USING (p) LEFT JOIN t USING (p)""", ("facts_a",))
def checksum(spark, d):
    f = frame(spark, d, "facts_a")
    return facts.checksum(f, f.filter("m = 'Общая выручка'").select("p", "v"), SEGMENTS, "выручка", "межсегмент")


@query("""
WITH asks(ask, metric, segment, period) AS (VALUES (1, 'выручка', 'BUILDING', '1996'), (2, 'ВЫРУЧКА', NULL, '1997'), (3, 'прибыль', NULL, '1996'), (4, 'межсегмент', NULL, '1998'))
SELECT ask, m, s, p, v, u, pg, seq FROM asks JOIN facts_merged f ON contains(lower(f.m), lower(metric)) AND f.s IS NOT DISTINCT FROM segment AND f.p = period AND v IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY ask ORDER BY seq) = 1""", ("facts_merged",))
def first_pick(spark, d):
    asks = [(1, "выручка", "BUILDING", "1996"), (2, "ВЫРУЧКА", None, "1997"), (3, "прибыль", None, "1996"), (4, "межсегмент", None, "1998")]
    return facts.first_pick(frame(spark, d, "facts_merged"), spark.createDataFrame(asks, "ask int, metric string, segment string, period string"))


@query("SELECT seq, t, m, s, p, v, u, pg FROM facts_merged WHERE s IS NULL AND m = 'Выручка' OR s IS NULL AND m = 'Общая выручка'", ("facts_merged",))
def fact_lookup(spark, d):
    f = frame(spark, d, "facts_merged")
    both = facts.lookup(f, m="Выручка", s=None).unionByName(facts.lookup(f, m="Общая выручка", s=None))
    return both.select("seq", *facts.project(f).columns)


# ---------------------------------------------------------------- linkage


def _d_keyed(table: str) -> str:
    split = r"(s IS NULL OR s = '') AND len(regexp_split_to_array(m, '\s+[—–-]\s+')) = 2"
    part = r"trim(regexp_split_to_array(m, '\s+[—–-]\s+')[{0}])"
    x = f"SELECT seq, pg, p, u, v, CASE WHEN {split} THEN {part.format(1)} ELSE m END AS m, CASE WHEN {split} THEN {part.format(2)} ELSE s END AS s FROM {table}"
    y = f"SELECT *, {d_norm_text('m')} AS t, {d_norm_text('s')} AS seg FROM ({x})"
    z = f"SELECT *, regexp_matches(t, '{D_CHANGE}') AS chg, trim(regexp_replace(regexp_replace(t, '{D_CHANGE}', ' ', 'g'), '\\s+', ' ', 'g')) AS rest FROM ({y})"
    return f"SELECT seq AS id, pg, p AS per, seg, {d_case('rest', P.CANONICAL_METRICS, 'rest')} AS cm, chg, {d_tokset('t')} AS mt, {d_tokset('seg')} AS st, v FROM ({z})"


CANDIDATES_SQL = f"""
WITH ka AS ({_d_keyed("facts_a")}), kb AS ({_d_keyed("facts_b")}),
pairs AS (SELECT a.pg, a.id AS pi, b.id AS vi, a.v AS av, b.v AS bv, CASE WHEN a.cm = b.cm THEN 1.0 ELSE greatest({d_jaccard("a.mt", "b.mt")}, {d_jaccard("list_concat(a.mt, a.st)", "list_concat(b.mt, b.st)")}) END AS ms,
    CASE WHEN a.seg <> '' AND b.seg <> '' THEN CASE WHEN a.seg = b.seg THEN 1.0 WHEN {d_jaccard("a.st", "b.st")} < 0.5 THEN NULL ELSE {d_jaccard("a.st", "b.st")} END
      WHEN a.seg <> '' OR b.seg <> '' THEN CASE WHEN {d_jaccard("(CASE WHEN len(a.st) > 0 THEN a.st ELSE b.st END)", "(CASE WHEN len(a.st) > 0 THEN b.mt ELSE a.mt END)")} >= 0.5 THEN 0.95 ELSE 0.45 END ELSE 1.0 END AS ss
  FROM ka a JOIN kb b ON a.pg = b.pg AND a.per = b.per AND a.chg = b.chg),
cand AS (SELECT pg, pi, vi, round(ms * 0.7 + ss * 0.3, 6) AS score, abs(av - bv) <= 0.051 OR abs(av - bv) / greatest(abs(av), abs(bv)) <= 0.005 AS same FROM pairs WHERE ms >= 0.34 AND ss IS NOT NULL)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return linkage.candidates(linkage.keyed(frame(spark, d, "facts_a")), linkage.keyed(frame(spark, d, "facts_b")))


@query(CANDIDATES_SQL + " SELECT pg, pi, vi, score, same FROM cand", ("facts_a", "facts_b"))
def match_candidates(spark, d):
    return _candidates(spark, d)


ASSIGN_SQL = CANDIDATES_SQL + """,
best AS (SELECT pg, list_reduce(list_prepend([]::STRUCT(pi BIGINT, vi BIGINT, score DOUBLE, same BOOLEAN)[], list(
    [{'pi': pi, 'vi': vi, 'score': CAST(score AS DOUBLE), 'same': same}] ORDER BY score DESC, same DESC, pi, vi)), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda k: k.pi = x[1].pi OR k.vi = x[1].vi)) > 0 THEN acc ELSE list_concat(acc, x) END) AS got FROM cand GROUP BY pg),
assigned AS (SELECT pg, unnest(got, recursive := true) FROM best)"""


@query(ASSIGN_SQL + " SELECT pg, pi, vi, score, same FROM assigned", ("facts_a", "facts_b"))
def match_assign(spark, d):
    return linkage.assign(_candidates(spark, d))


@query(ASSIGN_SQL + """
SELECT a.seq AS pi, b.seq AS vi, coalesce(a.m, b.m) AS m, CASE WHEN a.seq IS NULL THEN b.s ELSE a.s END AS s, coalesce(a.p, b.p) AS p, coalesce(a.v, b.v) AS v, coalesce(a.pg, b.pg) AS pg,
  CASE WHEN a.seq IS NULL THEN 'only_right' WHEN b.seq IS NULL THEN 'only_left' WHEN x.same THEN 'confirmed' ELSE 'mismatch' END AS kind, CASE WHEN NOT x.same THEN a.v END AS v_left, CASE WHEN NOT x.same THEN b.v END AS v_right
FROM facts_a a LEFT JOIN assigned x ON x.pi = a.seq FULL JOIN facts_b b ON b.seq = x.vi""", ("facts_a", "facts_b"))
def merge_sources(spark, d):
    out = linkage.reconcile(frame(spark, d, "facts_a"), frame(spark, d, "facts_b"), linkage.assign(_candidates(spark, d)))
    return out.orderBy(*linkage.merged_order()).select("pi", "vi", "m", "s", "p", "v", "pg", "kind", "v_left", "v_right")


# ---------------------------------------------------------------- quality


@query("SELECT seq, v, 'млн_руб [-100; 100]' AS rule FROM facts_a WHERE u = 'млн_руб' AND NOT (v BETWEEN -100 AND 100)", ("facts_a",))
def range_rules(spark, d):
    return quality.range_rules(frame(spark, d, "facts_a"), [("млрд_руб", -2000.0, 2000.0), ("млн_руб", -100.0, 100.0), ("%", -100.0, 1000.0)]).select("seq", "v", "rule")


@query("SELECT m, s, p, u, count(*) AS n, count(DISTINCT v) AS n_values, count(DISTINCT v) > 1 AS mismatch FROM facts_merged GROUP BY m, s, p, u HAVING count(*) > 1", ("facts_merged",))
def cross_source(spark, d):
    return quality.cross_source(frame(spark, d, "facts_merged"))


@query("SELECT pg, CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT pg, m, s, p, v, u, count(*) AS n FROM facts_merged GROUP BY ALL HAVING count(*) > 1) GROUP BY pg", ("facts_merged",))
def duplicates(spark, d):
    return quality.duplicates(frame(spark, d, "facts_merged"))


COVER_SQL = """
WITH o AS (SELECT pg, count(*) AS objects, count(*) FILTER (has_numbers) AS numeric, count(DISTINCT kind) AS kinds, CAST(sum(CASE WHEN has_numbers THEN rows * cols ELSE 0 END) AS BIGINT) AS declared FROM objects GROUP BY pg),
a AS (SELECT pg, count(*) AS n FROM facts_a GROUP BY pg), b AS (SELECT pg, count(*) AS n FROM facts_b GROUP BY pg),
cover AS (SELECT CAST(r.pg AS INTEGER) AS pg, coalesce(objects, 0) AS objects, coalesce(numeric, 0) AS numeric, coalesce(kinds, 0) AS kinds, coalesce(declared, 0) AS declared, coalesce(a.n, 0) AS n_parser, coalesce(b.n, 0) AS n_vision
  FROM range(1, 202) AS r(pg) LEFT JOIN o USING (pg) LEFT JOIN a USING (pg) LEFT JOIN b USING (pg)),
full_cover AS (SELECT *, n_vision - n_parser AS delta, CASE WHEN declared = 0 THEN 'none' WHEN greatest(n_parser, n_vision) >= 0.8 * declared THEN 'full' WHEN greatest(n_parser, n_vision) >= 0.5 * declared THEN 'partial' ELSE 'low' END AS verdict FROM cover)"""


@query(COVER_SQL + " SELECT * FROM full_cover", ("objects", "facts_a", "facts_b"))
def coverage(spark, d):
    pages = spark.range(1, 202).select(F.col("id").cast("int").alias("pg"))
    return quality.coverage(pages, frame(spark, d, "objects"), frame(spark, d, "facts_a"), frame(spark, d, "facts_b"))


@query(COVER_SQL + " SELECT verdict, count(*) AS pages, count(*) FILTER (numeric > 0 AND n_parser + n_vision = 0) AS gaps FROM full_cover GROUP BY verdict", ("objects", "facts_a", "facts_b"))
def coverage_counts(spark, d):
    return quality.coverage_counts(coverage(spark, d))


@query(COVER_SQL + " SELECT pg, objects, numeric, verdict FROM full_cover ORDER BY numeric DESC, pg LIMIT 15", ("objects", "facts_a", "facts_b"))
def busiest_pages(spark, d):
    return quality.busiest_pages(coverage(spark, d)).select("pg", "objects", "numeric", "verdict")


@query("SELECT kind, count(*) AS n, count(DISTINCT pg) AS pages FROM objects GROUP BY kind", ("objects",))
def objects_by_kind(spark, d):
    return quality.by_kind(frame(spark, d, "objects"))


@query("SELECT t, count(*) AS n, array_to_string(list_sort(list(DISTINCT pg)), ' ') AS pages FROM facts_a GROUP BY t", ("facts_a",))
def table_sources(spark, d):
    return quality.table_sources(frame(spark, d, "facts_a")).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), " "))


@query("""
SELECT e.m, e.s, e.p, want, count(f.v) AS n, coalesce(bool_and(abs(f.v - want) <= 1e-9), false) AS ok
FROM (SELECT m, s, p, CASE WHEN pg % 4 = 0 THEN v + 1 ELSE v END AS want FROM facts_a UNION ALL SELECT 'Выручка', 'NO SUCH SEGMENT', '1996', 1.0) e
LEFT JOIN facts_a f ON e.m = f.m AND e.s IS NOT DISTINCT FROM f.s AND e.p = f.p GROUP BY ALL""", ("facts_a",))
def control_values(spark, d):
    """Controls of which every fourth page's is wrong and one has no fact."""
    f = frame(spark, d, "facts_a")
    want = f.select("m", "s", "p", F.when(F.col("pg") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("want"))
    return quality.controls(f, want.union(spark.createDataFrame([("Выручка", "NO SUCH SEGMENT", "1996", 1.0)], want.schema)))


@query(f"""
SELECT s, p, round(stated, 4) AS stated, round(part / whole * 100, 4) AS computed, abs(part / whole * 100 - stated) <= 0.35 AS ok FROM (
  SELECT f.s, f.p, f.v AS part, t.v AS whole, round(f.v / t.v * 100, 0) + CASE WHEN f.p = '1996' THEN 2 ELSE 0 END AS stated FROM facts_a f JOIN facts_a t ON t.p = f.p AND t.m = 'Общая выручка' WHERE f.s IN {SEG_SQL})""", ("facts_a",))
def ratio_check(spark, d):
    f = frame(spark, d, "facts_a")
    part, total = f.filter("s IS NOT NULL").select("s", "p", "v"), f.filter("m = 'Общая выручка'").select("p", F.col("v").alias("w"))
    whole = part.join(total, "p").select("s", "p", F.col("w").alias("v"))
    stated = part.join(total, "p").select("s", "p", (F.round(F.col("v") / F.col("w") * 100, 0) + F.when(F.col("p") == "1996", 2).otherwise(0)).alias("v"))
    return quality.ratio_check(part, whole, stated).select("s", "p", F.round("stated", 4).alias("stated"), F.round("computed", 4).alias("computed"), "ok")


@query("""
SELECT f.p, round(sum(f.v), 4) AS summed, count(*) AS n, any_value(t.v) AS total, abs(sum(f.v) - any_value(t.v)) <= 0.3 AS ok FROM facts_a f JOIN facts_a t ON t.p = f.p AND t.m = 'Общая выручка' WHERE f.s IS NOT NULL GROUP BY f.p""", ("facts_a",))
def rollup_check(spark, d):
    f = frame(spark, d, "facts_a")
    return quality.rollup_check(f.filter("s IS NOT NULL").select("p", "v"), f.filter("m = 'Общая выручка'").select("p", "v")).withColumn("summed", F.round("summed", 4))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9][0-9 ]*(?:[.,][0-9]+)?')) AS INTEGER) AS n FROM documents WHERE len(regexp_extract_all(text, '[0-9][0-9 ]*(?:[.,][0-9]+)?')) >= 4")
def number_density(spark, d):
    return frame(spark, d, "documents").select("doc_id", X.number_density(F.col("text")).alias("n")).filter("n >= 4")


# ---------------------------------------------------------------- layout


@query("""
SELECT t.page, t.word AS tick, min(abs(t.x0 - n.x0)) AS dx, CAST(arg_min(n.text, struct_pack(a := abs(t.x0 - n.x0), b := n.x0, c := CAST(n.text AS DOUBLE))) AS DOUBLE) AS value
FROM words t JOIN words n ON t.page = n.page AND abs(t.x0 - n.x0) <= 22 WHERE t.word % 2 = 1 AND n.word % 2 = 0 GROUP BY t.page, t.word""", ("words",))
def nearest_label(spark, d):
    w = frame(spark, d, "words")
    return layout.nearest(w.filter("word % 2 = 1").select("page", F.col("word").alias("tick"), F.col("x0").alias("x")), w.filter("word % 2 = 0").select("page", F.col("x0").alias("x"), F.col("text").cast("double").alias("value")))


TICKS_SQL = """
WITH n AS (SELECT page, list({'i': i, 'x': x, 'value': v}) AS free FROM (SELECT page, x0 AS x, CAST(text AS DOUBLE) AS v, row_number() OVER (PARTITION BY page ORDER BY x0, CAST(text AS DOUBLE)) AS i FROM words WHERE word % 2 = 0) GROUP BY page),
t AS (SELECT page, list({'free': CAST([] AS STRUCT(i BIGINT, x DOUBLE, "value" DOUBLE)[]), 'got': [{'tick': word, 'x': x0, 'value': CAST(NULL AS DOUBLE)}]} ORDER BY x0, word) AS ts FROM words WHERE word % 2 = 1 GROUP BY page),
r AS (SELECT page, list_reduce(list_prepend({'free': free, 'got': []}, ts), lambda acc, x: CASE
    WHEN len(acc.free) > 0 AND list_sort(list_transform(acc.free, lambda v: abs(v.x - x.got[1].x)))[1] <= 22
    THEN {'free': list_filter(acc.free, lambda v: v.i <> list_sort(list_transform(acc.free, lambda w: {'d': abs(w.x - x.got[1].x), 'i': w.i, 'value': w.value}))[1].i),
          'got': list_concat(acc.got, [{'tick': x.got[1].tick, 'x': x.got[1].x, 'value': list_sort(list_transform(acc.free, lambda w: {'d': abs(w.x - x.got[1].x), 'i': w.i, 'value': w.value}))[1].value}])}
    ELSE acc END) AS z FROM t JOIN n USING (page)),
got AS (SELECT page, g.tick AS tick, g.value AS value FROM (SELECT page, unnest(z.got) AS g FROM r))"""


@query(TICKS_SQL + " SELECT page, tick, value FROM got", ("words",))
def assign_ticks(spark, d):
    w = frame(spark, d, "words")
    return layout.assign_ticks(w.filter("word % 2 = 1").select("page", F.col("word").alias("tick"), F.col("x0").alias("x")), w.filter("word % 2 = 0").select("page", F.col("x0").alias("x"), F.col("text").cast("double").alias("value")))


FILLED = "{'tick': x.got[1].tick, 'x': x.got[1].x, 'value': list_sort(list_transform(acc.free, lambda w: {'d': abs(w.x - x.got[1].x), 'i': w.i, 'value': w.value}))[1].value"
UNFILLED = "{'free': acc.free, 'got': list_concat(acc.got, [{'tick': x.got[1].tick, 'x': x.got[1].x, 'value': CAST(NULL AS DOUBLE), 'status': CASE WHEN len(acc.free) = 0 THEN 'none_free' ELSE 'too_far' END}])}"
CHART_SQL = TICKS_SQL.replace(FILLED, FILLED + ", 'status': 'ok'").replace("'value': CAST(NULL AS DOUBLE)}]}", "'value': CAST(NULL AS DOUBLE), 'status': ''}]}").replace("ELSE acc END", f"ELSE {UNFILLED} END")
CHART_SQL = CHART_SQL.replace("list_prepend({'free': free,", """list_prepend({'free': coalesce(free, CAST([] AS STRUCT(i BIGINT, x DOUBLE, "value" DOUBLE)[])),""").replace("FROM t JOIN n USING (page)", "FROM t LEFT JOIN n USING (page)").replace("g.value AS value FROM", "g.value AS value, g.status AS status FROM")


@query(CHART_SQL + " SELECT page, tick, CASE WHEN n = 2 THEN value END AS value, CASE WHEN n <> 2 THEN 'tick_count' ELSE status END AS status, CAST(n AS INTEGER) AS n_ticks FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM got)", ("words",))
def tick_chart(spark, d):
    """Every tick with its number or the reason why it has none; pages whose ticks are not two have no values."""
    w = frame(spark, d, "words")
    out = layout.tick_chart(w.filter("word % 2 = 1").select("page", F.col("word").alias("tick"), F.col("x0").alias("x")), w.filter("word % 2 = 0").select("page", F.col("x0").alias("x"), F.col("text").cast("double").alias("value")), 2)
    return out.select("page", "tick", "value", "status", "n_ticks")


@query("""
SELECT a.page, a.word AS anchor, string_agg(w.text, ' ' ORDER BY round(w.y0, 1), w.x0, w.word, w.text) AS label FROM words a JOIN words w ON a.page = w.page AND abs(a.y0 - w.y0) < 8 GROUP BY a.page, a.word""", ("words",))
def row_label_band(spark, d):
    w = frame(spark, d, "words")
    return layout.row_labels(w.select("page", F.col("word").alias("anchor"), F.col("y0").alias("y")), w, 8.0)


@query("SELECT page, word, text FROM words WHERE y0 BETWEEN 5 AND 25 AND x0 BETWEEN 8 AND 20 AND text <> '17'", ("words",))
def band_values(spark, d):
    return layout.in_band(frame(spark, d, "words"), 5, 25, 8, 20, ["17"]).select("page", "word", "text")


@query("""
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY round(y0, 1), x0, word, text) AS INTEGER) AS place, text, CAST(text AS DOUBLE) AS value, count(*) OVER (PARTITION BY page) AS found, count(*) OVER (PARTITION BY page) = 3 AS ok
FROM words WHERE y0 BETWEEN 5 AND 25""", ("words",))
def ordered_values(spark, d):
    return layout.band_sequence(frame(spark, d, "words"), 5, 25, 3)


@query(r"""
WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
w AS (SELECT *, lag(t, 1) OVER x AS one, lag(t, 2) OVER x AS two FROM l WHERE t <> '' WINDOW x AS (PARTITION BY doc ORDER BY line)),
n AS (SELECT doc, line, regexp_extract(t, '^([A-Z][a-z]{5,}) ', 1) AS value, CASE WHEN one IS NULL OR contains(one, 'tion') THEN '' WHEN ends_with(one, ':') OR two IS NULL OR contains(two, 'tion') THEN one ELSE two || ' ' || one END AS label
  FROM w WHERE regexp_matches(t, '^([A-Z][a-z]{5,}) '))
SELECT doc, CAST(line AS INTEGER) AS line, value, trim(regexp_replace(trim(rtrim(label, ':')), '[0-9]+$', '')) AS label FROM n""")
def label_lines(spark, d):
    lines = frame(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return layout.label_lines(lines, "^([A-Z][a-z]{5,}) ", ["tion"])


@query("SELECT page, count(*) AS found, count(*) = 4 AS ok FROM words GROUP BY page", ("words",))
def count_assertions(spark, d):
    return layout.assert_count(frame(spark, d, "words"), ["page"], 4)


@query("""
SELECT page, text_box, image_box, round(share, 6) AS share, on_top FROM (
  SELECT t.page, t.box AS text_box, i.box AS image_box, greatest(0, least(t.x1, i.x1) - greatest(t.x0, i.x0)) * greatest(0, least(t.y1, i.y1) - greatest(t.y0, i.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) AS share, i.paint > t.paint AS on_top
  FROM boxes t JOIN boxes i ON t.page = i.page AND t.is_text AND NOT i.is_text) WHERE share >= 0.3""", ("boxes",))
def rect_overlap(spark, d):
    b = frame(spark, d, "boxes")
    return layout.overlaps(b.filter("is_text"), b.filter("NOT is_text")).withColumn("share", F.round("share", 6))


HIDDEN_SQL = """
WITH h AS (SELECT page, box, CASE WHEN render_mode = 3 THEN 'invisible' WHEN size < 3 THEN 'tiny' WHEN abs((colour & 255) - (background & 255)) <= 12 AND abs(((colour >> 8) & 255) - ((background >> 8) & 255)) <= 12
  AND abs(((colour >> 16) & 255) - ((background >> 16) & 255)) <= 12 THEN 'same_colour' END AS reason FROM boxes)"""


@query(HIDDEN_SQL + " SELECT page, box, reason FROM h WHERE reason IS NOT NULL", ("boxes",))
def hidden_text(spark, d):
    return layout.hidden_text(frame(spark, d, "boxes")).select("page", "box", "reason")


@query(HIDDEN_SQL + " SELECT reason, count(*) AS n, count(DISTINCT page) AS pages FROM h WHERE reason IS NOT NULL GROUP BY reason", ("boxes",))
def layer_summary(spark, d):
    return layout.layer_summary(hidden_text(spark, d))


@query("""
WITH a AS (SELECT page, list([{'x0': x0, 'y0': y0, 'x1': x1, 'text': text}] ORDER BY round(y0, 1), x0, word, text) AS ws FROM words GROUP BY page),
b AS (SELECT page, list_reduce(ws, lambda acc, w: CASE WHEN abs(w[1].y0 - acc[len(acc)].y0) < 1.2 AND w[1].x0 - acc[len(acc)].x1 >= 0 AND w[1].x0 - acc[len(acc)].x1 < 3.2
    THEN list_concat(acc[1:len(acc) - 1], [{'x0': acc[len(acc)].x0, 'y0': acc[len(acc)].y0, 'x1': greatest(acc[len(acc)].x1, w[1].x1), 'text': acc[len(acc)].text || w[1].text}]) ELSE list_concat(acc, w) END) AS ps FROM a)
SELECT page, p.x0 AS x0, p.y0 AS y0, p.x1 AS x1, p.text AS text FROM (SELECT page, unnest(ps) AS p FROM b)""", ("words",))
def merge_adjacent(spark, d):
    return layout.merge_adjacent(frame(spark, d, "words")).select("page", "x0", "y0", "x1", "text")


# ---------------------------------------------------------------- answers


@query(r"SELECT answer_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)стр\.?\s*([0-9]{1,3})', 1), lambda x: CAST(x AS INTEGER)))), ' ') AS pages FROM answers", ("answers",))
def citations(spark, d):
    return frame(spark, d, "answers").select("answer_id", F.array_join(F.transform(X.citations(F.col("text")), lambda p: p.cast("string")), " ").alias("pages"))


@query("SELECT answer_id, regexp_matches(question, '(?i)" + words("|".join(P.ADVICE)) + "') AS advice FROM answers", ("answers",))
def advice_guard(spark, d):
    return frame(spark, d, "answers").select("answer_id", X.is_advice_request(F.col("question")).alias("advice"))


@query("SELECT answer_id, regexp_matches(regexp_replace(text, '(?i)не (рекомендую|советую|стоит|следует|покупайте|продавайте|инвестируйте)', ' ', 'g'), '(?i)" + words("|".join(P.VERDICTS)) + "') AS verdict FROM answers", ("answers",))
def verdict_guard(spark, d):
    return frame(spark, d, "answers").select("answer_id", X.has_verdict(F.col("text")).alias("verdict"))


UNVERIFIED = (
    f"list_sort(list_distinct(list_transform(list_filter({d_values('text')}, lambda v: len(list_filter({d_values('context')}, lambda c: abs(c - v) <= 0.5 * pow(10, -least(length(split_part(CAST(v AS VARCHAR), '.', 2)), 3)) + 1e-9)) = 0),"
    f" lambda v: {d_number_text('v')})))"
)


@query(f"SELECT answer_id, array_to_string({UNVERIFIED}, ' ') AS unverified FROM answers", ("answers",))
def check_numbers(spark, d):
    return frame(spark, d, "answers").select("answer_id", F.array_join(evaluate.unverified(F.col("text"), F.col("context")), " ").alias("unverified"))


@query(f"SELECT DISTINCT answer_id, v FROM (SELECT answer_id, context, unnest({d_values('text')}) AS v FROM answers) WHERE len(list_filter({d_values('context')}, lambda c: abs(c - v) <= 0.05 + 1e-9)) = 0", ("answers",))
def check_numbers_by_join(spark, d):
    a = frame(spark, d, "answers")
    return evaluate.unverified_rows(a.select("answer_id", F.col("answer_id").alias("ctx"), F.explode(X.values_in(F.col("text"))).alias("v")), a.select(F.col("answer_id").alias("ctx"), F.explode(X.values_in(F.col("context"))).alias("c")))


@query(f"""
WITH a AS (SELECT *, list_transform({d_values("text")}, lambda x: CAST({d_number_text("x")} AS DOUBLE)) AS vs FROM answers)
SELECT answer_id, CASE WHEN answer_id % 4 <> 0 THEN len(list_filter(vs, lambda g: abs(g - 35.9) <= 0.1795)) > 0 END AS values_ok, contains(lower(text), 'рост') AND contains(lower(text), 'купить') AS terms_ok,
  regexp_matches(text, '(?i)стр\\. ([1-9]|10)[^0-9]') AS pages_ok, CASE WHEN contains(lower(text), 'акции') THEN 'АКЦИИ' ELSE '' END AS forbidden FROM a""", ("answers",))
def eval_scores(spark, d):
    a = frame(spark, d, "answers").withColumns({
        "expect_values": F.when(F.col("answer_id") % 4 != 0, F.array(F.lit(35.9))), "expect_pages": F.array(*[F.lit(i) for i in range(1, 11)]), "expect_terms": F.array(F.lit("Рост"), F.lit("купить")),
        "forbid_terms": F.array(F.lit("АКЦИИ"), F.lit("нет такого")), "require_refusal": F.lit(False),
    })
    return evaluate.score_card(a).select("answer_id", "values_ok", "terms_ok", "pages_ok", F.array_join("forbidden_hit", " ").alias("forbidden"))


@query("SELECT id, mode, tokens FROM eval_rows WHERE id IN (3, 5, 8, 13, 21) ORDER BY id LIMIT 3", ("eval_rows",))
def pick_questions(spark, d):
    return evaluate.pick_questions(frame(spark, d, "eval_rows"), [21, 13, 8, 5, 3], 3).select("id", "mode", "tokens")


PRICE_SQL = "(VALUES ('large', 10.0, 50.0), ('small', 0.3, 2.5)) AS p(model, price_in, price_out)"
COST = "coalesce(prompt_tokens * price_in + completion_tokens * price_out, 0) / 1e6"


def _costed(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("large", 10.0, 50.0), ("small", 0.3, 2.5)], "model string, price_in double, price_out double")
    return evaluate.with_cost(frame(spark, d, "eval_rows"), prices)


@query(f"SELECT id, model, round({COST}, 8) AS cost FROM eval_rows LEFT JOIN {PRICE_SQL} USING (model)", ("eval_rows",))
def cost_model(spark, d):
    return _costed(spark, d).select("id", "model", F.round("cost", 8).alias("cost"))


SUMMARY_SQL = f"""
SELECT mode, count(*) AS runs, count(*) FILTER (passed) AS passed, count(*) FILTER (values_ok) AS values_ok_true, count(values_ok) AS values_ok_of, count(*) FILTER (pages_ok) AS pages_ok_true, count(pages_ok) AS pages_ok_of,
  list_sort(list(tokens))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS tokens_median, list_sort(list(latency))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS latency_median, round(sum({COST}), 4) AS cost
FROM eval_rows LEFT JOIN {PRICE_SQL} USING (model) GROUP BY mode"""


@query(SUMMARY_SQL, ("eval_rows",))
def eval_summary(spark, d):
    return evaluate.mode_summary(_costed(spark, d)).withColumn("cost", F.round("cost", 4))


@query(f"WITH s AS ({SUMMARY_SQL}) SELECT mode, round(100 - 100 * tokens_median / (SELECT CAST(tokens_median AS DOUBLE) FROM s WHERE mode = 'click'), 2) AS saved_pct FROM s", ("eval_rows",))
def eval_savings(spark, d):
    return evaluate.savings(eval_summary(spark, d), "click")


@query("SELECT id, mode, tokens, 'old' AS version FROM eval_rows WHERE id % 3 <> 0 UNION ALL SELECT id, mode, tokens + 1, 'new' FROM eval_rows WHERE id % 3 = 0", ("eval_rows",))
def upsert_results(spark, d):
    e = frame(spark, d, "eval_rows").select("id", "mode", "tokens")
    return evaluate.upsert(e.withColumn("version", F.lit("old")), e.filter("id % 3 = 0").select("id", "mode", (F.col("tokens") + 1).alias("tokens"), F.lit("new").alias("version")), ["id", "mode"])


@query("SELECT model AS status, count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in, CAST(sum(completion_tokens) AS BIGINT) AS tokens_out FROM eval_rows GROUP BY model", ("eval_rows",))
def status_counts(spark, d):
    return evaluate.status_counts(frame(spark, d, "eval_rows").withColumn("status", F.col("model")))


@query("SELECT doc_id, CAST(floor(length(text) / 2.5) AS INTEGER) AS tokens FROM documents")
def token_estimates(spark, d):
    return frame(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT seq, v, CASE WHEN v < 0 THEN '-' ELSE '' END || regexp_replace(CAST(CAST(floor(round(abs(v) * 10) / 10) AS BIGINT) AS VARCHAR), '^([0-9]+)([0-9]{3})$', '\\1 \\2') || ',' || CAST(CAST(round(abs(v) * 10) AS BIGINT) % 10 AS VARCHAR) AS printed FROM facts_a", ("facts_a",))
def format_ru(spark, d):
    return frame(spark, d, "facts_a").select("seq", "v", N.format_ru(F.col("v"), 1).alias("printed"))


REPAIRED = r"""
f AS (SELECT question_id, doc, CASE WHEN regexp_matches(reply, '(?s)```(?:json)?\s*(.*?)\s*```') THEN regexp_extract(reply, '(?s)```(?:json)?\s*(.*?)\s*```', 1) ELSE trim(reply) END AS body FROM replies),
j AS (SELECT question_id, doc, CAST(CASE WHEN json_valid(body) THEN body WHEN json_valid(regexp_extract(body, '(?s)\[.*\]')) AND contains(body, '[') THEN regexp_extract(body, '(?s)\[.*\]')
  WHEN json_valid(regexp_extract(body, '(?s)\{.*\}')) AND contains(body, '{') THEN regexp_extract(body, '(?s)\{.*\}') END AS JSON) AS j FROM f),
"""


@query("WITH " + REPAIRED + "k AS (SELECT question_id, CAST(json(j) AS VARCHAR) AS json FROM j) SELECT question_id, json FROM k", ("questions", "listed", "replies"))
def json_repair(spark, d):
    """The JSON of model replies in several wrappings; their keys stand in the order in which VARIANT prints them."""
    return frame(spark, d, "replies").select("question_id", X.repair_json(F.col("reply")).cast("string").alias("json"))


@query("WITH " + REPAIRED + """
v AS (SELECT question_id, doc, CASE WHEN json_type(j) = 'OBJECT' THEN CAST(j->'$.sections' AS VARCHAR[]) END AS named, coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN CAST(j->>'$.confidence' AS DOUBLE) END, 0.0) AS confidence, coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN CAST(j->>'$.need_full' AS BOOLEAN) END, false) AS need FROM j),
w AS (SELECT v.*, list_filter(coalesce(named, []), lambda x: x <> 'нет такого') AS ids FROM v)
SELECT question_id, array_to_string(ids, ' ') AS ids, confidence, need OR len(ids) = 0 AS need_full, NOT (need OR len(ids) = 0) AND confidence < 0.6 AS widen FROM w""", ("questions", "listed", "replies"))
def router_decisions(spark, d):
    out = context.route(frame(spark, d, "replies"), frame(spark, d, "sections"))
    return out.select("question_id", F.array_join("ids", " ").alias("ids"), "confidence", "need_full", "widen")


def router_client(prompt: str) -> dict:
    """Stands in for a model: two sections by the length of the question, odd replies and failures among them."""
    outline = prompt.split("<outline>\n", 1)[1].split("\n</outline>", 1)[0].split("\n")
    n = len(prompt.split("</outline>\n\n<question>", 1)[1]) - len("</question>")
    if n % 43 == 0:
        raise RuntimeError("busy")
    ids = [outline[k % len(outline)].split(" | ", 1)[0].strip() for k in (n, 7 * n)]
    body = '{"sections": ["' + '", "'.join(ids) + f'"], "confidence": 0.{n % 10}, "need_full": {"true" if n % 50 == 0 else "false"}}}'
    return {"text": "не знаю" if n % 41 == 0 else f"```json\n{body}\n```" if n % 3 == 0 else body, "prompt_tokens": n, "completion_tokens": 2}


def answer_client(prompt: str) -> dict:
    """Stands in for a model: a sentence by the length of the prompt, an empty reply and an error among them."""
    n = len(prompt)
    if n % 11 == 0:
        return {"error": "overloaded", "status": 503}
    return {"text": "" if n % 13 == 0 else f"Выручка {n % 7},5 млн (стр. {n % 90 + 1}).{' Рекомендую купить акции.' if n % 5 == 0 else ''}", "prompt_tokens": n // 3, "completion_tokens": 9}


ASK_SQL = """
WITH q AS (SELECT *, length(question) AS len FROM questions),
d AS (SELECT q.*, mode = 'full' OR len % 43 = 0 OR len % 41 = 0 OR len % 50 = 0 AS need, (len % 10) / 10.0 < 0.6 AS wide FROM q),
own AS (SELECT question_id, d.doc, l.id, d.wide FROM d JOIN listed l ON l.doc = d.doc AND l.k IN (len % l.n, 7 * len % l.n) WHERE NOT need),
spans AS (SELECT o.question_id, o.wide, s.* FROM own o JOIN sections s ON s.doc = o.doc AND s.id = o.id),
chosen AS (SELECT DISTINCT question_id, doc, seq FROM spans UNION SELECT o.question_id, t.doc, t.seq FROM spans o JOIN sections t ON o.wide AND t.doc = o.doc AND t.level = 1 AND t.page_from <= o.page_from AND o.page_to <= t.page_to),
picked AS (SELECT c.question_id, s.* FROM chosen c JOIN sections s USING (doc, seq)),
flat AS (SELECT * FROM picked s WHERE NOT EXISTS (SELECT 1 FROM picked x WHERE x.question_id = s.question_id AND x.seq <> s.seq AND x.page_from <= s.page_from AND x.page_to >= s.page_to AND (x.page_from < s.page_from OR x.page_to > s.page_to OR x.seq < s.seq))),
kept AS (SELECT d.question_id, question, CASE WHEN need THEN 'full' ELSE mode END AS mode, s.doc, s.seq, s.id, s.title, s.page_from, s.page_to, s.text FROM d JOIN flat s USING (question_id)
  UNION ALL SELECT d.question_id, question, 'full', s.doc, s.seq, s.id, s.title, s.page_from, s.page_to, s.text FROM d JOIN sections s ON s.doc = d.doc AND s.level = 1 WHERE need),
docs AS (SELECT question_id, any_value(question) AS question, any_value(mode) AS mode, any_value(doc) AS doc, array_to_string(list_sort(list_distinct(list_concat(list(page_from), list(page_to)))), ' ') AS pages,
  string_agg('<section id="' || id || '" title="' || title || '" pages="' || page_from || '-' || page_to || '">' || chr(10) || text || chr(10) || '</section>', chr(10) || chr(10) ORDER BY seq) AS document FROM kept GROUP BY question_id),
hit AS (SELECT DISTINCT docs.question_id, f.seq, CASE WHEN docs.mode = 'full' OR EXISTS (SELECT 1 FROM kept k WHERE k.question_id = docs.question_id AND f.pg BETWEEN k.page_from AND k.page_to) THEN 0 WHEN f.pg IN (12, 21) THEN 1 END AS part FROM docs JOIN facts_a f ON f.doc = docs.doc),
nums AS (SELECT question_id, '[' || string_agg('{"t":"' || t || '","m":"' || m || '","s":' || coalesce('"' || s || '"', 'null') || ',"p":"' || p || '","v":' || v || ',"u":"' || u || '","pg":' || pg || '}', ',' ORDER BY part, seq) || ']' AS numbers FROM hit JOIN facts_a USING (seq) WHERE part IS NOT NULL GROUP BY question_id),
agg AS (SELECT doc, '[' || string_agg('{"p":"' || p || '","v":' || v || '}', ',' ORDER BY p) || ']' AS aggregates FROM doc_aggregates GROUP BY doc),
prompts AS (SELECT question_id, question, mode, pages, '<question>' || question || '</question>' || chr(10) || chr(10) || '<numbers>' || chr(10) || '{"numbers":' || coalesce(numbers, '[]') || coalesce(',"aggregates":' || aggregates, '') || '}'
  || chr(10) || '</numbers>' || chr(10) || chr(10) || '<document>' || chr(10) || document || chr(10) || '</document>' AS prompt FROM docs LEFT JOIN nums USING (question_id) LEFT JOIN agg USING (doc))"""
ASK_VIEWS = ("sections", "questions", "listed", "facts_a", "doc_aggregates")


def _aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x)
    return frame(spark, d, "doc_aggregates").groupBy("doc").agg(F.to_json(rows).alias("aggregates"))


def _asked_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    """Questions, sections and facts, each computed once."""
    return [written(frame(spark, d, n), n) for n in ("questions", "sections", "facts_a")]


@query(ASK_SQL + " SELECT question_id, mode, pages, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS chars, CAST(floor(length(prompt) / 2.5) AS INTEGER) AS tokens FROM prompts", ASK_VIEWS)
def context_prompt(spark, d):
    """Router prompts, replies and decisions, then the context of every question: sections, facts, aggregates."""
    q, s, f = _asked_tables(spark, d)
    replies = context.routed(q, s, router_client).select("question_id", "doc", F.col("text").alias("reply"))
    q, chosen = context.selected(q, s, replies)
    out = context.build(q, s, f, chosen.select("question_id", "id"), [12, 21], _aggregates(spark, d))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), " ")
    return out.select("question_id", "mode", pages.alias("pages"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "chars", "tokens")


NOTICE_SQL, WARNING_SQL = f"chr(10) || chr(10) || '{context.NOTICE}'", f"'{context.WARNING}' || chr(10) || chr(10)"


@query(ASK_SQL + f""",
r AS (SELECT p.*, length(prompt) AS n, CASE WHEN length(prompt) % 11 = 0 THEN 'overloaded' WHEN length(prompt) % 13 = 0 THEN 'empty reply' END AS error FROM prompts p),
t AS (SELECT r.*, CASE WHEN error IS NULL THEN 'Выручка ' || n % 7 || ',5 млн (стр. ' || n % 90 + 1 || ').' || CASE WHEN n % 5 = 0 THEN ' Рекомендую купить акции.' ELSE '' END END AS text, error IS NULL AND n % 5 = 0 AS verdict, prompt AS context FROM r),
g AS (SELECT *, regexp_matches(question, '(?i){words("|".join(P.ADVICE))}') OR verdict AS advice FROM t)
SELECT question_id, mode, CASE WHEN verdict THEN {WARNING_SQL} ELSE '' END || text || CASE WHEN advice THEN {NOTICE_SQL} ELSE '' END AS text, array_to_string({UNVERIFIED}, ' ') AS unverified, advice AS advice_guarded, verdict AS verdict_leaked,
  CASE WHEN text IS NULL THEN NULL ELSE CAST(n % 90 + 1 AS VARCHAR) END AS cited_pages, error, CAST(CASE WHEN error IS NULL THEN n // 3 ELSE 0 END + CASE WHEN d.mode = 'router' AND len % 43 <> 0 THEN len ELSE 0 END AS BIGINT) AS prompt_tokens
FROM g JOIN (SELECT question_id, mode, len FROM d) d USING (question_id)""".replace("SELECT question_id, mode, CASE WHEN verdict", "SELECT question_id, g.mode AS mode, CASE WHEN verdict"), ASK_VIEWS)
def answer_pipeline(spark, d):
    """Every question from its router call to the guarded answer."""
    out = context.ask(*_asked_tables(spark, d), router_client, answer_client, [12, 21], _aggregates(spark, d), keep_prompts=False)
    pages = F.array_join(F.transform("cited_pages", lambda p: p.cast("string")), " ")
    return out.select("question_id", "mode", "text", F.array_join("unverified", " ").alias("unverified"), "advice_guarded", "verdict_leaked", pages.alias("cited_pages"), "error", "prompt_tokens")


@query(f"""
WITH a AS (SELECT *, list_transform({d_values("text")}, lambda x: CAST({d_number_text("x")} AS DOUBLE)) AS vs FROM answers),
c AS (SELECT answer_id, CASE WHEN answer_id % 4 <> 0 THEN len(list_filter(vs, lambda g: abs(g - 35.9) <= 0.1795)) > 0 END AS values_ok, regexp_matches(text, '(?i)стр\\. ([1-9]|10)[^0-9]') AS pages_ok, contains(lower(text), 'акции') AS forbidden,
  regexp_matches(regexp_replace(text, '(?i)не (рекомендую|советую|стоит|следует|покупайте|продавайте|инвестируйте)', ' ', 'g'), '(?i){words("|".join(P.VERDICTS))}') AS verdict, {UNVERIFIED} AS unverified FROM a)
SELECT answer_id, coalesce(values_ok, true) AND pages_ok AND NOT forbidden AND NOT verdict AND len(unverified) = 0 AS passed FROM c""", ("answers",))
def eval_passed(spark, d):
    """The pass rule over score cards of every answer."""
    a = frame(spark, d, "answers").withColumns({
        "expect_values": F.when(F.col("answer_id") % 4 != 0, F.array(F.lit(35.9))), "expect_pages": F.array(*[F.lit(i) for i in range(1, 11)]), "expect_terms": F.array().cast("array<string>"),
        "forbid_terms": F.array(F.lit("АКЦИИ"), F.lit("нет такого")), "require_refusal": F.lit(False), "unverified": evaluate.unverified(F.col("text"), F.col("context")),
    })
    return evaluate.judged(a).select("answer_id", "passed")
