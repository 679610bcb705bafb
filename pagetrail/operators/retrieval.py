"""Chunks, BM25 and section search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetrail.functions.text import folded, searchable, tokens
from pagetrail.shared import children, exists, removed, written

MAX_CHARS, OVERLAP, TOP_K, K1, B = 6000, 400, 8, 1.5, 0.75


def chunk_texts(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, separator: str = "\n\n") -> Column:
    """Pieces of a text: whole if short, else paragraphs packed up to max_chars, each piece starting with the end
    of the one before. A paragraph is never cut.

    A fold over the paragraphs in higher-order functions, without Python, linear in their number."""
    text = F.trim(text)
    sep = F.lit(separator)
    none = F.array().cast("array<string>")

    def step(cur: Column, p: Column) -> Column:
        full = (F.length(cur) + F.length(p) > max_chars) & (cur != "")
        start = F.when(F.length(cur) > overlap, F.right(cur, F.lit(overlap))).otherwise(cur)
        grown = F.when(cur == "", p).otherwise(F.concat(cur, sep, p))
        return F.struct(F.when(full, F.array(cur)).otherwise(none).alias("out"), F.when(full, F.concat(start, sep, p)).otherwise(grown).alias("cur"))

    packed = F.filter(folded(F.split(text, separator, -1), F.lit(""), step, lambda cur: F.array(cur)), lambda x: x != "")
    return F.when(F.length(text) == 0, none).when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


def chunks(sections: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, separator: str = "\n\n") -> DataFrame:
    """R2: chunks of the given (leaf) sections with their place."""
    pieces = sections.withColumn("piece", chunk_texts(F.col("text"), max_chars, overlap, separator))
    return pieces.select("doc", F.col("id").alias("section_id"), F.col("title").alias("section_title"), "page_from", "page_to", "seq", F.posexplode("piece").alias("chunk_ix", "chunk"))


def chunk_documents(pieces: DataFrame) -> DataFrame:
    """Chunks as (doc_id, doc, section_id, text) for bm25(): what is searched is title, pages and text. The id holds document,
    section and place of the chunk."""
    name = F.concat_ws(":", "doc", F.col("seq").cast("string"), F.col("chunk_ix").cast("string"))
    return pieces.select(name.alias("doc_id"), "doc", "section_id", searchable(F.col("section_title"), F.col("page_from"), F.col("page_to"), F.col("chunk")).alias("text"))


def write_index(docs: DataFrame, path: str) -> None:
    """Postings (term, doc_id, tf, len) in term order, so that a search reads only the row groups of its terms, and the corpus
    statistics, under ``path``. Common terms are spread over several files."""
    lengths = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    posted = lengths.select("doc_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
    posted = posted.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    _corpus(lengths).write.mode("overwrite").parquet(f"{path}/corpus")


def bm25_indexed(spark: SparkSession, path: str, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """bm25() on an index of write_index(): the corpus is neither read nor split into words again."""
    terms = _terms(queries)
    tf = spark.read.parquet(f"{path}/postings").join(terms.select("term").distinct(), "term", "left_semi")
    return _scores(terms, tf, spark.read.parquet(f"{path}/corpus"), k1, b)


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("avgdl"))


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


#: Up to so many asked terms are written into the plan, so that tokens are dropped before they become rows.
LISTED_TERMS = 1000


def asked_terms(terms: DataFrame) -> list[str] | None:
    """The distinct asked terms, or None if there are more than LISTED_TERMS."""
    found = [r.term for r in terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    return found if len(found) <= LISTED_TERMS else None


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a token with a query (query_id, query).

    A text is split once. Tokens that no query asks for are dropped inside its array, before any becomes a row: what moves is the matching postings, not the
    corpus. Beyond LISTED_TERMS asked terms they are dropped by a join instead. Repeated query tokens count each time."""
    terms = _terms(queries)
    asked = asked_terms(terms)
    lengths = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    if asked is None:
        posted = lengths.select("doc_id", F.size("toks").alias("len"), F.explode("toks").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    else:
        posted = lengths.select("doc_id", F.size("toks").alias("len"), F.explode(F.filter("toks", lambda t: t.isin(asked))).alias("term"))
    tf = posted.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    return _scores(terms, tf, _corpus(lengths), k1, b)


def _scores(terms: DataFrame, tf: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    norm = 1 - b + b * F.greatest(F.col("len"), F.lit(1)) / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return terms.join(tf, "term").join(df, "term").crossJoin(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int = TOP_K, digits: int | None = None) -> DataFrame:
    """The k best positive scores of each query; ties go to the smaller document. digits: rank by rounded scores."""
    s = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("score", s).filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- an index that is kept, with block maxima

BLOCK_DOCS = 512


def signature(docs: DataFrame) -> str:
    """What tells one corpus (doc_id, text) from another: its rows and a sum over their hashes, in no order."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}-{row.s or 0}"


def open_index(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> str:
    """The folder of the corpus's index under ``path``. It is built if there is none for these texts, and those of other texts go then.

    The index holds, for each term, its postings in blocks of documents, a document being in the same block for every term, with the largest share of a
    score that a posting of the block can give (without idf). The folder is named by the texts' signature and the parameters; it counts once all of it is written."""
    spark = docs.sparkSession
    name = f"{signature(docs)}-{block_docs}-{k1:g}-{b:g}"
    home = f"{path}/{name}"
    if exists(spark, f"{home}/corpus/_SUCCESS"):
        return home
    lengths = written(docs.select("doc_id", tokens(F.col("text")).alias("toks")), "tokens")
    corpus = _corpus(lengths).select("n", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"), F.greatest(F.ceil(F.col("n") / block_docs), F.lit(1)).alias("blocks"))
    # corpus: one row. Texts move to their block once, as arrays; counts and lists of a block are made where it lies, and no token moves as a row
    placed = lengths.crossJoin(F.broadcast(corpus)).select("doc_id", "toks", "avgdl", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block")).repartition("block")
    tf = placed.select("block", "doc_id", "avgdl", F.size("toks").alias("len"), F.explode("toks").alias("term")).groupBy("block", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"), F.first("avgdl").alias("avgdl"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest(F.col("len"), F.lit(1)) / F.col("avgdl")))
    lists = tf.select("term", "block", F.struct("doc_id", part.alias("part")).alias("p")).groupBy("block", "term").agg(F.collect_list("p").alias("postings"), F.max("p.part").alias("most"), F.count(F.lit(1)).alias("n"))
    # written before they are put in order, as that looks at them twice
    lists = written(lists.select("term", "block", "postings", "most", "n"), "lists")
    lists.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{home}/postings")
    spark.read.parquet(f"{home}/postings").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{home}/terms")
    corpus.write.mode("overwrite").parquet(f"{home}/corpus")
    removed(spark, lengths._written_path)
    removed(spark, lists._written_path)
    for other in children(spark, path):
        if other != name:
            removed(spark, f"{path}/{other}")
    return home


def top_k_indexed(spark: SparkSession, home: str, queries: DataFrame, k: int = TOP_K, digits: int | None = None) -> DataFrame:
    """top_k(bm25(...)) from open_index()'s folder: (query_id, doc_id, score, rank).

    Blocks end early: a query first scores its most promising blocks, those whose bounds (the sums of its terms' block maxima) are the largest and which hold k
    documents at least, and the kth score found there is one that others must reach. Of the rest only blocks whose bound reaches it are opened. Bounds are read
    without the postings."""
    terms = _terms(queries)
    asked = asked_terms(terms)
    one = lambda d: d if asked is None else d.filter(F.col("term").isin(asked))  # noqa: E731  reaches the files' statistics
    df, corpus = one(spark.read.parquet(f"{home}/terms")), spark.read.parquet(f"{home}/corpus")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = terms.join(df, "term").crossJoin(F.broadcast(corpus.select("n"))).select("query_id", "term", (F.col("times") * idf).alias("weight"))  # corpus: one row
    postings = one(spark.read.parquet(f"{home}/postings"))
    # a document holds one of a block's terms at least, so the longest list counts documents
    bound = weight.join(postings.select("term", "block", "most", F.col("n").alias("held")), "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.max("held").alias("held"))
    bound = written(bound, "bounds")
    by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("held").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = bound.withColumn("before", before).filter(F.col("before") < k).select("query_id", "block")

    def scored(blocks: DataFrame) -> DataFrame:
        opened = postings.join(blocks.join(weight, "query_id"), ["term", "block"]).select("query_id", "weight", F.explode("postings").alias("p"))
        return opened.groupBy("query_id", "p.doc_id").agg(F.sum(F.col("weight") * F.col("p.part")).alias("score"))

    first = top_k(scored(lead), k, digits)
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reach"))
    slack = 1e-9 if digits is None else 10.0**-digits
    rest = bound.join(reach, "query_id", "left").filter(F.col("reach").isNull() | (F.col("bound") + slack >= F.col("reach"))).select("query_id", "block")
    return top_k(scored(rest), k, digits)


def section_ids(hits: DataFrame) -> DataFrame:
    """Distinct sections of ranked chunks by their best rank. hits: query_id, section_id, rank."""
    first = hits.groupBy("query_id", "section_id").agg(F.min("rank").alias("best"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "section_id")))


def cosine(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): cosine of each asked vector and every other, as a dense hook for top_k()."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), dot(F.col("embedding"), F.col("embedding")).alias("vv"))
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), dot(F.col("embedding"), F.col("embedding")).alias("qq"))
    return v.join(q, F.col("doc_id") != F.col("query_id")).select("query_id", "doc_id", (dot(F.col("v"), F.col("q")) / F.sqrt(F.col("vv") * F.col("qq"))).alias("score"))


#: Rows of a cell of the vector search, and asked rows compared with them at a time.
CELL_ROWS, CELL_ASKED, STEP = 4096, 8192, 256


def dense_top_k(vectors: DataFrame, asked: DataFrame, k: int = TOP_K, digits: int = 6, cell_rows: int = CELL_ROWS, cell_asked: int = CELL_ASKED) -> DataFrame:
    """top_k(cosine(vectors, asked), k, digits) without a row for each pair.

    Vectors and asked ones meet in cells of bounded size, each pair in one. A cell multiplies whole matrices, and scores anew, in the order of
    the components, what comes within a rounding of an asked vector's kth score there; only that leaves the cell, of equal scores the k smallest ids. The work
    grows with the number of pairs, what moves and is held does not."""
    dot = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = lambda d: d.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), dot.alias("xx")).filter("id IS NOT NULL AND xx IS NOT NULL")
    v, q = rows(vectors), rows(asked)
    down, across = (max(1, -(-d.count() // n)) for d, n in ((vectors, cell_rows), (asked, cell_asked)))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("a", at(down)).withColumn("b", every(across))
    q = q.withColumn("b", at(across)).withColumn("a", every(down))
    kind = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        def split(t):
            t = t.combine_chunks()
            size = np.array([len(x) for x in t.column("x")], np.int64) if t.num_rows else np.zeros(0, np.int64)
            flat = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
            ids, xx, start = t.column("id").to_numpy(), t.column("xx").to_numpy(), np.cumsum(size) - size
            return {int(n): (ids[size == n], xx[size == n], flat[start[size == n][:, None] + np.arange(n)]) for n in np.unique(size)}

        out = []
        there, wanted = split(left), split(right)
        for n in there.keys() & wanted.keys():
            (ids, vv, x), (qids, qqs, ys) = there[n], wanted[n]
            for lo in range(0, len(qids), STEP):
                qid, qq, y = qids[lo : lo + STEP], qqs[lo : lo + STEP], ys[lo : lo + STEP]
                with np.errstate(all="ignore"):
                    s = (y @ x.T) / np.sqrt(qq[:, None] * vv[None, :])
                    own = qid[:, None] == ids[None, :]
                    s[own] = -np.inf
                    least = np.full((len(qid), 1), -np.inf)
                    if len(ids) > k:  # not a number counts as the largest, here as in the order of scores
                        least = np.partition(s, len(ids) - k, axis=1)[:, [len(ids) - k]]
                    keep = np.isnan(s) | (s >= np.maximum(least - 1.01 * 10.0**-digits, -1e-9))
                    i, j = np.nonzero(keep & ~own)
                    score = np.zeros(len(i))
                    for c in range(n):
                        score = score + x[j, c] * y[i, c]
                    score = score / np.sqrt(vv[j] * qq[i])
                order = np.lexsort((ids[j], score, i))
                i, j, score = i[order], j[order], score[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | ((score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1])))
                place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                few = place < k
                out.append(pa.Table.from_arrays([pa.array(qid[i[few]]), pa.array(ids[j[few]]), pa.array(score[few])], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    scores = v.groupBy("a", "b").cogroup(q.groupBy("a", "b")).applyInArrow(best, "query_id long, doc_id long, score double")
    return top_k(scores, k, digits)
