"""Periodic runs of words by tiles of the scale of their period.

A run is a stretch of words with smallest period q (words q apart are the same) and at least ``exponent * q`` words (and ``least``) that no
neighbouring word extends. Periods are dealt into octaves from P to 2P. For an octave a document is cut by boundaries 2P apart, each with a tile that reaches
2P words to its left and 2P beyond the period to its right; tiles overlap and are solved alone. In a tile the Z-functions
at the boundary c give, for each period q of the octave, how far the words from c and from c + q agree to the right, and those before
them to the left: together a fragment of period q around c. A run of four periods or more has fragments at all boundaries that lie a period before its end, and
neighbouring ones share a period at least; so fragments are shuffled by document and period, put in order, and stitched where they do.
A fragment whose first period repeats a shorter one goes, as it is a run of that one.

All tiles of an octave of the documents at hand are solved together, step by step over the pairs that still agree, and by hashes of stretches and halving once 16
words agree; fragments are then compared word by word. Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, unchanged, told by 64-bit hashes; a null text has none.
Whole texts are read, however long. Rows that repeat an id are judged each by its own text; rows that repeat both have the same result, each
in a row of its own. Rows without id are judged as they are. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, released, table, text_key, texts
from .wordhash import chunks, kept_texts, mix

EXPONENT, LEAST = 4, 6
STEPS = 16
RUN = "array<struct<start:bigint,period:bigint,length:bigint>>"


def planted_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a text of n words whose tail is made periodic by its id's checksum; None: each its own."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and n else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


class Stretches:
    """Words of several documents one after another, a mark that equals nothing before, between and behind them."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        self.start = first[:-1] + np.arange(1, len(first))
        self.size = size
        self.x = mix(np.arange(1, len(words) + len(first) + 1, dtype=np.uint64))
        self.x[np.arange(len(words)) + np.repeat(np.arange(1, len(first)), size)] = words
        self._sums: tuple | None = None

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and from b on have one hash."""
        if self._sums is None:
            base = 0x9E3779B97F4A7C15 | 1
            up, down = (np.full(len(self.x) + 1, k, np.uint64) for k in (base, pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            total = np.zeros(len(self.x) + 1, np.uint64)
            np.cumsum(self.x * up[:-1], out=total[1:])
            self._sums = total, down
        total, down = self._sums
        return (total[a + n] - total[a]) * down[a] == (total[b + n] - total[b]) * down[b]

    def agree(self, a: np.ndarray, b: np.ndarray, limit: int, step: int) -> np.ndarray:
        """Z-values: how many words agree one after another from a and b on (step 1) or before them (step -1), at most limit."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(min(limit, STEPS)):
            live = live[self.x[a[live] + step * k] == self.x[b[live] + step * k]]
            if not len(live):
                return out
            out[live] += 1
        if limit > STEPS:  # halve the rest; b is the later place, so what lies beyond its document never agrees
            room = np.minimum(limit, (len(self.x) - b[live]) if step > 0 else a[live] + 1)
            lo, hi = np.full(len(live), STEPS), room
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                shift = 0 if step > 0 else mid - 1
                fine = self.same(a[live] - shift, b[live] - shift, mid)
                lo, hi = np.where(fine, mid, lo), np.where(fine, hi, mid - 1)
            out[live] = lo
        return out


def smallest_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number up to n."""
    out = np.arange(n + 1)
    for i in range(2, int(n**0.5) + 1):
        if out[i] == i:
            out[i * i :: i] = np.minimum(out[i * i :: i], i)
    return out


def octave(s: Stretches, p: int, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, period, start, end) of the fragments of periods p to 2p - 1; places count from the document's start."""
    docs = np.flatnonzero(s.size >= exponent * p)
    n_tiles = (s.size[docs] - p + 2 * p - 1) // (2 * p)
    doc = np.repeat(docs, n_tiles)
    tile = np.arange(n_tiles.sum()) - np.repeat(np.cumsum(n_tiles) - n_tiles, n_tiles)
    c = s.start[doc] + 2 * p * tile
    q = np.arange(p, 2 * p)
    in_text = (2 * p * tile[:, None] + q < s.size[doc][:, None]) & (exponent * q <= s.size[doc][:, None])
    row, k = np.nonzero(in_text)
    a, b = c[row], c[row] + q[k]
    met = s.x[a] == s.x[b]
    doc, a, b, q = doc[row[met]], a[met], b[met], q[k[met]]
    right, left = s.agree(a, b, 2 * p, 1), s.agree(a - 1, b - 1, 2 * p, -1)
    # what ends on both sides before the tile does is whole, and a run or nothing; other fragments of a run have two periods
    whole = (left < 2 * p) & (right < 2 * p)
    wide = left + right + q >= np.where(whole, np.maximum(exponent * q, least), 2 * q)
    doc, a, b, q, right, left = (v[wide] for v in (doc, a, b, q, right, left))
    primitive, rest, factors = np.ones(len(q), bool), q.copy(), smallest_factors(2 * p)
    while (rest > 1).any():
        f = np.maximum(factors[rest], 1)
        shorter = q // f
        primitive &= (f == 1) | ~s.same(a, a + shorter, q - shorter)
        while (more := (f > 1) & (rest % f == 0)).any():
            rest = np.where(more, rest // f, rest)
    doc, a, b, q, right, left = (v[primitive] for v in (doc, a, b, q, right, left))
    begin, end = a - left, b + right
    for i in range(len(q)):  # word by word: hashes are no proof
        if not np.array_equal(s.x[begin[i] : end[i] - q[i]], s.x[begin[i] + q[i] : end[i]]):
            raise ArithmeticError("two stretches of words have one hash")
    return doc, q, begin - s.start[doc], end - s.start[doc]


def fragments(s: Stretches, exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """(document, period, start, end) of all octaves."""
    found, p = [], 1
    while exponent * p <= s.size.max(initial=0):
        found.append(octave(s, p, exponent, least))
        p *= 2
    return [np.concatenate([np.asarray(f[i], np.int64) for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]


_READ = "doc_id long, text_key long, n_words long, words string, parts array<struct<period:bigint,begin:bigint,end:bigint>>"


def tiled(docs: DataFrame, plant: Callable[[int | None, int], np.ndarray | None] | None, exponent: int, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, n_words, words (joined by one space) and the fragments (parts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text"), lower=False):
                ids = batch.column("doc_id").slice(w.lo, w.hi - w.lo)
                at = np.arange(len(w.hash))
                joined = kept_texts(w, np.ones(len(at), bool))
                for i, (doc_id, a, b) in enumerate(zip(ids.to_pylist(), w.first[:-1], w.first[1:], strict=True)):
                    if plant and (own := plant(doc_id, int(b - a))) is not None:
                        at[a:b] = a + own
                        words = joined[i].split(b" ")
                        joined[i] = b" ".join([words[k] for k in own])
                doc, q, begin, end = fragments(Stretches(w.hash[at], w.first), exponent, least)
                by = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[by], np.arange(w.hi - w.lo + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(v[by]) for v in (q, begin, end)], ["period", "begin", "end"])
                columns = [ids, batch.column("text_key").slice(w.lo, w.hi - w.lo), pa.array(np.diff(w.first), pa.int64()), pa.array(joined, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets), parts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "words", "parts"])

    return docs.mapInArrow(released(run), _READ)


def stitched(parts: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, runs from fragments (doc_id, text_key, period, begin, end): those that share a period are one stretch."""
    key = ["doc_id", "text_key", "period"]
    by = Window.partitionBy(*key).orderBy("begin", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("new", (reach.isNull() | (F.col("begin") + F.col("period") > reach)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = rows.groupBy(*key, "island").agg(F.min("begin").alias("start"), (F.max("end") - F.min("begin")).alias("length"))
    whole = whole.filter((F.col("length") >= exponent * F.col("period")) & (F.col("length") >= least))
    return whole.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        for w in chunks(batch.column("words"), lower=False):
            edge = np.zeros(len(w.hash) + 1, np.int32)
            for first, own in zip(w.first[:-1], runs.slice(w.lo, w.hi - w.lo).to_pylist(), strict=True):
                for r in own:
                    edge[first + r["start"] + r["period"]] += 1
                    edge[first + r["start"] + r["length"]] -= 1
            kept = pa.array(kept_texts(w, np.cumsum(edge[:-1]) == 0), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(w.lo, w.hi - w.lo) for c in ("doc_id", "n_words", "runs")), kept], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, plant: Callable[[int | None, int], np.ndarray | None] | None = None, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, period, length; by start, then period), collapsed (the words that no run holds after its first period,
    joined by one space) of every row. plant: gives the word that stands at each place of a text, for tests of known periods."""
    if exponent < 4:
        raise ValueError("tiles are cut for runs of four periods or more")
    rows = texts(docs).withColumn("text_key", text_key(F.col("text")))
    read = materialize(tiled(rows.select("doc_id", "text_key", "text"), plant, exponent, least), "tiles", compression="zstd")
    parts = read.select("doc_id", "text_key", F.explode("parts").alias("x")).select("doc_id", "text_key", "x.*")
    found = materialize(stitched(parts, exponent, least), "runs").withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    none = read.filter(F.size("parts") == 0).select("doc_id", "n_words", F.array().cast(RUN).alias("runs"), F.col("words").alias("collapsed"))
    some = read.filter(F.size("parts") > 0).select("doc_id", "text_key", "n_words", "words")
    some = some.join(found, some["doc_id"].eqNullSafe(found["of_id"]) & (some["text_key"] == found["of_key"]), "left")
    some = some.select("doc_id", "n_words", "words", F.coalesce("runs", F.array().cast(RUN)).alias("runs"))
    return none.unionByName(some.mapInArrow(released(_collapsed), f"doc_id long, n_words long, runs {RUN}, collapsed string"))


def op13_scale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with a periodic tail."""
    out = periodic_runs(table(spark, sf_dir, "documents"), planted_tail)
    size = lambda r: r["length"].cast("double") / r["period"]  # noqa: E731  correctly rounded: equal ratios are equal, others differ
    best = F.array_min(F.transform("runs", lambda r: F.struct((-size(r)).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = out.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        sha(text).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
        lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM d, crc),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS per FROM g),
x AS (SELECT rid, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % per END]) AS w FROM p),
t AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM x),
e AS (SELECT a.rid, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.rid = s.rid AND o.q < s.q AND s.q % o.q = 0 AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
c AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, min({'a': -CAST(length AS DOUBLE) / q, 'start': start, 'q': q, 'length': length}) AS best FROM r GROUP BY rid),
z AS (SELECT rid, list(DISTINCT j) AS gone FROM (SELECT rid, unnest(range(start + q, start + length)) AS j FROM r) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period, 1000 * best.length // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(gone, j - 1)) END, ' ')) AS collapsed_sha256
FROM x LEFT JOIN c USING (rid) LEFT JOIN z USING (rid)"""
