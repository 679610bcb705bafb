"""Repeated passages by difference-cover anchors.

A cover is a set of residues modulo a period in which every difference of two places occurs: whatever two places a passage starts at,
some shift of less than a period puts both on the cover. So if a window of ``window`` words starts in two documents, both hash an anchor of
``window - period + 1`` of its words at the same shift, although only the words at cover places start one (6 of 31 for 50 words).
Anchors that one document has alone end there. Around the others, found in a second reading by a bit set of bounded size, every
window that holds the anchor is the extension to the window's full length: windows are told by 128 bits, the smallest document of each
is counted up, and a window that also starts in a smaller document takes all its words out. What is removed is decided on the texts as they came.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, unchanged; a null text has none. Whole texts are read, however long; a text shorter than a
window loses nothing. Rows without id are named by no other and lose nothing. Rows that repeat an id are one document for the comparison: they
take nothing from each other, and rows that repeat id and text have the same result, each in a row of its own. Of equal texts the one with the smallest
id stays whole. An empty table gives no rows. Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, released, table, text_key, texts
from .graph import bloom_bits, bloom_has, bloom_width
from .wordhash import Words, chunks, kept_texts, run_hashes, second_hashes

WINDOW = 50
TURNS = 4
#: Residues whose differences are all residues, each once. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of three words or more (of two fifths of a long window), and its cover."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= max(3, 2 * window // 5))
    return period, COVERS[period]


def _places(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its document in the chunk, its place there, the words from it to the end of the document."""
    size = np.diff(w.first)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(doc)) - w.first[doc]
    return doc, place, size[doc] - place


def anchor_places(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in the chunk where an anchor starts, their hashes, and the anchor's words. Texts shorter than the window have none."""
    period, cover = cover_for(window)
    doc, place, left = _places(w)
    on = np.zeros(period, bool)
    on[list(cover)] = True
    at = np.flatnonzero(on[place % period] & (left > window - period) & (np.diff(w.first)[doc] >= window))
    return at, run_hashes(w.hash, at, window - period + 1), window - period + 1


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """h, doc_id of every anchor, once for each document of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text"), lower=False):
                at, h, _ = anchor_places(w, window)
                ids = batch.column("doc_id").slice(w.lo, w.hi - w.lo).to_numpy(zero_copy_only=False)[_places(w)[0][at]]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "h long, doc_id long")


def candidate_windows(docs: DataFrame, window: int, bits: Broadcast, width: int, turn: int, turns: int) -> DataFrame:
    """doc_id, text_key, place, w1, w2: every window around an anchor that the bit set may hold, of those whose hash has its turn."""
    period = cover_for(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text"), lower=False):
                at, h, _ = anchor_places(w, window)
                at = at[bloom_has(bits.value, (h >> np.uint64(64 - width)).astype(np.int64))]
                if not len(at):
                    continue
                doc, place, left = _places(w)
                edge = np.zeros(len(doc) + 1, np.int32)  # starts of windows that hold the anchor: up to period - 1 words before it
                np.add.at(edge, at - np.minimum(period - 1, place[at]), 1)
                np.add.at(edge, at + 1, -1)
                at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (left >= window))
                w1 = run_hashes(w.hash, at, window)
                now = w1 % np.uint64(turns) == turn
                at, w1 = at[now], w1[now]
                own = pa.array(doc[at])
                columns = [*(batch.column(c).slice(w.lo, w.hi - w.lo).take(own) for c in ("doc_id", "text_key")), pa.array(place[at].astype(np.int32))]
                columns += [pa.array(x.astype(np.int64)) for x in (w1, run_hashes(second_hashes(w), at, window))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "place", "w1", "w2"])

    return docs.mapInArrow(released(run), "doc_id long, text_key long, place int, w1 long, w2 long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, turns: int = TURNS) -> DataFrame:
    """doc_id, text_key, places ARRAY<INT>: the windows of each text that also start in a document with a smaller id.

    turns: the windows are looked up in so many turns, each over all texts, so that only that share of them is on disk at once."""
    rows = texts(docs).filter("doc_id IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    met = anchors(rows, window).groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    met = materialize(met, "anchors")
    width = bloom_width(met.count())
    bits = bloom_bits(met, F.shiftrightunsigned("h", 64 - width), width)
    bits = docs.sparkSession.sparkContext.broadcast(bits)
    parts = []
    for turn in range(turns):
        # both written, so that both sides of the join are exchanged and a window that many documents hold can be split
        found = materialize(candidate_windows(rows, window, bits, width, turn, turns), "windows")
        first = materialize(found.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("w1", "w2", "lo"), "first")
        again = found.join(first, ["w1", "w2"]).filter("lo < doc_id")
        parts.append(materialize(again.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places")), "repeats"))
        discard(found, first)
    out = materialize(reduce(DataFrame.union, parts).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places")), "repeats")
    discard(met, *parts)
    return out


def _without(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for w in chunks(batch.column("text"), lower=False):
                size = np.diff(w.first)
                edge = np.zeros(len(w.start) + 1, np.int32)
                hit = places.slice(w.lo, w.hi - w.lo)
                n = pc.fill_null(pc.list_value_length(hit), 0).to_numpy(zero_copy_only=False)
                if n.any():
                    at = np.repeat(w.first[:-1], n) + hit.flatten().to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[w.first]
                kept = kept_texts(w, np.cumsum(edge[:-1]) == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.lo, w.hi - w.lo), pa.array(size, pa.int64()), pa.array(np.diff(gone), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    gone = repeated_windows(docs, window).withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    rows = texts(docs).withColumn("text_key", text_key(F.col("text")))
    rows = rows.join(gone, (rows["doc_id"] == gone["gone_id"]) & (rows["text_key"] == gone["gone_key"]), "left").select("doc_id", "text", "places")
    return rows.mapInArrow(released(_without(window)), "doc_id long, n_words long, n_removed long, kept string")


def op11_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those of 50-word windows that a document with a smaller id has too."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM v),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM s) WHERE lo < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r),
a AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM d LEFT JOIN a USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
