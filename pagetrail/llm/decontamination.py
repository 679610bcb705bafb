"""Benchmark decontamination by spaced seeds: fixed masks over words that ignore some positions.

Every mask turns the words at its kept positions into one hash, at every place of every benchmark item and of
every document. A document's hash goes on only if a bit set of fixed size (8 MB, two bits a hash) says that some item may
have it, and is then joined to the items' hashes exactly. A hit fixes how item and document lie on each other;
there the words are compared one by one, and the overlap counts when some window of ``span`` words (the whole item
if that is shorter) agrees in at least ``share`` of them. Substituted words cost a match each, not the overlap: for the default
span and share the masks are so chosen that wherever the substitutions fall that a window of its length may have, one mask meets
none of them (enumerated in the tests). Items of up to SHORT words have lighter masks of their own. Items under ``MIN_WORDS`` words
leave no room for substitutions: their mask is as long as the item and it counts where a document holds all of it, word by word.
As a phrase that short also stands in texts that never saw the item, ``without_contaminated`` lets it speak only against a document that says nothing else.

Null and empty texts, on either side, match nothing; rows without id cannot be named and are left out. Repeated document rows are reported once an item,
with the best overlap (ties: the earliest in the item); rows that repeat an id with another text are another document. Case of A-Z is
ignored. Whole texts are read, however long. Empty tables give no rows. Only id and text are read of either table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, table, text_key, texts, without_rows
from .graph import BLOOM_BITS, bloom, bloom_bits, bloom_has, bloom_slot, bloom_width
from .wordhash import Words, chunks, mix, weights

#: Kept positions are 1. Five or six words for items of more than SHORT words, four for shorter ones.
MASKS = ("11111", "1101011", "110010011", "10110001101", "1110001001")
SHORT_MASKS = ("1111", "11011", "11101", "10111", "1100011")
#: Whole items of that many words.
WHOLE_MASKS = ("1", "11", "111", "1111")
SHORT = 9
MIN_WORDS = 5
SPAN = 13
SHARE = 0.75
_ALL_MASKS = MASKS + SHORT_MASKS + WHOLE_MASKS
_WHOLE = len(MASKS + SHORT_MASKS)
_SLOT = np.uint64((1 << BLOOM_BITS) - 1)


def seed_hashes(w: Words, masks: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask, given by its place in _ALL_MASKS: hashes, their first words' places in the chunk, and their documents."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for m in masks:
        mask = _ALL_MASKS[m]
        n = len(w.hash) - len(mask) + 1
        if n <= 0:
            continue
        kept = [i for i, c in enumerate(mask) if c == "1"]
        h = np.full(n, m + 1, np.uint64)
        for c, i in zip(weights(len(kept)), kept, strict=True):
            h += w.hash[i : i + n] * c
        at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
        yield m, mix(h[at]), at, doc[at]


_ROW = "doc_id long, text_key long, "


def _own(batch: pa.RecordBatch, w: Words) -> list[pa.Array]:
    return [batch.column(c).slice(w.lo, w.hi - w.lo) for c in ("doc_id", "text_key")]


def word_lists(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, words BINARY: hashes of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text")):
                lists = [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*_own(batch, w), pa.array(lists, pa.binary())], ["doc_id", "text_key", "words"])

    return rows.select("doc_id", "text_key", "text").mapInArrow(released(run), _ROW + "words binary")


def seeds(rows: DataFrame, masks: list[int], bits: np.ndarray | None = None) -> DataFrame:
    """doc_id, text_key, mask, hash, pos of every seed, or of those that the bit set may hold; pos counts words from the text's start.
    Without a bit set a text has the seeds of the masks for its length only, with one the first of each hash only of WHOLE_MASKS, as one place tells all."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text")):
                own = _own(batch, w)
                for m, h, at, doc in seed_hashes(w, masks):
                    if shared is not None:
                        hit = np.flatnonzero(bloom_has(shared.value, (h & _SLOT).astype(np.int64)))
                        hit = hit[bloom_has(shared.value, (h[hit] >> np.uint64(BLOOM_BITS) & _SLOT).astype(np.int64))]
                        if m >= _WHOLE:
                            order = np.lexsort((hit, h[hit], doc[hit]))
                            new = np.ones(len(order), bool)
                            new[1:] = (np.diff(h[hit][order]) != 0) | (np.diff(doc[hit][order]) != 0)
                            hit = np.sort(hit[order[new]])
                    else:
                        n = np.diff(w.first)[doc]
                        hit = np.flatnonzero(n == len(_ALL_MASKS[m]) if m >= _WHOLE else (n <= SHORT if m >= len(MASKS) else n > SHORT) & (n >= MIN_WORDS))
                    h, at, doc = h[hit], at[hit], doc[hit]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(doc)) for c in own), pa.array(np.full(len(h), m, np.int32)), pa.array(h.astype(np.int64)), pa.array(at - w.first[doc])], ["doc_id", "text_key", "mask", "hash", "pos"])

    return rows.select("doc_id", "text_key", "text").mapInArrow(released(run), _ROW + "mask int, hash long, pos long")


def best_window(text: np.ndarray, item: np.ndarray, shift: int, span: int) -> tuple[int, int]:
    """(most equal words in a window of the overlap, the window's start in the item)."""
    n = min(span, len(item))
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi - lo < n:
        return 0, 0
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == text[lo + shift : hi + shift])])
    runs = same[n:] - same[:-n]
    at = int(runs.argmax())
    return int(runs[at]), lo + at


def _verify(span: int, share: float):
    """Rows of a document come together, its text first (role 0), then its hits. Items under MIN_WORDS must agree in all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, text = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for d, key, role, item, shift, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "role", "item_id", "shift", "words")), strict=True):
                w = np.frombuffer(words, np.uint64)
                if role == 0:
                    doc, text = (d, key), w
                elif doc == (d, key):
                    n = min(span, len(w))
                    same, start = best_window(text, w, shift, span)
                    if same >= (share * n if n >= MIN_WORDS else n):
                        for column, x in zip(out, (d, key, item, start + shift, same, n, len(text)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "text_key", "item_id", "word_start", "matched", "span", "n_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, word_start, matched, span, n_words (of the document), text_key (see common): a row for each document and item that overlap."""
    spark = docs.sparkSession
    docs, items = (texts(t, i).filter("doc_id IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), "text") for t, i in ((docs, "doc_id"), (benchmark, "item_id")))
    lists = materialize(word_lists(items).filter(F.octet_length("words") > 0).select(F.col("doc_id").alias("item_id"), "words").distinct(), "items")
    known = materialize(seeds(items, list(range(len(_ALL_MASKS)))).select(F.col("doc_id").alias("item_id"), "mask", "hash", F.col("pos").alias("item_pos")).distinct(), "seeds")
    masks = sorted(r[0] for r in known.select("mask").distinct().collect())
    slots = known.select(F.explode(F.array(F.col("hash").bitwiseAND(int(_SLOT)), F.shiftrightunsigned("hash", BLOOM_BITS).bitwiseAND(int(_SLOT)))).alias("slot"))
    found = seeds(docs, masks, bloom_bits(slots, F.col("slot"))).drop("mask").join(known, "hash")
    hits = materialize(found.select("doc_id", "text_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")
    width = bloom_width(hits.count())
    bits = spark.sparkContext.broadcast(bloom(hits, "doc_id", width))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom_has(bits.value, batch.column("slot").to_numpy())))
            yield batch.select(["doc_id", "text_key", "text"])

    hit_docs = docs.withColumn("slot", bloom_slot(F.col("doc_id"), width)).mapInArrow(released(few), _ROW + "text string")
    none = F.lit(None).cast("long")
    text_rows = word_lists(hit_docs).select("doc_id", "text_key", F.lit(0).alias("role"), none.alias("item_id"), none.alias("shift"), "words")
    hit_rows = hits.join(lists, "item_id").select("doc_id", "text_key", F.lit(1).alias("role"), "item_id", "shift", "words")
    rows = text_rows.union(hit_rows).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "role")
    out = rows.mapInArrow(released(_verify(span, share)), _ROW + "item_id long, word_start long, matched long, span long, n_words long")
    best = F.max(F.struct("matched", (-F.col("word_start")).alias("neg"), "span", "n_words"))
    return out.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.neg")).alias("word_start"), "b.matched", "b.span", "b.n_words", "text_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap an item, all columns kept. An item under MIN_WORDS words counts where it is the whole document."""
    gone = contaminated(docs, benchmark).filter((F.col("span") >= MIN_WORDS) | (F.col("n_words") == F.col("span")))
    return without_rows(docs, gone.select("doc_id", "text_key"))


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
