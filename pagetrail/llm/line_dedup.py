"""Line dedup by a log-template tree: recurring templates across documents are dropped.

Lines are cut at line feeds, their tokens at ASCII white space; A-Z counts as a-z. A token with a digit, ``@`` or ``://``
is a variable field and a wildcard wherever it stands. The tree has a fixed depth: token count, the first DEPTH tokens, then PARTS
levels for equal parts of the rest of the line (single tokens, where fewer than that are left). At these levels a line takes the branch of
its tokens, or the wildcard branch at VARIABLE of them, as long as ``alike`` of its tokens stay; so it ends in every leaf, or
template, that generalises it so, and in that of itself. Lines that differ anywhere in two parts meet in one.

A template recurs when at least ``min_docs`` different texts hold a line of it, or two if its lines have LONG tokens that are no fields,
and at least ``min_fixed`` of its tokens are fixed. A line belongs to the recurring template that most texts hold (ties: the larger key).
It is dropped from all documents but those with the same text as the one with the smallest id that holds the template, so
that text which only copies share is not lost, and exact copies stay equal. All of this is counting by keys:
the result does not depend on the order of rows, on partitions, or on how many lines meet in a branch, and no task gets a whole one.

A line with fewer than MIN_FIXED tokens that are no fields has no wildcards: only its very repetitions count.
Lines of fewer than ``min_fixed`` tokens are never dropped. Null texts stay null and empty ones empty; a text that loses all
its lines is empty. Rows without id keep their lines and do not count; rows that repeat an id with different texts are different
documents. Whole texts and lines are read, however long. No rows give no rows. Columns other than text pass through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import discard, materialize, released, table, text_key, texts
from .graph import bloom_bits, bloom_has, bloom_width
from .wordhash import Words, chunks, mix

DEPTH = 4
PARTS = 7
VARIABLE = 2
MIN_DOCS = 3
MIN_FIXED = 4
LONG = 50
ALIKE = 0.7
#: The parts that are wildcards, for each kind of template.
WILD = [list(c) for k in (VARIABLE, 1) for c in combinations(range(1, PARTS + 1), k)]
_ANY = np.uint64(0)
_TABLE_HASH = np.uint64(0x9FB21C651E98DF25)


class Lines:
    """Lines of a chunk of documents with at least one token: token hashes (fields 0) and the keys of each line."""

    def __init__(self, w: Words):
        feeds = np.flatnonzero(w.data == 10)
        # the line of a byte: line feeds before it, and a new line at every document's start
        doc_of_word = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        line = np.searchsorted(feeds, w.start)
        new = np.append([True], (line[1:] != line[:-1]) | (doc_of_word[1:] != doc_of_word[:-1])) if len(line) else np.zeros(0, bool)
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(line)))
        self.doc = doc_of_word[self.begin]
        field = np.concatenate([[0], np.cumsum(((w.data >= 48) & (w.data <= 57)) | (w.data == 64))])
        variable = field[w.end] > field[w.start]
        slashes = np.flatnonzero((w.data[:-2] == 58) & (w.data[1:-1] == 47) & (w.data[2:] == 47)) if len(w.data) > 2 else np.zeros(0, np.int64)
        variable |= np.searchsorted(slashes, w.end) > np.searchsorted(slashes, w.start)
        # a line of hardly anything but fields is taken by its very tokens
        fixed = np.add.reduceat((~variable).astype(np.int64), self.begin) if len(self.begin) else self.size
        variable &= np.repeat(fixed >= MIN_FIXED, self.size)
        self.tokens = np.where(variable, _ANY, w.hash | np.uint64(1))
        self.fixed = np.add.reduceat((~variable).astype(np.int64), self.begin) if len(self.begin) else self.size
        self.literal = fixed < MIN_FIXED
        place = np.arange(len(line)) - np.repeat(self.begin, self.size)
        self.key = self._sum(place, None)
        self.leaf = self._sum(place, DEPTH)
        # the line's bytes: from after the line feed (or document start) before it to the next line feed (or document end)
        self.line_no = line[self.begin] if len(line) else line

    def _sum(self, place: np.ndarray, upto: int | None) -> np.ndarray:
        """Hash of each line's token count and its first tokens."""
        if not len(self.begin):
            return np.zeros(0, np.int64)
        value = mix(self.tokens + (place.astype(np.uint64) + np.uint64(1)) * _TABLE_HASH)
        if upto is not None:
            value = np.where(place < upto, value, np.uint64(0))
        return mix(np.add.reduceat(value, self.begin) + self.size.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)).astype(np.int64)

    def templates(self, at: np.ndarray, alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The templates with wildcards of the lines ``at``: index of the line, key, number of fixed tokens."""
        n = self.size[at]
        # tokens of these lines in order, and the branch each lies on: 0 for the leading ones, then a number for each part
        line = np.repeat(np.arange(len(at)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        token = self.tokens[np.repeat(self.begin[at], n) + place]
        rest = np.maximum(n - DEPTH, 1)[line]
        branch = np.where(place < DEPTH, 0, 1 + np.where(rest >= PARTS, (place - DEPTH) * PARTS // rest, place - DEPTH))
        value = mix(token + (place.astype(np.uint64) + np.uint64(1)) * _TABLE_HASH)
        slot = line * (PARTS + 1) + branch
        edge = np.flatnonzero(np.append([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        sums, count, solid = np.zeros(len(at) * (PARTS + 1), np.uint64), np.zeros(len(at) * (PARTS + 1), np.int64), np.zeros(len(at) * (PARTS + 1), np.int64)
        if len(edge):
            sums[slot[edge]] = np.add.reduceat(value, edge)
            count[slot[edge]] = np.diff(np.append(edge, len(slot)))
            solid[slot[edge]] = np.add.reduceat((token != _ANY).astype(np.int64), edge)
        sums, count, solid = (x.reshape(len(at), PARTS + 1) for x in (sums, count, solid))
        out: list[tuple] = []
        for number, parts in enumerate(WILD, 1):
            wild = count[:, parts].sum(axis=1)
            ok = (count[:, parts] > 0).all(axis=1) & (wild <= (1 - alike) * n) & ~self.literal[at]
            # one part alone says no more than two, unless the line is too short for two
            ok &= (len(parts) == VARIABLE) | (n - DEPTH < VARIABLE) | (VARIABLE > (1 - alike) * n)
            i = np.flatnonzero(ok)
            key = mix(sums[i].sum(axis=1) - sums[i][:, parts].sum(axis=1) + n[i].astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(number * 0x94D049BB133111EB % 2**64))
            out.append((at[i], key.astype(np.int64), solid[i].sum(axis=1) - solid[i][:, parts].sum(axis=1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def line_keys(docs: DataFrame, min_fixed: int) -> DataFrame:
    """doc_id, text_key, leaf, line, solid: each document's different lines that may be dropped; leaf: token count and leading tokens,
    solid: tokens that are no fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text")):
                x = Lines(w)
                _, once = np.unique(mix(x.key.astype(np.uint64)) + x.doc.astype(np.uint64) * _TABLE_HASH, return_index=True)
                once = once[x.size[once] >= min_fixed]
                own = [batch.column(c).slice(w.lo, w.hi - w.lo).take(pa.array(x.doc[once])) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v[once]) for v in (x.leaf, x.key, x.fixed))], ["doc_id", "text_key", "leaf", "line", "solid"])

    return docs.mapInArrow(released(run), "doc_id long, text_key long, leaf long, line long, solid long")


def line_templates(docs: DataFrame, bits: np.ndarray, width: int, alike: float) -> DataFrame:
    """line, template, fixed of the lines whose key may be in the bit set, once a task as a rule."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for w in chunks(batch.column("text")):
                x = Lines(w)
                at = np.flatnonzero(bloom_has(shared.value, (x.key.astype(np.uint64) >> np.uint64(64 - width)).astype(np.int64)))
                _, first = np.unique(x.key[at], return_index=True)
                at = np.array([i for i in at[first].tolist() if int(x.key[i]) not in done], np.int64)
                done = (done if len(done) < 1 << 18 else set()) | set(x.key[at].tolist())
                i, key, fixed = x.templates(at, alike)
                yield pa.RecordBatch.from_arrays([pa.array(x.key[i]), pa.array(key), pa.array(fixed)], ["line", "template", "fixed"])

    return docs.select("text").mapInArrow(released(run), "line long, template long, fixed long")


def _needed(solid: Column, min_docs: int) -> Column:
    """Texts that must hold a template whose lines have so many tokens that are no fields."""
    return F.when(solid >= LONG, min(2, min_docs)).otherwise(min_docs)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_fixed: int = MIN_FIXED, alike: float = ALIKE, copies: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, lines): keys of the lines that each document of (doc_id, text) loses.

    copies (doc_id, text_key, owner): documents with one owner count as one, as equal texts do without it: what only copies share does
    not recur, and copies of the document that keeps a line keep it too, so that all of them lose the same lines."""
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    found = line_keys(docs, min_fixed)
    if copies is not None:
        found = found.join(copies.select("doc_id", "text_key", "owner").distinct(), ["doc_id", "text_key"])
    found = materialize(found, "lines")
    lines = found if copies is not None else found.withColumn("owner", F.col("text_key"))
    per_line = materialize(lines.groupBy("line").agg(F.count_distinct("owner").alias("texts"), F.first("leaf").alias("leaf"), F.first("solid").alias("solid")), "line-counts")
    # branches below the leading tokens that several lines take, which could make a template together
    leaf = per_line.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("texts").alias("d"), F.max("solid").alias("most")).filter((F.col("n") > 1) & (F.col("d") >= _needed(F.col("most"), min_docs)))
    shared = materialize(per_line.join(leaf, "leaf").select("line", "texts", "solid"), "branches")
    width = bloom_width(shared.count())
    bits = bloom_bits(shared, F.shiftrightunsigned("line", 64 - width), width)
    made = materialize(line_templates(docs, bits, width, alike).filter(F.col("fixed") >= min_fixed).join(shared, "line").distinct(), "made")
    # templates of one line only say no more than the line; those of too few texts in all cannot recur
    enough = lambda n: F.col(n) >= _needed(F.col("solid"), min_docs)
    wide = made.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.sum("texts").alias("all"), F.min("solid").alias("solid")).filter((F.col("n") > 1) & enough("all"))
    wide = made.select("line", "template").join(wide.select("template", "solid"), "template")
    alone = per_line.filter(enough("texts") & (F.col("solid") >= min_fixed)).select("line", F.col("line").alias("template"), "solid")
    named = materialize(alone.unionByName(wide), "templates")
    held = lines.select("doc_id", "owner", "line").join(named, "line")
    recur = held.groupBy("template").agg(F.count_distinct("owner").alias("texts"), F.min(F.struct("doc_id", "owner")).getField("owner").alias("first"), F.min("solid").alias("solid")).filter(enough("texts"))
    # both written, so that the join below exchanges both sides and a line that many documents hold can be split
    best = named.join(recur.select("template", "texts", "first"), "template").groupBy("line").agg(F.max(F.struct("texts", "template", "first")).getField("first").alias("first"))
    best = materialize(best, "recurring")
    out = lines.select("doc_id", "text_key", "owner", "line").join(best, "line").filter(F.col("owner") != F.col("first"))
    out = materialize(out.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines")), "dropped")
    discard(found, per_line, shared, made, named, best)
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, drop = batch.column("text").to_pylist(), batch.column("lines").to_pylist()
        n_lines, n_dropped = [0 if t is None else t.count("\n") + 1 for t in text], [0] * len(text)
        hit = [i for i, d in enumerate(drop) if d and text[i] is not None]
        if hit:
            picked = pa.array([text[i] for i in hit], pa.string())
            for w in chunks(picked):
                x = Lines(w)
                edge = np.searchsorted(x.doc, np.arange(w.hi - w.lo + 1))
                feeds_before = np.searchsorted(np.flatnonzero(w.data == 10), w.offsets[:-1])
                for j in range(w.hi - w.lo):
                    i = hit[w.lo + j]
                    gone = set(drop[i])
                    at = {int(x.line_no[k] - feeds_before[j]) for k in range(edge[j], edge[j + 1]) if int(x.key[k]) in gone}
                    rows = text[i].split("\n")
                    text[i] = "\n".join(r for k, r in enumerate(rows) if k not in at)
                    n_dropped[i] = len(at)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])


def deduped_lines(docs: DataFrame, **options) -> DataFrame:
    """row (the document as it was, a struct), text without recurring lines, n_lines, n_dropped."""
    gone = recurring_lines(texts(docs), **options).withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    # texts travel once: the row's own is put back by the caller
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("id"), text_key(docs["text"]).alias("text_key"), docs["text"].cast("string").alias("text"))
    rows = rows.join(gone, (rows["id"] == gone["gone_id"]) & (rows["text_key"] == gone["gone_key"]), "left").select("row", "text", "lines")
    kind = StructType().add("row", rows.schema["row"].dataType).add("text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())
    return rows.mapInArrow(released(_without), kind)


def without_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the recurring lines gone from text; all columns kept, in their order."""
    return deduped_lines(docs, **options).select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return deduped_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "text", "n_lines", "n_dropped")
