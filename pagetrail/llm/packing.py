"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Every document becomes the ids of a public tokenizer plus an end id. Runs of ``window`` ids are windows of
their own; what remains of a document is cut into pieces of at most ``piece`` ids. Pieces are dealt by hash
into blocks of about ``block_pieces``, and each block is split into the fewest windows that hold it by multiway
differencing: the two partial partitions with the largest imbalance are merged, the fullest part of one with the
emptiest of the other, until one partition is left. If its fullest window exceeds the capacity, the block takes
one window more and starts again.

A null or empty text is the end id alone. Rows that repeat a doc_id, and rows without one, are packed each on
their own. An empty table gives no pieces. The longest text is cut like any other.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, table, texts
from .wordhash import chunks

WINDOW = 4096
PIECE = 512
BLOCK_PIECES = 4096
END_ID = 2
CACHE_WORDS = 1 << 19
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = _PIECES + ", sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts from a cache of words.

    Only for tokenizers that lower-case, drop white space and split at it and between letters and marks before
    anything else, so that the ids of a text are those of its words in order. The cache is emptied when it holds
    CACHE_WORDS words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        at = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
        count = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(words))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(count) - count
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, begin)
        self.count = np.insert(self.count, place, count)

    def encode(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids, offsets of the documents' ids) for each chunk of documents."""
        for w in chunks(col, split=True):
            uniq, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(self.keys) + len(uniq) > CACHE_WORDS:
                self.clear()
            at = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[at] != uniq) if len(self.keys) else np.arange(len(uniq))
            if len(new):
                text = w.data.tobytes()
                self._learn(uniq[new], [text[a:b].decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, uniq)
            begin, count = (self.begin[at][inverse], self.count[at][inverse]) if len(uniq) else (np.zeros(0, np.int64),) * 2
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = self.pool[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])]
            yield w.lo, ids, ends[w.first]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker; its cache of words is emptied after each, as workers live on."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cuts(tokens: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then even parts of the rest of at most ``piece``."""
    full = tokens // window
    out = [(i * window, window) for i in range(full)]
    rest, at = tokens - full * window, full * window
    n = -(-rest // piece)
    for i in range(n):
        size = rest // n + (i < rest % n)
        out.append((at, size))
        at += size
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every document."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, ids, offsets in t.encode(batch.column("text")):
                out: list[list] = [[], [], [], [], []]
                for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for start, size in cuts(len(own), window, piece):
                        for column, x in zip(out, (names[lo + d], start, size, zlib.crc32(own[start : start + size]), len(own)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)
        t.clear()

    return texts(docs).mapInArrow(released(tokenize), _PIECES)


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Indices of the sizes in each of ``parts`` parts, by multiway largest differencing."""
    if parts == 1:
        return [list(range(len(sizes)))]
    # a state lists (-sum, items) by rising -sum; parts it does not list are empty
    heap = [(-s, i, [(-s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        if len(a) + len(b) <= parts:
            if len(b) == 1:
                insort(a, b[0], key=lambda x: x[0])
            else:
                a = sorted(a + b, key=lambda x: x[0])
        else:
            # b's fullest parts go to a's emptiest
            spare = parts - len(a)
            a = a + [(0, [])] * spare
            joined = a[: parts - len(b)] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[parts - len(b) :], reversed(b), strict=True)]
            a = sorted(joined, key=lambda x: x[0])
        low = a[-1][0] if len(a) == parts else 0
        heapq.heappush(heap, (a[0][0] - low, tick, a))
        tick += 1
    state = heap[0][2] if heap else []
    return [items for _, items in state]


def pack(sizes: list[int], window: int) -> list[list[int]]:
    """Windows of at most ``window``, as few as differencing allows."""
    parts = max(1, -(-sum(sizes) // window))
    while True:
        out = differencing(sizes, parts)
        if max((sum(sizes[i] for i in x) for x in out), default=0) <= window:
            return out
        parts += 1


def _block(window: int):
    def packed(block: pa.Table) -> pa.Table:
        block = block.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        size = block.column("length").to_numpy()
        base = block.column("block")[0].as_py() << 24
        full = int((size == window).sum())
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        seq[:full] = np.arange(full)
        rest = size[full:].tolist()
        for i, items in enumerate(pack(rest, window)):
            at = 0
            for j in sorted(items):
                seq[full + j], off[full + j] = full + i, at
                at += rest[j]
        out = block.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(base + seq)).append_column("offset", pa.array(off))

    return packed


def karmarkar_karp_packing(docs: DataFrame, tokenizer: str, window: int = WINDOW, piece: int = PIECE, block_pieces: int = BLOCK_PIECES, end_id: int = END_ID) -> DataFrame:
    """Each piece with its sequence and its place there: see the module's docstring."""
    cut = materialize(pieces(docs, tokenizer, window, piece, end_id), "pieces")
    blocks = max(1, -(-cut.count() // block_pieces))
    # the row number keeps repeated rows from meeting in one block
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_block(window), _PACKED)


def op8_karmarkar_karp(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents packed into windows of 4096 ids."""
    return karmarkar_karp_packing(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
