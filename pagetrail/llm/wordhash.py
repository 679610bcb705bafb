"""Vectorised words and word hashes over the UTF-8 bytes of Arrow string batches.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased, which is the
same at byte and code point level. Each word gets a 64-bit hash from prefix sums of a polynomial over
the batch's bytes, so no Python object is made for any word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = True
_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CODE2 = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words(NamedTuple):
    """One chunk of documents. Word i is data[start[i]:end[i]]; document d has words first[d]:first[d + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    total: np.ndarray


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES, split: bool = False, bare: bool = False, lower: bool = True) -> Iterator[Words]:
    """Words of the column's documents, in chunks of about ``limit`` bytes of whole documents.

    lower: A-Z count as a-z.
    bare: words are maximal runs of ASCII letters and digits and of bytes beyond ASCII, so that marks are no part of them.
    split: also cut between an ASCII letter and an ASCII mark other than ``'<|>``; a chunk that holds ``<|`` is
    then left as it is, neither cut so nor lower-cased."""
    offsets, data = buffers(col)
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        plain = split and b"<|" in part.tobytes()
        yield _words(lo, hi, part if plain or not lower else _LOWER[part], offsets[lo : hi + 1] - offsets[lo], split and not plain, _NO_WORD if bare else _SPACE)
        lo = hi


def _words(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, split: bool, between: np.ndarray) -> Words:
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if split:
        letter, mark = _LETTER[data], _MARK[data]
        edge[1:n] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:]
    closes = np.zeros(n + 1, bool)
    closes[1:] = solid[:-1] & (~solid[1:] | edge[1:])
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    up = _power(n + 1)[0]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:n], out=total[1:])
    return Words(lo, hi, data, offsets, start, end, _range_hash(total, start, end), np.searchsorted(start, offsets), total)


def _range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _power(len(total))[1]
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def second_hashes(w: Words) -> np.ndarray:
    """Another 64-bit hash of each word, by other codes of the bytes: with Words.hash 128 bits a word."""
    up, down = _power(len(w.data) + 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(_CODE2[w.data] * up[: len(w.data)], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] ^ (w.end - w.start).astype(np.uint64))


def run_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each of the places on, by prefix sums over the words' hashes."""
    up, down = _power(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[at + k] - total[at]) * down[at])


def kept_texts(w: Words, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words as they are in the data, joined by one space."""
    n = len(w.data)
    data = w.data.copy()
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(w.first, kept, "right") - 1
    more = np.zeros(len(kept), bool)  # another kept word of the document follows: white space stands after this one
    more[:-1] = doc[:-1] == doc[1:]
    data[w.end[kept[more]]] = 32
    edge = np.zeros(n + 1, np.int32)
    edge[w.start[kept]] = 1
    edge[w.end[kept] + more] -= 1  # no two words end at one place
    inside = np.cumsum(edge[:n]) > 0
    place = np.concatenate([[0], np.cumsum(inside)])[w.offsets]
    out = data[inside].tobytes()
    return [out[a:b] for a, b in zip(place[:-1], place[1:], strict=True)]


_STEP = [0x8CB92BA72F3D8DD7 | 1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3]


def weights(k: int) -> np.ndarray:
    """k odd multipliers, one for each place of a word sequence."""
    out, x = [], 0x2545F4914F6CDD1D
    for i in range(k):
        out.append(_STEP[i] if i < len(_STEP) else (x := (x * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % 2**64) | 1)
    return np.array(out, np.uint64)


def shingle_hashes(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one document."""
    n, c = len(w.hash), weights(k)
    h = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        h += w.hash[j : j + len(h)] * c[j]
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    return mix(h), doc[: len(h)] == doc[k - 1 :] if n >= k else np.zeros(0, bool)


def shingle_sets(w: Words, k: int = 5) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingles; a shorter one is a single shingle, one without words has none."""
    h, ok = shingle_hashes(w, k)
    c = weights(k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            yield s[keep]
        elif b > a:
            yield mix(np.array([(w.hash[a:b] * c[: b - a]).sum(dtype=np.uint64) ^ _U(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """64-bit key of a shingle set, as a signed long; equal sets have equal keys."""
    if not len(s):
        return 0
    x = mix(s * _U(0xD1B54A32D192ED03) + _U(len(s))).sum(dtype=np.uint64)
    return int(mix(np.array([x ^ _U(len(s))], np.uint64)).astype(np.int64)[0])
