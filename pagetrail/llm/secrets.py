"""Secret scan: fixed patterns, and a randomness battery over every other long token.

Patterns (base spans): ``assign``, ``access`` and ``hex``, leftmost and non-overlapping per kind over the whole
text; a match that is too short is dropped after it has used up its characters.

Battery (``random`` spans): a candidate is a maximal run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that no
base span contains. Its encoding is the smallest listed alphabet that holds it, and three tests ask whether it could
be uniform over it: chi-squared of the symbol counts, number of runs above and below the alphabet's middle, and
lag-1 serial correlation, joined by Fisher's method. False discoveries are controlled by Benjamini-Hochberg within each length band,
over all candidates of the corpus, twice. First over the battery's own p-values: what it rejects at ``level`` is not random, with at most
that share of random tokens among what is given up. Then over p-values under "ordinary text", from the log-likelihood ratio of uniform
symbols against the corpus's own symbol frequencies (counted over all documents), whose mean and variance grow with the
length; what the battery rejected counts there with a p-value of one. So a short token needs as much evidence as its band's
error rate asks. Both use histograms of p-values with fixed bins, each bin counting at its larger end.

A null or empty text has no spans; each row of documents gives one row, repeated ones too. The longest text and
token are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, table, texts
from .wordhash import buffers

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

_DIGIT, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by size of alphabet.
ALPHABETS = {
    "decimal": _DIGIT,
    "hex": _DIGIT + "abcdef",
    "hex upper": _DIGIT + "ABCDEF",
    "lower": _LOW,
    "upper": _UP,
    "base32": _UP + "234567",
    "base36": _DIGIT + _LOW,
    "base36 upper": _DIGIT + _UP,
    "letters": _UP + _LOW,
    "base62": _UP + _LOW + _DIGIT,
    "base64": _UP + _LOW + _DIGIT + "+/",
    "base64url": _UP + _LOW + _DIGIT + "-_",
    "mixed": _UP + _LOW + _DIGIT + "+/-_=",
}
_INDEX = {name: {ord(c): i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
#: Length bands: each starts at its number.
BANDS = (20, 24, 32, 48, 64, 128)
BINS_PER_DECADE, MAX_BIN = 10, 3000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the pattern matches."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    # both kinds lie inside runs of 20 characters
    for run in RUN.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= MIN_ACCESS]
        if b - a >= MIN_HEX:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def encoding(token: str) -> str:
    used = set(token)
    return next((n for n, s in _SETS.items() if used <= s), "mixed")


def _tail(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(x: np.ndarray, size: int) -> float:
    """Joint p-value that the symbol indices x are uniform and independent over ``size`` symbols."""
    n = len(x)
    counts = np.bincount(x, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    p = [_tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    high = x >= size / 2
    up = int(high.sum())
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    p.append(2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else _tail(n / 2))
    d = x - x.mean()
    ss = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / ss if ss else 1.0
    p.append(2 * _tail(abs(r + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(v, 1e-300)) for v in p)
    return math.exp(-half) * (1 + half + half * half / 2)  # chi-squared with 6 degrees of freedom


def ordinary_models(counts: np.ndarray) -> dict[str, tuple[np.ndarray, float, float]]:
    """For each encoding: log-likelihood ratio of every symbol, and its mean and variance in ordinary text."""
    out = {}
    for name, alphabet in ALPHABETS.items():
        f = counts[[ord(c) for c in alphabet]].astype(float) + 1
        f /= f.sum()
        llr = -np.log(f * len(alphabet))
        mean = float((f * llr).sum())
        out[name] = (llr, mean, float((f * (llr - mean) ** 2).sum()))
    return out


def neglog_p(x: np.ndarray, model: tuple[np.ndarray, float, float]) -> float:
    """-log10 of the p-value under ordinary text, at most MAX_BIN / BINS_PER_DECADE."""
    llr, mean, var = model
    z = (float(llr[x].sum()) - len(x) * mean) / math.sqrt(len(x) * var + 1e-9)
    if z < 30:
        return -math.log10(_tail(z))
    return min(MAX_BIN / BINS_PER_DECADE, (z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10))


def p_bin(neglog: float) -> int:
    return min(MAX_BIN, int(neglog * BINS_PER_DECADE))


def candidates(text: str, base: list[tuple[int, int, int]], models: dict) -> list[tuple[int, int, int, int, int]]:
    """(start, end, length band, bin of the battery's p-value, bin of the one under ordinary text) of every candidate."""
    out = []
    for run in RUN.finditer(text):
        a, b = run.span()
        if any(s <= a and b <= e for s, _, e in base):
            continue
        token = text[a:b]
        name = encoding(token)
        symbols = token.rstrip("=") if name == "mixed" else token
        name = encoding(symbols) if name == "mixed" else name
        if len(symbols) < BANDS[0]:
            continue
        x = np.array([_INDEX[name][ord(c)] for c in symbols])
        band = sum(len(x) >= v for v in BANDS)
        battery = -math.log10(max(uniformity(x, len(ALPHABETS[name])), 1e-300))
        out.append((a, b, band, p_bin(battery), p_bin(neglog_p(x, models[name]))))
    return out


def byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte occurs over all texts: 256 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            total += np.bincount(buffers(b.column("text"))[1], minlength=256)
        yield pa.RecordBatch.from_pydict({"byte": np.arange(256, dtype=np.int32), "n": total})

    rows = docs.select("text").mapInArrow(released(count), "byte int, n long").groupBy("byte").agg(F.sum("n")).collect()
    out = np.zeros(256, np.int64)
    for byte, n in rows:
        out[byte] = n
    return out


def cutoffs(hist: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg in each length band: the least bin whose candidates count as found."""
    out = {}
    for band in {b for b, _ in hist}:
        bins = sorted(((k, n) for (b, k), n in hist.items() if b == band), reverse=True)
        m, seen = sum(n for _, n in bins), 0
        for k, n in bins:
            seen += n
            if 10 ** (-k / BINS_PER_DECADE) <= rate * seen / m:
                out[band] = k
    return out


def two_cutoffs(hist: dict[tuple[int, int, int], int], level: float, rate: float) -> tuple[dict[int, int], dict[int, int]]:
    """From counts by (band, bin of the battery, bin under ordinary text): by band the least bin that the battery rejects, and the
    least that is found among the others."""
    battery, ordinary = Counter(), Counter()
    for (band, odd, _), n in hist.items():
        battery[band, odd] += n
    rejected = cutoffs(battery, level)
    for (band, odd, k), n in hist.items():
        ordinary[band, 0 if odd >= rejected.get(band, MAX_BIN + 1) else k] += n
    return rejected, cutoffs(ordinary, rate)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CAND = "array<struct<start:int,kind:int,end:int,band:int,odd:int,bin:int>>"


def secret_scan(docs: DataFrame, rate: float = 1e-3, level: float = 1e-3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random. rate: share of false ones allowed among the tokens found in a
    length band. level: that among the tokens the battery rejects."""
    docs = texts(docs)
    models = ordinary_models(byte_counts(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("odd", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            base_out, cand_out = [], []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                base_out.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                cand_out.append([{"start": s, "kind": 3, "end": e, "band": w, "odd": u, "bin": v} for s, e, w, u, v in candidates(text, base, models)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base_out, span), pa.array(cand_out, cand)], ["doc_id", "base", "cand"])

    found = materialize(docs.mapInArrow(released(scan), f"doc_id long, base {_SPAN}, cand {_CAND}"), "secrets")
    # bounded by bands and bins
    hist = found.select(F.explode("cand").alias("c")).groupBy("c.band", "c.odd", "c.bin").count().collect()
    rejected, least = two_cutoffs({(r["band"], r["odd"], r["bin"]): r["count"] for r in hist}, level, rate)
    of_band = lambda c, cut: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (cut or {0: 0}).items() for x in kv]), c["band"]), F.lit(MAX_BIN + 1))
    random = F.transform(F.filter("cand", lambda c: (c["odd"] < of_band(c, rejected)) & (c["bin"] >= of_band(c, least))), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    # a second parameter of the lambda would be the element's index, so the kind is bound outside
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    n = [of_kind(i) for i in range(3)]
    return found.select("doc_id", *n, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", random))).alias("spans"), F.size(random).cast("long").alias("n_random"))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan(table(spark, sf_dir, "documents"))
