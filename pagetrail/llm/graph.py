"""Connected components and bounded Bloom filters as DataFrame jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

BLOOM_BITS = 26


def components(edges: DataFrame) -> DataFrame:
    """(key, comp): the smallest key that each key of the edges (u, v) reaches, itself left out when alone.

    Alternates large-star and small-star contraction until nothing changes. Neighbours are only ever reduced to
    their minimum and joined back, never gathered, so a key with many edges is an ordinary skewed join.
    """
    lo, hi = F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")
    e = materialize(edges.filter("u <> v").select(lo, hi).distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select("hi", "lo")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u AND v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "k")
        pairs = large.join(low, F.col("hi") == F.col("k"))
        small = pairs.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(pairs.select("m", "hi")).distinct()
        following = materialize(small, "edges")
        discard(e)
        e = following
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("hi").alias("key"), F.col("lo").alias("comp"))
        state = now


def bloom_width(n: int) -> int:
    """log2 of the bits for a set of n keys: 16 bits a key, between 2**26 (8 MB) and 2**29 bits (64 MB)."""
    return min(29, max(BLOOM_BITS, (16 * n).bit_length()))


def bloom_slot(col: Column, width: int = BLOOM_BITS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(1 << width))


def bloom(keys: DataFrame, col: str, width: int = BLOOM_BITS) -> np.ndarray:
    """Bit set of the keys' slots."""
    return bloom_bits(keys, bloom_slot(F.col(col), width), width)


def bloom_bits(keys: DataFrame, slot: Column, width: int = BLOOM_BITS) -> np.ndarray:
    """2**width bits (8 MB by default) for any number of rows, built from 4 KB pieces."""
    slot = slot + 1
    pieces = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros((1 << width) >> 3, np.uint8)
    for b, bits in pieces:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)
    return out


def bloom_has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
