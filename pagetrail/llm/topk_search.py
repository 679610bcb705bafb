"""Exact inner-product top-k by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are packed where they lie, without an exchange, into blocks of up to ``block_rows`` rows of one length. A block holds its
rows and, for each dimension, their order by falling value; it is sorted and written once, and all queries read it so. Queries travel:
at most about ``query_rows`` of them at a time are broadcast, and every task asks all of them of its blocks. A query
reads each list from its better end (the top for a positive weight, the bottom for a negative one), scores every
row it meets first in full, and stops once the bound, the weighted sum of the values at the read positions, is
below its kth score: no unread row can reach it. A bound that equals the kth score goes on, as an unread row
with a smaller id could tie. The kth score of the first block is every query's floor from the start, and a task carries
its kth score from block to block, so most blocks are left after few reads. A task returns at most the k best of each query, none of
them below the floor; these are then ranked together.

Component x counts as floor(1024 * x), x as double. Vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows without id; vectors meet only those of their own length. A query's own row is
every row with its id. Repeated query ids are asked once, with the smallest vector; repeated candidate rows each
count. A query without candidates gives no row. Scores beyond the signed 64-bit range are clipped to its ends. Other columns are not read,
whatever they are called. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, released, ship, table

SCALE = 1024.0
EXACT = 2.0**53
LONG = 2**63 - 1
NONE = float("-inf")
_OUT = "query_id long, vec_id long, score long"
_BLOCK = "dim int, ids binary, data binary, sorted binary"


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE> of whole numbers, dim) of the rows that take part."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite).withColumn("dim", F.size("v"))


def threshold_search(ids: np.ndarray, rows: np.ndarray, order: np.ndarray, own: int, q: np.ndarray, k: int, floor: float = NONE, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for q, best first. order: for each dimension the rows by falling value.

    Rows that score less than floor may be missing."""
    n = len(ids)
    dims = np.flatnonzero(q)
    weight = q[dims]
    down = order[::-1]

    def listed(lo: int, hi: int) -> np.ndarray:
        """The rows at these places of the lists; column j is dimension dims[j] from its better end."""
        return np.where(weight > 0, order[lo:hi, dims], down[lo:hi, dims]) if len(dims) else order[lo:hi, :1]

    seen = np.zeros(n, bool)
    best_id, best = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    depth = 0
    if not len(dims):  # every score is 0: the lists say nothing, the ids decide
        step = n
    elif n and (rows[listed(0, 1)[0], dims] * weight).sum() < floor:
        depth = n
    while depth < n:
        upto = min(n, depth + step)
        met = listed(depth, upto).ravel()
        new = np.unique(met[~seen[met]])
        seen[new] = True
        new = new[ids[new] != own]
        best = np.concatenate([best, rows[new] @ q])
        best_id = np.concatenate([best_id, ids[new]])
        top = np.lexsort((best_id, -best))[:k]
        best, best_id = best[top], best_id[top]
        if len(dims):
            bound = (rows[listed(upto - 1, upto)[0], dims] * weight).sum()
            if bound < floor or (len(best) == k and bound < best[-1]):
                break
        depth, step = upto, step * 2
    return best_id, best


class Block(NamedTuple):
    """Rows of one length. order: for each dimension their places by falling value; most: the largest size of a component."""

    ids: np.ndarray
    rows: np.ndarray
    order: np.ndarray
    most: float


def _block(dim: int, ids: bytes, data: bytes, order: bytes) -> Block:
    rows = np.frombuffer(data, float).reshape(-1, dim)
    return Block(np.frombuffer(ids, np.int64), rows, np.frombuffer(order, np.int32).reshape(-1, dim), float(np.abs(rows).max()))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, whole-number components) of the batch's vectors of each length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dim, at, np.floor(SCALE * flat.reshape(-1, dim))


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of (vec_id, v, dim), sorted: dim, ids, data, sorted. A task holds at most two blocks' rows and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dims: list[int]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for dim in dims:
                ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
                for lo in range(0, len(ids), block_rows):
                    part = data[lo : lo + block_rows]
                    order = np.argsort(-part, axis=0, kind="stable").astype(np.int32)
                    for column, x in zip(out, (dim, ids[lo : lo + block_rows].tobytes(), part.tobytes(), order.tobytes()), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["dim", "ids", "data", "sorted"])

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for dim, at, values in _vectors(batch):
                held.setdefault(dim, []).append((ids[at], values))
            sizes = {dim: sum(len(i) for i, _ in parts) for dim, parts in held.items()}
            full = list(sizes) if sum(sizes.values()) >= 2 * block_rows else [dim for dim, n in sizes.items() if n >= block_rows]
            if full:
                yield flush(full)
        if held:
            yield flush(list(held))

    return rows.select("vec_id", "v", "dim").mapInArrow(released(run), _BLOCK)


def _ask(block: Block, own: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """threshold_search, in whole numbers of any size where doubles are not exact."""
    ids, rows, order, most = block
    if np.abs(q).max() * most * len(q) >= EXACT:
        rows, q = np.array([[int(x) for x in r] for r in rows], object), np.array([int(x) for x in q], object)
    return threshold_search(ids, rows, order, own, q, k, floor)


def with_floor(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """asked (vec_id, v, dim) with its kth score in the first block, -Infinity where that has too few rows or another length."""
    least = blocks.agg(F.min("block")).first()[0]
    if least is None:
        return asked.withColumn("least", F.lit(NONE))
    dim, *parts = blocks.filter(F.col("block") == least).select("dim", "ids", "data", "sorted").first()
    shared = asked.sparkSession.sparkContext.broadcast((dim, [bytes(x) for x in parts]))  # one block: block_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, parts = shared.value
        block = _block(dim, *parts)
        for batch in batches:
            least, ids = np.full(batch.num_rows, NONE), batch.column("vec_id").to_numpy()
            for d, at, values in _vectors(batch):
                for i, q in zip(at.tolist(), values, strict=True) if d == dim else ():
                    score = _ask(block, ids[i], q, k, NONE)[1]
                    if len(score) == k and abs(score[-1]) < EXACT:
                        least[i] = float(score[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], [*batch.schema.names, "least"])

    return asked.select("vec_id", "v", "dim").mapInArrow(released(run), "vec_id long, v array<double>, dim int, least double")


def best_of_tasks(blocks: DataFrame, asked: pa.Table, k: int) -> tuple[DataFrame, object]:
    """query_id, vec_id, score: the k best rows of each task's blocks for each asked vector, without those below its floor; and the broadcast
    that holds the asked vectors."""
    by_dim: dict[int, list[tuple]] = {}
    for batch in asked.combine_chunks().to_batches():
        ids, least = batch.column("vec_id").to_numpy(), batch.column("least").to_numpy()
        for dim, at, values in _vectors(batch):
            by_dim.setdefault(dim, []).append((ids[at], values, least[at]))
    shared = blocks.sparkSession.sparkContext.broadcast({d: [np.concatenate(x) for x in zip(*parts, strict=True)] for d, parts in by_dim.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, *parts in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "data", "sorted")), strict=True):
                if dim not in queries:
                    continue
                block = _block(dim, *parts)
                for i, (own, q, floor) in enumerate(zip(*queries[dim], strict=True)):
                    old_id, old = best.get((dim, i), (np.zeros(0, np.int64), np.zeros(0)))
                    if len(old) == k:
                        floor = max(floor, old[-1])
                    found, score = _ask(block, own, q, k, floor)
                    keep = score >= floor
                    found, score = np.concatenate([old_id, found[keep]]), np.concatenate([old, score[keep]])
                    top = np.lexsort((found, -score))[:k]
                    best[dim, i] = found[top], score[top]
        out_q, out_i, out_s = [], [], []
        for (dim, i), (found, score) in best.items():
            out_q += [int(queries[dim][0][i])] * len(found)
            out_i += found.tolist()
            out_s += [max(-LONG - 1, min(LONG, int(s))) for s in score]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_q, out_i, out_s)], ["query_id", "vec_id", "score"])

    return blocks.select("dim", "ids", "data", "sorted").mapInArrow(released(run), _OUT), shared


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 2048, query_rows: int = 1 << 14) -> DataFrame:
    """query_id, rank, vec_id, score for every query: see the module's docstring. query_rows bounds, on average, what the driver holds and
    broadcasts at a time; each such part reads all blocks once."""
    spark = vectors.sparkSession
    ship(spark)
    rows, cores = usable(vectors).select("vec_id", "v", "dim"), spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small table in few files
        rows = rows.repartition(cores)
    blocks = materialize(packed(rows, block_rows).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = materialize(with_floor(asked, blocks, k), "asked")
    parts = max(1, -(-asked.count() // query_rows))
    found = None
    for part in range(parts):
        got = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
        best, shared = best_of_tasks(blocks, got, k)
        best = materialize(best, "best")
        shared.destroy()
        found = best if found is None else found.union(best)
    discard(blocks, asked)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_threshold_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every row whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * c.c[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.c) = len(c.c)
  WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
