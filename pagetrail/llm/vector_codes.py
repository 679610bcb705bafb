"""Product-quantised vectors by dual-tree Lloyd rounds.

Vectors become whole numbers floor(256 * x), x as double, and are cut into ``parts`` equal consecutive parts. Each part position has a codebook
that starts as that part of the ``entries`` vectors with the smallest ids. A round assigns every part to its nearest entry (squared
distance, ties to the lower index), then replaces each entry by floor(sum / count) of its parts; entries without parts stay.

A task takes its rows in blocks. For each part position it builds a tree of boxes over the block's parts, each node with the sum
and number of its parts, and one over the entries. A pair of nodes has a least and a greatest distance: an entry node farther from a data node
than another is at most holds the nearest entry of none of its parts and goes. A node left with one entry takes it whole, by its cached sum; leaves left
with several compare their parts with those in whole numbers. Nothing is ever decided by a rounded number, so the codes are exact and do not depend on blocks
or tasks. Only the sums of each codebook's entries are collected, a row for each component of each entry.

Rows whose vector is null or holds a null or non-finite component go, and so do vectors whose length is not a positive multiple of
``parts``, as they have no equal parts. Vectors of each length have codebooks of their own. Rows that repeat an id are all coded; among them the smaller
vector counts first for the start. Rows without id are coded and start a codebook only where too few have ids. Fewer rows than ``entries`` start fewer
entries. Components beyond 2**80 either way count as that, and errors beyond a signed 64-bit number as its largest. Only the id, the vector and the label are
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, ship, table

SCALE = 256.0
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK_ROWS = 4096
LEAF = 16
LABELS_BROADCAST = 100_000
LONG = 2**63 - 1
_HEX = np.array([f"{i:02x}".encode() for i in range(256)])


def usable(vectors: DataFrame, parts: int = PARTS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v ARRAY<DOUBLE>, dim of the rows that are coded."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)).filter(finite).withColumn("dim", F.size("v"))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as 64-bit numbers, or as Python's own where those could overflow in a squared distance."""
    x = np.floor(SCALE * values)
    if not x.size or x.shape[-1] * (2 * np.abs(x).max() + 1) ** 2 < 2.0**52:
        return x.astype(np.int64)
    return np.array([[max(-(2**80), min(2**80, int(c))) for c in row] for row in x], object)


class Tree(NamedTuple):
    """Node k of level l holds the rows order[edges[l][k]:edges[l][k + 1]], its children are 2k and 2k + 1; lo and hi are the sides of its box."""

    order: np.ndarray
    edges: list[np.ndarray]
    lo: list[np.ndarray]
    hi: list[np.ndarray]
    sums: list[np.ndarray]


def tree(points: np.ndarray, leaf: int) -> Tree:
    """Halves of equal size along the widest side, until a node has at most twice ``leaf`` rows."""
    n = len(points)
    levels = max(0, (n // leaf).bit_length() - 1)
    edges = [(n * np.arange((1 << k) + 1)) >> k for k in range(levels + 1)]
    order = np.arange(n)
    for edge in edges[:-1]:
        p = points[order]
        axis = (np.maximum.reduceat(p, edge[:-1]) - np.minimum.reduceat(p, edge[:-1])).argmax(1)
        node = np.repeat(np.arange(len(axis)), np.diff(edge))
        key = p[np.arange(n), axis[node]]
        order = order[np.lexsort((key if key.dtype != object else np.unique(key, return_inverse=True)[1], node))]
    p = points[order]
    lo, hi, sums = ([f.reduceat(p, edges[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
    for _ in range(levels):
        for f, x in ((np.minimum, lo), (np.maximum, hi), (np.add, sums)):
            x.insert(0, f(x[0][::2], x[0][1::2]))
    return Tree(order, edges, lo, hi, sums)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first:last one after another, and which range each is of."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which], which


class Assigned(NamedTuple):
    """Where the parts of a block went: whole nodes (level, nodes, entries), and single rows with their entries."""

    tree: Tree
    nodes: list[tuple[int, np.ndarray, np.ndarray]]
    rows: np.ndarray
    entries: np.ndarray

    def codes(self) -> np.ndarray:
        out = np.zeros(len(self.tree.order), np.int64)
        out[self.rows] = self.entries
        for level, nodes, entries in self.nodes:
            at, which = _spread(self.tree.edges[level][nodes], self.tree.edges[level][nodes + 1])
            out[self.tree.order[at]] = entries[which]
        return out

    def totals(self, points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the parts of each entry."""
        total, count = np.zeros((size, points.shape[1]), points.dtype), np.zeros(size, np.int64)
        np.add.at(total, self.entries, points[self.rows])
        np.add.at(count, self.entries, 1)
        for level, nodes, entries in self.nodes:
            np.add.at(total, entries, self.tree.sums[level][nodes])
            np.add.at(count, entries, np.diff(self.tree.edges[level])[nodes])
        return total, count


def dual_tree(points: np.ndarray, entries: np.ndarray, leaf: int = LEAF) -> Assigned:
    """The nearest entry of every point, ties to the lower index; points and entries in whole numbers."""
    at: dict[tuple, int] = {}
    for i, x in enumerate(map(tuple, entries.tolist())):
        at.setdefault(x, i)
    first = np.array(list(at.values()), np.int64)  # an entry that repeats an earlier one is nearest to nothing
    lines = entries[first]
    data, book = tree(points, leaf), tree(lines, 1)
    # below the entries' leaves, which hold one or two, stand the entries themselves
    kids = [2 * np.arange(len(x) + 1) for x in book.lo[:-1]]
    kids.append(book.edges[-1])
    book.edges.append(np.arange(len(lines) + 1))
    book.lo.append(lines[book.order])
    book.hi.append(lines[book.order])
    last_d, last_e = len(data.lo) - 1, len(book.lo) - 1
    d, e, level_d, level_e = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    nodes: list[tuple[int, np.ndarray, np.ndarray]] = []
    while True:
        d_lo, d_hi, e_lo, e_hi = data.lo[level_d][d], data.hi[level_d][d], book.lo[level_e][e], book.hi[level_e][e]
        gap, reach = np.maximum(np.maximum(e_lo - d_hi, d_lo - e_hi), 0), np.maximum(e_hi - d_lo, d_hi - e_lo)
        near, far = (gap * gap).sum(1), (reach * reach).sum(1)
        new = np.ones(len(d), bool)
        new[1:] = d[1:] != d[:-1]
        keep = near <= np.minimum.reduceat(far, np.flatnonzero(new))[np.cumsum(new) - 1]
        d, e = d[keep], e[keep]
        alone = np.ones(len(d), bool)
        alone[1:] &= d[1:] != d[:-1]
        alone[:-1] &= d[1:] != d[:-1]
        alone &= level_e == last_e
        nodes.append((level_d, d[alone], first[book.order[e[alone]]] if level_e == last_e else e[alone]))
        d, e = d[~alone], e[~alone]
        down_d, down_e = level_d < last_d, level_e < last_e
        if not len(d) or not (down_d or down_e):
            break
        if down_e:
            e, which = _spread(kids[level_e][e], kids[level_e][e + 1])
            d = d[which]
        if down_d:
            d, e = np.concatenate([2 * d, 2 * d + 1]), np.concatenate([e, e])
        by = np.argsort(d, kind="stable")
        d, e, level_d, level_e = d[by], e[by], level_d + down_d, level_e + down_e
    # uncertain leaves: every row with every entry left, in whole numbers
    row, which = _spread(data.edges[-1][d], data.edges[-1][d + 1])
    row, entry = data.order[row], book.order[e[which]]
    off = points[row] - lines[entry]
    key = (off * off).sum(1) * len(lines) + entry
    by = np.lexsort((key if key.dtype != object else np.unique(key, return_inverse=True)[1], row))
    row, entry = row[by], entry[by]
    best = np.ones(len(row), bool)
    best[1:] = row[1:] != row[:-1]
    return Assigned(data, nodes, row[best], first[entry[best]])


def _alike(*arrays: np.ndarray) -> list[np.ndarray]:
    """All as 64-bit numbers, or all as Python's own where one of them is."""
    return [a.astype(object) for a in arrays] if any(a.dtype == object for a in arrays) else list(arrays)


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """dim, rows and whole numbers of up to block_rows rows of one length."""

    def block(dim: int, held: list[pa.Table]) -> tuple[int, pa.Table, np.ndarray]:
        t = pa.concat_tables(held)
        return dim, t, whole(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))

    held: dict[int, list[pa.Table]] = {}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            held.setdefault(dim, []).append(rows.filter(pa.array(dims == dim)))
            if sum(map(len, held[dim])) >= block_rows:
                yield block(dim, held.pop(dim))
        if sum(len(t) for ts in held.values() for t in ts) >= 4 * block_rows:
            for dim in list(held):
                yield block(dim, held.pop(dim))
    for dim in list(held):
        yield block(dim, held.pop(dim))


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, k * width : (k + 1) * width] for k in range(parts)]


def start_books(rows: DataFrame, parts: int, entries: int) -> dict[int, list[np.ndarray]]:
    """For each length the codebooks of the vectors with the smallest ids: at most ``entries`` rows a length reach the driver."""
    books = {}
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        first = rows.filter(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        books[dim] = _parts(whole(np.array([r.v for r in first], np.float64)), parts)
    return books


def lloyd_round(rows: DataFrame, books: dict[int, list[np.ndarray]], block_rows: int = BLOCK_ROWS) -> dict[int, list[np.ndarray]]:
    """The codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, x in _blocks(batches, block_rows):
            for part, (own, book) in enumerate(zip(_parts(x, len(shared.value[dim])), shared.value[dim], strict=True)):
                own, book = _alike(own, book)
                total, count = dual_tree(own, book).totals(own, len(book))
                used = np.flatnonzero(count)
                n, width = len(used), own.shape[1]
                sums = pa.array([Decimal(int(s)) for s in total[used].ravel()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * width, dim)), pa.array(np.full(n * width, part)), pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), n)), sums, pa.array(np.repeat(count[used], width))],
                    ["dim", "part", "entry", "at", "total", "n"],
                )

    sums = rows.select("dim", "v").mapInArrow(released(totals), "dim long, part long, entry long, at long, total decimal(38,0), n long")
    out = {dim: [b.astype(object) for b in parts] for dim, parts in books.items()}
    for r in sums.groupBy("dim", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.dim][r.part][r.entry, r.at] = int(r.total) // r.n
    shared.destroy()
    fits = lambda b: b.size == 0 or b.shape[1] * (2 * int(np.abs(b).max()) + 1) ** 2 < 2**52
    return {dim: [b.astype(np.int64) if fits(b) else b for b in parts] for dim, parts in out.items()}


def books_sha256(books: list[np.ndarray]) -> str:
    """Hash of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def coded(rows: DataFrame, books: dict[int, list[np.ndarray]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row."""
    shared = rows.sparkSession.sparkContext.broadcast((books, {dim: books_sha256(b) for dim, b in books.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, names = shared.value
        for dim, t, x in _blocks(batches, block_rows):
            code, error = np.zeros((len(x), len(books[dim])), np.int64), np.zeros(len(x), object)
            for part, (own, book) in enumerate(zip(_parts(x, len(books[dim])), books[dim], strict=True)):
                own, book = _alike(own, book)
                code[:, part] = dual_tree(own, book).codes()
                off = own - book[code[:, part]]
                error += (off * off).sum(1)
            text = np.ascontiguousarray(_HEX[code]).view(f"S{2 * code.shape[1]}").ravel().astype(str)
            t = t.select(["vec_id", "label"]).combine_chunks()
            columns = [*(c.combine_chunks() for c in t.columns), pa.array(text), pa.array([min(LONG, int(v)) for v in error], pa.int64()), pa.array([names[dim]] * len(x))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    return rows.select("vec_id", "label", "v", "dim").mapInArrow(released(run), kind)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: see the module's docstring."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    ship(vectors.sparkSession)
    rows = usable(vectors, parts)
    books = start_books(rows, parts, entries)
    for _ in range(rounds):
        books = lloyd_round(rows, books)
    out = materialize(coded(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = materialize(out.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "labels")
    few = labels.count() <= LABELS_BROADCAST
    joined = out.join(F.broadcast(labels) if few else labels, out["label"].eqNullSafe(labels["of"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assign_sql(k: int) -> str:
    """SQL: the nearest entries by codebook b{k}, and the next codebook."""
    dist = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    return f"""
d{k} AS MATERIALIZED (SELECT rid, w, part, x, entry, CAST({dist} AS BIGINT) AS dist FROM p JOIN b{k} USING (w, part)),
a{k} AS MATERIALIZED (SELECT rid, w, part, any_value(x) AS x, arg_min(entry, dist * 256 + entry) AS entry, min(dist) AS dist FROM d{k} GROUP BY rid, w, part),
u{k} AS (SELECT w, part, entry, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM a{k}),
m{k} AS (SELECT w, part, entry, i, sum(c) AS s, count(*) AS n FROM u{k} GROUP BY w, part, entry, i),
n{k} AS (SELECT w, part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM m{k} GROUP BY w, part, entry),
b{k + 1} AS MATERIALIZED (SELECT w, part, entry, coalesce(z, y) AS y FROM b{k} LEFT JOIN n{k} USING (w, part, entry)),"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT *, unnest(range({PARTS})) AS part FROM v),
p AS MATERIALIZED (SELECT rid, w, part, c[part * w + 1 : (part + 1) * w] AS x FROM q),
f AS (SELECT rid, row_number() OVER (PARTITION BY w ORDER BY vec_id NULLS LAST, c) - 1 AS entry FROM v),
b0 AS MATERIALIZED (SELECT w, part, entry, x AS y FROM p JOIN f USING (rid) WHERE entry < {ENTRIES}),{"".join(map(_assign_sql, range(ROUNDS + 1)))}
s AS (SELECT w, sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS} GROUP BY w),
r AS (SELECT rid, any_value(w) AS w, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (rid) JOIN s ON s.w = r.w"""
