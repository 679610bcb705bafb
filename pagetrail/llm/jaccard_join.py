"""N-gram Jaccard join by T-occurrence search, down to connected components.

A document's set holds its distinct five-word shingles (a shorter text is one shingle). Documents with equal sets form a
class; classes are linked when 100 * intersection >= percent * union.

1. One pass gives every document its class key and finds shingles that are frequent in some task.
2. Shingles are put in one global order, frequent ones last. Two linked sets share a shingle among the first
   n - ceil(percent * n / 100) + 1 of either; these go, packed, to their shingle's bucket, where lists of a single class
   vanish at once. Lengths, places in the order and the number of shared prefix shingles rule out most other pairs.
3. A first round links the members of each list to its hub, which joins most copies. The second round takes
   every pair of a list whose classes are not yet in one component, so no link between components is missed, and the
   many pairs inside a large group are never made.
4. Candidates are verified by T-occurrence search: a block of at most 256 candidate sets becomes inverted lists; those of
   the query's shingles are split as in DivideSkip; the short lists are merged with a heap, and what
   can reach its overlap is looked up in the long ones by binary search. Nothing else counts the overlaps; shingles are compared there by 48 bits.

Texts without words have no shingles, link with nothing and are components of their own. Null ids count last: a
component's id is the smallest id that is not null. Rows that repeat an id give a row each. Ties do not arise: sets of equal members are one
class. Whole texts are read, however long; no rows give no rows; columns other than id and text are not read. Sets, shingles and
classes are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, released, table, text_key, texts
from .graph import bloom, bloom_has, bloom_slot, bloom_width, components
from .wordhash import chunks, set_key, shingle_sets

PERCENT = 75
WORDS = 5
HOT = 1 << 20
BLOCK = 256
FLUSH = 1 << 20
BUCKET = 1 << 20
_POSTING = np.dtype([("rest", "<u4"), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest intersection of linked sets with n and m members."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, key, n of every document; rows with hot: a shingle (key) that n classes of a task's documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def rows(ids, texts, keys, sizes, hot):
            return pa.RecordBatch.from_arrays([ids, texts, pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array([hot] * len(keys), pa.bool_())], ["doc_id", "text_key", "key", "n", "hot"])

        def frequent():
            s, c = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            many = c > 1
            return rows(*[pa.nulls(int(many.sum()), pa.int64())] * 2, s[many].astype(np.int64), c[many], True)

        for batch in batches:
            for w in chunks(batch.column("text")):
                keys, sizes = [], []
                for s in shingle_sets(w, words):
                    keys.append(set_key(s))
                    sizes.append(len(s))
                    if len(s) and keys[-1] not in sets:
                        sets[keys[-1]] = s
                        held += len(s)
                yield rows(*(batch.column(c).slice(w.lo, w.hi - w.lo) for c in ("doc_id", "text_key")), keys, sizes, False)
                if held > 2 * FLUSH:
                    yield frequent()
                    sets, held = {}, 0
        if sets:
            yield frequent()

    return docs.mapInArrow(released(run), "doc_id long, text_key long, key long, n long, hot boolean")


def ordered_prefix(s: np.ndarray, hot: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The first members of the set in the global order: rare ones by hash, then frequent ones by count."""
    p = prefix(len(s), percent)
    if not len(hot):
        return s[:p]
    at = np.searchsorted(hot, s)
    at[at == len(hot)] = 0
    rank = np.where(hot[at] == s, count[at], 0)
    return s[np.argsort(rank, kind="stable")[:p]] if rank.any() else s[:p]


def postings(docs: DataFrame, model, words: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, packed BINARY): prefix shingles of every class that a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = model.value
        pack = zstandard.ZstdCompressor(1)
        done: set[int] = set()
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            s = np.concatenate([p[0] for p in parts])
            size = [len(p[0]) for p in parts]
            t = np.zeros(len(s), _POSTING)
            t["rest"] = s & np.uint64(0xFFFFFFFF)
            t["key"] = np.repeat(np.array([p[1] for p in parts], np.int64), size)
            t["n"] = np.repeat(np.array([p[2] for p in parts], np.uint32), size)
            t["pos"] = np.concatenate([np.arange(k, dtype=np.uint32) for k in size])
            bucket = ((s >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            t, bucket = t[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(edge[1:] > edge[:-1])
            blobs = [pack.compress(b"".join(t[c][edge[b] : edge[b + 1]].tobytes() for c in _POSTING.names)) for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for w in chunks(batch.column("text")):
                for s in shingle_sets(w, words):
                    key = set_key(s)
                    if not len(s) or key in done:
                        continue
                    done.add(key)
                    parts.append((ordered_prefix(s, hot, count, percent), key, len(s)))
                    held += len(parts[-1][0])
                if held > FLUSH // 2:
                    yield flush()
                    parts, held, done = [], 0, done if len(done) < FLUSH else set()
        if parts:
            yield flush()

    return docs.select("text").mapInArrow(released(run), "bucket int, packed binary")


def _shared_lists(percent: int):
    """Postings of the shingles that several classes hold; pairs that cannot link are left out where they stand alone."""

    def run(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        cols: dict[str, list] = {c: [] for c in _POSTING.names}
        for blob in map(unpack.decompress, group.column("packed").to_pylist()):
            n, at = len(blob) // _POSTING.itemsize, 0
            for c in _POSTING.names:
                cols[c].append(np.frombuffer(blob, _POSTING[c], n, at))
                at += n * _POSTING[c].itemsize
        rest, key, n, pos = (np.concatenate(cols[c]) for c in _POSTING.names)
        order = np.lexsort((key, rest))
        rest, key, n, pos = rest[order], key[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        new = np.append([True], (rest[1:] != rest[:-1]) | (key[1:] != key[:-1]))  # copies met in several tasks
        rest, key, n, pos = rest[new], key[new], n[new], pos[new]
        # a member without another of a length it may link with goes, and with it lists of one
        order = np.lexsort((n, rest))
        rest, key, n, pos = rest[order], key[order], n[order], pos[order]
        close = (rest[1:] == rest[:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep = np.append([False], close) | np.append(close, [False])
        start = np.flatnonzero(np.append([True], rest[keep][1:] != rest[keep][:-1])) if keep.any() else np.zeros(0, np.int64)
        size = np.diff(np.append(start, keep.sum()))
        sh = (np.int64(group.column("bucket")[0].as_py()) << 32) | rest[keep].astype(np.int64)
        return pa.table({"sh": sh, "key": key[keep], "n": n[keep], "pos": pos[keep], "size": np.repeat(size, size)})

    return run


def _need(n: str, m: str, percent: int) -> Column:
    """T: the intersection that sets of n and m members need."""
    return F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")


def _counted(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n, m) whose prefixes share enough shingles, as (a, b).

    Sets that share T shingles share at least l among the first n - T + l of one and m - T + l of the other; l is the
    largest number for which both prefixes reach so far."""
    own = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "key")
    held = materialize(lists.join(own, "key").groupBy("key").agg(F.collect_list(F.struct("pos", "sh")).alias("h")), "held")
    rows = pairs.join(held.select(F.col("key").alias("a"), F.col("h").alias("ha")), "a").join(held.select(F.col("key").alias("b"), F.col("h").alias("hb")), "b")
    need = _need("n", "m", percent)
    room = [F.expr(f"{v} - ({percent} * {v} + 99) div 100 + 1") - (F.col(v) - need) for v in ("n", "m")]
    rows = rows.withColumn("l", F.greatest(F.lit(1), F.least(*room))).withColumn("t", need)
    first = lambda h, n: F.transform(F.filter(h, lambda e: e["pos"] < F.col(n) - F.col("t") + F.col("l")), lambda e: e["sh"])
    return rows.filter(F.size(F.array_intersect(first("ha", "n"), first("hb", "m"))) >= F.col("l")).select("a", "b")


class Postings:
    """Inverted lists of a block of sets: for each member the indices of the sets that hold it, in rising order. They are made of
    the sets alone, before any query is known."""

    def __init__(self, sets: list[np.ndarray]):
        token = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(token, kind="stable")
        token, self.owner = token[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        first = np.flatnonzero(np.append([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        self.token, self.edge = token[first], np.append(first, len(token))
        self.merged = self.probed = 0

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The lists of the query's members, longest first."""
        at = np.searchsorted(self.token, query)
        held = at < len(self.token)
        at = at[held][self.token[at[held]] == query[held]]
        return sorted((self.owner[self.edge[i] : self.edge[i + 1]].tolist() for i in at), key=len, reverse=True)


def divide_skip(query: np.ndarray, sets: list[np.ndarray] | Postings, need: list[int]) -> list[int]:
    """Indices of the sets that share at least need[i] members with the query. All sets are sorted and distinct.

    The longest of the query's inverted lists are set aside; the others are merged with a heap, which brings every set up with its count of
    short lists, and those that can still reach their overlap are looked up in the long ones by binary search. No other count is made.
    mu = 0.01 balances the cost of a heap step against that of a binary search.
    """
    index = sets if isinstance(sets, Postings) else Postings(sets)
    lists = index.lists(query)
    t = min(need)
    if len(lists) < t:
        return []
    n_long = min(t - 1, int(t / (0.01 * math.log2(len(lists[0])) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    out = []
    for i, met in groupby(heapq.merge(*short)):
        count = sum(1 for _ in met)
        index.merged += count
        if count < need[i] - n_long:
            continue
        for row in long:
            at = bisect_left(row, i)
            index.probed += 1
            count += at < len(row) and row[at] == i
        if count >= need[i]:
            out.append(i)
    return out


def packed_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of each member, six bytes each: two sets of n and m meet by accident with n * m / 2**48."""
    return np.ascontiguousarray((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked_set(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _search(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple = (None, None)
        query = None
        keys: list[int] = []
        sets: list[np.ndarray] = []

        def found() -> pa.RecordBatch:
            hits = divide_skip(query, sets, [least_overlap(len(query), len(s), percent) for s in sets]) if query is not None and sets else []
            return pa.RecordBatch.from_arrays([pa.array([block[0]] * len(hits), pa.int64()), pa.array([keys[i] for i in hits], pa.int64())], ["u", "v"])

        for batch in batches:
            for q, salt, role, key, blob in zip(*(batch.column(c).to_pylist() for c in ("q", "salt", "role", "key", "members")), strict=True):
                if (q, salt) != block:
                    yield found()
                    block, query, keys, sets = (q, salt), None, [], []
                s = unpacked_set(blob)
                if role == 0:
                    query = s
                else:
                    keys.append(key)
                    sets.append(s)
        yield found()

    return run


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v) of the candidate pairs (a, b) whose sets link, by T-occurrence search in blocks of a query and BLOCK sets."""
    spark = docs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(many, "a").select(F.col("a").alias("q"), F.col("b").alias("key"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("salt"))
    asked = materialize(dealt.select("q", "salt", "key", F.lit(1).alias("role")).union(dealt.select("q", "salt", F.col("q").alias("key"), F.lit(0).alias("role")).distinct()), "asked")
    reps = asked.select("key").distinct().join(classes, "key").select("first")
    width = bloom_width(asked.count())  # at least as many as the representatives, which would have to be joined twice to be counted
    bits = spark.sparkContext.broadcast(bloom(reps, "first", width))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom_has(bits.value, batch.column("slot").to_numpy())))
            for w in chunks(batch.column("text")):
                got = [(set_key(s), packed_set(s)) for s in shingle_sets(w, words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], ["key", "members"])

    sets = docs.select("text", bloom_slot(F.col("doc_id"), width).alias("slot")).mapInArrow(released(members), "key long, members binary")
    rows = asked.join(sets, "key").select("q", "salt", "role", "key", "members")
    rows = rows.repartition("q", "salt").sortWithinPartitions("q", "salt", "role")
    out = materialize(rows.mapInArrow(released(_search(percent)), "u long, v long"), "links")
    discard(asked)
    return out


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member of a list with the list's hub, where two lists or more give that pair.

    The hub is the member whose lists are largest in all: among edited copies that is the text they come from, as each
    edit puts shingles of its own, which nobody shares, in front of a copy's order."""
    weight = lists.groupBy("key").agg(F.sum("size").alias("weight"))
    rows = materialize(lists.join(weight, "key").select("sh", F.struct("weight", "key", "n", "pos").alias("m")), "weighted")
    hub = rows.groupBy("sh").agg(F.max("m").alias("x"))
    near = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (F.col("x.key") != F.col("y.key"))
    pairs = rows.withColumnRenamed("m", "y").join(hub, "sh").filter(near).groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    out = pairs.agg(F.count(F.lit(1)).alias("k"), F.max(F.least("x.n", "y.n")).alias("n")).filter((F.col("k") >= 2) | (F.col("n") < 20))
    out = materialize(out.select("a", "b"), "star")
    discard(rows)
    return out


def candidates_across(lists: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a list that may link and whose classes lie in different components; a has the larger set.

    Members of a list's largest component are paired with the others only, and in every pair the shingle stands among
    the first ones of the smaller set.
    """
    own = lists.join(comp, "key", "left").select("sh", "key", "n", "pos", F.coalesce("comp", "key").alias("c"))
    per = own.groupBy("sh", "c").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("sh").agg(F.max(F.struct("k", "c")).getField("c").alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").drop("comps")
    mixed = materialize(own.join(main, "sh").select("sh", F.struct("key", "n", "pos", "c").alias("m"), (F.col("c") == F.col("main")).alias("in_main")), "mixed")
    m = F.col("m")
    # T is smallest, and so the places that count are most, for a partner of the same size
    first = m["pos"] <= m["n"] - _need("m.n", "m.n", percent)
    large, small = mixed.select("sh", m.alias("x"), "in_main"), mixed.filter(first).select("sh", m.alias("y"), F.col("in_main").alias("y_main"))
    need = _need("x.n", "y.n", percent)
    bigger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.key") > F.col("y.key")))
    ok = bigger & (F.col("x.c") != F.col("y.c")) & (100 * F.col("y.n") >= percent * F.col("x.n")) & (F.col("x.pos") <= F.col("x.n") - need) & (F.col("y.pos") <= F.col("y.n") - need)
    out = None
    for left, right in ((large.filter("NOT in_main"), small), (large.filter("in_main"), small.filter("NOT y_main"))):
        pairs = left.join(right, "sh").filter(ok).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))
        out = pairs if out is None else out.union(pairs)
    out = materialize(out.distinct(), "tight")
    discard(mixed)
    return _counted(out, lists, percent)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (see common) of every document: see the module's docstring."""
    spark = docs.sparkSession
    docs = texts(docs)
    docs = docs.withColumn("text_key", text_key(F.col("text")))
    found = materialize(profiles(docs, words), "profiles")
    rows = found.filter("NOT hot").select("doc_id", "text_key", "key", "n")
    classes = materialize(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum(F.expr(f"n - ({percent} * n + 99) div 100 + 1")), F.lit(0))).first()[0]
    hot = found.filter("hot").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HOT).toArrow()
    shingle = hot.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(shingle)
    model = spark.sparkContext.broadcast((shingle[order], hot.column("n").to_numpy()[order]))
    packed = postings(docs, model, words, percent, max(4 * partitions(spark), total // BUCKET))
    lists = materialize(packed.groupBy("bucket").applyInArrow(_shared_lists(percent), "sh long, key long, n long, pos long, size long"), "lists")

    star = star_pairs(lists, percent)
    links = verified(star, docs, classes, words, percent)
    comp = materialize(components(links), "components")

    across = candidates_across(lists, comp, percent)
    tried = star.select("a", "b").union(star.select("b", "a"))
    across = materialize(across.join(tried, ["a", "b"], "left_anti"), "across")
    discard(lists, star)
    more = verified(across, docs, classes, words, percent)
    comp = materialize(components(comp.select(F.col("key").alias("u"), F.col("comp").alias("v")).union(more)), "components")

    least = comp.select("key", "comp").union(comp.select("comp", "comp").distinct()).join(classes, "key").groupBy("comp").agg(F.min("first").alias("least"))
    named = comp.join(least, "comp").select("key", "least").union(least.select("comp", "least"))
    label = materialize(classes.join(named, "key", "left").select("key", F.coalesce("least", "first").alias("component_id")), "labels")
    full = rows.filter("n > 0").join(label, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key")
    return full.union(rows.filter("n = 0").select("doc_id", "n", "doc_id", "text_key"))


def op4_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 75 per cent of five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
