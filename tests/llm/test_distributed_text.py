"""Operators 11 to 13 against brute force, on awkward tables; the searches of 4 and 9 by themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.llm import jaccard_join, periodic_runs, quality, substring_dedup, vector_codes

from .test_operators import AWKWARD, docs, sentence

VEC = "vec_id long, embedding array<float>, label int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def wide(df, id_col):
    """df with columns that clash with names the operators use."""
    return df.select("*", *[F.lit(7).alias(c) for c in ("h", "lo", "places", "row", "part", "code", "dim", "runs", "island", "text_key") if c != id_col])


# ---------------------------------------------------------------- 11 substring dedup


@pytest.mark.parametrize(("period", "cover"), substring_dedup.COVERS.items())
def test_covers_hold_every_difference(period, cover):
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def brute_repeats(rows, window):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("window", "turns"), [(50, 4), (12, 1), (3, 2), (1, 1)])
def test_repeats_equal_brute_force(spark, window, turns):
    rng = random.Random(window)
    passages = [sentence(rng, rng.choice([window - 1, window, window + 1, 2 * window + 7])) for _ in range(6)]
    rows = list(AWKWARD)
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, window)), rng.choice(passages), sentence(rng, rng.randint(0, 30)), rng.choice(passages) if i % 3 else ""]
        rows.append((100 + i, (" " if i % 2 else "\n\t").join(parts)))
    rows += [(300 + i, rows[20][1]) for i in range(30)]  # copies
    rows += [(5, rows[20][1]), (None, rows[20][1]), (90, sentence(rng, 3000) + " " + passages[0]), (91, passages[0].upper()), (-4, passages[3])]
    table = wide(docs(spark, rows), "doc_id")
    assert {r.doc_id for r in substring_dedup.repeated_windows(table, window, turns).collect()} == {r[0] for r in brute_repeats(rows, window) if r[2]}
    out = substring_dedup.without_repeats(table, window)
    assert rows_of(out) == brute_repeats(rows, window)


def test_anchors_are_a_fifth_of_the_words():
    import pyarrow as pa

    from pagetrail.llm.wordhash import chunks

    (w,) = chunks(pa.array([sentence(random.Random(5), 3120)]), lower=False)
    at, _, size = substring_dedup.anchor_places(w, 50)
    assert size == 20 and 0.18 < len(at) / 3120 < 0.20


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.without_repeats(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 12 vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        w = dim // parts
        cut = lambda v, w=w: [tuple(v[k * w : (k + 1) * w]) for k in range(parts)]
        books = [[cut(r[1])[k] for r in own[:entries]] for k in range(parts)]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
        for _ in range(rounds):
            for k in range(parts):
                at = defaultdict(list)
                for _, v, _ in own:
                    at[near(cut(v)[k], books[k])[1]].append(cut(v)[k])
                books[k] = [tuple(sum(c) // len(c) for c in zip(*at[i], strict=True)) if i in at else e for i, e in enumerate(books[k])]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, v, label in own:
            best = [near(x, book) for x, book in zip(cut(v), books, strict=True)]
            out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), sha))
    total = Counter()
    for _, label, _, error, _ in out:
        total[label] += error
    big = 2**63 - 1
    return sorted(((i, label, code, min(error, big), min(big, total[label]), sha) for i, label, code, error, sha in out), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "huge", "lengths"])
def test_codes_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    size = {"few": 5}.get(kind, 300)
    draw = {"ties": lambda: rng.choice([0.0, 0.25, -0.25]), "huge": lambda: rng.choice([1e18, -3e9, 2.0, 0.1])}.get(kind, lambda: rng.gauss(0, 1))
    rows = [(i, [draw() for _ in range(16 * (1 + (i % 3 if kind == "lengths" else 1)))], rng.choice([None, 1, 2])) for i in range(size)]
    rows += [(3, rows[0][1], 1), (None, rows[1][1], None), (900, None, 1), (901, [], 1), (902, [None] * 32, 1), (903, [float("nan")] * 32, 1), (904, [float("inf")] * 32, 1), (905, [1.0] * 17, 1)]
    rows += [(1000 + i, [0.5] * 32, 3) for i in range(100)]  # one very common vector
    got = vector_codes.vector_codes(wide(spark.createDataFrame(rows, VEC), "vec_id"), entries=12)
    assert rows_of(got) == brute_codes(rows, 16, 12, 2)


def test_whole_nodes_are_assigned_by_their_sums():
    rng = np.random.default_rng(7)
    points = (rng.normal(size=(4096, 4)) * 3 + rng.integers(0, 6, (4096, 1)) * 100).astype(np.int64)
    book = np.repeat(np.arange(6) * 100, 4).reshape(6, 4)
    got = vector_codes.dual_tree(points, book)
    want = ((points[:, None] - book) ** 2).sum(2).argmin(1)
    assert (got.codes() == want).all() and len(got.rows) < 200
    total, count = got.totals(points, 6)
    assert all((total[k] == points[want == k].sum(0)).all() and count[k] == (want == k).sum() for k in range(6))


def test_blocks_do_not_change_codes(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.normal(size=16).tolist(), 1) for i in range(500)], VEC)
    usable = vector_codes.usable(rows)
    books = vector_codes.start_books(usable, 16, 64)
    one, many = (vector_codes.lloyd_round(usable.repartition(n), books, block) for n, block in ((1, 4096), (7, 50)))
    assert all((a == b).all() for a, b in zip(one[16], many[16], strict=True))


def test_codes_of_an_empty_table(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VEC)).count() == 0


# ---------------------------------------------------------------- 13 periodic runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            block = w[i : i + q]
            if n >= max(6, 4 * q) and not any(q % p == 0 and block == block[:p] * (q // p) for p in range(1, q)):
                out.append((i, q, n))
            i = j + 1
    return sorted(out)


def brute_row(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[2], best[1], 1000 * best[2] // best[1] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(13)
    rows = list(AWKWARD)
    for i in range(250):
        parts = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.choice("ab") if i % 3 else rng.choice("abcdefghij") for _ in range(rng.randint(1, rng.choice([2, 5, 20, 60])))]
            parts.append(sentence(rng, rng.randint(0, 12)))
            parts.append(" ".join((block * 9)[: rng.randint(1, 7 * len(block) + 3)]))
        rows.append((100 + i, "  ".join(parts)))
    morse = [bin(i).count("1") % 2 for i in range(600)]
    rows += [(1000, "a " * 500), (1001, " ".join("ab"[m] for m in morse)), (1002, " ".join(["x y"] * 3 + ["x"])), (1003, sentence(rng, 2500) + " " + (sentence(rng, 333) + " ") * 5)]
    rows += [(5, "u v " * 9), (None, "n " * 20), (1004, "é 日 " * 6 + "é")]
    wide(docs(spark, rows), "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(periodic_runs.op13_scale_tiles(spark, str(tmp_path)))
    want = sorted((brute_row(i, t) for i, t in rows), key=lambda r: tuple((x is not None, x) for x in r))
    assert got == want and sum(r[1] for r in want) > 300


def test_fragments_of_long_runs_are_stitched(spark):
    text = " ".join(sentence(random.Random(3), 700).split() * 12)
    tiles = periodic_runs.tiled(docs(spark, [(1, text)]).select("doc_id", F.lit(0).cast("long").alias("text_key"), "text"), None, 4)
    assert tiles.select(F.size("parts")).first()[0] > 4
    (row,) = periodic_runs.periodic_runs(docs(spark, [(1, text)])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 700, 8400)] and row.collapsed == " ".join(text.split()[:700])


def test_one_word_many_times_stays_linear(spark):
    (row,) = periodic_runs.periodic_runs(docs(spark, [(1, "w " * 120_000)])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 1, 120_000)] and row.collapsed == "w"


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 4 and 9


def test_divide_skip_reads_lists_of_an_index_made_before_the_query():
    rng = np.random.default_rng(4)
    common = np.arange(1000, 1060, dtype=np.uint64)  # in every set: long lists
    bases = [rng.integers(0, 900, 60).astype(np.uint64) for _ in range(10)]
    sets = [np.unique(np.concatenate([common, np.where(rng.random(60) < 0.05, rng.integers(2000, 9000, 60).astype(np.uint64), bases[k % 10])])) for k in range(200)]
    index = jaccard_join.Postings(sets)
    for i in (3, 50, 120):
        query = np.unique(np.concatenate([sets[i][:-4], rng.integers(0, 900, 3).astype(np.uint64)]))
        need = [jaccard_join.least_overlap(len(query), len(s), 75) for s in sets]
        before = index.merged, index.probed
        assert jaccard_join.divide_skip(query, index, need) == [k for k, s in enumerate(sets) if len(np.intersect1d(query, s)) >= need[k]]
        merged, probed = index.merged - before[0], index.probed - before[1]
        everything = sum(len(np.intersect1d(query, s)) for s in sets)
        assert 0 < merged < everything / 2 and 0 < probed < everything
    # what the lists do not hold is not found: they, and nothing beside them, decide
    index.owner = np.where(index.owner == 3, 4, index.owner)
    assert 3 not in jaccard_join.divide_skip(sets[3], index, [10] * 200)


def test_margins_equal_a_dense_slow_model(spark):
    rng = random.Random(9)
    good, bad = [f"fine{i}" for i in range(12)], [f"junk{i}!" for i in range(12)]
    rows = [(i, " ".join(rng.choice(good if (i % 2) ^ (rng.random() < 0.2) else bad) for _ in range(rng.randint(3, 9))), i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    ratios = quality.log_count_ratios(frame)
    features = quality.Features()
    places = [np.sort(features(np.frombuffer(t.encode(), np.uint8))) for _, t, _ in rows]
    counts = np.ones((2, 1 << quality.BITS))
    for p, (_, _, y) in zip(places, rows, strict=True):
        counts[y, p] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(ratios, want)
    used = np.unique(np.concatenate(places))
    dense = np.zeros((len(rows), len(used)))
    for i, p in enumerate(places):
        dense[i, np.searchsorted(used, p)] = want[p]
    dense = np.hstack([dense / np.linalg.norm(dense, axis=1, keepdims=True), np.ones((len(rows), 1))])  # the bias is a feature that is 1
    y = np.array([r[2] for r in rows]) * 2.0 - 1
    # the same problem by projected gradient steps on the whole dual: hinge loss, both classes of one weight
    gram = (dense * y[:, None]) @ (dense * y[:, None]).T
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, 1.0)
    margins = dense @ ((alpha * y) @ dense)
    w, b = quality.dual_coordinate_descent([(p, quality.scaled(ratios, p)) for p in places], y, 1 << quality.BITS, epochs=2000, tol=1e-7)
    got = np.array([float(w[p] @ quality.scaled(ratios, p)) + b for p in places])
    assert np.abs(got - margins).max() < 0.01 and ((got > 0) == (y > 0)).mean() > 0.9
