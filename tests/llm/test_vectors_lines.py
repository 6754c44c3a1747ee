"""Hard negatives, frequent lines and centroids against brute force on small fixtures."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import hard_negatives, line_runs, ptolemy_kmeans
from seriesloom.llm.common import fresh_path

VECTORS = "vec_id long, embedding array<float>, label int, row string, v string, block string"
DOCS = "doc_id long, text string, hash string, n string, place string"


def vectors(spark, n, dims=64, seed=3, common=0):
    """Rows with repeated vectors (ties), nulls in every column, wrong lengths, and columns named like the operators' own."""
    rng = random.Random(seed)
    base = [[float(np.float32(rng.uniform(-0.5, 0.5))) for _ in range(dims)] for _ in range(max(n // 3, 1))]
    rows = [(i, rng.choice(base) if i >= common else base[0], rng.randrange(4), "r", "v", "b") for i in range(n)]
    odd = [(None, base[0], 1, None, None, None), (100 * n, None, 1, "r", "v", "b"), (100 * n + 1, base[0][:-1] + [None], 1, "r", "v", "b"),
           (100 * n + 2, base[0][:-1] + [float("nan")], 2, "r", "v", "b"), (100 * n + 3, base[0][:-1] + [float("inf")], 2, "r", "v", "b"),
           (100 * n + 4, base[0], None, "r", "v", "b"), (100 * n + 5, base[0][:5], 3, "r", "v", "b"), (100 * n + 6, [], 3, "r", "v", "b")]
    return spark.createDataFrame(rows + odd, VECTORS).repartition(3)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, n_pos, n_neg, low=30, high=90):
    rows = [(r.vec_id, r.label, [math.floor(256 * x) for x in r.embedding]) for r in rows
            if r.vec_id is not None and r.label is not None and finite(r.embedding)]
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for j, (b, other, w) in enumerate(rows) if j != k)
        for ps, p, _ in [s for s in scored if s[2] == label][:n_pos]:
            fits = [(s, b) for s, b, other in scored if other != label and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, rank + 1, b, -ps, -s) for rank, (s, b) in enumerate(fits[:n_neg])]
    return sorted(out)


@pytest.mark.parametrize("n, common, chunk, part", [(420, 0, 8192, 8192), (420, 200, 2, 50), (1, 0, 8, 8)])
def test_hard_negatives(spark, n, common, chunk, part):
    df = vectors(spark, n, common=common)
    rows = df.collect()
    got = hard_negatives.hard_negatives(df, n_positives=5, n_negatives=10, chunk=chunk, part=part)
    want = brute_negatives(rows, 5, 10)
    assert sorted(map(tuple, got.collect())) == want
    assert n == 1 or len(want) > 100
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_hard_negatives_repeated_ids_and_empty_table(spark):
    df = vectors(spark, 210)
    twice = df.union(df.where("vec_id in (100, 7, 8)"))
    assert sorted(map(tuple, hard_negatives.hard_negatives(twice).collect())) == brute_negatives(twice.collect(), 5, 10)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_slot_combiner_keeps_the_first_of_ties():
    one = np.ones((1, 2), np.int64)
    combiner = hard_negatives.SlotCombiner(np.array([9]), np.array([0]), one, np.array([[5, 2, -100]]), 3, False)
    n = 1000
    combiner.add(np.arange(10, 10 + n), np.arange(n), np.ones(n, np.int64), np.stack([np.arange(n) % 7, np.zeros(n, np.int64)], 1))
    held = combiner.held.tolist()
    assert [(h[1], h[2], h[3]) for h in held] == [(0, 5, 5), (0, 5, 12), (0, 5, 19), (1, 2, 2), (1, 2, 9), (1, 2, 16)]


def brute_lines(texts, min_docs, min_chars=1):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    out = []
    for lines in split:
        stay = [x for x in lines if seen[key(x)] < min_docs]
        out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def line_docs(spark):
    rng = random.Random(9)
    pool = ["Home", " home\t", "HOME\x0b", "Σίσυφος İ É", "σίσυφος i é", "", " ", "a\x1c", "x", "footer line", "　wide", "very " * 500]
    texts = [None, "", "\n", "\n\n", "only"] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts += ["\n".join(f"own {i}" for i in range(3000)) + "\nhome", "copy\nof this"]
    rows = [(i, t, "h", "n", "p") for i, t in enumerate(texts)]
    rows += [(3, "copy\nof this", None, None, None)] * 11 + [(None, "home\nnull id", "h", "n", "p"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.mark.parametrize("min_docs, min_chars, batches, fanout", [(10, 1, 4, 4), (3, 5, 7, 2), (1, 0, 1, 2)])
def test_line_dedup(spark, min_docs, min_chars, batches, fanout):
    df = line_docs(spark)
    rows = df.collect()
    want = sorted((r.doc_id or -1, *b) for r, b in zip(rows, brute_lines([r.text for r in rows], min_docs, min_chars)))
    got = line_runs.line_dedup(df, min_docs, min_chars, batches, fanout).collect()
    assert sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in got) == [w if w[0] else (-1, *w[1:]) for w in want]


def test_frequent_lines_leave_other_columns(spark):
    df = line_docs(spark)
    out = line_runs.drop_frequent_lines(df, 3, 1)
    assert out.columns == df.columns and out.count() == df.count()
    rows = df.collect()
    assert sorted(r.text for r in out.collect()) == sorted(b[0] for b in brute_lines([r.text for r in rows], 3))
    assert line_runs.line_dedup(df.limit(0)).count() == 0


def counts(spark, **n):
    return spark.createDataFrame([(bytearray(k.encode()), v) for k, v in n.items()], "hash binary, n long")


def test_line_index_levels_reruns_and_reopening(spark):
    path = fresh_path(spark, "index")
    index = line_runs.LineIndex(spark, path, min_docs=4, fanout=2, buckets=3)
    total = Counter()
    for step, batch in enumerate([dict(a=1, b=5, c=2), dict(a=2, c=1, d=1), dict(a=1, b=9, e=4), dict(c=1, d=2), dict(d=1, f=1)]):
        index.add(counts(spark, **batch), f"day-{step}")
        index.add(counts(spark, **batch), f"day-{step}")  # a repeated job adds nothing
        total.update(batch)
        assert sorted(bytes(r.hash).decode() for r in index.settled().collect()) == sorted(k for k, v in total.items() if v >= 4)
    assert sorted(r.level for r in index.live()) == [0, 2]
    compacted = index.read(next(r.run for r in index.live() if r.level == 2))
    assert compacted.count() == compacted.select("hash").distinct().count() == 5
    # a run left without its manifest row, as by a job that failed in between, is written anew
    index._write(counts(spark, z=50).selectExpr("hash", "n", "true as settled"), "0_" + hashlib.sha256(b"day-6").hexdigest()[:16], 0, "lost", [])
    records = [r for r in index.records() if r.batch != "lost"]
    index._records = records
    index.add(counts(spark, f=3), "day-6")
    index.drop_tables()
    again = line_runs.LineIndex(spark, path, min_docs=4, fanout=2, buckets=3)
    again._records = [r for r in again.records() if r.batch != "lost"]
    assert sorted(bytes(r.hash).decode() for r in again.settled().collect()) == ["a", "b", "c", "d", "e", "f"]
    again.drop_tables()


def test_settled_runs_are_read_in_their_buckets(spark):
    path = fresh_path(spark, "index")
    index = line_runs.LineIndex(spark, path, 2, 9, buckets=4)
    index.add(counts(spark, a=1), "one")
    rest = counts(spark, a=1, b=2)
    plan = rest.join(index.read(index.live()[0].run).where("settled").select("hash").hint("merge"), "hash", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1
    index.drop_tables()


def brute_centroids(rows, k, rounds):
    kept = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in rows if finite(r.embedding) and len(r.embedding) == 64]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    centres = [list(v) for _, v in sorted(kept, key=order)[:k]]

    def assign(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[assign(v)[1]].append(v)
        centres = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, centres)]
    placed = [(i, *reversed(assign(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in placed:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in placed]


@pytest.mark.parametrize("n, common, k, rounds", [(300, 0, 8, 10), (300, 150, 8, 3), (5, 0, 8, 2), (60, 60, 8, 2)])
def test_centroids(spark, n, common, k, rounds):
    df = vectors(spark, n, common=common)
    got = ptolemy_kmeans.cluster(df, k, rounds).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_centroids(df.collect(), k, rounds)))


def test_centroids_of_no_vectors_and_large_components(spark):
    df = vectors(spark, 3)
    assert ptolemy_kmeans.cluster(df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in ptolemy_kmeans.cluster(big, 2, 1).collect()}
    assert len(out) == 3 and all(0 <= r.distance < 2**63 for r in out.values())


def test_pivot_bounds_never_exceed_and_do_prune():
    rng = np.random.default_rng(1)
    groups = rng.integers(-2000, 2000, (8, 64))
    points = groups[rng.integers(0, 8, 4000)] + rng.integers(-150, 150, (4000, 64))
    points[:50] = groups[rng.integers(0, 8, 50)]  # equal points: every bound is met exactly
    pivots = ptolemy_kmeans.Pivots(ptolemy_kmeans._spread(groups, 4))
    cached = pivots.distances(points)
    true = np.stack([ptolemy_kmeans.squares(points, c) for c in groups], 1)
    assert (pivots.lower_squares(cached, groups) <= true).all()
    near, best, measured = ptolemy_kmeans.nearest(points, cached, groups, pivots)
    assert (near == true.argmin(1)).all() and (best == true.min(1)).all()
    assert measured < 0.3 * true.size
