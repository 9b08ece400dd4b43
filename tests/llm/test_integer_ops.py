"""Hard negatives and clusters of integer vectors: against brute force, and on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumeset.llm import common, hard_negatives, lookup_clusters

ROWS = "vec_id long, embedding array<double>, label int, score double, n long, dims int, cluster int"
NAN, INF = float("nan"), float("inf")


def rows_of(spark, rows):
    """rows: (vec_id, embedding, label); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, v, l, 0.5, 7, 1, 3) for i, v, l in rows], ROWS)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 4).tolist(), int(rng.integers(0, 3))) for i in range(60)]
    rows += [rows[0]] * 3 + [rows[10]] * 2 + [(10, rows[11][1], 1), (20, rows[0][1], 2), (200, rows[0][1], 0)]  # repeated rows, one id with two vectors, ties
    rows += [(None, [0.1] * 4, 1), (61, None, 1), (62, [0.1, None, 0.2, 0.3], 1), (63, [NAN, 0.0, 0.0, 0.0], 1), (64, [INF, 0.0, 0.0, 0.0], 1), (65, [0.1] * 4, None), (66, [1e300, 0.0, 0.0, 0.0], 1)]
    rows += [(70, [0.5, 0.5], 1), (80, [0.25, 0.5], 1), (90, [0.5, 0.25], 2), (100, [0.0] * 4, 0), (110, [], 1), (111, [], 1), (112, [], 2)]
    return rows


def whole(rows, labels=True):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)
    return [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if good(v) and (not labels or (i is not None and l is not None))]


# --- 11 ---


def brute_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    out = collections.Counter()
    for a, (ai, al, av) in enumerate(rows):
        if not is_anchor(ai):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, l) for k, (i, l, v) in enumerate(rows) if k != a and len(v) == len(av))
        for s, p, _ in [x for x in scored if x[2] == al][:positives]:
            fit = [x for x in scored if x[2] != al and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out.update((ai, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1))
    return out


def integer_rows(df, ten):
    e = common.integer_vectors(df, "vec_id", "label", "score", "n")
    return e.withColumn("anchor", F.col("vec_id") % ten == 0)


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "chunk": 7}])
def test_hard_negatives_of_odd_rows(spark, sizes):
    rows = odd_rows()
    got = hard_negatives.mine(integer_rows(rows_of(spark, rows), 10), **sizes).collect()
    assert collections.Counter(map(tuple, got)) == brute_negatives(whole(rows), lambda i: i % 10 == 0)


def clustered(n, dims, groups, noise, rng, scale=1.0):
    centres = rng.normal(0, 1, (groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(0, noise, (n, dims))
    return scale * x / np.linalg.norm(x, axis=1, keepdims=True)


def test_hard_negatives_of_clusters(spark):
    rng = np.random.default_rng(5)
    x = clustered(1500, 16, 30, 0.1, rng)
    x[:500] = x[0]  # a third of the rows are one vector
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    got = hard_negatives.mine(integer_rows(rows_of(spark, rows), 25), block=16, chunk=200).collect()
    want = brute_negatives(whole(rows), lambda i: i % 25 == 0)
    assert want and collections.Counter(map(tuple, got)) == want


def test_bounds_leave_scores_out():
    """Of like anchors only the root and the candidates in question are scored, with the same result."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * clustered(6000, 32, 60, 0.02, rng)).astype(np.int64)
    near = np.linalg.norm(x[:2000] - x[0], axis=1).argsort()[:30]
    anchors = x[near]
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert all(parent[k] < k for k in range(len(parent))) and parent[0] == -1
    block = {"ids": near[order], "labels": np.zeros(30, np.int64), "vecs": anchors[order], "parent": parent, "edge": edge}
    labels = np.arange(6000) % 2
    chunks = [{"ids": np.arange(s, s + 1000), "labels": labels[s : s + 1000], "n": np.ones(1000, np.int64), "vecs": x[s : s + 1000]} for s in range(0, 6000, 1000)]
    held, scored = hard_negatives.positives_in(block, chunks)
    assert scored < 0.35 * 30 * 6000
    windows = []
    for k, i in enumerate(block["ids"]):
        s = x @ x[i]
        want = sorted((-s[j], j) for j in range(6000) if labels[j] == 0 and j != i)[:5]
        assert list(zip(-held[k].scores, held[k].ids)) == want
        windows.append([hard_negatives.window(int(v), 30, 90) for v in held[k].scores])
    found, scored = hard_negatives.negatives_in(block, windows, chunks)
    assert scored < 0.35 * 30 * 6000
    for k, i in enumerate(block["ids"]):
        s = x @ x[i]
        for (a, b), h in zip(windows[k], found[k]):
            assert list(zip(-h.scores, h.ids)) == sorted((-s[j], j) for j in range(6000) if labels[j] == 1 and a <= s[j] <= b)[:10]


def test_products_are_exact():
    x, y = np.array([[2**29, 2**28 + 1], [3, -(2**29)]]), np.array([2**29 - 1, 2**28 + 3])
    assert hard_negatives.products(x, y).tolist() == [sum(int(a) * int(b) for a, b in zip(r, y)) for r in x]


def test_hard_negatives_of_nothing(spark):
    none = integer_rows(rows_of(spark, []), 10)
    assert hard_negatives.mine(none).count() == 0
    assert hard_negatives.mine(integer_rows(rows_of(spark, [(1, [0.5], 1), (2, [0.25], 2)]), 10)).count() == 0  # no anchor
    assert hard_negatives.mine(integer_rows(rows_of(spark, [(10, [0.5], 1), (2, [0.25], 2)]), 10)).count() == 0  # no positive
    assert hard_negatives.mine(integer_rows(rows_of(spark, [(10, [0.5], 1), (2, [-0.5], 1), (3, [-0.4], 2)]), 10)).count() == 0  # a score below zero


# --- 13 ---


def brute_clusters(rows, k, rounds):
    hashed = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    ids, x = [i for i, _, _ in rows], np.array([v for _, _, v in rows], object)
    first = sorted(range(len(rows)), key=lambda r: (*hashed(ids[r]), rows[r][2]))[:k]
    c = [rows[r][2] for r in first]

    def nearest():
        far = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
        return [min(range(len(c)), key=lambda j: (f[j], j)) for f in far], far

    for _ in range(rounds):
        at, _ = nearest()
        c = [[sum(x[r][d] for r in mine) // len(mine) for d in range(len(m))] if (mine := [r for r in range(len(x)) if at[r] == j]) else m for j, m in enumerate(c)]
    at, far = nearest()
    each = collections.Counter()
    for r, j in enumerate(at):
        each[j] += far[r][j]
    return collections.Counter((ids[r], j, far[r][j], each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for r, j in enumerate(at))


@pytest.mark.parametrize(("clusters", "chunk"), [(7, 4096), (7, 5), (200, 4096)])
def test_clusters_of_odd_rows(spark, clusters, chunk):
    rows = odd_rows()
    e = common.integer_vectors(rows_of(spark, rows).where(F.size("embedding") == 4), "vec_id", "cluster")
    got = lookup_clusters.cluster(e, clusters, 3, chunk=chunk)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == brute_clusters([r for r in whole(rows, False) if len(r[2]) == 4], clusters, 3)


def test_clusters_with_a_hot_vector_and_empty_clusters(spark):
    rng = np.random.default_rng(7)
    x = clustered(900, 6, 5, 0.2, rng, 3.0)
    x[:300] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = lookup_clusters.cluster(common.integer_vectors(rows_of(spark, rows), "vec_id"), 12, 4, chunk=100)
    assert collections.Counter(map(tuple, got.collect())) == brute_clusters(whole(rows), 12, 4)


def test_clusters_of_nothing(spark):
    assert lookup_clusters.cluster(common.integer_vectors(rows_of(spark, [(1, None, 1), (2, [None], 1)]), "vec_id")).count() == 0
