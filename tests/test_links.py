"""Similarity joins against all pairs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumeset.operators import links


def near_hashes(rng, n):
    h = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)]
    h += [h[0], h[0] ^ 0b1011, h[1] ^ (1 << 60), -1, 0, None]
    return h + [(h[2] ^ int(x)) for x in rng.integers(0, 2**9, n // 2)]  # a third within nine bits


@pytest.mark.parametrize(("under", "bucket", "tile"), [(5, 2048, 4096), (5, 4, 7), (20, 2048, 4096), (20, 10, 9), (1, 3, 2), (65, 5, 30)])
def test_hamming_links_equal_all_pairs(spark, under, bucket, tile):
    h = near_hashes(np.random.default_rng(5), 60)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "k long, h long")
    m = (1 << 64) - 1
    want = {(i, j) for i, j in itertools.combinations(range(len(h)), 2) if h[i] is not None and h[j] is not None and ((h[i] & m) ^ (h[j] & m)).bit_count() < under}
    members = {r["class"]: [i for i, x in enumerate(h) if x == r.h] for r in links.hash_classes(df, "k", "h").collect()}
    found = links.hamming_links(df, "k", "h", under, bucket, tile).collect()
    assert all((r.n_a, r.n_b) == (len(members[r.a]), len(members[r.b])) and r.a < r.b for r in found)
    got = [(min(i, j), max(i, j)) for r in found for i in members[r.a] for j in members[r.b]] + [(i, j) for c in members.values() for i in c for j in c if i < j]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("searched", "bucket", "meetings"), [(64, 2048, 8), (64, 1, 8), (1, 3, 8), (1, 3, 0), (2, 3, 8)])
@pytest.mark.parametrize("under", [1, 3, 5])
def test_links_under_several_masks_are_told_once(spark, monkeypatch, under, searched, bucket, meetings):
    """Buckets searched in their task, dealt out by each mask or met by tiles: each link comes once, and none is dealt out again."""
    for name, value in (("DEALT", 0.0), ("SEARCHED", searched), ("MEETINGS", meetings)):
        monkeypatch.setattr(links, name, value)
    rng = np.random.default_rng(under)
    h = near_hashes(rng, 60) + [int(x) << 40 for x in rng.integers(0, 2**12, 60)]  # many agree in most blocks
    df = spark.createDataFrame([*enumerate(h), (None, 77)], "k long, h long")
    assert len(links.block_masks(100, under)) > 1 or under == 1
    found = links.hamming_links(df, "k", "h", under, bucket, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert bucket < 2048 or "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    members = {}
    for i, x in enumerate(h):
        if x is not None:
            members.setdefault(x, []).append(i)
    m = (1 << 64) - 1
    want = {(v[0], w[0], d, len(v), len(w)) for x, v in members.items() for y, w in members.items() if v[0] < w[0] and (d := ((x & m) ^ (y & m)).bit_count()) < under}
    got = [tuple(r) for r in found.select("a", "b", "distance", "n_a", "n_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (want or under == 1)


@pytest.mark.parametrize(("n", "under", "most"), [(10**6, 5, 1e-3), (10**9, 5, 1e-6), (10**6, 10, 0.02)])
def test_masks_leave_few_pairs_and_lose_none(n, under, most):
    masks = [x % 2**64 for x in links.block_masks(n, under)]
    assert len(masks) <= links.MASKS and sum(2.0 ** -m.bit_count() for m in masks) < most
    rng = np.random.default_rng(1)
    for _ in range(2000):
        d = sum(1 << int(b) for b in rng.choice(64, under - 1, replace=False))
        assert any(not d & m for m in masks)


def test_a_wide_radius_is_one_bucket():
    assert links.block_masks(1000, 40) == [0]


def clustered(rng, n, dims, groups, noise):
    c = rng.normal(size=(groups, dims))
    return c[rng.integers(0, groups, n)] + rng.normal(0, noise, (n, dims))


@pytest.mark.parametrize("at_least", [0.95, -0.2])
def test_cosine_links_equal_all_pairs(spark, at_least):
    rng = np.random.default_rng(2)
    x = clustered(rng, 300, 6, 12, 0.05)
    x[200:280] = x[0] + rng.normal(0, 0.01, (80, 6))  # a dense group
    x[280:290] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 6), (301, [0.0] * 6), (302, None), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if cos[i, j] >= at_least}
    for sizes in ({}, {"cell": 20, "block": 16}):
        found, members = links.cosine_links(df, "k", "v", at_least, **sizes)
        found, members = found.collect(), members.collect()
        own = {r["class"]: [i for i, (k, v) in enumerate(rows) if k is not None and v == rows[r["class"]][1]] for r in members}
        grp = {r["class"]: r.grp for r in members}
        got = [tuple(sorted((i, j))) for r in found for i in own[r.a] for j in own[r.b]]
        got += [(i, j) for c in own if c < 300 for i in own[c] for j in own[c] if i < j]
        got += [tuple(sorted((i, j))) for a, b in itertools.combinations(sorted(own), 2) if grp[a] is not None and grp[a] == grp[b] for i in own[a] for j in own[b]]
        assert len(got) == len(set(got)) and set(got) == want
        if sizes and at_least == 0.95:
            assert len(found) < len(want) / 2  # most links are told by membership
        if not sizes:
            continue
        counts = {r["class"]: r.links for r in links.link_counts(*links.cosine_links(df, "k", "v", at_least, **sizes)).where("class < 300").collect()}
        assert counts == {c: sum((min(c, j), max(c, j)) in want for j in range(300) if j != c) for c in own if c < 300}
    pairs = {(r.a, r.b) for r in links.cosine_pairs(df.where("k is not null"), "k", "v", at_least).collect()}
    assert pairs == want


def test_far_blocks_do_not_meet(spark, monkeypatch):
    """On clustered vectors the pairs of blocks grow less than with the square of the rows."""
    met = []
    real = links.materialise

    def watch(df, name, **options):
        out = real(df, name, **options)
        if name in ("met", "blocks"):
            met.append((name, out.count()))
        return out

    monkeypatch.setattr(links, "materialise", watch)
    rng = np.random.default_rng(3)
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(rng, n, 16, n // 50, 0.05))], "k long, v array<double>")
        links.cosine_links(df, "k", "v", math.cos(0.35), cell=10, block=32)[0].count()
    by = [dict(met[i : i + 2]) for i in (0, 2)]
    assert all(b["met"] < 0.2 * b["blocks"] ** 2 / 2 for b in by)
    assert by[1]["met"] / by[0]["met"] < 0.6 * (by[1]["blocks"] / by[0]["blocks"]) ** 2


@pytest.mark.parametrize("kind", ["double", "float"])
def test_blocks_that_all_meet_are_not_dealt_out(spark, kind):
    """Without structure nothing is shuffled for pairs of blocks, however many there are; counts are those of the pairs."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    x[300:330] = x[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, [0.0] * 8), (401, None)], f"k long, v array<{kind}>")
    want = {(i, j) for i, j in itertools.combinations(range(400), 2) if cos[i, j] >= 0.3}
    found = links.cosine_pairs(df, "k", "v", 0.3, block=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    found = found.collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    assert all(r.cosine == 1.0 for r in found if r.a in {0, *range(300, 330)} and r.b in range(300, 330))
    assert {(r.a, r.b) for r in links.cosine_pairs(df, "k", "v", 1.0, block=16).collect()} == set(itertools.combinations([0, *range(300, 330)], 2))
    degrees = {r["class"]: (r.n, r.links) for r in links.cosine_degrees(df, "k", "v", 0.3, block=16, cell=20).collect()}
    both = {r["class"]: (r.n, r.links) for r in links.link_counts(*links.cosine_links(df, "k", "v", 0.3, block=16, cell=20)).collect()}
    assert degrees == both == {c: (31 if c == 0 else 1, int((cos[c] >= 0.3).sum()) - 1) for c in range(400) if c not in range(300, 330)} | {400: (1, 0)}


def test_links_of_nothing(spark):
    none = spark.createDataFrame([], "k long, v array<double>, h long")
    found, members = links.cosine_links(none, "k", "v", 0.5)
    assert found.count() == members.count() == links.cosine_pairs(none, "k", "v", 0.5).count() == links.hamming_links(none, "k", "h", 5).count() == 0
    zero = spark.range(3).select(F.col("id").alias("k"), F.array(F.lit(0.0)).alias("v"))
    assert links.cosine_links(zero, "k", "v", -1.0)[0].count() == 0


def test_degrees_of_nothing(spark):
    assert links.cosine_degrees(spark.createDataFrame([], "k long, v array<double>"), "k", "v", 0.5).count() == 0
