"""Greedy choices from large groups: the same rows as one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumeset.operators import allocate, blocks, lazy, select

ROWS = "run string, key long, ord long, source string, ts double, score double, h long, scene string, family string"
FAMILIES = ["content", "content", "content", "title", "map", "menu"]


def table(n, sources, rng, run="a", copies=0.3):
    h = rng.integers(-(2**63), 2**63 - 1, n)
    for i in range(1, n):
        if rng.random() < copies:
            h[i] = h[rng.integers(0, i)] ^ (1 << int(rng.integers(0, 62)))
    return [(run, i, int(rng.integers(0, 1000)), f"s{rng.integers(0, sources)}", float(rng.integers(0, 4000)), float(rng.integers(0, 100)), int(h[i]), f"c{rng.integers(0, 6)}", FAMILIES[rng.integers(0, 6)]) for i in range(n)]


def by_loop(rows, count, bits, final):
    """One by one over all rows, as the rules are written down."""
    visual, time, dup = (0.65, 9.0, 35.0) if final else (0.60, 8.0, 30.0)
    caps = {"title": 1, "map": max(1, -(-count // 10)), "menu": max(2, -(-count * 15 // 100))}
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    key, ts, score = (np.array([r[i] for r in rows]) for i in (1, 4, 5))
    h = np.array([r[6] for r in rows]).view(np.uint64)
    source, scene, family = (np.array([r[i] for r in rows]) for i in (3, 7, 8))
    names = np.unique(source)
    scale = np.zeros(len(rows))
    for s in names:
        scale[source == s] = max(60.0, (ts[source == s].max() - ts[source == s].min()) / max(1.0, count / len(names)))
    chosen = []
    while len(chosen) < min(count, len(rows)):
        vd = np.bitwise_count(h[:, None] ^ h[chosen][None]).min(1) if chosen else np.full(len(rows), 64)
        td, n_scene, n_source, n_family = scale.copy(), np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
        for s in np.unique(source[chosen]) if chosen else []:
            mine = [c for c in chosen if source[c] == s]
            td[source == s] = np.abs(ts[source == s][:, None] - ts[mine][None]).min(1)
        for c in chosen:
            n_scene += scene == scene[c]
            n_source += source == source[c]
            n_family += family == family[c]
        total = score + 14.0 / (n_scene + 1) + 12.0 / (n_source + 1) + np.minimum(32, vd) * visual + np.minimum(scale, td) / scale * time
        pool = ~np.isin(np.arange(len(rows)), chosen)
        if len(chosen) < min(count, len(names)):
            pool &= n_source == 0
        if final:
            total = total - np.where(family == "content", 0.0, n_family * 1.5)
            wanted = pool & (n_family < np.array([caps.get(f, np.inf) for f in family]))
            pool = wanted if wanted.any() else pool
            pool = pool & (vd >= bits) if (pool & (vd >= bits)).any() else pool
        total = total - np.where((vd < bits) & (td < 60), dup, 0.0)
        at = np.flatnonzero(pool)
        chosen.append(int(at[np.lexsort((at, ts[at], -score[at], -total[at]))[0]]))
    return key[chosen].tolist()


def chosen_by(spark, rows, count, bits, final, most, partitions=6):
    df = spark.createDataFrame(rows, ROWS).repartition(partitions)
    got = {}
    for r in sorted(select.diverse_candidates(df, count, bits, final, strict=False, most=most).collect(), key=lambda r: r.pick):
        got.setdefault(r.run, []).append(r.key)
    return got


@pytest.mark.parametrize("final", [False, True])
def test_choice_of_a_large_run_equals_the_loop(spark, final):
    rows = table(20_000, 5, np.random.default_rng(1))
    assert chosen_by(spark, rows, 30, 5, final, 4000) == {"a": by_loop(rows, 30, 5, final)}


@pytest.mark.parametrize(("final", "sources", "bits"), [(False, 3, 5), (True, 7, 28)])
def test_choices_in_small_slices(spark, monkeypatch, final, sources, bits):
    for c, v in {"HEADS": 12, "TOP": 5, "OF_SOURCE": 1, "AHEAD": 3, "FEW": 0}.items():
        monkeypatch.setattr(lazy, c, v)
    monkeypatch.setattr(blocks, "SLICE", 40)
    rng = np.random.default_rng(2)
    rows = table(300, sources, rng, "a") + table(160, sources, rng, "b", 0.9) + table(30, 2, rng, "c")
    got = chosen_by(spark, rows, 9, bits, final, 100)
    assert got == {run: by_loop([r for r in rows if r[0] == run], 9, bits, final) for run in "abc"}


def apart_by_loop(rows, need, bits, seeds):
    rows, taken, out = sorted(rows, key=lambda r: (-r[5], r[4], r[1])), [r[6] for r in seeds], []
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() >= bits
    while rows and len(out) < need:
        r = next((r for r in rows if all(far(r[6], t) for t in taken)), rows[0])
        rows.remove(r)
        taken.append(r[6])
        out.append(r[1])
    return out


@pytest.mark.parametrize(("n", "need", "bits", "small"), [(9000, 12, 29, False), (300, 40, 26, True)])
def test_first_apart_of_large_groups_equals_the_loop(spark, monkeypatch, n, need, bits, small):
    if small:
        for c, v in {"HEADS": 24, "TOP": 9, "AHEAD": 3}.items():
            monkeypatch.setattr(lazy, c, v)
        monkeypatch.setattr(blocks, "SLICE", 40)
    rng = np.random.default_rng(4)
    rows = table(n, 1, rng, "a") + table(60, 1, rng, "b")
    seed = {(r[0], r[1]) for r in rows if rng.random() < 0.02}
    df = spark.createDataFrame([(*r, (r[0], r[1]) in seed, need) for r in rows], ROWS + ", seed boolean, need int")
    got = {}
    for r in sorted(select.first_apart(df, ["run"], bits, most=100).collect(), key=lambda r: r.pick):
        got.setdefault(r.run, []).append(r.key)
    part = lambda run, begun: [r for r in rows if r[0] == run and ((r[0], r[1]) in seed) == begun]
    assert got == {run: apart_by_loop(part(run, False), need, bits, part(run, True)) for run in "ab"}


def test_preselection_and_backfill_of_large_runs(spark):
    """With and without rounds the same."""
    rng = np.random.default_rng(5)
    rows = table(400, 4, rng, "a") + table(50, 3, rng, "b")
    df = spark.createDataFrame(rows, ROWS).withColumns({"bin": (F.col("ts") / 100).cast("int"), "assessed": F.col("key") % 5 == 0, "is_transition": F.col("key") % 10 != 0})
    both = [sorted(map(tuple, select.primary_preselect(df, 3, 27, most=most).collect())) for most in (150, 4000)]
    assert both[0] == both[1] and sum(r[0] == "a" for r in both[0]) == 36
    order = select.backfill_order(df.where("assessed"), df.select("run", "source").distinct(), 150)
    both = [sorted(map(tuple, select.source_backfill(df, order, 27, most=most).collect())) for most in (150, 4000)]
    assert both[0] == both[1] and both[0]


def test_scene_choice_of_large_runs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 60)
    monkeypatch.setattr(blocks, "SLICE", 50)
    rng = np.random.default_rng(6)
    rows = [(g, i, i, int(rng.integers(0, 3)), str(rng.choice(["recurring_gameplay", "ordinary"])), rng.normal(size=3).tolist()) for g, n in (("a", 300), ("b", 40)) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "run string, key long, turn long, segment int, role string, features array<double>")
    for count in (40,):
        both = [sorted(map(tuple, select.similar_aware_choice(df, count, [0.3, 0.7, 0.9], most=most).collect())) for most in (100, 4000)]
        assert both[0] == both[1]


def test_round_robin_equals_the_loop(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for run in range(60):
        free = rng.integers(0, 9, int(rng.integers(1, 8)))
        target, given = int(rng.integers(0, 30)), np.zeros(len(free), int)
        while given.sum() < min(target, free.sum()):
            for i in range(len(free)):
                if given.sum() < target and given[i] < free[i]:
                    given[i] += 1
        rows += [(run, i, int(free[i]), target) for i in range(len(free))]
        want |= {(run, i): int(given[i]) for i in range(len(free))}
    df = spark.createDataFrame(rows, "run int, turn int, free int, target int")
    assert {(r.run, r.turn): r.given for r in allocate.round_robin(df).collect()} == want
