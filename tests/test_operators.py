"""Operators on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumeset.functions import metrics as M
from lumeset.functions import text as X
from lumeset.functions import vectors as V
from lumeset.operators import allocate, blocks, interleave, profile, reject, select, similarity

METRICS = "brightness contrast edge_density action_intensity luminance_entropy luminance_range near_black_ratio near_white_ratio dominant_tone_ratio".split()
FRAMES = {
    "informative": (120, 55, 0.35, 45, 3.0, 120, 0.02, 0.01, 0.35),
    "blackout": (1, 0.2, 0.001, 0.1, 0.05, 1, 0.99, 0, 1.0),
    "whiteout": (250, 0.3, 0.001, 0.1, 0.05, 1, 0, 0.99, 1.0),
    "single_tone": (120, 0.2, 0.001, 0.1, 0.08, 3, 0, 0, 0.96),
    "fade_transition": (12, 0, 0, 0, 0, 0, 0.85, 0, 0.90),
}


def positions(spark, duration, count, end_margin=0.05, start=0.0, last=None):
    df = spark.createDataFrame([(1, float(duration), float(end_margin), float(start), last)], "key int, duration double, end_margin double, start double, last double")
    return [r.ts for r in allocate.sample_positions(df, count).orderBy("i").collect()]


def test_positions_of_an_hour(spark):
    got = positions(spark, 3600, 30)
    assert len(got) == 1080 and got[0] == 0.5 and got[-1] == 3599.5


def test_positions_of_a_short_source(spark):
    assert positions(spark, 0.45, 2) == [0.1, 0.35]


def test_positions_of_a_delayed_source(spark):
    got = positions(spark, 3.0, 3, end_margin=1.0, start=5.0)
    assert len(got) == 7 and got[0] == 5.5 and got[-1] == 7.0


@pytest.mark.parametrize(("n", "want"), [(4, [361] * 4), (12, None)])
def test_budget_of_equal_sources(spark, n, want):
    df = spark.createDataFrame([(1, i, i, 3600.0) for i in range(n)], "run int, key int, ord int, duration double")
    df = df.withColumn("capacity", allocate.sample_capacity(F.col("duration"), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double")))
    got = [r.n for r in allocate.weighted_counts(allocate.automatic_budget(df, 30)).orderBy("key").collect()]
    assert got == want if want else sum(got) == 4000 and min(got) > 0


def test_more_sources_than_samples(spark):
    """An error, or one sample each; other runs have theirs as before."""
    df = spark.range(4003).selectExpr("CASE WHEN id < 4001 THEN 1 ELSE 2 END AS run", "id AS key", "id AS ord", "3600.0D AS duration", "10000L AS capacity")
    with pytest.raises(Exception, match="more sources than samples"):
        allocate.automatic_budget(df, 30).collect()
    got = allocate.weighted_counts(allocate.automatic_budget(df, 30, strict=False)).collect()
    assert len(got) == 4003 and {r.n for r in got if r.run == 1} == {1} and [r.n for r in got if r.run == 2] == [540, 540]


def test_weighted_counts_equal_the_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for run in range(40):
        n = int(rng.integers(1, 8))
        most = rng.integers(1, 12, n)
        least = np.minimum(rng.integers(0, 3, n), most)
        weight = np.round(rng.random(n) * 5, 1)
        target = int(rng.integers(least.sum(), most.sum() + 1))
        counts = least.copy()
        for _ in range(target - least.sum()):
            best = max((i for i in range(n) if counts[i] < most[i]), key=lambda i: (max(weight[i], 0.001) / (counts[i] + 1), -i))
            counts[best] += 1
        want |= {(run, i): int(counts[i]) for i in range(n)}
        rows += [(run, i, i, float(weight[i]), int(least[i]), int(most[i]), target) for i in range(n)]
    df = spark.createDataFrame(rows, "run int, key int, ord int, weight double, least long, most long, target long")
    assert {(r.run, r.key): r.n for r in allocate.weighted_counts(df).collect()} == want


def scene_rows(spark, rows):
    df = spark.createDataFrame([(1, s, i, role, float(a), float(a)) for i, (s, role, a) in enumerate(rows)], "run int, scene string, ord int, role string, selection double, quality double")
    return allocate.scene_stats(df)


def test_scarce_places_go_to_the_best_scenes(spark):
    stats = scene_rows(spark, [("battle", "ordinary", 0.2), ("menu", "ordinary", 0.6), ("climax", "ordinary", 0.9)])
    assert {r.scene: r.quota for r in allocate.scene_quotas(stats, 2).collect()} == {"battle": 0, "menu": 1, "climax": 1}


def test_cinematic_scenes_are_limited(spark):
    rows = [(s, "cinematic" if s == "event" else "ordinary", 0.5) for s in ("event", "battle", "puzzle") for _ in range(10)]
    assert {r.scene: r.quota for r in allocate.scene_quotas(scene_rows(spark, rows), 10).collect()} == {"event": 1, "battle": 5, "puzzle": 4}


def test_static_reasons(spark):
    rest = dict.fromkeys(("blur_score", "color_richness", "ui_density", "visual_balance", "dramatic_score"), 50.0) | dict.fromkeys(("menu_layout", "title_layout", "game_over_layout"), 0.1)
    rows = [(name, *map(float, v), *rest.values(), 0.9 if name == "informative" else 0.0) for name, v in FRAMES.items()]
    df = spark.createDataFrame(rows, ["name", *METRICS, *rest, "adaptive"])
    df = profile.with_profile(M.normalised(df), profile.build_profile(df))
    df = df.withColumn("visibility", F.col("adaptive")).withColumn("information", F.col("adaptive")).withColumn("washout", M.bright_washout())
    got = {r.name: r.reason for r in df.select("name", reject.static_reason().alias("reason")).collect()}
    assert got == {k: None if k == "informative" else k for k in FRAMES}


def test_only_the_middle_frame_dips(spark):
    df = spark.createDataFrame([(1, i, [1.0, 0.0] if i < 3 else [0.0, 1.0], v, None) for i, v in enumerate((0.9, 0.1, 0.9, 0.1, 0.9))], "run int, i int, features array<double>, visibility double, reason string")
    assert [r.i for r in reject.temporal_dips(df, ["run"], ["i"]).where("dip").collect()] == [1]


def test_percentile_ranks_in_single_precision(spark):
    v = [0.1, 0.2, 0.2, 0.3, 0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v double")
    pop = np.sort(np.asarray(v, np.float32))
    want = {i: (np.searchsorted(pop, x, "left") + np.searchsorted(pop, x, "right")) / 2 / len(v) for i, x in enumerate(v)}
    assert {r.id: r.rank for r in profile.with_rank(df, "v", "rank").collect()} == pytest.approx(want)


@pytest.mark.parametrize("few", [10**6, 0])
def test_ranks_of_values_with_an_outlier(spark, few):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=800), [1e12, -1e12, 0.1, 0.1, 0.0]])
    df = spark.createDataFrame([(i, float(x), float(x) * 3) for i, x in enumerate(v)] + [(-1, None, 1.0)], "id int, v double, w double")
    pop = np.sort(v.astype(np.float32))
    want = {i: (np.searchsorted(pop, x, "left") + np.searchsorted(pop, x, "right")) / 2 / len(v) for i, x in enumerate(v)} | {-1: None}
    got = {r.id: r.rank for r in profile.with_ranks(df, {"v": "rank", "w": "other"}, slices=16, few=few).collect()}
    assert got == pytest.approx(want)
    if not few:  # the slices are even in spite of the outliers
        sizes = profile.rank_table(df, ["v"], slices=16, few=0)[0]
        assert sizes.count() == len(np.unique(pop))


def test_percentiles_of_odd_values(spark):
    rng = np.random.default_rng(8)
    columns = {"a": rng.normal(size=3000), "b": np.concatenate([np.full(1000, 7.0), rng.normal(0, 1e-20, 1999), [1e30]]), "c": np.zeros(3000), "d": np.concatenate([[-1e38, 1e38], rng.integers(-3, 3, 2998).astype(float)])}
    df = spark.createDataFrame([tuple(float(x[i]) for x in columns.values()) for i in range(3000)] + [(None,) * 4], ", ".join(f"{c} double" for c in columns))
    for slots in (4096, 5):
        got = profile.build_profile(df, tuple(columns), (0, 10, 25, 50, 90, 100), slots).first().asDict()
        assert got == pytest.approx({f"p_{c}_{q}": float(np.percentile(x.astype(np.float32).astype(float), q)) for c, x in columns.items() for q in (0, 10, 25, 50, 90, 100)}, rel=1e-12)
    assert set(profile.build_profile(df.where("a > 1e9"), ("a",)).first()) == {0.0}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.normalize_scene(F.lit(" !? ")).alias("none"), X.normalize_scene(F.lit("Boss Battle #2")).alias("scene"), X.screen_family(F.lit(" World Map ")).alias("map"), X.screen_family(F.lit("the Title Screen")).alias("title"),
        X.infer_title(F.lit("Great Game Part 12 end")).alias("part"), X.infer_title(F.lit("Great Game #3")).alias("number"), X.infer_title(F.lit("Plain")).alias("plain"),
        X.frame_interval(F.lit("30/1")).alias("rate"), X.frame_interval(F.lit("0/0")).alias("zero"), X.frame_interval(F.lit("x")).alias("bad"), X.timestamp_label(F.lit(3725.0)).alias("at"),
        X.host_url(F.lit("box")).alias("host"), X.host_url(F.lit("https://box:80/")).alias("full"),
    ).first()
    assert (row.none, row.scene, row.map, row.title) == (X.OTHER_SCENE, "bossbattle2", "map", "title")
    assert (row.part, row.number, row.plain) == ("Great Game", "Great Game", "Plain")
    assert (row.rate, row.zero, row.bad, row["at"]) == (pytest.approx(1 / 30), 0.0, 0.0, "01:02:05")
    assert (row.host, row.full) == ("http://box:11434", "https://box:80")


def test_folded_case(spark):
    words = ["Straße", "STRASSE", "ﬁsh", "ΑΣ Σ", "İx", "Ꭰꭰ", "ſtop", "ǅ", "abc", "", "ẞ", "µm"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.casefold(F.col("w")).alias("c")).collect()
    assert {r.w: r.c for r in got} == {w: w.casefold() for w in words}
    assert spark.range(1).select(X.normalize_scene(F.lit("Straße")).alias("a"), X.screen_family(F.lit(" WORLD MAP ")).alias("b")).first() == ("strasse", "map")


@pytest.mark.parametrize("digits", [0, 2, 4, 6])
def test_half_even_rounding_by_exact_values(spark, digits):
    rng = np.random.default_rng(9)
    values = [2.675, 5e-7, 0.00015, 0.5, 1.5, -0.5, -2.5, -2.675, 1e20, 0.0, *rng.uniform(-1000, 1000, 500), *np.round(rng.uniform(0, 100, 500), 3), *(rng.integers(0, 10**6, 500) / 2.0 ** rng.integers(1, 12, 500))]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", M.round_half_even(F.col("v"), digits).alias("r")).collect()
    assert all(r.r == round(r.v, digits) for r in got)


def test_hashes_and_zero_vectors(spark):
    row = spark.range(1).select(V.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("all"), V.hash_number(V.hash_text(F.lit(-1).cast("long"))).alias("back"), V.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("zero")).first()
    assert (row["all"], row["back"], row["zero"]) == (64, -1, [0.0, 0.0])
    grey = [[i * (j + 1) for i in range(9)] for j in range(8)]
    assert spark.createDataFrame([(grey,)], "rows array<array<int>>").select(V.difference_hash(F.col("rows"))).first()[0] == -1


def choose(spark, vectors, count, steps):
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(vectors)], "run int, key int, v array<double>")
    rows = similarity.diverse_filter(df, "run", "key", "key", "v", count, steps).collect()
    return [r.key for r in sorted(rows, key=lambda r: r.pick) if r.pick], sum(r.refused for r in rows)


def test_diverse_filter(spark):
    assert choose(spark, [(1, 0)] * 10, 5, [0.9]) == ([0], 9)
    assert choose(spark, [(1, 0, 0), (0.8, 0.6, 0)], 2, [0.9, 0.7]) == ([0, 1], 0)
    assert choose(spark, [(1, 0, 0), (0.8, 0.6, 0)], 2, [0.7, 0.9]) == ([0, 1], 0)


def test_leader_groups(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(([1.0, 0.0], [1.0, 0.01], [0.0, 1.0]))], "scene string, key int, v array<double>")
    assert [r.leader for r in similarity.leader_groups(df, "scene", "key", "key", "v", 0.95).orderBy("key").collect()] == [1, 1, 2]


def test_final_choice_keeps_soft_caps_and_distance(spark):
    rows = [(1, i, i, 0, 100.0 * i, 90.0 - i, h, s, f) for i, (h, s, f) in enumerate([(0, "title", "title"), (2**40 - 1, "title", "title"), (2**20 - 1, "a", "content"), (2**20 - 2, "a", "content"), (2**60 - 2**40, "b", "content"), (2**30 - 2**10, "c", "content")])]
    df = spark.createDataFrame(rows, "run int, key int, ord int, source int, ts double, score double, h long, scene string, family string")
    got = {r.key for r in select.diverse_candidates(df, 3, final=True).collect()}
    assert len(got & {0, 1}) <= 1 and len(got & {2, 3}) <= 1 and len(got) == 3
    with pytest.raises(Exception, match="fewer than"):
        select.diverse_candidates(df, 7, final=True).collect()


def test_preselect_covers_sources(spark):
    df = spark.createDataFrame([(1, i, i, float(i), float(i % 7), i * 977, i % 12) for i in range(100)], "run int, key int, source int, ts double, score double, h long, bin int")
    got = [r.key for r in select.primary_preselect(df, 1).collect()]
    assert len(got) == 12 and len(set(got)) == 12


def test_backfill_takes_the_uncovered_source(spark):
    rows = [(1, i, int(i >= 4), float(i), 50.0 - i, i * 1023, i != 3) for i in range(8)]
    df = spark.createDataFrame(rows, "run int, key int, source int, ts double, score double, h long, assessed boolean")
    order = select.backfill_order(df.where("assessed").withColumn("is_transition", F.col("source") == 0), df.select("run", "source").distinct(), 2)
    assert [(r.source, r.target) for r in order.collect()] == [(0, 3)]
    assert [r.key for r in select.source_backfill(df, order).collect()] == [3]


def test_names_collide_without_regard_to_case(spark):
    df = spark.createDataFrame([(1, 0, "A", ".png"), (1, 1, "a", ".PNG"), (1, 2, "A", ".png")], "run int, o int, scene string, suffix string")
    got = [r.name for r in interleave.output_names(df, "run", "o", 5).orderBy("o").collect()]
    assert got == ["A0001.png", "a0001_1.PNG", "A0002.png"]


def chunks_by_loop(sizes, budget, least):
    """Plain walk of one run: chunk of each size."""
    bounds, start, total, count = [], 0, 0, 0
    for i, z in enumerate(sizes):
        if i and total + z > budget and count >= least:
            bounds.append((start, i))
            start, total, count = i, z, 1
        else:
            total, count = total + z, count + 1
    bounds.append((start, len(sizes)))
    if len(bounds) > 1 and bounds[-1][1] - bounds[-1][0] < least:
        end = bounds.pop()[1]
        bounds[-1] = (bounds[-1][0], end)
    return [n for n, (a, b) in enumerate(bounds) for _ in range(b - a)]


@pytest.mark.parametrize("batch, least, block, parts", [(10_000, 16, 65_536, 8), (7, 4, 5, 4), (10_000, 5, 1, 2), (10_000, 1, 20, 8), (10_000, 40, 13, 8)])
def test_memory_chunks_equal_the_loop(spark, batch, least, block, parts):
    rng = np.random.default_rng(least)
    runs = {"hot": 400, None: 37, "a": 1, "b": 3, "c": 16}
    rows = [(r, i, None if i % 29 == 5 else int(rng.choice([0, 3, 40, 90, 400]))) for r, n in runs.items() for i in range(n)]
    df = spark.createDataFrame(rows, "run string, o long, size long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = interleave.memory_chunks(df, "size", 200, ["o"], ["run"], least, unknown=150, block=block, parts=parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run in runs:
        own = [150 if z is None else z for r, _, z in rows if r == run]
        assert [x.chunk for x in sorted(got, key=lambda x: x.o) if x.run == run] == chunks_by_loop(own, 200, least)


def test_memory_chunks_of_nothing(spark):
    assert interleave.memory_chunks(spark.createDataFrame([], "run string, o long, size long"), "size", 200, ["o"], ["run"]).count() == 0


def test_shortlist(spark):
    assert [select.shortlist_size(n) for n in (-1, 0, 30, 100, 200, 600, 2000, 3000)] == [500, 500, 500, 1000, 2000, 2000, 2000, 3300]
    vectors = [(1, 0), (0.9, 0.1), (0, 1), (0.1, 0.9)]
    rows = [(r, i, 4.0 - i, [float(x) for x in v]) for r, part in ((1, vectors), (2, vectors[:2])) for i, v in enumerate(part)]
    df = spark.createDataFrame(rows, "run int, key int, quality double, features array<double>")
    got = sorted((r.run, r.place, r.key) for r in select.shortlist(df, 3, [0.5]).collect())
    assert got == [(1, 1, 0), (1, 2, 2), (1, 3, 1), (2, 1, 0), (2, 2, 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, int(rng.integers(0, 50)), rng.normal(size=3).tolist()) for g, n in (("a", 300), (None, 220), ("b", 30)) for i in range(n)]
    return spark.createDataFrame(rows, "g string, key long, o int, v array<double>").repartition(5)


@pytest.mark.parametrize("block", [7, 64])
@pytest.mark.parametrize("at_least", [0.6, 0.97])
def test_leader_groups_in_blocks(vectors, monkeypatch, block, at_least):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "SLICE", 50)
    want = similarity.leader_groups(vectors, "g", "key", "o", "v", at_least).collect()
    assert len(want) == 550 and sorted(map(repr, want)) == sorted(map(repr, similarity.leader_groups(vectors, "g", "key", "o", "v", at_least, most=100).collect()))


@pytest.mark.parametrize("count, steps", [(0, [0.5]), (4, [0.5]), (12, [0.3, 0.6, 0.9]), (40, [0.6, 0.9]), (400, [0.5, 0.995])])
def test_diverse_filter_in_blocks(vectors, monkeypatch, count, steps):
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "SLICE", 50)
    want = similarity.diverse_filter(vectors, "g", "key", "o", "v", count, steps).collect()
    assert len(want) == 550 and sorted(map(repr, want)) == sorted(map(repr, similarity.diverse_filter(vectors, "g", "key", "o", "v", count, steps, most=100).collect()))


def scene_select_by_loop(rows, count, steps):
    """rows: dicts in turn order with key, segment, role, unit vector."""
    chosen = []
    for late in (False, True):
        part = [r for r in rows if (r["segment"] == 2) == late]
        for t in steps:
            for r in part:
                if len(chosen) >= min(count, len(rows)) or r in chosen:
                    continue
                limit = max(t, 0.98) if r["role"] == "recurring_gameplay" else t
                if all(float(np.dot(r["u"], c["u"])) <= limit for c in chosen):
                    chosen.append(r)
    return [r["key"] for r in chosen]


def test_scene_select_equals_the_loop(spark, small):
    from lumeset.plans.registered import scene_select, turns

    rows = turns(spark, small).select("run", "key", "turn", "segment", "role", "features").collect()
    got = {}
    for r in sorted(scene_select(spark, small).collect(), key=lambda r: r.pick):
        got.setdefault(r.run, []).append(r.key)
    for run in got:
        own = sorted((r for r in rows if r.run == run), key=lambda r: r.turn)
        table = [{"key": r.key, "segment": r.segment, "role": r.role, "u": np.asarray(r.features) / np.linalg.norm(r.features)} for r in own]
        assert got[run] == scene_select_by_loop(table, 20, similarity.ladder(0.1))


def best_first(rows):
    return sorted(rows, key=lambda r: (-r.score, r.ts, r.key))


def far(a, b, bits):
    return ((a.h ^ b.h) & (2**64 - 1)).bit_count() >= bits


def first_apart(rows, taken, chosen, bits):
    left = [r for r in rows if r.key not in taken]
    return next((r for r in left if all(far(r, c, bits) for c in chosen)), left[0] if left else None)


def preselect_by_loop(rows, count, bits):
    target, taken, of_source, of_bin = min(12 * count, len(rows)), [], {}, {}
    sources = sorted({r.source for r in rows}, key=lambda s: (-best_first([r for r in rows if r.source == s])[0].score, s))[:target]

    def take(r):
        taken.append(r.key)
        of_source.setdefault(r.source, []).append(r)
        of_bin.setdefault(r.bin, []).append(r)

    for _ in range(3 if len({r.source for r in rows}) <= count else 1):
        for s in sources:
            if len(taken) < target and (r := first_apart(best_first([r for r in rows if r.source == s]), [x.key for x in of_source.get(s, [])], of_source.get(s, []), bits)):
                take(r)
    while len(taken) < target:
        for b in sorted({r.bin for r in rows}):
            if len(taken) < target and (r := first_apart(best_first([r for r in rows if r.bin == b]), taken, of_bin.get(b, []), bits)):
                take(r)
    return set(taken)


def test_preselect_equals_the_loop(spark, small):
    from lumeset.plans.registered import binned, primary_preselect
    from lumeset.sources.tables import candidates

    rows, got = binned(candidates(spark, small), 3).collect(), {}
    for r in primary_preselect(spark, small).collect():
        got.setdefault(r.run, set()).add(r.key)
    assert got == {run: preselect_by_loop([r for r in rows if r.run == run], 3, 30) for run in {r.run for r in rows}}


def test_backfill_equals_the_loop(spark, small):
    from lumeset.plans.registered import COUNT, source_backfill
    from lumeset.sources.tables import candidates

    rows, got, want = candidates(spark, small).collect(), {}, {}
    for r in source_backfill(spark, small).collect():
        got.setdefault(r.run, set()).add(r.key)
    for run in {r.run for r in rows}:
        own = [r for r in rows if r.run == run]
        done = [r for r in own if r.key % 3 == 0]
        sources = sorted({r.source for r in own})
        alive = {s: sum(r.source == s and r.key % 4 == 0 for r in done) for s in sources}
        bare = [s for s in sources if not alive[s]] if len(sources) <= COUNT else []
        short = max(0, COUNT - sum(alive.values()))
        order, target = (bare, 3 * len(bare)) if bare else (sorted(sources, key=lambda s: (alive[s], s)), 3 * short)
        taken, chosen = {s: [r for r in done if r.source == s] for s in sources}, []
        moved = True
        while len(chosen) < target and moved:
            moved = False
            for s in order:
                if len(chosen) < target and (r := first_apart(best_first([r for r in own if r.source == s and r.key % 3]), chosen, taken[s], 30)):
                    taken[s].append(r)
                    chosen.append(r.key)
                    moved = True
        if chosen:
            want[run] = set(chosen)
    assert got == want
