"""Greedy choices that depend on what was chosen before.

Groups of up to ``MOST_ROWS`` rows are walked in a task each, larger ones in rounds (``lazy.py``, ``blocks.py``) with the same result; groups are
independent, so Spark deals them out. Everything that does not depend on the order of choices happens before, in plain columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.operators.allocate import round_robin
from lumeset.operators.blocks import by_size, near_any, picks_of_large, unit_rows
from lumeset.operators.lazy import Apart, Diverse, choose, choose_large
from lumeset.operators.similarity import diverse_filter, walk_diverse
from lumeset.operators.walks import MOST_ROWS, walk

DISTINCT_BITS = 5
#: How many screens of a family are chosen before others of it come last, for so many outputs
SOFT_CAPS: dict[str, Callable[[int], int]] = {"title": lambda n: 1, "map": lambda n: max(1, math.ceil(n * 0.10)), "menu": lambda n: max(2, math.ceil(n * 0.15))}
#: Weights of look and time, and what a near duplicate loses, in the diverse and in the final choice
DIVERSE, FINAL = (0.60, 8.0, 30.0), (0.65, 9.0, 35.0)


def time_scales(source: np.ndarray, ts: np.ndarray, count: int) -> np.ndarray:
    """Each row's source's span over the number expected of it, 60 at least. Sources are numbered from 0."""
    n = int(source.max()) + 1
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, source, ts)
    np.maximum.at(high, source, ts)
    return np.maximum(60.0, (high - low) / max(1.0, count / n))[source]


def diverse_candidates(df: DataFrame, count: int, distinct_bits: int = DISTINCT_BITS, final: bool = False, strict: bool = True, most: int = MOST_ROWS) -> DataFrame:
    """run, key, pick (1-based) of the ``count`` rows chosen of each run: the largest utility among what is left, then score, earlier time, earlier row.

    df: run, key, ord, source, ts, score, h (64-bit hash), scene, and family if final. A run with fewer rows than count
    raises if strict, else all of it is chosen. final uses the weights, soft caps and preferences of the last choice. Runs of more than ``most`` rows are
    chosen from in rounds, with the same result.
    """
    weights = FINAL if final else DIVERSE

    def kernel(rows: dict[str, np.ndarray], meta: dict) -> Diverse:
        caps = {f: cap(int(meta["target"])) for f, cap in SOFT_CAPS.items()} if final else None
        return Diverse(rows, int(meta["target"]), int(meta["sources"]), distinct_bits, *weights, caps)

    def one(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(rows["key"])
        if n < count and strict:
            raise ValueError(f"{n} candidates are fewer than the {count} asked for")
        source = np.unique(rows["source"].astype(str), return_inverse=True)[1]
        ts = rows["ts"].astype(float)
        more = {"ts": ts, "score": rows["score"].astype(float), "tie1": np.arange(n), "tie2": np.zeros(n), "scale": time_scales(source, ts, min(count, n))}
        chosen = choose(rows | more, kernel, {"target": min(count, n), "sources": source.max() + 1})
        return {"run": rows["run"][chosen], "key": rows["key"][chosen], "pick": np.arange(1, len(chosen) + 1, dtype=np.int32)}

    kind = dict(df.dtypes)
    rows = df.select("run", "key", "ord", "source", "ts", "score", "h", "scene", F.col("family") if final else F.lit("content").alias("family"))
    small, large, sizes = by_size(rows, ["run"], most)
    found = walk(small, ["run"], ["ord", "key"], one, f"run {kind['run']}, key {kind['key']}, pick int")
    if large is None:
        return found
    spans = large.groupBy("_g", "source").agg((F.max("ts") - F.min("ts")).cast("double").alias("span"), F.count("*").alias("n"))
    meta = spans.groupBy("_g").agg(F.least(F.lit(count), F.sum("n")).cast("int").alias("target"), F.count("*").cast("int").alias("sources"))
    expected = F.greatest(F.lit(1.0), F.col("target") / F.col("sources"))
    scales = spans.join(meta, "_g").select(F.col("_g").alias("_h"), F.col("source").alias("_s"), F.greatest(F.lit(60.0), F.col("span") / expected).alias("scale"))
    same = (F.col("_g") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s"))
    cols = ["run", "key", "_g", "_id", F.col("score").cast("double").alias("score"), F.col("ts").cast("double").alias("ts"), F.col("ord").alias("tie1"), F.col("key").alias("tie2"), "h", *Diverse.extras]
    return found.union(choose_large(large.join(scales, same).select(*cols), sizes, ["run", "key"], meta, kernel, Diverse.extras))


def first_apart(df: DataFrame, group: list[str], distinct_bits: int = DISTINCT_BITS, most: int = MOST_ROWS) -> DataFrame:
    """The group's columns, key, pick: up to ``need`` rows of each group, one by one the first left that is apart from all taken, else the first left.

    df: the group's columns, key, score, ts, h, need (the same in a group) and ``seed``: rows taken before, which are not chosen. Rows come by (score, earlier ts, key).
    Groups of more than ``most`` rows are chosen from in rounds, with the same result.
    """

    def kernel(rows: dict[str, np.ndarray], meta: dict) -> Apart:
        return Apart(rows, distinct_bits)

    def one(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(rows["key"])
        more = {"ts": rows["ts"].astype(float), "score": rows["score"].astype(float), "tie1": rows["key"], "tie2": np.arange(n), "near": np.zeros(n, bool)}
        chosen = choose(rows | more, kernel, {"target": int(rows["need"][0])}, rows["seed"].astype(bool))
        return {**{c: rows[c][chosen] for c in [*group, "key"]}, "pick": np.arange(1, len(chosen) + 1, dtype=np.int32)}

    kind = dict(df.dtypes)
    rows = df.select(*group, "key", "score", "ts", "h", "seed", F.col("need").cast("int").alias("need"))
    small, large, sizes = by_size(rows, group, most)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*group, "key"]) + ", pick int"
    found = walk(small, group, ["key"], one, schema)
    if large is None:
        return found
    meta = large.groupBy("_g").agg(F.max("need").alias("target"))
    free = near_any(large, sizes, distinct_bits)
    cols = [*group, "key", "_g", "_id", F.col("score").cast("double").alias("score"), F.col("ts").cast("double").alias("ts"), F.col("key").alias("tie1"), F.col("_id").alias("tie2"), "h", "near"]
    return found.union(choose_large(free.select(*cols), sizes, [*group, "key"], meta, kernel, Apart.extras))


def representatives(df: DataFrame, group: list[str], count: int, distinct_bits: int = DISTINCT_BITS, most: int = MOST_ROWS) -> DataFrame:
    """The group's columns, key, pick: the best rows of each group by (score, earlier ts, key) that differ from those picked before."""
    return first_apart(df.withColumns({"need": F.lit(count), "seed": F.lit(False)}), group, distinct_bits, most)


def primary_preselect(df: DataFrame, count: int, distinct_bits: int = DISTINCT_BITS, multiple: int = 12, per_source: int = 3, most: int = MOST_ROWS) -> DataFrame:
    """run, key: up to ``multiple`` times ``count`` rows of each run, spread over its sources and time bins.

    df: run, key, source, ts, score, h, bin (see ``time_bins``). Sources come first, by their best score, then bins in turn.
    """
    rows = df.select("run", "key", "source", "ts", "score", "h", "bin")
    by = W.partitionBy("run")
    sources = rows.groupBy("run", "source").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    target = F.least(F.lit(count * multiple), F.sum("n").over(by))
    need = F.when(F.count("*").over(by) <= count, per_source).otherwise(1)
    sources = sources.select("run", "source", F.row_number().over(by.orderBy(F.col("best").desc(), "source")).alias("turn"), target.alias("target"), need.alias("need")).where(F.col("turn") <= F.col("target"))
    first = first_apart(joined(rows, sources, ["run", "source"]).withColumn("seed", F.lit(False)), ["run", "source"], distinct_bits, most)
    first = joined(first, sources, ["run", "source"]).withColumn("place", F.row_number().over(by.orderBy("pick", "turn"))).where(F.col("place") <= F.col("target")).select("run", "key", "target")
    taken = first.select("run", "key", F.lit(True).alias("seed"))
    marked = rows.join(taken, ["run", "key"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    left = first.groupBy("run").agg((F.max("target") - F.count("*")).alias("target"))
    bins = marked.groupBy("run", "bin").agg(F.count_if(~F.col("seed")).alias("free")).join(left, "run").withColumn("turn", F.col("bin"))
    bins = round_robin(bins).where("given > 0").select("run", "bin", F.col("given").alias("need"))
    rest = first_apart(marked.join(bins, ["run", "bin"]), ["run", "bin"], distinct_bits, most)
    return first.select("run", "key").union(rest.select("run", "key"))


def joined(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which nulls of the key are equal."""
    t = table.withColumnsRenamed({c: f"_{c}" for c in on})
    same = None
    for c in on:
        term = df[c].eqNullSafe(t[f"_{c}"])
        same = term if same is None else same & term
    return df.join(t, same).drop(*(f"_{c}" for c in on))


def source_backfill(df: DataFrame, order: DataFrame, distinct_bits: int = DISTINCT_BITS, most: int = MOST_ROWS) -> DataFrame:
    """run, key: unassessed rows that fill up sources in turn.

    df: run, key, source, ts, score, h, assessed. order: run, source, turn and target (rows wanted of the run; the same in a run).
    """
    rows = joined(df.select("run", "key", "source", "ts", "score", "h", F.col("assessed").alias("seed")), order, ["run", "source"])
    free = rows.groupBy("run", "source").agg(F.count_if(~F.col("seed")).alias("free"), F.max("turn").alias("turn"), F.max("target").alias("target"))
    given = round_robin(free).where("given > 0").select("run", "source", F.col("given").alias("need"))
    return first_apart(joined(rows, given, ["run", "source"]), ["run", "source"], distinct_bits, most).select("run", "key")


def backfill_order(df: DataFrame, sources: DataFrame, count: int, per_source: int = 3) -> DataFrame:
    """run, source, turn, target for ``source_backfill``: sources without a survivor if there are any and the run has no more sources than ``count``, else all by their survivors.

    df: run, source, is_transition of the assessed rows. sources: run, source.
    """
    alive = df.where(~F.col("is_transition")).groupBy("run", "source").agg(F.count("*").alias("alive"))
    by = W.partitionBy("run")
    s = sources.join(alive, ["run", "source"], "left").withColumn("alive", F.coalesce("alive", F.lit(0)))
    s = s.withColumn("bare", (F.col("alive") == 0) & (F.count("*").over(by) <= count))
    s = s.withColumn("bares", F.sum(F.col("bare").cast("int")).over(by)).withColumn("short", F.greatest(F.lit(0), F.lit(count) - F.sum("alive").over(by)))
    s = s.where(F.when(F.col("bares") > 0, F.col("bare")).otherwise(F.col("short") > 0))
    turn = F.row_number().over(by.orderBy("alive", "source"))
    return s.select("run", "source", turn.alias("turn"), (F.when(F.col("bares") > 0, F.col("bares")).otherwise(F.col("short")) * per_source).cast("int").alias("target"))


def similar_aware_choice(df: DataFrame, count: int, thresholds: list[float], recurring: float = 0.98, most: int = MOST_ROWS) -> DataFrame:
    """run, key, pick of rows in their turn (see ``interleave.scene_turns``), unlike those chosen before.

    df: run, key, turn, segment, role, features. Rows of a recurring role are held to the laxer of both thresholds. Cinematic overflow
    (segment 2) is looked at only after all steps over the rest, and if places are left. Runs of more than ``most`` rows are walked in blocks, with the same result.
    """

    def one(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = unit_rows(np.stack(rows["v"]).astype(float))
        steps = [np.where(rows["lax"].astype(bool), max(t, recurring), t) for t in thresholds]
        late = rows["late"].astype(bool)
        chosen: list[int] = []
        for part in (np.flatnonzero(~late), np.flatnonzero(late)):
            if len(chosen) < min(count, len(x)):
                walk_diverse(x, min(count, len(x)), steps, part, chosen)
        return {"run": rows["run"][chosen], "key": rows["key"][chosen], "pick": np.arange(1, len(chosen) + 1, dtype=np.int32)}

    kind = dict(df.dtypes)
    rows = df.select("run", "key", F.col("turn").alias("o"), (F.col("segment") == 2).alias("late"), (F.col("role") == "recurring_gameplay").alias("lax"), F.col("features").alias("v"))
    small, large, sizes = by_size(rows, ["run"], most)
    found = walk(small, ["run"], ["o"], one, f"run {kind['run']}, key {kind['key']}, pick int")
    if large is None:
        return found
    lax = F.col("lax")
    passes: list[tuple[Column, Column]] = [(F.col("late") == part, F.when(lax, max(t, recurring)).otherwise(t)) for part in (False, True) for t in thresholds]
    return found.union(picks_of_large(large, sizes, ["run", "key"], count, passes, walk_block).where("pick > 0").select("run", "key", "pick"))


def walk_block(x: np.ndarray, wanted: int, thresholds: np.ndarray) -> list[int]:
    chosen: list[int] = []
    walk_diverse(x, min(wanted, len(x)), [thresholds], np.arange(len(x)), chosen)
    return chosen


def shortlist_size(wanted: int, multiple: int = 10, least: int = 500, most: int = 2000, reserve: int = 10) -> int:
    """How many rows go on for ``wanted`` outputs: a multiple of them within bounds, or a reserve above them if they pass the upper bound."""
    wanted = max(wanted, 0)
    size = min(max(wanted * multiple, least), most)
    return size if wanted <= size else wanted + max(wanted // reserve, 1)


def shortlist(df: DataFrame, size: int, thresholds: list[float]) -> DataFrame:
    """run, key, place of the ``size`` rows of each run that go on: those unlike the ones before by quality, then the rest by quality.

    df: run, key, quality, features. A run of no more rows than ``size`` goes on whole, in the order of its keys.
    """
    by = W.partitionBy("run")
    ranked = df.withColumn("rank", F.row_number().over(by.orderBy(F.col("quality").desc(), "key"))).withColumn("n", F.count("*").over(by))
    large = diverse_filter(ranked.where(F.col("n") > size), "run", "key", "rank", "features", size, thresholds).where("pick > 0").select("run", "key", "pick")
    small = F.col("n") <= size
    order = [F.when(~small, F.col("pick").isNull()), F.when(~small, F.col("pick")), F.when(~small, F.col("rank")), "key"]
    found = ranked.select("run", "key", "rank", "n").join(large, ["run", "key"], "left")
    return found.withColumn("place", F.row_number().over(by.orderBy(*order))).where(F.col("place") <= size).select("run", "key", "place")
