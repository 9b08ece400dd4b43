"""Greedy walks over groups that are too large for one task, with the same result as row by row.

The first rows of what is left of each group are walked in one task; what they chose then meets all later rows of the group, spread over
tasks, and rows that this decides leave. So no task ever holds more of a group than a block or a slice, whatever its size; how often this
is repeated follows the number of rows that nothing before them decides, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.operators.walks import walk
from lumeset.session import materialise

BLOCK = 1000  # rows of a group that are walked at once; up to this many, Spark cuts each partition down to them before it shuffles
SLICE = 4096  # rows of a group, about, that meet the chosen ones in one task
ORDER = ["o", "key", "_id"]


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-8, 0.0, x / np.where(n < 1e-8, 1.0, n))


def by_size(rows: DataFrame, group: list[str], most: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of groups of up to ``most`` rows; rows of larger ones with their group's number ``_g``, an ``_id`` and a slice; and the larger groups."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    if sizes.isEmpty():
        return rows, None, None
    sizes = materialise(sizes.select("*", F.monotonically_increasing_id().alias("_g"), F.ceil(F.col("_n") / SLICE).alias("_slices")), "sizes")
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(sizes[c]) for c in group))
    large = rows.join(sizes, same).select(*(rows[c] for c in rows.columns), "_g", "_slices", F.monotonically_increasing_id().alias("_id"))
    large = large.withColumn("_slice", F.pmod(F.xxhash64("_id"), "_slices")).drop("_slices")
    return rows.join(sizes, same, "left_anti"), materialise(large, "large"), sizes.select("_g", "_slices")


def first_rows(left: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("_g").orderBy(*ORDER))
    return left.withColumn("_place", place).where(F.col("_place") <= BLOCK).drop("_place")


def sieve(left: DataFrame, chosen: DataFrame, sizes: DataFrame, near: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """left with ``hit``: the smallest n of the group's ``chosen`` (_g, n, v) whose cosine with the row is ``near``, 0 if there is none."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))
    spread = chosen.select("_g", "n", F.col("v").alias("v")).join(sizes, "_g").select("_g", "n", "v", every.alias("_slice"))

    def meet(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(rows), np.int32)
        if len(rows) and len(heads):
            heads = heads.sort_values("n")
            x, y = (unit_rows(np.stack(f["v"].to_numpy()).astype(float)) for f in (rows, heads))
            close = near(rows, x @ y.T)
            hit = np.where(close.any(axis=1), heads["n"].to_numpy()[close.argmax(axis=1)], 0).astype(np.int32)
        return rows.assign(hit=hit)

    schema = ", ".join(f"`{c}` {t}" for c, t in left.dtypes) + ", hit int"
    return left.groupBy("_g", "_slice").cogroup(spread.groupBy("_g", "_slice")).applyInPandas(meet, schema)


def near_any(large: DataFrame, sizes: DataFrame, bits: int) -> DataFrame:
    """Rows of large (_g, _id, _slice, h, seed) that are no seed, with ``near``: whether a seed of the group differs in fewer than ``bits`` bits.

    Seeds meet the other rows a block of distinct hashes and a slice of rows at a time.
    """
    seeds = large.where("seed").select("_g", "h").distinct().withColumn("_block", F.pmod(F.xxhash64("h"), F.lit(1 << 20)))
    counted = seeds.groupBy("_g").agg(F.ceil(F.count("*") / SLICE).alias("_blocks"))
    seeds = seeds.join(counted, "_g").join(sizes, "_g").select("_g", F.pmod("_block", "_blocks").alias("_block"), "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)).alias("_slice"))
    free = large.where(~F.col("seed"))
    dealt = free.select("_g", "_id", "_slice", "h").join(counted, "_g").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))

    def meet(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        a, b = (f["h"].to_numpy(np.int64).view(np.uint64) for f in (rows, heads))
        near = np.zeros(len(a), bool)
        for h in b:
            near |= np.bitwise_count(a ^ h) < bits
        return rows[["_id"]][near]

    on = ["_g", "_slice", "_block"]
    seeds = seeds.toDF(*seeds.columns)  # columns of its own: both sides come from large
    found = dealt.groupBy(*on).cogroup(seeds.groupBy(*on)).applyInPandas(meet, "_id long").distinct().withColumn("near", F.lit(True))
    return free.join(found, "_id", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def leaders_of_large(large: DataFrame, sizes: DataFrame, names: list[str], at_least: float, lead: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """names, leader of the rows of large groups. ``lead`` numbers the leaders within a block of unit vectors."""
    kind, left, done = dict(large.dtypes), large, []
    found = sizes.select("_g", F.lit(0).alias("found"))

    def one(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        number = lead(unit_rows(np.stack(rows["v"]).astype(float)))
        first = np.zeros(len(number), bool)
        first[np.unique(number, return_index=True)[1]] = True
        return {**{c: rows[c] for c in [*names, "_g", "_id", "v"]}, "n": (number + rows["found"]).astype(np.int32), "leads": first}

    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*names, "_g", "_id", "v"]) + ", n int, leads boolean"
    while not left.isEmpty():
        block = materialise(walk(first_rows(left).join(found, "_g"), ["_g"], ORDER, one, schema), "block")
        rest = left.join(block.select("_id"), "_id", "left_anti").select(*large.columns)
        tested = materialise(sieve(rest, block.where("leads"), sizes, lambda rows, cos: cos >= at_least), "tested")
        done += [block.select(*names, F.col("n").alias("leader")), tested.where("hit > 0").select(*names, F.col("hit").alias("leader"))]
        left = tested.where("hit = 0").select(*large.columns)
        found = block.groupBy("_g").agg(F.max("n").alias("found"))  # a group without a block has no rows left
    return reduce(DataFrame.union, done)


def picks_of_large(large: DataFrame, sizes: DataFrame, names: list[str], count: int, passes: list[tuple[Column, Column]], pick: Callable[[np.ndarray, int, np.ndarray], list[int]]) -> DataFrame:
    """names, pick, refused of the rows of large groups, walked in passes: each over the rows of a condition, at a threshold by row.

    ``pick`` gives the places of up to so many unit vectors of a block that are unlike under their thresholds.
    """
    kind, columns = dict(large.dtypes), large.columns
    carried = ["_g", *ORDER, "v"]
    schema = ", ".join(f"`{c}` {kind[c]}" for c in carried) + ", n int, step int"
    chosen = large.sparkSession.createDataFrame([], schema)
    like = lambda rows, cos: cos > rows["_t"].to_numpy(float)[:, None]

    for step, (of, threshold) in enumerate(passes):
        left = large.where(of).withColumn("_t", threshold.cast("double"))
        columns = left.columns
        if step:
            left = sieve(left.join(chosen.select("_id"), "_id", "left_anti").select(*columns), chosen, sizes, like).where("hit = 0").select(*columns)
        while True:
            have = sizes.select("_g").join(chosen.groupBy("_g").agg(F.max("n").alias("have")), "_g", "left").select("_g", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < count)
            left = materialise(left.join(have, "_g", "left_semi").select(*columns), "left")
            if left.isEmpty():
                break

            def one(rows: dict[str, np.ndarray], step: int = step) -> dict[str, np.ndarray]:
                have = int(rows["have"][0])
                taken = pick(unit_rows(np.stack(rows["v"]).astype(float)), count - have, rows["_t"].astype(float))
                n = np.arange(have + 1, have + len(taken) + 1, dtype=np.int32)
                return {**{c: rows[c][taken] for c in carried}, "n": n, "step": np.full(len(taken), step, np.int32)}

            block = materialise(first_rows(left).join(have, "_g"), "block")
            picked = materialise(walk(block, ["_g"], ORDER, one, schema), "picked")
            chosen = chosen.union(picked)
            rest = left.join(block.select("_id"), "_id", "left_anti").select(*columns)
            left = sieve(rest, picked, sizes, like).where("hit = 0").select(*columns)
    # a row was refused if it was met before the last place was given away: in an earlier pass, or in the last one at an earlier place
    place = F.struct(*ORDER)
    last = chosen.where(F.col("n") == count).select("_g", place.alias("last"), F.col("step").alias("ended"))
    found = large.join(chosen.select("_id", "n"), "_id", "left").join(last, "_g", "left")
    met = F.lit(count > 0) & F.col("n").isNull() & (F.col("last").isNull() | (F.col("ended") > 0) | (place < F.col("last")))
    return found.select(*names, F.coalesce("n", F.lit(0)).alias("pick"), met.alias("refused"))
