"""Greedy choices from groups of any size: the same rows, in the same order, as one by one over all rows.

How a row stands - its tier (small is good), then its total, then score, earlier time and ties - only gets worse as other rows are chosen. So a standing
computed earlier bounds what the row can be later, and the best standing of a slice of rows bounds the whole slice. A round computes the standings of
those slices whose bound reaches the best rows known (at first of all), takes the best rows of each together in one task, and goes on choosing there as long
as the best of them is ahead of everything that was left behind. Slices are bands of scores, so that most are never looked at again.

A round makes at least one choice for each group. A task holds one slice, or the HEADS best rows of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.session import materialise

HEADS, TOP, OF_SOURCE = 1024, 256, 4  # best rows of a group in a round; of a slice; and of a slice's source while sources come first
BANDS, FEW = 64, 1000  # bands of scores; groups whose cuts are broadcast
AHEAD = 128  # the standing of this head says which slices the next round looks at
Columns = dict[str, np.ndarray]
STANDING = ["tier", "fall", "score", "ts", "tie1", "tie2"]


class Diverse:
    """Rows under the utility of a diverse choice: score, and what scene, source, look and time add that differ from the rows chosen."""

    extras = ("source", "scene", "scale", "family")

    def __init__(self, rows: Columns, count: int, sources: int, bits: int, visual: float, time: float, duplicate: float, caps: dict[str, int] | None):
        code = lambda c: np.unique(rows[c].astype(str), return_inverse=True)
        (self.scenes, self.scene), (self.sources, self.source), (self.families, self.family) = code("scene"), code("source"), code("family")
        n = len(rows["h"])
        self.h, self.ts, self.score, self.scale = rows["h"].astype(np.int64).view(np.uint64), rows["ts"].astype(float), rows["score"].astype(float), rows["scale"].astype(float)
        self.count, self.all_sources, self.bits, self.weights, self.caps = count, sources, bits, (visual, time, duplicate), caps
        self.vd, self.td, self.chosen = np.full(n, 64), self.scale.copy(), 0
        self.of_scene, self.of_source, self.shown = (np.zeros(len(x)) for x in (self.scenes, self.sources, self.families))
        self.cap = np.array([(caps or {}).get(f, np.inf) for f in self.families.tolist()])
        self.weighed = np.where(self.families == "content", 0.0, 1.5)

    def phase(self) -> int:
        """0 while sources without a choice come first."""
        return int(self.chosen >= min(self.count, self.all_sources))

    def add(self, rows: Columns) -> None:
        """Rows that are chosen, of this group, in any order."""
        n = len(rows["h"])
        if not n:
            return
        self.chosen += n
        for values, count, c in ((self.scenes, self.of_scene, "scene"), (self.families, self.shown, "family")):
            for v in rows[c].astype(str):
                at = np.searchsorted(values, v)
                if at < len(values) and values[at] == v:
                    count[at] += 1
        for h in rows["h"].astype(np.int64).view(np.uint64):
            self.vd = np.minimum(self.vd, np.bitwise_count(self.h ^ h))
        for v, t in zip(rows["source"].astype(str), rows["ts"].astype(float), strict=True):
            at = np.searchsorted(self.sources, v)
            if at < len(self.sources) and self.sources[at] == v:
                same = self.source == at
                away = np.abs(self.ts - t)
                self.td = np.where(same, np.minimum(self.td, away) if self.of_source[at] else away, self.td)
                self.of_source[at] += 1

    def standing(self) -> tuple[np.ndarray, np.ndarray]:
        visual, time, duplicate = self.weights
        total = self.score + 14.0 / (self.of_scene[self.scene] + 1) + 12.0 / (self.of_source[self.source] + 1) + np.minimum(32, self.vd) * visual + np.minimum(self.scale, self.td) / self.scale * time
        tier = np.zeros(len(total), np.int64)
        if self.caps is not None:
            total = total - (self.shown * self.weighed)[self.family]
            tier += 2 * (self.shown >= self.cap)[self.family] + (self.vd < self.bits)
        if not self.phase():
            tier += 4 * (self.of_source[self.source] > 0)
        return tier, total - np.where((self.vd < self.bits) & (self.td < 60), duplicate, 0.0)


class Apart:
    """Rows in their order, those apart from all chosen ones first; ``near`` rows are so to some row from the start."""

    extras = ("near",)

    def __init__(self, rows: Columns, bits: int):
        self.h, self.bits, self.near = rows["h"].astype(np.int64).view(np.uint64), bits, rows["near"].astype(bool)

    def phase(self) -> int:
        return 1

    def add(self, rows: Columns) -> None:
        for h in rows["h"].astype(np.int64).view(np.uint64):
            self.near = self.near | (np.bitwise_count(self.h ^ h) < self.bits)

    def standing(self) -> tuple[np.ndarray, np.ndarray]:
        return self.near.astype(np.int64), np.zeros(len(self.h))


Kernel = Callable[[Columns, dict], Diverse | Apart]


def best_of(left: np.ndarray, tier: np.ndarray, total: np.ndarray, rows: Columns) -> int:
    """The row left with the best standing."""
    at = np.flatnonzero(left)
    for x in (tier, -total, -rows["score"], rows["ts"], rows["tie1"]):
        v = x[at]
        at = at[v == v.min()]
        if len(at) == 1:
            return int(at[0])
    v = rows["tie2"][at]
    return int(at[v == v.min()][0])


def take(rows: Columns, at: np.ndarray | list[int]) -> Columns:
    return {c: x[at] for c, x in rows.items()}


def choose(rows: Columns, kernel: Kernel, meta: dict, begun: np.ndarray | None = None) -> list[int]:
    """Up to meta["target"] of the rows, one by one; rows that are ``begun`` count as chosen before."""
    k, left, chosen = kernel(rows, meta), np.ones(len(rows["h"]), bool), []
    if begun is not None:
        left &= ~begun
        k.add(take(rows, np.flatnonzero(begun)))
    while len(chosen) < meta["target"] and left.any():
        best = best_of(left, *k.standing(), rows)
        chosen.append(best)
        left[best] = False
        k.add(take(rows, [best]))
    return chosen


def key_of(row: Columns, i: int, tier, total) -> tuple:
    return (int(tier[i]), -float(total[i]), -float(row["score"][i]), float(row["ts"][i]), row["tie1"][i], row["tie2"][i])


def banded(large: DataFrame, sizes: DataFrame) -> DataFrame:
    """large with ``_slice`` by bands of scores, each split by hash where it holds more than a slice."""
    cuts = large.groupBy("_g").agg(F.percentile_approx("score", [k / BANDS for k in range(1, BANDS)], 1000).alias("_cuts"))
    bands = F.least(F.lit(BANDS), F.col("_slices"))
    band = F.floor(F.size(F.filter("_cuts", lambda x: x > F.col("score"))) * bands / BANDS)
    parts = F.ceil(F.col("_slices") / BANDS)
    cuts = sizes.join(cuts, "_g")
    # a row a group, which goes to every task if so few groups are large
    cuts = F.broadcast(cuts) if sizes.limit(FEW + 1).count() <= FEW else cuts
    return large.drop("_slice").join(cuts, "_g").withColumn("_slice", band * parts + F.pmod(F.xxhash64("_id"), parts)).drop("_cuts", "_slices")


def chosen_columns(chosen: list | None, fields: list[str]) -> Columns:
    rows = [] if chosen is None or isinstance(chosen, float) else list(chosen)
    return {c: np.array([r[c] for r in rows], None if rows and c != "h" else (np.int64 if c in ("h", "_id") else float if c == "ts" else object)) for c in fields}


def choose_large(large: DataFrame, sizes: DataFrame, names: list[str], meta: DataFrame, kernel: Kernel, extras: tuple[str, ...]) -> DataFrame:
    """names and pick (from 1) of up to ``target`` rows of each large group (see ``blocks.by_size``).

    large: names, _g, _id, score, ts, tie1, tie2, h and extras. meta: _g, target and what else the kernel needs; a row a group.
    """
    kind = dict(large.dtypes)
    own = ["_id", "score", "ts", "tie1", "tie2", "h", *extras]
    schema = "_g long, _slice long, " + ", ".join(f"`{c}` array<{kind[c]}>" for c in own)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": f["_g"].iloc[:1].to_numpy(), "_slice": f["_slice"].iloc[:1].to_numpy()} | {c: [f[c].to_numpy()] for c in own})

    packed = materialise(banded(large.select("_g", *own), sizes).groupBy("_g", "_slice").applyInPandas(pack, schema), "slices", **{"parquet.block.size": 16 << 20})
    kept = ["_id", "ts", "h", *extras]
    flat = ", ".join(f"`{c}` {kind[c]}" for c in own)
    done = large.sparkSession.createDataFrame([], f"_g long, n int, {flat}")
    places = meta.columns
    bounds = packed.select("_g", "_slice", F.lit(0).cast("long").alias("tier"), F.lit(-float("inf")).alias("fall"))  # the best that a row of the slice can be
    reach = None  # _g, tier, fall: slices that cannot be as good are passed over

    def opened(r) -> Columns:
        return {c: np.asarray(getattr(r, c)) for c in own}

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.rename(columns={"_g": "group", "_slice": "slice_", "_id": "id_"})
            for r in f.itertuples(index=False):
                rows = {"_id": np.asarray(r.id_)} | {c: np.asarray(getattr(r, c)) for c in own if c != "_id"}
                k = kernel(rows, {c: getattr(r, c) for c in places if c != "_g"})
                old = chosen_columns(r.chosen, kept)
                k.add(old)
                tier, total = k.standing()
                order = np.lexsort((rows["tie2"], rows["tie1"], rows["ts"], -rows["score"], -total, tier))
                order = order[~np.isin(rows["_id"][order], old["_id"])] if len(old["_id"]) else order
                if k.phase():
                    keep, last = order[: TOP + 1], np.arange(len(order[: TOP + 1])) == TOP
                else:  # the first rows of each source, and one more that tells where it goes on
                    of = pd.Series(rows["source"][order].astype(str)).groupby(rows["source"][order].astype(str)).cumcount().to_numpy()
                    keep, last = order[of <= OF_SOURCE], of[of <= OF_SOURCE] == OF_SOURCE
                if len(keep):
                    yield pd.DataFrame({"_g": r.group, "_slice": r.slice_} | {c: list(x[keep]) if x.dtype == object else x[keep] for c, x in rows.items()} | {"tier": tier[keep], "fall": -total[keep], "last": last})

    def go_on(heads: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(heads):
            return pd.DataFrame({c: [] for c in ["_g", "n", *own, "tier", "fall", "chosen"]})
        r = state.rename(columns={"_g": "group"}).iloc[0]
        heads = heads.sort_values(STANDING, ascending=[True, True, False, True, True, True], kind="stable").reset_index(drop=True)
        rows = {c: heads[c].to_numpy() for c in own}
        tier, total, last = heads["tier"].to_numpy(), -heads["fall"].to_numpy(), heads["last"].to_numpy(bool)
        start = [key_of(rows, i, tier, total) for i in range(len(heads))]
        k = kernel(rows, {c: r[c] for c in places if c != "_g"})
        old = chosen_columns(r["chosen"], kept)
        k.add(old)
        first = k.phase()
        cut = start[-1] if len(heads) >= HEADS else None
        passed = None if pd.isna(r["passed_tier"]) else (int(r["passed_tier"]), float(r["passed_fall"]))
        left, picks, ends = ~last, [], np.flatnonzero(last)
        sources = rows["source"].astype(str) if not first else None
        while len(old["_id"]) + len(picks) < int(r["target"]) and left.any() and k.phase() == first:
            tier, total = k.standing()
            best = best_of(left, tier, total, rows)
            key = key_of(rows, best, tier, total)
            # a source that has its choice is behind all others as a whole
            open_ends = (start[i] for i in ends if first or not np.isin(sources[i], [sources[p] for p in picks]))
            stop = next(open_ends, None)
            if (stop is not None and key > stop) or (cut is not None and key > cut) or (passed is not None and key[:2] >= passed):
                break
            picks.append(best)
            left[best] = False
            k.add(take(rows, [best]))
        tier, total = k.standing()
        at = np.flatnonzero(left)
        if k.phase() != first or not len(at):
            next_tier, next_fall = np.nan, np.nan
        else:
            i = at[np.lexsort((-total[at], tier[at]))][: AHEAD][-1]
            next_tier, next_fall = float(tier[i]), -float(total[i])
        out = pd.DataFrame({"_g": r["group"], "n": np.arange(len(picks), dtype=np.int32) + len(old["_id"]) + 1} | {c: list(rows[c][picks]) if rows[c].dtype == object else rows[c][picks] for c in own})
        return out.assign(tier=next_tier, fall=next_fall, chosen=True)

    while True:
        so_far = done.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("n", *kept))).alias("chosen"))  # at most target rows
        state = meta.join(so_far, "_g", "left").where(F.coalesce(F.size("chosen"), F.lit(0)) < F.col("target"))
        if reach is None:
            asked, passed = bounds, bounds.groupBy("_g").agg(F.lit(None).cast("long").alias("passed_tier"), F.lit(None).cast("double").alias("passed_fall"))
        else:
            met = bounds.join(reach, "_g").withColumn("in", F.col("to_tier").isNull() | (F.struct("tier", "fall") <= F.struct(F.col("to_tier").alias("tier"), F.col("to_fall").alias("fall"))))
            asked = met.where("in")
            passed = met.groupBy("_g").agg(F.min(F.when(~F.col("in"), F.struct("tier", "fall"))).alias("p")).select("_g", F.col("p.tier").alias("passed_tier"), F.col("p.fall").alias("passed_fall"))
        state = materialise(state.join(passed, "_g"), "state")
        if state.isEmpty():
            break
        seen = packed.join(asked.select("_g", "_slice"), ["_g", "_slice"], "left_semi").join(state, "_g").mapInPandas(look, f"_g long, _slice long, {flat}, tier long, fall double, last boolean")
        seen = materialise(seen, "seen")
        by = W.partitionBy("_g").orderBy("tier", "fall", F.desc("score"), "ts", "tie1", "tie2")
        heads = seen.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= HEADS).drop("_place", "_slice")
        made = heads.groupBy("_g").cogroup(state.groupBy("_g")).applyInPandas(go_on, f"_g long, n int, {flat}, tier double, fall double, chosen boolean")
        made = materialise(made, "made")
        done = done.union(made.select("_g", "n", *own))
        reach = made.groupBy("_g").agg(F.max("tier").cast("long").alias("to_tier"), F.max("fall").alias("to_fall"))
        reach = reach.withColumns({"to_tier": F.when(~F.isnan("to_fall"), F.col("to_tier")), "to_fall": F.when(~F.isnan("to_fall"), F.col("to_fall"))})
        fresh = seen.groupBy("_g", "_slice").agg(F.min(F.struct("tier", "fall")).alias("b")).select("_g", "_slice", "b.*")
        asked_now = asked.select("_g", "_slice")
        kept_bounds = bounds.join(asked_now, ["_g", "_slice"], "left_anti").select("_g", "_slice", "tier", "fall").union(fresh)
        # where sources have had their turn, tiers begin anew; totals still bound
        turned = reach.where("to_tier is null").select("_g", F.lit(True).alias("turned"))
        kept_bounds = kept_bounds.join(turned, "_g", "left").select("_g", "_slice", F.when(F.col("turned"), F.lit(0).cast("long")).otherwise(F.col("tier")).alias("tier"), "fall")
        bounds = materialise(kept_bounds, "bounds")
    return large.join(done.select("_id", F.col("n").alias("pick")), "_id").select(*names, "pick")

