"""Groups and choices that depend on similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeset.operators.blocks import by_size, leaders_of_large, picks_of_large, unit_rows
from lumeset.operators.walks import MOST_ROWS, walk

LADDER = (0.72, 0.75, 0.78, 0.82, 0.87)


def ladder(base: float, steps=(0.03, 0.06, 0.10, 0.15), most: float = 0.98) -> list[float]:
    """Thresholds from strict to lenient."""
    return [base, *(min(base + d, most) for d in steps)]


def walk_diverse(x: np.ndarray, count: int, steps: list[np.ndarray], order: np.ndarray, chosen: list[int]) -> set[int]:
    """Add to ``chosen``, in order, rows whose cosine with all chosen ones is no more than their threshold in any step; returns those refused and never taken."""
    refused: set[int] = set()
    taken = set(chosen)
    for step in steps:
        for i in order:
            if len(chosen) >= count:
                break
            if i in taken:
                continue
            if chosen and bool((x[chosen] @ x[i] > step[i]).any()):
                refused.add(i)
                continue
            chosen.append(i)
            taken.add(i)
        if len(chosen) >= count:
            break
    return refused - taken


def diverse_filter(df: DataFrame, run: str, key: str, order: str, vec: str, count: int, thresholds: list[float], most: int = MOST_ROWS) -> DataFrame:
    """run, key, pick (1-based place, 0 if not chosen), refused: a run's rows taken in order while they are unlike those taken before.

    Runs of more than ``most`` rows are walked in blocks, with the same result.
    """

    def one(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = unit_rows(np.stack(rows["v"]).astype(float))
        chosen: list[int] = []
        refused = walk_diverse(x, min(count, len(x)), [np.full(len(x), t) for t in thresholds], np.arange(len(x)), chosen)
        place = np.zeros(len(x), np.int32)
        place[chosen] = np.arange(1, len(chosen) + 1)
        return {"run": rows["run"], "key": rows["key"], "pick": place, "refused": np.isin(np.arange(len(x)), list(refused))}

    def pick(x: np.ndarray, wanted: int, thresholds: np.ndarray) -> list[int]:
        chosen: list[int] = []
        walk_diverse(x, min(wanted, len(x)), [thresholds], np.arange(len(x)), chosen)
        return chosen

    rows = df.select(F.col(run).alias("run"), F.col(key).alias("key"), F.col(order).alias("o"), F.col(vec).alias("v"))
    kind = dict(rows.dtypes)
    small, large, sizes = by_size(rows, ["run"], most)
    found = walk(small, ["run"], ["o", "key"], one, f"run {kind['run']}, key {kind['key']}, pick int, refused boolean")
    return found if large is None else found.union(picks_of_large(large, sizes, ["run", "key"], count, [(F.lit(True), F.lit(t)) for t in thresholds], pick))


def leaders(x: np.ndarray, at_least: float) -> np.ndarray:
    """Number, from 1, of the leader of each unit vector: the first earlier one that is near enough, else itself."""
    heads, group = np.empty_like(x), np.zeros(len(x), np.int32)
    n = 0
    for i in range(len(x)):
        near = np.flatnonzero(heads[:n] @ x[i] >= at_least)
        if not len(near):
            heads[n] = x[i]
            n += 1
        group[i] = near[0] + 1 if len(near) else n
    return group


def leader_groups(df: DataFrame, scene: str | list[str], key: str, order: str, vec: str, at_least: float, most: int = MOST_ROWS) -> DataFrame:
    """The scene's columns, key, leader (number in the scene from 1): each row joins the first earlier leader that is near enough, else leads a group.

    Scenes of more than ``most`` rows are walked in blocks, with the same result.
    """
    scene = [scene] if isinstance(scene, str) else scene

    def one(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {**{c: rows[c] for c in scene}, "key": rows["key"], "leader": leaders(unit_rows(np.stack(rows["v"]).astype(float)), at_least)}

    rows = df.select(*scene, F.col(key).alias("key"), F.col(order).alias("o"), F.col(vec).alias("v"))
    kind = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in [*scene, "key"])
    small, large, sizes = by_size(rows, scene, most)
    found = walk(small, scene, ["o", "key"], one, f"{schema}, leader int")
    return found if large is None else found.union(leaders_of_large(large, sizes, [*scene, "key"], at_least, lambda x: leaders(x, at_least)))
