"""Groups walked in order inside tasks: partitions are sorted by group, and a task goes through its groups batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_ROWS = 4000  # of a group that is walked as one; larger ones are walked in blocks or rounds

Columns = dict[str, np.ndarray]


def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
    if len(pdf) > MOST_ROWS:
        raise ValueError(f"a group of {len(pdf)} rows is walked in order; at most {MOST_ROWS} can be")
    return pdf


def group_starts(f: pd.DataFrame, group: list[str]) -> np.ndarray:
    """Places at which a group of sorted rows begins; nulls are equal to each other."""
    change = np.zeros(max(0, len(f) - 1), bool)
    for c in group:
        x, none = f[c].to_numpy(), f[c].isna().to_numpy()
        change |= ((x[1:] != x[:-1]) & ~(none[1:] & none[:-1])).astype(bool) | (none[1:] != none[:-1])
    return np.concatenate([[0], np.flatnonzero(change) + 1]) if len(f) else np.zeros(0, int)


def walked(batches: Iterator[pd.DataFrame], group: list[str], one: Callable[[Columns], Columns]) -> Iterator[pd.DataFrame]:
    """What ``one`` makes of each group of sorted rows, a frame for each batch; a group that goes on in the next batch waits for it."""
    held: pd.DataFrame | None = None

    def made(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns = {c: f[c].to_numpy() for c in f.columns}
        out = [one({c: x[a:b] for c, x in columns.items()}) for a, b in zip(starts, [*starts[1:], len(f)], strict=True)]
        return pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in out[0]})

    for f in batches:
        if not len(f):
            continue
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        starts = group_starts(f, group)
        last = int(starts[-1])
        held = bounded(f.iloc[last:].reset_index(drop=True))
        if last:
            yield made(f.iloc[:last], starts[:-1])
    if held is not None:
        yield made(held, np.zeros(1, int))


def walk(df: DataFrame, group: list[str], order: list[str], one: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """``one`` over each group's rows in order: many small groups share a batch."""
    ordered = df.repartition(*group).sortWithinPartitions(*group, *order)
    return ordered.mapInPandas(lambda batches: walked(batches, group, one), schema)
