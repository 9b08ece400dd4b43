"""Orders that take groups in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.operators.walks import group_starts
from lumeset.session import materialise


def variant_turns(df: DataFrame, scene: list[str]) -> DataFrame:
    """Add ``place`` in the scene: the first of every variant group, then the second, groups in the order of their best member.

    df: selection, quality, path, variant_group.
    """
    best = [F.col("selection").desc(), F.col("quality").desc(), F.col("path")]
    df = df.withColumn("_score", F.row_number().over(W.partitionBy(*scene).orderBy(*best)))
    group = W.partitionBy(*scene, "variant_group")
    df = df.withColumn("_k", F.row_number().over(group.orderBy("_score"))).withColumn("_first", F.min("_score").over(group))
    return df.withColumn("place", F.row_number().over(W.partitionBy(*scene).orderBy("_k", "_first"))).drop("_score", "_k", "_first")


def scene_turns(df: DataFrame, run: str = "run") -> DataFrame:
    """Add ``turn`` in the run and ``segment``: 0 within the quota, scenes in turn; 1 the rest scene by scene; 2 the rest of cinematic scenes.

    df: scene, first (order of the scene), place, quota, scene_role.
    """
    over = F.col("place") > F.col("quota")
    segment = F.when(~over, 0).when(F.col("scene_role") == "cinematic", 2).otherwise(1)
    order = [F.col("segment"), F.when(F.col("segment") == 0, F.col("place")).otherwise(0), F.col("first"), F.col("place")]
    return df.withColumn("segment", segment).withColumn("turn", F.row_number().over(W.partitionBy(run).orderBy(*order)))


def batches(df: DataFrame, run: list[str], order: list[str], size: int) -> DataFrame:
    """Add ``batch``: runs of ``size`` rows in order."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*run).orderBy(*order)) - 1) / size))


def cut(sizes: np.ndarray, budget: int, least: int, number: int, total: int, count: int) -> tuple[np.ndarray, int, int, int]:
    """Chunk of each size, going on in chunk ``number`` that holds ``count`` sizes of ``total``, and where this ends: number, total, count."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(len(sizes), np.int64)
    i = 0
    while True:
        # the first size that no longer fits; a chunk of fewer than ``least`` sizes takes more than its budget
        j = max(i, int(np.searchsorted(before[1:], budget - total + before[i], side="right")), i + max(least, 1) - count)
        out[i:j] = number
        if j >= len(sizes):
            return out, number, total + int(before[-1] - before[i]), count + len(sizes) - i
        i, number, total, count = j, number + 1, 0, 0


def summary(sizes: np.ndarray, budget: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What entering a block with an open chunk leads to: running sums of its first rows, and for each place at which a chunk may then break first, the numbers of chunks begun, and the open chunk's sum and count at the end.

    A chunk that enters breaks at the latest where one that began with the block would, so the table covers these rows only.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    reach = max(int(np.searchsorted(before[1:], budget, side="right")), least)  # where a chunk that begins with the block breaks
    reach = min(reach, len(sizes) - 1)
    begun, total, count = (np.zeros(reach + 1, np.int64) for _ in range(3))
    for p in range(reach + 1):
        _, number, total[p], count[p] = cut(sizes[p:], budget, least, 0, 0, 0)
        begun[p] = number + 1
    return before[1 : reach + 2], begun, total, count


def enter(entry: tuple[int, int, int], block, budget: int, least: int) -> tuple[int, int, int]:
    """(number, total, count) of the open chunk at the end of a block (n, whole, running, begun, total, count), entered with these."""
    number, total, count = entry
    first = max(int(np.searchsorted(block.running, budget - total, side="right")), least - count, 0)
    if first >= len(block.begun):  # no row of the block breaks the chunk
        return number, total + int(block.whole), count + int(block.n)
    return number + int(block.begun[first]), int(block.total[first]), int(block.count[first])


def memory_chunks(df: DataFrame, size: str, budget: int, order: list[str], run: list[str], least: int = 16, unknown: int = 1 << 20, block: int = 65_536, parts: int | None = None) -> DataFrame:
    """The columns of ``run`` and ``order``, and ``chunk``: numbers of runs of rows whose sizes fit the budget together.

    A chunk is closed before the row that would pass the budget, once it has ``least`` rows; a last one of fewer rows joins the one before.
    A null size counts as ``unknown``, a negative one as none. Null values of ``run`` are a run.

    Rows are dealt out by range, so that a run of any size is cut into blocks of many tasks. Each block tells, for the few places at which an open chunk may break
    in it, how it is left then; the blocks of a run are gone through by these tables alone, and then every block numbers its own rows.
    """
    kind = dict(df.dtypes)
    keep = [*run, *order]
    sizes = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(size).cast("long"), F.lit(unknown).cast("long")))
    # where rows are alike in run and order, what they were read with tells them apart, so that they can be split too
    rows = df.select(*keep, sizes.alias("_size"), F.spark_partition_id().alias("_from"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(least, 1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for f in batches:
            starts = group_starts(f, run)
            for a, b in zip(starts, [*starts[1:], len(f)], strict=True):
                for s in range(a, b, block):
                    g = f.iloc[s : min(s + block, b)]
                    seq += 1
                    yield pd.DataFrame({**{c: g[c].iloc[:1].to_numpy() for c in run}, "_part": part, "_seq": seq} | {c: [g[c].to_numpy()] for c in order} | {"_size": [g["_size"].to_numpy()]})

    of_run = "".join(f"`{c}` {kind[c]}, " for c in run)
    packed = rows.repartitionByRange(parts, *keep, "_from").sortWithinPartitions(*keep, "_from").mapInPandas(pack, f"{of_run}_part int, _seq int, " + ", ".join(f"`{c}` array<{kind[c]}>" for c in order) + ", _size array<long>")
    packed = materialise(packed, "blocks", **{"parquet.block.size": 16 << 20})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            each = [(len(x), int(x.sum()), *summary(x, budget, least)) for x in map(np.asarray, f["_size"])]
            yield f[[*run, "_part", "_seq"]].assign(**{c: [e[i] for e in each] for i, c in enumerate(("n", "whole", "running", "begun", "total", "count"))})

    tables = packed.mapInPandas(summed, f"{of_run}_part int, _seq int, n long, whole long, running array<long>, begun array<long>, total array<long>, count array<long>")

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state in which each block of a run is entered, and the run's last chunk if it is short."""
        seen, at, entry, last = [], None, (0, 0, 0), None

        def done() -> pd.DataFrame:
            short = entry[0] if entry[0] and entry[2] < least else -1
            return pd.DataFrame(seen, columns=["_part", "_seq", "number", "open", "held"]).assign(short=short)

        for f in batches:
            starts = set(group_starts(f, run).tolist())
            for i, r in enumerate(f.rename(columns={"_part": "part_", "_seq": "seq_"}).itertuples(index=False)):
                name = tuple(None if pd.isna(x) else x for x in r[: len(run)])
                if last is None or (i in starts and name != at):
                    if seen:
                        yield done()
                    seen, at, entry, last = [], name, (0, 0, 0), True
                seen.append((r.part_, r.seq_, *entry))
                entry = enter(entry, r, budget, least)
        if seen:
            yield done()

    # as many rows as blocks, with a table of a chunk's rows each
    entries = tables.repartition(*run).sortWithinPartitions(*run, "_part", "_seq").mapInPandas(through, "_part int, _seq int, number long, open long, held long, short long")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            f = f.rename(columns={"_size": "size_"})
            for i, r in enumerate(f.itertuples(index=False)):
                chunk, *_ = cut(np.asarray(r.size_), budget, least, int(r.number), int(r.open), int(r.held))
                chunk = np.where(chunk == r.short, chunk - 1, chunk)
                yield pd.DataFrame({**{c: f[c].iloc[[i] * len(chunk)].to_numpy() for c in run}, **{c: f[c].iloc[i] for c in order}, "chunk": chunk})

    met = packed.join(entries, ["_part", "_seq"]).select(*keep, "_size", "number", "open", "held", "short")
    return met.mapInPandas(numbered, ", ".join(f"`{c}` {kind[c]}" for c in keep) + ", chunk long")


def output_names(df: DataFrame, run: str, order: str, requested: int) -> DataFrame:
    """Add ``name``: scene, number in the scene, suffix; a name that equals an earlier one in lower case gets _1, _2 and so on."""
    width = max(4, len(str(requested)))
    number = F.row_number().over(W.partitionBy(run, "scene").orderBy(order))
    df = df.withColumn("_stem", F.concat("scene", F.lpad(number.cast("string"), width, "0")))
    again = F.row_number().over(W.partitionBy(run, F.lower(F.concat("_stem", "suffix"))).orderBy(order)) - 1
    name = F.when(again > 0, F.concat("_stem", F.lit("_"), again.cast("string"), "suffix")).otherwise(F.concat("_stem", "suffix"))
    return df.withColumn("name", name).drop("_stem")
