"""Whole-input percentiles and ranks."""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.session import materialise

SLICES, FEW = 1024, 200_000  # slices of a metric's values; values of all metrics that go to every task as a table, a few MB
#: What is profiled, and the percentiles of it
PROFILED = ("brightness", "contrast", "edge_density", "action_intensity", "luminance_entropy", "luminance_range", "near_black_ratio", "near_white_ratio", "dominant_tone_ratio")
POINTS = (10, 25, 50, 90)
#: Weights of the information score
INFORMATION = {"contrast": 0.20, "edge_density": 0.25, "action_intensity": 0.15, "luminance_entropy": 0.20, "luminance_range": 0.20}


def rough(x: Column) -> Column:
    """A place among 2^12 for every number, never falling as x grows: by its sign and logarithm; NaN comes last."""
    size = F.log1p(F.abs(x) * 2.0**60) / math.log(2.0) * 10.9  # 188 octaves of single precision, eleven places each
    return F.when(F.isnan(x), 4095).otherwise(F.floor(F.when(x < 0, 2047 - F.least(size, F.lit(2047.0))).otherwise(2047 + F.least(size, F.lit(2047.0))))).cast("int")


def build_profile(df: DataFrame, metrics=PROFILED, points=POINTS, slots: int = 4096) -> DataFrame:
    """One row p_<metric>_<point>: exact percentiles with linear interpolation over single-precision values; 0 for an empty input.

    Values are narrowed down by histograms, pass by pass: a pass counts the values of the intervals that still hold a wanted rank in up to ``slots`` parts, and
    keeps the part with the rank, until the part holds one value. So a task holds counts of parts only, however many values there are; a
    pass reads the metrics once, and three or four suffice.
    """
    value = lambda m: F.col(m).cast("float").cast("double")
    each = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("m"), value(m).alias("v")) for i, m in enumerate(metrics)))).alias("e")).select("e.*").where("v is not null")
    counted = each.groupBy("m", rough(F.col("v")).alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    parts = [r.asDict() for r in counted.collect()]  # at most 4096 rows a metric
    found: dict[tuple[int, int], float] = {}
    wanted: dict[tuple[int, int], tuple[int, float, float]] = {}  # (metric, rank): rank within an interval, its ends
    ranks: dict[tuple[int, int], tuple[int, int, float]] = {}  # (metric, point): the ranks on both sides, and how far the point lies between

    def narrow(asked: list[tuple[tuple[int, int], int]], own: list[dict]) -> None:
        """Put each rank (of its interval) into the part of ``own`` that holds it."""
        own = sorted(own, key=lambda r: r["s"])
        ends = list(itertools.accumulate(r["n"] for r in own))
        for key, rank in asked:
            i = bisect.bisect_right(ends, rank)
            if own[i]["low"] == own[i]["high"] or math.isnan(own[i]["low"]):
                found[key] = own[i]["low"]
            else:
                wanted[key] = (rank - (ends[i] - own[i]["n"]), own[i]["low"], own[i]["high"])

    for i in range(len(metrics)):
        own = [r for r in parts if r["m"] == i]
        total = sum(r["n"] for r in own)
        for q in points:
            at = (total - 1) * (q / 100)
            ranks[i, q] = (math.floor(at), math.ceil(at), at) if total else (-1, -1, 0.0)
        narrow([((i, r), r) for r in sorted({r for q in points for r in ranks[i, q][:2] if r >= 0})], own)
    while wanted:
        intervals = sorted({(key[0], low, high) for key, (_, low, high) in wanted.items()})
        number = {x: j for j, x in enumerate(intervals)}
        table = F.broadcast(df.sparkSession.createDataFrame([(j, *x) for x, j in number.items()], "j int, m int, lo double, hi double"))  # two rows a metric and point at most
        inside = each.join(table, "m").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        part = F.least(F.lit(slots - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * slots)).cast("int")
        # the ends stand alone: of two values at least one part is always passed
        part = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), slots).otherwise(part)
        counted = inside.groupBy("j", part.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        parts = [r.asDict() for r in counted.collect()]  # slots a wanted rank at most
        now, wanted = wanted, {}
        for j, x in enumerate(intervals):
            narrow([(key, rank) for key, (rank, low, high) in now.items() if (key[0], low, high) == x], [r for r in parts if r["j"] == j])

    def between(i: int, q: int) -> float:
        low, high, at = ranks[i, q]
        if low < 0:
            return 0.0
        a, b = found[i, low], found[i, high]
        return a if low == high or a == b else (high - at) * a + (at - low) * b

    names = [f"p_{m}_{q}" for m in metrics for q in points]
    return df.sparkSession.createDataFrame([tuple(between(i, q) for i in range(len(metrics)) for q in points)], ", ".join(f"{c} double" for c in names))


def with_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Every row with the profile, whose one row becomes constants that rules can be folded with."""
    return df.withColumns({c: F.lit(x) for c, x in profile.first().asDict().items()})


def rank_table(df: DataFrame, metrics: list[str], slices: int = SLICES, few: int = FEW) -> tuple[DataFrame, bool]:
    """m, f, lt, le, total: for each single-precision value of each metric how many values are less, and no more, of how many; and whether the table is small.

    The values of all metrics are counted in one pass. Running counts are summed in slices and over the slices; slices are cut at quantiles of the distinct
    values, so that they are even whatever the values. NaN counts as the largest value.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).cast("float").cast("double").alias("f")) for m in metrics))).alias("e")
    counts = materialise(df.select(each).select("e.*").where("f is not null").groupBy("m", "f").agg(F.count("*").alias("n")), "counts")
    small = counts.limit(few + 1).count() <= few
    if small:
        sliced = counts.withColumn("s", F.lit(0))
    else:
        cuts = counts.groupBy("m").agg(F.percentile_approx("f", [k / slices for k in range(1, slices)], 10 * slices).alias("cuts"))
        # a row a metric; the number of cuts below a value is found by halving
        steps = max(1, (slices - 1).bit_length())
        place = F.lit(0)
        for k in reversed(range(steps)):
            place = F.when(F.coalesce(F.get("cuts", place + (1 << k) - 1) < F.col("f"), F.lit(False)), place + (1 << k)).otherwise(place)
        sliced = counts.join(F.broadcast(cuts), "m").withColumn("s", place).drop("cuts")
    sums = sliced.groupBy("m", "s").agg(F.sum("n").alias("sn"))
    by = W.partitionBy("m")
    sums = sums.select("m", "s", F.coalesce(F.sum("sn").over(by.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("sn").over(by).alias("total"))  # as many rows as slices
    run = F.sum("n").over(W.partitionBy("m", "s").orderBy("f"))
    ranked = sliced.withColumn("run", run).join(F.broadcast(sums), ["m", "s"])
    return ranked.select("m", "f", (F.col("base") + F.col("run") - F.col("n")).alias("lt"), (F.col("base") + F.col("run")).alias("le"), "total"), small


def with_ranks(df: DataFrame, names: dict[str, str], slices: int = SLICES, few: int = FEW, rows: DataFrame | None = None) -> DataFrame:
    """df (or ``rows``, the same rows in other partitions) with, for each metric of ``names``, the mean of the shares of values below, and up to, each row's value; null where the metric is.

    The values compared with are in single precision but the value itself is not, so it counts as above or below
    its own rounded value where rounding moved it. The table of values goes to every task if it is small, else rows meet it by their values.
    """
    table, small = rank_table(df, list(names), slices, few)
    table = materialise(table, "ranks")
    out = df if rows is None else rows
    for i, m in enumerate(names):
        own = table.where(F.col("m") == m).select(F.col("f").alias(f"_f{i}"), F.struct("lt", "le", "total").alias(f"_r{i}"))
        out = out.join(F.broadcast(own) if small else own, F.col(m).cast("float").cast("double") == F.col(f"_f{i}"), "left").drop(f"_f{i}")  # up to FEW rows
    for i, (m, name) in enumerate(names.items()):
        f, r = F.col(m).cast("float").cast("double"), F.col(f"_r{i}")
        left, right = F.when(f < F.col(m), r["le"]).otherwise(r["lt"]), F.when(f > F.col(m), r["lt"]).otherwise(r["le"])
        out = out.withColumn(name, (left + right) / 2.0 / r["total"])
    return out.drop(*(f"_r{i}" for i in range(len(names))))


def with_rank(df: DataFrame, metric: str, name: str) -> DataFrame:
    """df with the rank of one metric (see ``with_ranks``)."""
    return with_ranks(df, {metric: name})


def with_information(df: DataFrame, weights=INFORMATION, rows: DataFrame | None = None) -> DataFrame:
    """df with ``information``: weighted percentile ranks. The rows need no key; ``rows`` are as in ``with_ranks``."""
    out = with_ranks(df, {m: f"_rank_{m}" for m in weights}, rows=rows)
    total = F.lit(0.0)
    for m, w in weights.items():
        total = total + F.col(f"_rank_{m}") * w
    return out.withColumn("information", total).drop(*(f"_rank_{m}" for m in weights))
