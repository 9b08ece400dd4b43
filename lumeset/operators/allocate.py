"""Sample positions, budgets and quotas in closed form.

The loops that hand out one unit at a time are ranks here: unit k of a key has a priority, and the first so many
units over all keys are granted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

MOST, STEP, MARGIN, TOLERANCE = 4000, 0.25, 0.05, 1e-9  # samples a run, least seconds between, at the ends, on counts
LONGEST_STEP = 10.0


def sample_capacity(duration: Column, interval: Column, start: Column, last: Column) -> Column:
    """Most samples of a source at the least step. last may be null."""
    end_margin = F.greatest(F.lit(MARGIN), interval)
    tight = MARGIN + end_margin >= duration
    low = F.when(tight, 0.0).otherwise(MARGIN)
    high = F.when(tight, F.greatest(F.lit(0.0), duration - end_margin)).otherwise(duration - end_margin)
    high = F.when(last.isNotNull(), F.least(high, last - start)).otherwise(high)
    return F.least(F.lit(MOST), F.floor(F.greatest(F.lit(0.0), high - low) / STEP + TOLERANCE) + 1).cast("long")


def sample_positions(sources: DataFrame, count: int) -> DataFrame:
    """key, i, ts: evenly spaced positions of each source for ``count`` outputs.

    sources: key, duration, end_margin, start, last (null if unknown). Nearly the whole source is covered; a short one gives up
    its margins, and down to one sample in the middle.
    """
    c, g, least, lit = F.col, F.greatest, F.least, F.lit
    need = float(max(0, count - 1)) * STEP
    df = sources.withColumn("em", g(lit(MARGIN), "end_margin")).withColumn("ds", least(lit(0.5), c("duration") / 4.0))
    df = df.withColumn("tight", MARGIN + c("em") >= c("duration"))
    df = df.withColumn("total", g(MARGIN + c("em"), least(c("ds") + g("ds", "em"), g(lit(0.0), c("duration") - need))))
    df = df.withColumn("s1", least("ds", c("total") / 2.0))
    df = df.withColumn("s2", F.when(c("s1") < MARGIN, lit(MARGIN)).otherwise(c("s1"))).withColumn("e2", c("total") - c("s2"))
    short_end = c("e2") < c("em")
    df = df.withColumn("s", F.when(c("tight"), 0.0).when(short_end, c("total") - c("em")).otherwise(c("s2")))
    df = df.withColumn("e", F.when(c("tight"), least("duration", "em")).when(short_end, c("em")).otherwise(c("e2")))
    df = df.withColumn("end", g("s", c("duration") - c("e")))
    known = c("last").isNotNull()
    df = df.withColumn("end", F.when(known, least("end", c("last") - c("start"))).otherwise(c("end")))
    df = df.withColumn("s", F.when(known, least("s", "end")).otherwise(c("s")))
    earliest = F.when(c("tight"), 0.0).otherwise(least(lit(MARGIN), c("end")))
    df = df.withColumn("s", F.when(known & (c("end") - c("s") < need), least("end", g(earliest, c("end") - need))).otherwise(c("s")))
    wanted = g(F.ceil(c("duration") / LONGEST_STEP) + 1, lit(max(count * 36, 120)))
    df = df.withColumn("n", g(lit(1), least(wanted, lit(MOST), F.floor((c("end") - c("s")) / STEP + TOLERANCE) + 1)).cast("long"))
    df = df.withColumn("a", c("start") + c("s")).withColumn("b", c("start") + c("end"))
    df = df.select("key", "n", "a", "b", F.explode(F.sequence(lit(0).cast("long"), c("n") - 1)).alias("i"))
    step = (c("b") - c("a")) / (c("n") - 1)
    ts = F.when(c("n") == 1, (c("a") + c("b")) / 2.0).when(c("i") == c("n") - 1, c("b")).otherwise(c("a") + c("i") * step)
    return df.select("key", "i", F.round(ts, 6).alias("ts"))


def weighted_counts(sources: DataFrame, run: str = "run") -> DataFrame:
    """run, key, n: ``target`` units of each run shared by highest averages.

    sources: run, key, ord, weight, least, most, target (the same in a run). Each key starts with ``least``; the unit that would be its k-th has
    priority weight / k; ties go to the lower ord. Only units over a priority that is low enough for the target are made: it is looked
    for on a grid, so a run makes little more than ``target`` units, and none if what its keys start with is as much.
    """
    w = F.greatest(F.col("weight"), F.lit(0.001))
    tops = sources.groupBy(run).agg(F.max(w).alias("top"), F.max("target").alias("wanted"), F.sum("least").alias("begun")).where("begun < wanted")
    tried = sources.join(tops, run).select(run, "wanted", "least", "most", w.alias("w"), "top", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("j"))
    held = F.greatest("least", F.least("most", F.floor(F.col("w") / (F.col("top") * F.pow(F.lit(1.17), -F.col("j"))))))
    enough = tried.groupBy(run, "j").agg(F.sum(held).alias("c"), F.max("wanted").alias("wanted"), F.max("top").alias("top")).where("c >= wanted")
    level = enough.groupBy(run).agg(F.min_by(F.col("top") * F.pow(F.lit(1.17), -F.col("j")), "j").alias("level"))
    last = F.least("most", F.greatest("least", F.coalesce(F.floor(w / F.col("level")) + 1, F.col("most"))))
    units = sources.join(tops.select(run), run, "left_semi").join(level, run, "left").withColumn("last", last).where("last > least").select(run, "key", "ord", "weight", "target", F.explode(F.sequence(F.col("least") + 1, "last")).alias("k"))
    rank = F.row_number().over(W.partitionBy(run).orderBy((F.greatest(F.col("weight"), F.lit(0.001)) / F.col("k")).desc(), "ord", "k"))
    start = sources.groupBy(run).agg(F.sum("least").alias("begun"))
    given = units.withColumn("r", rank).join(start, run).where(F.col("r") <= F.col("target") - F.col("begun")).groupBy(run, "key").agg(F.count("*").alias("more"))
    return sources.join(given, [run, "key"], "left").select(run, "key", (F.col("least") + F.coalesce("more", F.lit(0))).alias("n"))


def automatic_budget(sources: DataFrame, count: int, run: str = "run", strict: bool = True) -> DataFrame:
    """sources (run, key, ord, duration, capacity) with weight, least, most and target for ``weighted_counts``.

    A run of more sources than its samples is an error or, if not ``strict``, gives each source one.
    """
    by = W.partitionBy(run)
    base = F.least(F.col("capacity"), F.ceil(F.col("duration") / LONGEST_STEP) + 1).cast("long")
    df = sources.withColumn("base", base)
    wanted = F.greatest(F.lit(count * 36), F.lit(120), F.sum("base").over(by), F.count("*").over(by))
    target = F.least(wanted, F.sum("capacity").over(by), F.lit(MOST))
    if strict:
        target = F.when(target < F.count("*").over(by), F.raise_error(F.lit("more sources than samples"))).otherwise(target)
    df = df.withColumn("target", target)
    least = F.when(F.sum("base").over(by) <= F.col("target"), F.col("base")).otherwise(F.lit(1))
    return df.select(run, "key", "ord", F.col("duration").alias("weight"), least.cast("long").alias("least"), F.col("capacity").alias("most"), F.col("target").cast("long").alias("target"))


def scene_stats(df: DataFrame, run: str = "run") -> DataFrame:
    """run, scene, n, first (order of appearance), role (first that is not ordinary) and best scores of df (run, scene, ord, role, selection, quality)."""
    other = F.when(F.col("role") != "ordinary", F.col("role"))
    zero = F.struct(F.lit(0.0).alias("selection"), F.lit(0.0).alias("quality"))
    best = F.greatest(F.max(F.struct("selection", "quality")), zero)
    return df.groupBy(run, "scene").agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), F.coalesce(F.min_by(other, F.when(F.col("role") != "ordinary", F.col("ord"))), F.lit("ordinary")).alias("role"),
        best["selection"].alias("best_selection"), best["quality"].alias("best_quality"),
    )


def scene_quotas(scenes: DataFrame, count: int, run: str = "run") -> DataFrame:
    """Add ``quota``: ``count`` places of each run dealt to its scenes in turn, cinematic ones together up to their limit.

    If there are more scenes than places, the best scenes come first, else those that appear first.
    """
    by = W.partitionBy(run)
    cinematic = F.col("role") == "cinematic"
    df = scenes.withColumn("places", F.least(F.lit(count), F.sum("n").over(by)))
    all_cinematic, others = F.sum(F.when(cinematic, F.col("n")).otherwise(0)).over(by), F.sum(F.when(cinematic, 0).otherwise(F.col("n"))).over(by)
    soft = F.greatest(F.lit(1), F.ceil(F.col("places") * 0.1))
    df = df.withColumn("limit", F.least(all_cinematic, F.greatest(soft, F.col("places") - others)))
    scarce = F.lit(count) < F.count("*").over(by)
    order = F.row_number().over(by.orderBy(F.when(F.col("scarce"), -F.col("best_selection")), F.when(F.col("scarce"), -F.col("best_quality")), "first"))
    df = df.withColumn("scarce", scarce).withColumn("turn", order)
    units = df.select(run, "scene", "turn", "places", "limit", cinematic.alias("cin"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(count).cast("long")))).alias("k"))
    rank = F.row_number().over(W.partitionBy(run, "cin").orderBy("k", "turn"))
    units = units.withColumn("c", rank).where(~F.col("cin") | (F.col("c") <= F.col("limit")))
    rank = F.row_number().over(W.partitionBy(run).orderBy("k", "turn"))
    given = units.withColumn("r", rank).where("r <= places").groupBy(run, "scene").agg(F.count("*").alias("quota"))
    return df.join(given, [run, "scene"], "left").select(*scenes.columns, F.coalesce("quota", F.lit(0)).alias("quota"))


def round_robin(groups: DataFrame, run: str = "run") -> DataFrame:
    """Add ``given``: ``target`` units of each run dealt one at a time to its groups in turn, none more than its ``free``.

    groups: run, turn, free, target (the same in a run). In closed form: what all get is the level at which the units would be used up if larger
    groups stopped there; the first of the larger ones get one more.
    """
    by = W.partitionBy(run)
    rising = by.orderBy("free", "turn")
    at, below = F.row_number().over(rising), F.coalesce(F.sum("free").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = groups.withColumn("_at", at).withColumn("_below", below).withColumn("_groups", F.count("*").over(by))
    # if all larger groups stopped at this one's size
    df = df.withColumn("_held", F.col("_below") + F.col("free") * (F.col("_groups") - F.col("_at") + 1))
    known = F.max(F.when(F.col("_held") <= F.col("target"), F.struct("_at", "free", "_held", "_groups"))).over(by)
    df = df.withColumn("_known", known)
    base, held = F.coalesce("_known.free", F.lit(0)), F.coalesce("_known._held", F.lit(0))
    over = F.count_if(F.col("free") > F.coalesce("_known.free", F.lit(0))).over(by)
    df = df.withColumn("_base", base).withColumn("_rest", F.greatest(F.lit(0), F.col("target") - held)).withColumn("_over", over)
    larger = F.col("free") > F.col("_base")
    place = F.row_number().over(W.partitionBy(run, larger).orderBy("turn"))
    more = F.when(larger, F.floor(F.col("_rest") / F.col("_over")) + F.when(place <= F.col("_rest") % F.col("_over"), 1).otherwise(0)).otherwise(0)
    return df.withColumn("given", F.least("free", F.least("free", "_base") + more).cast("int")).select(*groups.columns, "given")
