"""Rules that reject frames, alone and against their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.functions import metrics as M
from lumeset.functions.vectors import dot, l2_normalise

REASONS = ("blackout", "whiteout", "single_tone", "fade_transition", "temporal_transition")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often later expressions use them: a generated row keeps the optimiser from writing them out there."""
    each = F.explode(F.array(F.struct(*(x.alias(c) for c, x in columns.items())))).alias("_settled")
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, each).select(*rest, *(F.col(f"_settled.{c}").alias(c) for c in columns))


def with_reason(df: DataFrame) -> DataFrame:
    """df with ``reason`` (see ``static_reason``), which all scores that rules share are settled for."""
    df = settled(df, **{c: F.col(c) for c in ("visibility", "information", "washout")})
    bright, dark = M.relative_transition(F.col("washout"))
    veiled = M.veiled_transition(F.col("visibility"), F.col("information"), F.col("washout"))
    df = settled(df, bright=bright, dark=dark, veiled=veiled)
    return df.withColumn("reason", static_reason(*map(F.col, ("bright", "dark", "veiled"))))


def static_reason(bright: Column | None = None, dark: Column | None = None, veiled: Column | None = None) -> Column:
    """First rule that a frame meets, else null. Needs metrics, ``n_`` metrics, layout, profile, visibility, information and washout columns."""
    c, g, lit = F.col, F.greatest, F.lit
    p = lambda m, q: c(f"p_{m}_{q}")
    if bright is None or dark is None or veiled is None:
        bright, dark = M.relative_transition(c("washout"))
        veiled = M.veiled_transition(c("visibility"), c("information"), c("washout"))
    # fixed values: the thresholds of all rules below
    extreme = g("near_black_ratio", "near_white_ratio")
    span10, span25 = g(lit(12.0), p("luminance_range", 10)), g(lit(14.0), p("luminance_range", 25))
    whiteout = (
        ((c("near_white_ratio") >= 0.92) & (c("luminance_entropy") <= 0.55) & (c("luminance_range") <= g(lit(12.0), p("luminance_range", 25))))
        | ((c("brightness") >= 245.0) & (c("contrast") <= g(lit(6.0), p("contrast", 10))) & (c("edge_density") <= g(lit(0.02), p("edge_density", 10))) & (c("dominant_tone_ratio") >= 0.88))
        | ((c("washout") >= 0.60) & (c("brightness") >= 200.0) & (c("contrast") <= g(lit(8.0), p("contrast", 25))) & (c("edge_density") <= g(lit(0.05), p("edge_density", 25))) & (c("visibility") <= 0.76))
    )
    single = (c("dominant_tone_ratio") >= 0.88) & (extreme <= 0.25) & (c("luminance_range") <= span10) & (c("contrast") <= p("contrast", 25)) & (c("edge_density") <= p("edge_density", 25))
    brighter = (bright >= 0.56) & ((c("visibility") <= 0.78) | (c("information") <= 0.62)) & ((c("near_white_ratio") >= p("near_white_ratio", 90)) | (c("washout") >= 0.24))
    darker = (dark >= 0.54) & (c("visibility") <= 0.66) & (c("brightness") <= p("brightness", 25))
    obvious = ((c("near_black_ratio") >= 0.65) | (c("near_white_ratio") >= 0.65)) & (c("visibility") < 0.30) & ((c("luminance_range") <= span25) | (c("information") < 0.35))
    washed = (c("washout") >= 0.54) & ((c("brightness") >= 185.0) | (c("near_white_ratio") >= 0.24)) & ((c("visibility") <= 0.68) | (c("information") <= 0.55))
    under_veil = (veiled >= 0.46) & ((c("washout") >= 0.40) | (c("near_white_ratio") >= 0.20) | (c("near_black_ratio") >= 0.20) | (M.system_ui() >= 0.20))
    lit_or_dark = (c("near_white_ratio") >= 0.28) | (c("brightness") >= g(lit(200.0), p("brightness", 90))) | (c("near_black_ratio") >= 0.28) | (c("brightness") <= F.least(lit(58.0), p("brightness", 10)))
    weak = (c("dominant_tone_ratio") >= 0.72) | (c("luminance_range") <= g(lit(28.0), p("luminance_range", 25)))
    direct = lit_or_dark & (c("contrast") <= g(lit(12.0), p("contrast", 25))) & (c("edge_density") <= g(lit(0.08), p("edge_density", 25))) & weak
    return (
        F.when((c("near_black_ratio") >= 0.97) & (c("luminance_entropy") <= 0.35) & (c("luminance_range") <= span10), "blackout")
        .when(whiteout, "whiteout").when(single, "single_tone")
        .when(brighter, F.when((bright >= 0.72) | (c("near_white_ratio") >= 0.58), "whiteout").otherwise("fade_transition"))
        .when(darker | obvious | washed | under_veil | direct, "fade_transition")
    )


def temporal_dips(df: DataFrame, run: list[str], order: list[str], similarity: float = 0.88, margin: float = 0.18) -> DataFrame:
    """Add ``dip``: a clean frame between two clean, like neighbours that are both more visible by the margin.

    df: features, visibility, reason (null if clean). The ends of a run are never dips.
    """
    by = W.partitionBy(*run).orderBy(*order)
    unit = df.withColumn("_unit", l2_normalise(F.col("features")))
    near = {f"_{side}_{c}": f(c).over(by) for side, f in (("before", F.lag), ("after", F.lead)) for c in ("_unit", "visibility")}
    clean = F.col("reason").isNull()
    unit = unit.withColumns({**near, "_around": F.coalesce(F.lag(clean).over(by), F.lit(False)) & F.coalesce(F.lead(clean).over(by), F.lit(False))})
    like = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("_before__unit"), F.col("_after__unit")))) >= similarity
    dim = F.col("visibility") + margin < F.least("_before_visibility", "_after_visibility")
    return unit.withColumn("dip", F.coalesce(clean & F.col("_around") & like & dim, F.lit(False))).select(*df.columns, "dip")


def breakdown(df: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n: rejected rows per reason, zero where there are none."""
    domain = df.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    counted = df.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return domain.join(counted, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))
