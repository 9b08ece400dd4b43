"""Scores of a frame from its metrics, as column expressions.

Metric columns: blur_score, brightness, contrast, edge_density, color_richness, ui_density,
action_intensity, visual_balance, dramatic_score, luminance_entropy, luminance_range, near_black_ratio,
near_white_ratio, dominant_tone_ratio. Normalised ones carry the prefix ``n_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the overall quality
QUALITY_WEIGHTS = {"blur_score": 0.165, "contrast": 0.145, "color_richness": 0.06, "visual_balance": 0.10, "edge_density": 0.13, "action_intensity": 0.125, "ui_density": 0.225, "dramatic_score": 0.05}
#: Fixed values: (centre, steepness) of the sigmoid of a metric
SIGMOIDS = {"blur_score": (500.0, 0.005), "contrast": (50.0, 0.1), "color_richness": (40.0, 0.1), "action_intensity": (30.0, 0.2), "ui_density": (10.0, 0.3)}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column, centre: float, steepness: float) -> Column:
    """1 / (1 + exp(-k (x - c))); saturates where exp overflows."""
    return 1.0 / (1.0 + F.exp(-steepness * (x - centre)))


def normalised(df: DataFrame) -> DataFrame:
    """Add ``n_`` columns in 0..1."""
    made = {f"n_{c}": sigmoid(F.col(c), *p) for c, p in SIGMOIDS.items()}
    made["n_edge_density"] = F.least(F.lit(1.0), F.col("edge_density") * 5.0)
    made["n_dramatic_score"] = F.least(F.lit(1.0), F.col("dramatic_score") / 100.0)
    made["n_visual_balance"] = F.col("visual_balance") / 100.0
    return df.withColumns(made)


def quality_score() -> Column:
    """Weighted sum of the normalised metrics."""
    total = F.lit(0.0)
    for name, weight in QUALITY_WEIGHTS.items():
        total = total + F.col(f"n_{name}") * weight
    return total


def selection_score(quality: Column, confidence: Column) -> Column:
    return quality * 0.7 + confidence * 0.3


# Every number in the scores from here to ``relative_transition``


def unusable(brightness: Column, contrast: Column, sharpness: Column) -> Column:
    """A frame that is black, white or empty."""
    return ((brightness < 7) & (contrast < 4)) | ((brightness > 248) & (contrast < 4)) | ((contrast < 2) & (sharpness < 1))


def mechanical_quality(brightness: Column, contrast: Column, sharpness: Column, entropy: Column) -> Column:
    """0..100 from exposure, contrast, sharpness and entropy."""
    exposure = F.greatest(F.lit(0.0), 1.0 - F.abs(brightness - 125.0) / 125.0)
    sharp = F.least(F.lit(1.0), F.log1p(sharpness) / F.log1p(F.lit(800.0)))
    return (exposure * 0.10 + F.least(F.lit(1.0), contrast / 70.0) * 0.25 + sharp * 0.35 + F.least(F.lit(1.0), entropy / 7.5) * 0.30) * 100.0


def visibility() -> Column:
    one = F.lit(1.0)
    return (
        0.30 * F.least(one, F.col("luminance_range") / 32.0) + 0.25 * F.least(one, F.col("luminance_entropy") / 1.5) + 0.20 * F.least(one, F.col("edge_density") / 0.08)
        + 0.15 * F.least(one, F.col("contrast") / 12.0) + 0.10 * (1.0 - F.greatest("near_black_ratio", "near_white_ratio"))
    )


def penalties() -> tuple[Column, Column, Column]:
    """Loss of contrast, edges and range, each in 0..1."""
    return clamp01(1.0 - F.col("contrast") / 18.0), clamp01(1.0 - F.col("edge_density") / 0.14), clamp01(1.0 - F.col("luminance_range") / 48.0)


def bright_washout() -> Column:
    contrast, edge, span = penalties()
    return clamp01(0.25 * clamp01((F.col("brightness") - 180.0) / 75.0) + 0.20 * F.col("near_white_ratio") + 0.20 * contrast + 0.15 * edge + 0.10 * F.col("dominant_tone_ratio") + 0.10 * span)


def system_ui() -> Column:
    return F.greatest("menu_layout", "title_layout", "game_over_layout")


def support_ui() -> Column:
    return clamp01(0.65 * F.col("n_ui_density") + 0.35 * (1.0 - F.col("n_action_intensity")))


def veiled_transition(visible: Column, information: Column, washout: Column) -> Column:
    contrast, edge, span = penalties()
    return clamp01(
        0.18 * (1.0 - visible) + 0.16 * (1.0 - information) + 0.12 * F.greatest("near_black_ratio", "near_white_ratio")
        + 0.10 * span + 0.10 * contrast + 0.08 * edge + 0.10 * washout + 0.08 * system_ui() + 0.08 * support_ui()
    )


def relative_transition(washout: Column) -> tuple[Column, Column]:
    """(bright, dark) outlier scores against the profile columns p_<metric>_<percentile>."""
    p = lambda m, q: F.col(f"p_{m}_{q}")
    contrast, edge, span = penalties()
    lost = clamp01(0.40 * contrast + 0.35 * edge + 0.25 * span)
    over = lambda m, floor, scale: clamp01((F.col(m) - F.greatest(F.lit(floor), p(m, 90))) / scale)
    above = clamp01((F.col("brightness") - p("brightness", 90)) / F.greatest(F.lit(8.0), p("brightness", 90) - p("brightness", 50)))
    below = clamp01((p("brightness", 10) - F.col("brightness")) / F.greatest(F.lit(8.0), p("brightness", 50) - p("brightness", 10)))
    bright = clamp01(0.35 * above + 0.25 * over("near_white_ratio", 0.05, 0.18) + 0.20 * washout + 0.20 * lost)
    dark = clamp01(0.40 * below + 0.25 * over("near_black_ratio", 0.05, 0.18) + 0.20 * over("dominant_tone_ratio", 0.55, 0.20) + 0.15 * lost)
    return bright, dark


def round_half_even(x: Column, digits: int) -> Column:
    """x rounded to decimal digits by its exact binary value, a tie to the even digit: 2.675 is less than it looks and gives 2.67.

    x times the power of ten is taken as the exact sum of two products of halves of its digits, so that the comparison with a tie has no error.
    Values so large that they have no such digits stay as they are; so do null, NaN and the infinities.
    """
    power = float(10**digits)
    turned = x * 134217729.0
    high = turned - (turned - x)
    a, b = high * power, (x - high) * power
    whole = F.floor(a + b)
    over = (a - (whole + 0.5)) + b
    units = F.when(over > 0, whole + 1).when(over < 0, whole).otherwise(whole + F.abs(whole % 2))
    return F.when(F.abs(x) < 2.0**52 / power, F.when(units == 0, F.lit(0.0) * x).otherwise(units / power)).otherwise(x)
