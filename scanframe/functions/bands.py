"""Grades, gates and flag texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, decimals: int) -> Column:
    """Fixed decimals of the exact binary value, true ties to even, as C's printf gives them.

    Neither the formatter nor ``bround`` does: both look at the shortest decimal text, for which 0.95 is a tie. What the
    scaled product loses by rounding is found by splitting the value, so a product at a half is decided exactly.
    """
    v, scale = v.cast("double"), float(10 ** decimals)
    size = F.abs(v)
    product = size * scale
    shifted = size * 134217729.0
    high = shifted - (shifted - size)
    lost = (high * scale - product) + (size - high) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    signed = F.when(v < 0, 0.0 - rounded).otherwise(rounded)
    return F.format_string(f"%.{decimals}f", F.when(product < float(1 << 50), signed).otherwise(v))


def confidence(n_flags: Column, score: Column) -> Column:
    return (F.when(n_flags == 0, "HIGH").when((n_flags == 1) | ((n_flags == 2) & (score > 0.97)), "MEDIUM")
            .otherwise("LOW"))


def refined_confidence(score: Column) -> Column:
    return F.when(score > 0.99, "HIGH").when(score > 0.97, "MEDIUM").otherwise("LOW")


def manual_band(score: Column) -> Column:
    return (F.when(score.isNull(), "N/A").when(score >= 0.99, "VERY HIGH").when(score >= 0.97, "HIGH")
            .when(score >= 0.85, "MEDIUM").when(score >= 0.70, "LOW").otherwise("VERY LOW"))


def manual_color_class(score: Column) -> Column:
    return F.when(score.isNull(), "text").when(score >= 0.97, "high").when(score >= 0.85, "medium").otherwise("low")


def focus_band(score: Column, min_score: float, soft_min: float | None) -> Column:
    """hard, soft or NULL (dropped)."""
    band = F.when(score >= min_score, "hard")
    return band if soft_min is None else band.when(score >= min(soft_min, min_score), "soft")


def resplit_band(score: Column, min_score: float | None, soft_min: float | None) -> Column:
    """Second split of selected tiles. With no hard threshold every score from the soft one up counts as soft."""
    if soft_min is None:
        return F.lit("hard")
    soft = score >= soft_min
    return F.when(soft if min_score is None else soft & (score < min_score), "soft").otherwise("hard")


def worth_fine_focus(hard: Column, soft: Column, hard_min: int = 10, soft_min: int = 200) -> Column:
    return ~((hard < hard_min) & (soft < soft_min))


def end_of_sample(hard: Column, soft: Column, ylum: Column) -> Column:
    return (hard < 10) & (soft < 15) & (ylum < 30)


def is_black(std_r: Column, std_g: Column, std_b: Column, threshold: float = 5.0) -> Column:
    """Black when any channel is flat, and when there is nothing to look at."""
    return F.coalesce(F.least(std_r, std_g, std_b) < threshold, F.lit(True))


def mark_shape_ok(area: Column, w: Column, h: Column, min_area: int = 50, max_area: int = 10000,
                  max_aspect: float = 3.0) -> Column:
    short, long_ = F.least(w, h), F.greatest(w, h)
    return (area > min_area) & (area < max_area) & (short > 0) & (long_ < max_aspect * short)


def in_lower_half(cy: Column, height: Column) -> Column:
    return cy >= height / 2.0


def accepted(score: Column, min_acceptable: float = 0.7) -> Column:
    return score > min_acceptable


def response_class(reply: Column) -> Column:
    low = F.lower(F.trim(reply))
    return (F.when(low.isNull() | (low == ""), "empty").when(low.isin("ok", "processing"), low)
            .when(F.startswith(F.trim(reply), F.lit("error")), "error").otherwise("info"))


def _flag(label: str, value: Column, decimals: int = 4, unit: str = "") -> Column:
    return F.concat(F.lit(f"{label}("), fixed(value, decimals), F.lit(f"{unit})"))


def outlier_flags(score: Column, coarse: Column, z_score: Column, recent_score: Column) -> Column:
    """Outlier flags in fixed order; NULL evidence raises no flag and a coarse score of 0 counts as absent."""
    seen = F.coalesce(coarse, F.lit(0.0)) != 0
    return F.array_compact(F.array(
        F.when(score < 0.95, _flag("LOW_FINAL_SCORE", score)),
        F.when(seen & (coarse < 0.93), _flag("LOW_COARSE_SCORE", coarse)),
        F.when(seen & (score - coarse > 0.10), _flag("LARGE_SCORE_JUMP", score - coarse)),
        F.when(z_score > 3, _flag("OVERLAP_DEVIATION", z_score, 2, "σ")),
        F.when(score < recent_score - 0.05, _flag("SCORE_DROP", recent_score - score))))


def refinement_flags(improvement: Column, gap_type: Column, gap_multiplier: Column) -> Column:
    return F.array_compact(F.array(
        F.when(improvement > 0.001, F.concat(F.lit("REFINED(+"), fixed(improvement, 4), F.lit(")")))
        .when(improvement < -0.001, F.concat(F.lit("REFINED("), fixed(improvement, 4), F.lit(")"))),
        F.when(gap_type == "skip", F.concat(F.lit("GAP_SKIP(×"), fixed(gap_multiplier, 1), F.lit(")")))))


def overlap_scale(multiplier: Column) -> Column:
    """Share of the usual overlap that is left when the stage moved ``multiplier`` usual gaps."""
    return (F.when(multiplier >= 2.0, F.lit(0.59)).when(multiplier >= 1.5, F.lit(0.75))
            .when(multiplier > 1.0, 1.0 - (multiplier - 1.0) * 0.5).otherwise(1.0 + (1.0 - multiplier)))


def small_aware_number(v: Column) -> Column:
    """Two decimals, four for values below a hundredth."""
    return F.when(F.abs(v) < 0.01, fixed(v, 4)).otherwise(fixed(v, 2))
