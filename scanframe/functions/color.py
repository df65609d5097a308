"""Colour arithmetic on 0..255 channel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma and luminance weights (ITU-R BT.601, BT.709), sRGB transfer and CIE L* constants,
# 15-bit fixed-point BT.601 weights used for 8-bit gray images.
LUMA601 = (0.299, 0.587, 0.114)
LUMA709 = (0.2126, 0.7152, 0.0722)
GRAY_FIXED = (9798, 19235, 3735)
GRAY_SHIFT = 15
LAB_EPS = (6.0 / 29.0) ** 3
LAB_SLOPE = 1.0 / (3.0 * (6.0 / 29.0) ** 2)


def weighted(weights: tuple[float, float, float], r: Column, g: Column, b: Column) -> Column:
    return weights[0] * r + weights[1] * g + weights[2] * b


def gray_truncated(r: Column, g: Column, b: Column) -> Column:
    """Gray of a captured frame: BT.601 luma, truncated."""
    return weighted(LUMA601, r, g, b).cast("int")


def gray_rounded(r: Column, g: Column, b: Column) -> Column:
    """Gray used by the scorers: BT.601 luma in 15-bit fixed point, rounded."""
    total = GRAY_FIXED[0] * r + GRAY_FIXED[1] * g + GRAY_FIXED[2] * b + (1 << (GRAY_SHIFT - 1))
    return F.shiftright(total.cast("int"), GRAY_SHIFT)


def srgb_to_linear(v: Column) -> Column:
    u = v / F.lit(255.0)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    return weighted(LUMA709, srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))


def lightness(y: Column) -> Column:
    """CIE L* of a relative luminance."""
    f = F.when(y > LAB_EPS, F.cbrt(y)).otherwise(y * LAB_SLOPE + 4.0 / 29.0)
    return 116.0 * f - 16.0


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV: hue 0..179, saturation and value 0..255, 12-bit fixed point."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    diff = v - low
    sat_scale = F.when(v == 0, F.lit(0.0)).otherwise(F.bround(F.lit(255.0 * 4096) / F.greatest(v, F.lit(1))))
    hue_scale = F.when(diff == 0, F.lit(0.0)).otherwise(F.bround(F.lit(180.0 * 4096) / (6.0 * F.greatest(diff, F.lit(1)))))
    s = F.floor((diff * sat_scale + 2048) / 4096.0).cast("int")
    sector = F.when(v == r, g - b).when(v == g, b - r + 2 * diff).otherwise(r - g + 4 * diff)
    h = F.floor((sector * hue_scale + 2048) / 4096.0).cast("int")
    return F.when(h < 0, h + 180).otherwise(h), s, v


def circular_hue(mean_sin: Column, mean_cos: Column) -> Column:
    """Mean hue (0..180) from mean sine and cosine of the doubled angle."""
    angle = F.atan2(mean_sin, mean_cos)
    angle = F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)
    return angle * 180.0 / (2 * F.pi())


def hue_angle(h: Column) -> Column:
    return h * (2.0 * F.pi() / 180.0)


def red_isolation(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), r - F.greatest(g, b)))


def red_scaled(value: Column, frame_max: Column) -> Column:
    """Isolation stretched so that the frame maximum becomes 255."""
    return F.when(frame_max > 0, (value / frame_max * 255.0).cast("int")).otherwise(value.cast("int"))


def red_difference(r: Column, g: Column, b: Column) -> Column:
    return r - (g + b)


def red_dominance(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), red_difference(r, g, b))


def min_max_255(v: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(0)).otherwise(((v - low) / F.nullif(high - low, F.lit(0)) * 255.0).cast("int"))


def over_white(c: Column, alpha: Column) -> Column:
    """Channel composed over white, 8-bit alpha."""
    return F.floor((c * alpha + 255 * (255 - alpha) + 127) / 255.0).cast("int")


def clip_u8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")
