"""Pixel and stage geometry as Column arithmetic.

``bround`` is round-half-even, a cast to int truncates; both are chosen per rule and must not be swapped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_MM = 100
Z_QUANTUM = 4


def int_div(a: Column, b: Column | int) -> Column:
    """Floor division on whole numbers, also for negative ones."""
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("int")


def mm_to_ticks(mm: Column) -> Column:
    return (mm * TICKS_PER_MM).cast("int")


def ticks_to_mm(ticks: Column) -> Column:
    return ticks / F.lit(float(TICKS_PER_MM))


def axis_max_mm(ticks: Column) -> Column:
    return F.floor(ticks / TICKS_PER_MM).cast("int")


def quantize_even(z: Column) -> Column:
    return (F.bround(z / F.lit(float(Z_QUANTUM))) * Z_QUANTUM).cast("int")


def quantize_floor(z: Column) -> Column:
    return (F.floor(z / F.lit(float(Z_QUANTUM))) * Z_QUANTUM).cast("int")


def in_envelope(z: Column, start: Column, kind: str) -> Column:
    """Reachable heights of a focus search: below the start only, both sides, or the fine window."""
    low, high = {"descent": (560, 0), "alternating": (560, 560), "fine": (16, 16)}[kind]
    return z.between(start - low, start + high) & (z >= 0)


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def interior_rect(w: Column, h: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """Frame minus its margins, rounded half-even per edge: struct(x, y, w, h)."""
    edge = lambda size, pct: F.bround(size * clamp01(pct)).cast("int")
    l, r, t, b = edge(w, left), edge(w, right), edge(h, top), edge(h, bottom)
    return F.struct(l.alias("x"), t.alias("y"), F.greatest(F.lit(0), w - l - r).alias("w"),
                    F.greatest(F.lit(0), h - t - b).alias("h"))


def in_rect(x: Column, y: Column, rect: Column) -> Column:
    return ((x >= rect["x"]) & (x < rect["x"] + rect["w"]) & (y >= rect["y"]) & (y < rect["y"] + rect["h"]))


def contains_tile(rect: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return ((x >= rect["x"]) & (y >= rect["y"]) & (x + w <= rect["x"] + rect["w"])
            & (y + h <= rect["y"] + rect["h"]))


def focus_crop(w: Column, h: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """Crop of the quadrant score; edges truncate. ``ok`` is false where nothing is left."""
    x0, x1 = (w * left).cast("int"), (w * (1.0 - right)).cast("int")
    y0, y1 = (h * top).cast("int"), (h * (1.0 - bottom)).cast("int")
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"),
                    ((x1 > x0) & (y1 > y0)).alias("ok"))


def clamp_roi(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """Region of interest cut to the image; NULL where nothing is left."""
    lim = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    x0, y0, x1, y1 = lim(x, img_w), lim(y, img_h), lim(x + w, img_w), lim(y + h, img_h)
    rect = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when((x1 > x0) & (y1 > y0), rect)


def tile_index(v: Column, stride: int) -> Column:
    return F.greatest(F.lit(0), F.floor(v / stride).cast("int"))


def tile_rect(col: Column, row: Column, stride: int, tile: int) -> Column:
    return F.struct((col * stride).alias("x"), (row * stride).alias("y"), F.lit(tile).alias("w"),
                    F.lit(tile).alias("h"))


def tile_origins(size: Column, tile: int, stride: int) -> Column:
    """Origins along one axis; a ragged remainder is left out, a small image still gives one."""
    last = F.greatest(F.lit(1), size - tile + 1) - 1
    return F.sequence(F.lit(0), last.cast("int"), F.lit(max(1, stride)))


def scaled_tile(tile: int, stride: int, scale: float) -> dict[str, float | int]:
    """Tile geometry in a scaled image; a scale that is not positive counts as 1."""
    sf = scale if scale > 0 else 1.0
    return {"sf": sf, "tile": max(1, int(round(tile * sf))), "stride": max(1, int(round(stride * sf))),
            "inv": 1.0 / sf}


def map_back(v: Column, inv: float) -> Column:
    return F.bround(v * F.lit(float(inv))).cast("int")


def quadrant(x: Column, y: Column, w: Column, h: Column) -> Column:
    top, left = y < int_div(h, 2), x < int_div(w, 2)
    return (F.when(top & left, "Top Left").when(top, "Top Right").when(left, "Bottom Left")
            .otherwise("Bottom Right"))


def rotations(axis: str, rotate: int = 0) -> list[str]:
    """Rotations in order: the scan along y is turned counter-clockwise first, then at most one extra turn."""
    extra = {0: [], 90: ["cw"], 180: ["half"], 270: ["ccw"]}[rotate]
    return (["ccw"] if axis == "y" else []) + extra


def rotate_point(x: Column, y: Column, w: Column, h: Column, turns: list[str]) -> tuple[Column, Column, Column, Column]:
    """Coordinates and size after the turns."""
    for turn in turns:
        if turn == "ccw":
            x, y, w, h = y, w - 1 - x, h, w
        elif turn == "cw":
            x, y, w, h = h - 1 - y, x, h, w
        else:
            x, y = w - 1 - x, h - 1 - y
    return x, y, w, h


def inclusive_range(start: Column, end: Column, step: Column) -> Column:
    """Direction-aware range that runs one step past the end when the step does not divide the distance."""
    steps = F.ceil(F.abs(end - start) / step).cast("int")
    sign = F.when(start < end, F.lit(1)).otherwise(F.lit(-1))
    return F.transform(F.sequence(F.lit(0), steps), lambda k: (start + sign * step * k).cast("int"))


def gcode_position(x: Column, y: Column, z: Column) -> Column:
    """Position in ticks as command text in millimetres, shortest decimal form."""
    num = lambda t: ticks_to_mm(t).cast("string")
    return F.concat(F.lit("X"), num(x), F.lit(" Y"), num(y), F.lit(" Z"), num(z))


def gcode_move(x: Column, y: Column, z: Column) -> Column:
    """Move of a scan plan: two decimals per axis."""
    return F.format_string("G0 X%.2f Y%.2f Z%.2f", ticks_to_mm(x), ticks_to_mm(y), ticks_to_mm(z))
