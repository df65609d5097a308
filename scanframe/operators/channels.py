"""Channel statistics and colour averages of frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import color, kernels
from scanframe.operators.frames import map_frames


_MARGINS = tuple[float, float, float, float]


def _planes(img: np.ndarray, margins: _MARGINS) -> list[tuple[str, np.ndarray]]:
    """Counts of the 256 values of each channel inside the margins (left, right, top, bottom shares, rounded half-even
    per edge); none where nothing is left."""
    left, right, top, bottom = margins
    h, w = img.shape[:2]
    l, r, t, b = (int(round(w * left)), int(round(w * right)), int(round(h * top)), int(round(h * bottom)))
    cut = img[t:max(t, h - b), l:max(l, w - r)]
    if cut.size == 0:
        return []
    return [(name, np.bincount(cut[:, :, plane if img.shape[2] >= 3 else 0].ravel(), minlength=256))
            for name, plane in (("r", 2), ("g", 1), ("b", 0))]


def _moments(counts: np.ndarray) -> tuple[int, int, int]:
    values = np.arange(256, dtype=np.int64)
    return int(counts.sum()), int((values * counts).sum()), int((values * values * counts).sum())


def _spread(n: str, s1: str, s2: str) -> tuple[Column, Column]:
    """Mean and population deviation from whole-number sums."""
    mean = F.try_divide(F.col(s1), F.col(n).cast("double"))
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(s2), F.col(n).cast("double")) - mean * mean))


def channel_stats(frames: DataFrame, keys: list[str], margins: _MARGINS = (0, 0, 0, 0)) -> DataFrame:
    """mean, median, std (population), min, max per frame and channel (r, g, b). Narrow: sums leave the frame's task."""
    def one(img, _):
        for name, counts in _planes(img, margins):
            n, s1, s2 = _moments(counts)
            upto, present = np.cumsum(counts), np.flatnonzero(counts)
            low, high = (int(np.searchsorted(upto, k, side="right")) for k in ((n - 1) // 2, n // 2))
            yield name, n, s1, s2, (low + high) / 2.0, int(present[0]), int(present[-1])

    mean, std = _spread("n", "s1", "s2")
    raw = map_frames(frames, keys, "channel string, n long, s1 long, s2 long, median double, min int, max int", one)
    return raw.select(*keys, "channel", mean.alias("mean"), "median", std.alias("std"), "min", "max")


def channel_histogram(frames: DataFrame, keys: list[str], margins: _MARGINS = (0, 0, 0, 0)) -> DataFrame:
    """Count of all 256 values per frame and channel, 0 where none is. Narrow: one array per channel leaves the task."""
    def one(img, _):
        for name, counts in _planes(img, margins):
            yield name, counts.tolist()

    return map_frames(frames, keys, "channel string, counts array<long>", one).select(
        *keys, "channel", F.posexplode("counts").alias("value", "n"))


def black_frames(frames: DataFrame, keys: list[str], margins: _MARGINS = (0, 0, 0, 0), threshold: float = 5.0) -> DataFrame:
    """Per frame: the three interior standard deviations and whether any of them says black (an empty interior does)."""
    from scanframe.functions.bands import is_black

    def one(img, _):
        yield [v for _, counts in _planes(img, margins) for v in _moments(counts)] or [0] * 9

    raw = map_frames(frames, keys, ", ".join(f"{v}_{c} long" for c in "rgb" for v in ("n", "s1", "s2")), one)
    stats = raw.select(*keys, *[_spread(f"n_{c}", f"s1_{c}", f"s2_{c}")[1].alias(f"std_{c}") for c in "rgb"])
    return stats.withColumn("is_black", is_black(F.col("std_r"), F.col("std_g"), F.col("std_b"), threshold))


def average_color(frames: DataFrame, keys: list[str], roi: tuple[int, int, int, int] | None = None, space: str = "RGB",
                  y_method: str = "luma601", as_int: bool = True) -> DataFrame:
    """Average colour per frame over the (clamped) region: three channels named by their space, and ``ylum``.

    ``y_method``: luma601, luma709 (on the channel means), relY_linear or LabLstar (per pixel). An empty region gives no
    row. Narrow: one row of sums per frame leaves Python, the means are Columns.
    """
    space, method = space.upper(), y_method.lower()
    if space not in ("RGB", "BGR", "HSV"):
        raise ValueError("space must be RGB, BGR or HSV")
    if method not in ("luma601", "luma709", "rely_linear", "lablstar"):
        raise ValueError("unknown y_method")

    def one(img, _):
        h, w = img.shape[:2]
        x, y, rw, rh = roi or (0, 0, w, h)
        x0, x1 = max(0, min(x, w)), max(0, min(x + rw, w))
        y0, y1 = max(0, min(y, h)), max(0, min(y + rh, h))
        if x1 <= x0 or y1 <= y0:
            return
        cut = img[y0:y1, x0:x1].astype(np.int64)
        b, g, r = (cut[:, :, c if cut.shape[2] >= 3 else 0] for c in range(3))
        sums = [float(r.size), float(r.sum()), float(g.sum()), float(b.sum())]
        if space == "HSV":
            hue, s, v = kernels.hsv(r, g, b)
            angle = hue * (2.0 * np.pi / 180.0)
            sums += [float(np.sin(angle).sum()), float(np.cos(angle).sum()), float(s.sum()), float(v.sum())]
        else:
            sums += [0.0] * 4
        if method in ("rely_linear", "lablstar"):
            luminance = kernels.relative_luminance(r, g, b)
            sums.append(float((kernels.lightness(luminance) if method == "lablstar" else luminance).sum()))
        else:
            sums.append(0.0)
        yield sums

    names = ("n", "r", "g", "b", "sin", "cos", "s", "v", "y")
    raw = map_frames(frames, keys, ", ".join(f"sum_{c} double" for c in names), one)
    mean = {c: F.col(f"sum_{c}") / F.col("sum_n") for c in names[1:]}
    if space == "HSV":
        first = {"h": color.circular_hue(mean["sin"], mean["cos"]), "s": mean["s"], "v": mean["v"]}
    else:
        first = {c.lower(): mean[c.lower()] for c in space}
    rgb = (mean["r"], mean["g"], mean["b"])
    y, scale = {"luma601": (color.weighted(color.LUMA601, *rgb), 1.0), "luma709": (color.weighted(color.LUMA709, *rgb), 1.0),
                "rely_linear": (mean["y"], 255.0), "lablstar": (mean["y"], 255.0 / 100.0)}[method]
    finish = (lambda c, k=1.0: F.bround(c * k).cast("int")) if as_int else (lambda c, k=1.0: c)
    return raw.select(*keys, *[finish(c).alias(name) for name, c in first.items()], finish(y, scale).alias("ylum"))
