"""Red registration marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions import bands, kernels
from scanframe.operators.frames import map_frames


def red_plane(img: np.ndarray) -> np.ndarray:
    """Red isolation of a frame, stretched to 0..255 and closed."""
    b, g, r = (img[:, :, c].astype(np.int64) for c in range(3))
    isolated = np.clip(r - np.maximum(g, b), 0, 255)
    top = int(isolated.max()) if isolated.size else 0
    scaled = (isolated / top * 255.0).astype(np.uint8) if top > 0 else isolated.astype(np.uint8)
    return kernels.close_cross(scaled)


def threshold_of(plane: np.ndarray, percentile: float) -> float:
    positive = plane[plane > 0]
    return float(np.percentile(positive, percentile)) if positive.size else 50.0


def red_masks(frames: DataFrame, keys: list[str], percentile: float = 75.0, tile: int | None = None) -> DataFrame:
    """Mask tiles of the pixels above the frame's own threshold (percentile of the positive pixels, 50 if none)."""
    def one(img, _):
        plane = red_plane(img)
        limit = threshold_of(plane, percentile)
        mask = (plane > limit).astype(np.uint8)
        h, w = mask.shape
        step_y, step_x = (tile or h), (tile or w)
        for y in range(0, h, step_y):
            for x in range(0, w, step_x):
                part = np.ascontiguousarray(mask[y:y + step_y, x:x + step_x])
                yield w, h, x, y, part.shape[1], part.shape[0], limit, part.tobytes()
    return map_frames(frames, keys, "image_w int, image_h int, x0 int, y0 int, w int, h int, threshold double, "
                                    "mask binary", one)


def red_thresholds(frames: DataFrame, keys: list[str], percentile: float = 75.0) -> DataFrame:
    return map_frames(frames, keys, "threshold double, n_positive long", lambda img, _: [
        (threshold_of(red_plane(img), percentile), int((red_plane(img) > 0).sum()))])


def classify(components: DataFrame, keys: list[str], min_area: int = 50, max_area: int = 10000,
             max_aspect: float = 3.0) -> DataFrame:
    """Components (with their ``image_h``) of a mark-like shape with a status: ``valid``, ``upper_half`` or ``outlier``.

    Outliers lie beyond 1.5 interquartile ranges in x; they are looked for only where more than three marks are left.
    """
    shaped = components.filter(bands.mark_shape_ok(F.col("area"), F.col("w"), F.col("h"), min_area, max_area, max_aspect))
    placed = shaped.withColumn("lower", bands.in_lower_half(F.col("cy"), F.col("image_h")))
    frame = Window.partitionBy(*keys)  # bounded: the marks of one frame
    x = F.when(F.col("lower"), F.col("cx"))
    q = placed.withColumns({"q1": F.percentile(x, 0.25).over(frame), "q3": F.percentile(x, 0.75).over(frame),
                            "n": F.count(x).over(frame)})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outlier = (F.col("n") > 3) & ~F.col("cx").between(F.col("q1") - reach, F.col("q3") + reach)
    status = F.when(~F.col("lower"), "upper_half").when(outlier, "outlier").otherwise("valid")
    return q.withColumn("status", status).drop("q1", "q3", "n", "lower", "image_h")


def rejected(marks: DataFrame) -> DataFrame:
    return marks.filter("status = 'upper_half'").unionByName(marks.filter("status = 'outlier'"))


def summary(marks: DataFrame, keys: list[str]) -> DataFrame:
    good = F.col("status") == "valid"
    return marks.groupBy(*keys).agg(F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_rejected"),
                                    F.avg(F.when(good, F.col("cx"))).alias("mean_x"))


def red_measure(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Red dominance R-(G+B): range over the frame, positive pixels, and sums per column and per row as arrays."""
    def one(img, _):
        b, g, r = (img[:, :, c].astype(np.int64) for c in range(3))
        diff = r - (g + b)
        red = np.maximum(diff, 0)
        yield (int(diff.min()), int(diff.max()), int(red.min()), int(red.max()), int((red > 0).sum()), red.size,
               red.sum(0).tolist(), red.sum(1).tolist())
    return map_frames(frames, keys, "diff_min int, diff_max int, red_min int, red_max int, positive long, total long, "
                                    "per_x array<long>, per_y array<long>", one)


def projections(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the projections: axis, position, sum."""
    part = lambda axis: measured.select(*keys, F.lit(axis).alias("axis"),
                                        F.posexplode(f"per_{axis}").alias("position", "total"))
    return part("x").unionByName(part("y"))


def projection_quartiles(projected: DataFrame, keys: list[str]) -> DataFrame:
    """25/50/75 percentiles per frame and axis, where anything is positive."""
    q = F.percentile("total", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (projected.groupBy(*keys, "axis").agg(q.alias("q"), F.max("total").alias("top")).filter("top > 0")
            .select(*keys, "axis", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")))
