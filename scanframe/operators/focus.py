"""Focus scores of tiles, quadrants and stacks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import bands, geometry, kernels
from scanframe.operators.frames import map_frames

# Quadrant names in the order that breaks ties.
QUADRANTS = ("Top Left", "Top Right", "Bottom Left", "Bottom Right")


def score_of(n: Column, s1: Column, s2: Column, p90: Column) -> Column:
    """Half of (population variance + 90th percentile) from whole-number sums."""
    n = n.cast("double")
    return 0.5 * ((s2 / n - (s1 / n) * (s1 / n)) + p90)


def tile_scores(frames: DataFrame, keys: list[str], tile: int = 48, stride: int = 48, scale: float = 1.0,
                ksize: int = 3) -> DataFrame:
    """One row per tile: rectangle in frame pixels, moments of the absolute Laplacian, score, rank in its frame.

    The blur sees the whole frame, the Laplacian only its tile. Ranks (score, then y, then x) are given where the tiles
    are cut, so picking a frame's best tiles needs no shuffle.
    """
    size = geometry.scaled_tile(tile, stride, scale)

    def one(img, _):
        g = kernels.blur(kernels.gray(img)).astype(np.uint8)
        if size["sf"] != 1.0:
            g = kernels.resize(g, size["sf"])
        ys, xs, cut = kernels.tiles(g, size["tile"], size["stride"])
        s1, s2, p90 = kernels.moments(kernels.abs_laplacian(cut, ksize))
        n = cut.shape[1] * cut.shape[2]
        mean = s1 / n
        by_score = np.lexsort((xs, ys, -(0.5 * ((s2 / n - mean * mean) + p90))))
        rank = np.empty(len(cut), int)
        rank[by_score] = np.arange(1, len(cut) + 1)
        back = lambda v: int(round(v * size["inv"]))
        for i in range(len(cut)):
            yield (back(int(xs[i])), back(int(ys[i])), back(size["tile"]), back(size["tile"]), img.shape[1],
                   img.shape[0], n, int(s1[i]), int(s2[i]), float(p90[i]), int(rank[i]), len(cut))

    raw = map_frames(frames, keys, "x int, y int, w int, h int, frame_w int, frame_h int, n long, s1 long, s2 long, "
                                   "p90 double, rank int, n_tiles int", one)
    return raw.withColumn("score", score_of(F.col("n"), F.col("s1"), F.col("s2"), F.col("p90"))).withColumns({
        "col": geometry.tile_index(F.col("x"), stride), "row": geometry.tile_index(F.col("y"), stride)})


def select_tiles(scored: DataFrame, keys: list[str], min_score: float | None, soft_min: float | None,
                 top_percent: float = 0.15) -> DataFrame:
    """Tiles with a band: by thresholds, or without a threshold the top share per frame (at least one)."""
    if min_score is not None:
        return scored.withColumn("band", bands.focus_band(F.col("score"), min_score, soft_min)).filter(
            "band is not null")
    keep = F.greatest(F.lit(1), F.bround(F.col("n_tiles") * F.lit(float(top_percent))).cast("int"))
    return scored.filter(F.col("rank") <= keep).withColumn("band", F.lit("hard"))


def _quadrant_rows(img: np.ndarray, ksize: int, margins: tuple[float, float, float, float], scale: float):
    """(order, name, n, s1, s2, p90) of the quadrants of a cropped frame."""
    left, right, top, bottom = margins
    h, w = img.shape[:2]
    cut = img[int(h * top):int(h * (1.0 - bottom)), int(w * left):int(w * (1.0 - right))]
    if cut.size == 0:
        return
    planes = [cut[:, :, c] for c in range(cut.shape[2])]
    if scale > 0 and scale != 1.0:
        planes = [kernels.resize(p, scale) for p in planes]
    g = kernels.gray(np.dstack(planes))
    mh, mw = g.shape[0] // 2, g.shape[1] // 2
    for order, (name, part) in enumerate(zip(QUADRANTS, (g[:mh, :mw], g[:mh, mw:], g[mh:, :mw], g[mh:, mw:]))):
        if part.size:
            s1, s2, p90 = kernels.moments(kernels.abs_laplacian(kernels.blur(part), ksize)[None])
            yield order, name, part.size, int(s1[0]), int(s2[0]), float(p90[0])


def quadrant_scores(frames: DataFrame, keys: list[str], ksize: int = 7,
                    margins: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0),
                    scale: float = 1.0) -> DataFrame:
    """One row per frame quadrant (margins left, right, top, bottom cut off first).

    Frames whose crop is empty give no rows; see ``crop_rejects``.
    """
    raw = map_frames(frames, keys, "quadrant_order int, quadrant string, n long, s1 long, s2 long, p90 double",
                     lambda img, _: _quadrant_rows(img, ksize, margins, scale))
    return raw.withColumn("score", score_of(F.col("n"), F.col("s1"), F.col("s2"), F.col("p90")))


def crop_rejects(frames: DataFrame, keys: list[str], margins: tuple[float, float, float, float]) -> DataFrame:
    crop = geometry.focus_crop(F.col("width"), F.col("height"), *[F.lit(float(m)) for m in margins])
    return (frames.select(*keys, crop.alias("crop")).filter("not crop.ok")
            .select(*keys, F.lit("edge margins leave an empty region").alias("reason")))


def frame_scores(frames: DataFrame, keys: list[str], ksize: int = 7,
                 margins: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0), scale: float = 1.0,
                 black_threshold: float = 5.0) -> DataFrame:
    """Per frame: black test, mean of the quadrant scores, the quadrants as a map, the best one (first wins a tie).

    One narrow pass: every frame is decoded once and nothing is shuffled. Scores of black frames are NULL.
    """
    left, right, top, bottom = margins

    def one(img, _):
        h, w = img.shape[:2]
        l, r, t, b = (int(round(w * left)), int(round(w * right)), int(round(h * top)), int(round(h * bottom)))
        inner = img[t:max(t, h - b), l:max(l, w - r), :3].astype(np.int64)
        flat = inner.reshape(-1, inner.shape[2])
        quads = [dict(zip(("quadrant_order", "quadrant", "n", "s1", "s2", "p90"), q)) for q in _quadrant_rows(img, ksize, margins, scale)]
        yield len(flat), flat.sum(0).tolist(), (flat * flat).sum(0).tolist(), quads

    raw = map_frames(frames, keys, "n long, s1 array<long>, s2 array<long>, quads array<struct<quadrant_order:int,quadrant:string,"
                                   "n:long,s1:long,s2:long,p90:double>>", one)
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    stds = F.zip_with("s1", "s2", lambda a, b: F.sqrt(F.greatest(F.lit(0.0), b / n - (a / n) * (a / n))))
    scored = F.transform("quads", lambda q: F.struct(
        score_of(q["n"], q["s1"], q["s2"], q["p90"]).alias("score"), (-q["quadrant_order"]).alias("nth"), q["quadrant"].alias("quadrant")))
    total = F.aggregate("scored", F.lit(0.0), lambda a, q: a + q["score"])
    out = raw.withColumns({"is_black": F.coalesce(F.array_min(stds) < black_threshold, F.lit(True)), "scored": scored})
    seen = ~F.col("is_black")
    best = F.array_max("scored")
    return out.select(
        *keys, "is_black", F.when(seen, F.try_divide(total, F.size("scored"))).alias("score"),
        F.when(seen, F.map_from_entries(F.transform("scored", lambda q: F.struct(q["quadrant"], q["score"])))).alias("quadrants"),
        F.when(seen, F.struct(best["quadrant"].alias("quadrant"), best["score"].alias("score"))).alias("best"))


def laplacian_histogram(frames: DataFrame, keys: list[str], ksize: int = 3, bins: int = 256) -> DataFrame:
    """Counts of absolute Laplacian values 0..bins per quadrant; larger values are left out, the last bin is closed."""
    def one(img, _):
        g = kernels.gray(img)
        mh, mw = g.shape[0] // 2, g.shape[1] // 2
        for name, part in zip(QUADRANTS, (g[:mh, :mw], g[:mh, mw:], g[mh:, :mw], g[mh:, mw:])):
            if part.size == 0:
                continue
            values = kernels.abs_laplacian(kernels.blur(part), ksize).ravel()
            counts = np.bincount(np.minimum(values[values <= bins], bins - 1), minlength=bins)
            for value in np.flatnonzero(counts):
                yield name, int(value), int(counts[value])
    return map_frames(frames, keys, "quadrant string, bin int, n long", one)


def local_sharpness(frames: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Canvas-aligned tiles of a frame with, per pixel, its value bytes and its absolute Laplacian (int32 bytes)."""
    def one(img, _):
        lap = kernels.abs_laplacian(kernels.blur(kernels.gray(img)), 3).astype("<i4")
        for y in range(0, img.shape[0], tile):
            for x in range(0, img.shape[1], tile):
                part = np.ascontiguousarray(img[y:y + tile, x:x + tile])
                yield (x // tile, y // tile, part.shape[1], part.shape[0], part.shape[2], part.tobytes(),
                       np.ascontiguousarray(lap[y:y + tile, x:x + tile]).tobytes())
    return map_frames(frames, keys, "tile_col int, tile_row int, w int, h int, n_channels int, data binary, "
                                    "sharpness binary", one)
