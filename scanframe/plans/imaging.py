"""Jobs on single frames: focus tiles, frame focus, colour, marks, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import bands, geometry
from scanframe.operators import channels, components, focus, hot, marks

Margins = tuple[float, float, float, float]  # left, right, top, bottom
NO_MARGINS: Margins = (0.0, 0.0, 0.0, 0.0)


def focus_tiles(frames: DataFrame, keys: list[str], tile: int = 48, stride: int = 48, top_percent: float = 0.15,
                min_score: float | None = 50.0, soft_min: float | None = 35.0, scale: float = 1.0,
                margins: Margins = NO_MARGINS, hot_tiles: DataFrame | None = None, resplit: bool = True) -> DataFrame:
    """In-focus tiles with their band: scored, selected, inside the margins, split hard/soft, hot tiles left out."""
    scored = focus.tile_scores(frames, keys, tile, stride, scale)
    chosen = focus.select_tiles(scored, keys, min_score, soft_min, top_percent)
    rect = geometry.interior_rect(F.col("frame_w"), F.col("frame_h"), *[F.lit(float(m)) for m in margins])
    inside = chosen.filter(geometry.contains_tile(rect, F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    if resplit:
        inside = inside.withColumn("band", bands.resplit_band(F.col("score"), min_score, soft_min))
    if hot_tiles is not None:
        keyed = inside.withColumnsRenamed({"frame_w": "grid_w", "frame_h": "grid_h"})
        inside = hot.exclude(keyed, hot_tiles).withColumnsRenamed({"grid_w": "frame_w", "grid_h": "frame_h"})
    return inside.select(*keys, "x", "y", "w", "h", "col", "row", "score", "band")


def focus_counts(tiles: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.count_if(F.col("band") == "hard").alias("hard"),
                                    F.count_if(F.col("band") == "soft").alias("soft"))


def frame_focus(frames: DataFrame, keys: list[str], margins: Margins = NO_MARGINS, ksize: int = 7, scale: float = 1.0,
                black_threshold: float = 5.0) -> DataFrame:
    """Focus score per frame with quadrants; NULL score for black frames (and frames the margins leave empty)."""
    return focus.frame_scores(frames, keys, ksize, margins, scale, black_threshold)


def frame_color(frames: DataFrame, keys: list[str], space: str = "RGB", roi: tuple[int, int, int, int] | None = None,
                y_method: str = "luma601", as_int: bool = True) -> DataFrame:
    return channels.average_color(frames, keys, roi, space, y_method, as_int)


def registration_marks(frames: DataFrame, keys: list[str], percentile: float = 75.0, min_area: int = 50,
                       max_area: int = 10000, max_aspect: float = 3.0, tile: int | None = None) -> DataFrame:
    """Red marks of every frame with their status. With ``tile`` the masks are cut and joined across tile borders."""
    masks = marks.red_masks(frames, keys, percentile, tile)
    found = components.components(masks, [*keys, "image_h"], whole_images=tile is None)
    return marks.classify(found, keys, min_area, max_area, max_aspect)


def red_dominance(frames: DataFrame, keys: list[str]) -> DataFrame:
    measured = marks.red_measure(frames, keys)
    return measured.withColumn("positive_pct", F.col("positive") / F.col("total") * 100.0)


def compare_focus(frames: DataFrame, a: Column, b: Column, pair: Column, keys: list[str], ksize: int = 3) -> DataFrame:
    """Quadrant scores of two frames side by side. ``a``/``b`` say which frame of a pair a row is, ``pair`` names it."""
    scored = focus.quadrant_scores(frames, keys, ksize)
    side = F.when(a, "a").when(b, "b")
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("score")))
    sides = scored.withColumn("pair", pair).withColumn("side", side).filter("side is not null")
    per_quadrant = sides.groupBy("pair", "quadrant", "quadrant_order").agg(pick("a").alias("score_a"), pick("b").alias("score_b"))
    best = per_quadrant.groupBy("pair").agg(F.max("score_a").alias("best_a"), F.max("score_b").alias("best_b"))
    low, high = F.least("best_a", "best_b"), F.greatest("best_a", "best_b")
    verdict = best.withColumns({
        "sharper": F.when(F.col("best_a") > F.col("best_b"), "a").when(F.col("best_b") > F.col("best_a"), "b")
        .otherwise("same"),
        "difference_pct": F.try_divide(high - low, low) * 100})
    return per_quadrant.join(verdict, "pair")
