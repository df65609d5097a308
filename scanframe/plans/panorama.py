"""From descriptors to one blended picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.operators import canvas, match
from scanframe.session import cut_lineage


def match_descriptors(descriptors: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Ratio-tested matches between consecutive images with their coordinates."""
    return match.with_points(match.ratio_matches(match.two_nearest(descriptors), ratio), descriptors)


def image_maps(descriptors: DataFrame, images: DataFrame, ratio: float = 0.75, min_matches: int = 8) -> DataFrame:
    """Map of every image (sample_id, seq) to the first one of its sample.

    A pair with an image of fewer than four key points gets the identity.
    """
    poor = descriptors.groupBy("sample_id", "seq").agg(F.count(F.lit(1)).alias("n")).filter("n < 4")
    bad = poor.select("sample_id", F.explode(F.array(F.col("seq"), F.col("seq") - 1)).alias("pair_idx"))
    points = match_descriptors(descriptors, ratio).join(bad, match.PAIR, "left_anti")
    pairs = images.filter("seq > 0").select("sample_id", (F.col("seq") - 1).alias("pair_idx"))
    return match.global_homographies(match.pair_homographies(points, pairs, min_matches))


def warp_blend(frames: DataFrame, maps: DataFrame, tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Blended canvas tiles and, per sample, the box of covered pixels the picture is cropped to."""
    maps = cut_lineage(maps)            # one small row per image, needed for the canvas size and for the pixels
    tiles = cut_lineage(canvas.blend(canvas.warp_pieces(frames, maps, tile), tile))  # read for the picture and for its box
    return tiles, canvas.covered_box(tiles)


def warp_blend_tiles(stored: DataFrame, sizes: DataFrame, maps: DataFrame, source: int, tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``warp_blend`` for frames that lie in storage tiles of side ``source`` (``frames.cut_tiles``): no task holds a frame."""
    maps = cut_lineage(maps)
    tiles = cut_lineage(canvas.blend(canvas.warp_stored_tiles(stored, sizes, maps, source, tile), tile))
    return tiles, canvas.covered_box(tiles)


def crop(pixels: DataFrame, box: DataFrame) -> DataFrame:
    """Canvas pixels moved so that the covered box starts at 0, 0."""
    return pixels.join(box, "sample_id").filter(
        F.col("canvas_x").between(F.col("x0"), F.col("x1")) & F.col("canvas_y").between(F.col("y0"), F.col("y1"))).select(
        "sample_id", (F.col("canvas_y") - F.col("y0")).alias("canvas_y"), (F.col("canvas_x") - F.col("x0")).alias("canvas_x"), "v")
