"""Defective ("hot") tiles: learned from frames taken with the lens covered, keyed by frame size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = ["grid_w", "grid_h"]
TILE = [*GRID, "col", "row"]


def candidates(hits: DataFrame, min_hits: int = 1) -> DataFrame:
    """Tiles seen in focus at least ``min_hits`` times."""
    return hits.groupBy(*TILE).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= max(1, min_hits))


def dilate(tiles: DataFrame, d: int) -> DataFrame:
    """Every tile with its square neighbourhood; indices may become negative."""
    if d <= 0:
        return tiles.select(*TILE).distinct()
    reach = F.sequence(F.lit(-d), F.lit(d))
    return (tiles.select(*TILE, F.explode(reach).alias("dc"))
            .select(*GRID, (F.col("col") + F.col("dc")).alias("col"), "row").distinct()
            .select("*", F.explode(reach).alias("dr"))
            .select(*GRID, "col", (F.col("row") + F.col("dr")).alias("row")).distinct())


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select(*TILE).union(new.select(*TILE)).distinct()


def newly_marked(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select(*TILE).distinct().join(old, TILE, "left_anti")


def clear(hot_tiles: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """Map without the given grids; without grids everything is cleared."""
    return hot_tiles.filter(F.lit(False)) if grids is None else hot_tiles.join(grids.select(*GRID), GRID, "left_anti")


def exclude(tiles: DataFrame, hot_tiles: DataFrame) -> DataFrame:
    """Tiles that are not hot. The join strategy is left to the optimizer, which knows the map's size."""
    return tiles.join(hot_tiles, TILE, "left_anti")


def build_report(hits: DataFrame, old: DataFrame, min_hits: int, dilation: int) -> DataFrame:
    """One row per grid: frames sampled, candidates, newly marked, total after the update."""
    new = dilate(candidates(hits, min_hits), dilation)
    flagged = (new.withColumn("is_new", F.lit(1)).join(old.select(*TILE).withColumn("is_old", F.lit(1)), TILE, "full"))
    tiles = flagged.groupBy(*GRID).agg(
        F.count("is_new").alias("candidates"),
        F.count_if(F.col("is_old").isNull()).alias("newly_marked"), F.count(F.lit(1)).alias("total_invalid"))
    seen = hits.groupBy(*GRID).agg(F.count_distinct("frame_id").alias("frames"))
    return tiles.join(seen, GRID, "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("bigint")))


def union_size(hot_tiles: DataFrame) -> DataFrame:
    """How many tile positions are hot on any grid."""
    return hot_tiles.agg(F.count_distinct("col", "row").alias("n_positions"))
