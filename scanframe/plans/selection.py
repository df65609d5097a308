"""Which frames to keep and how to put them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.functions import names
from scanframe.operators import select


def select_frames(files: DataFrame, strategy: str = "all", n: int = 5, threshold: float | None = None,
                  kind: str = "absolute") -> DataFrame:
    """Frames of one strategy: all, top_n, threshold or best (``files``: folder, name, path)."""
    if strategy == "all":
        return select.all_frames(files).withColumn("f", names.f_score(F.col("name")))
    scored = select.scored(files)
    if strategy == "top_n":
        return select.top_n(scored, n).drop("rank")
    if strategy == "best":
        return select.best_single(scored).drop("rank")
    if strategy == "threshold":
        return select.above_threshold(scored, threshold, kind).drop("threshold")
    raise ValueError(f"unknown strategy {strategy}")


def run_all_strategies(files: DataFrame, n: int = 5) -> DataFrame:
    """Every strategy side by side, tagged; folders with fewer than two frames left are dropped (but for ``best_single``).

    Three passes instead of five: both thresholds come from one join with the folder's statistics, and the best frame is
    the first of the top ones.
    """
    columns = [*files.columns, "f"]
    scored = select.scored(files)
    every = files.withColumn("f", names.f_score(F.col("name"))).select(*columns, F.lit("all").alias("strategy"))
    top_tags = F.filter(F.array(F.lit(f"top{n}"), F.when(F.col("rank") == 1, "best_single")), lambda t: t.isNotNull())
    top = select.top_n(scored, n).select(*columns, F.explode(top_tags).alias("strategy"))
    stats = select.score_stats(scored).select("folder", "auto_absolute", "auto_relative")
    limits = F.filter(F.array(F.when(F.col("f") >= F.col("auto_absolute"), "thresh_auto"),
                              F.when(F.col("f") >= F.col("auto_relative"), "thresh_70pct")), lambda t: t.isNotNull())
    above = scored.join(stats, "folder").select(*columns, F.explode(limits).alias("strategy"))
    chosen = every.unionByName(top).unionByName(above)
    single = F.col("strategy") == "best_single"
    enough = chosen.groupBy("folder", "strategy").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) | single)
    return chosen.join(enough.select("folder", "strategy"), ["folder", "strategy"], "left_semi")


def mosaic_groups(results: DataFrame, by: str) -> DataFrame:
    """Row (``y``), column (``x``) or panorama (``all``) groups of stacked results keyed ``X{x}Y{y}_{strategy}``."""
    k = names.stem(F.col("key"))
    placed = results.withColumns({"x": names.folder_x(k), "y": names.folder_y(k), "strategy": names.strategy_of(k)})
    return select.grid_groups(placed.filter("x is not null and y is not null"), by)
