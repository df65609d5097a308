"""Choosing frames per stack folder by their focus score, and plans for putting the chosen ones together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions import names
from scanframe.operators import ordered

DERIVED = ("focus_stacked", "best_images", "stitch_working", "y_stitched", "x_stitched")


def listed(files: DataFrame) -> DataFrame:
    """Adds folder and name of every path; derived folders are left out."""
    out = files.withColumns({"folder": names.parent_name(F.col("path")), "name": names.base_name(F.col("path"))})
    skip = F.lit(False)
    for prefix in DERIVED:
        skip = skip | F.startswith(F.col("folder"), F.lit(prefix))
    return out.filter(~skip)


def scored(files: DataFrame) -> DataFrame:
    return files.withColumn("f", names.f_score(F.col("name"))).filter("f is not null")


def without_scores(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Folders in which no frame carries a score."""
    return files.select(folder).distinct().join(scored(files).select(folder), folder, "left_anti")


def all_frames(files: DataFrame) -> DataFrame:
    return files.withColumn("strategy", F.lit("all"))


def top_n(files: DataFrame, n: int = 5, folder: str = "folder") -> DataFrame:
    """Highest ``n`` scores per folder, path order on ties. Spark cuts to ``n`` per folder before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(folder).orderBy(F.desc("f"), "path"))
    return files.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("strategy", F.lit(f"top{n}"))


def best_single(files: DataFrame, folder: str = "folder") -> DataFrame:
    return top_n(files, 1, folder).withColumn("strategy", F.lit("best_single"))


def score_stats(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Count, range and automatic thresholds per folder."""
    return files.groupBy(folder).agg(
        F.count("f").alias("n"), F.min("f").alias("f_min"), F.max("f").alias("f_max"),
        (F.avg("f") + 0.5 * F.coalesce(F.stddev_samp("f"), F.lit(0.0))).alias("auto_absolute"),
        (F.max("f") * 0.7).alias("auto_relative"))


def above_threshold(files: DataFrame, threshold: float | None = None, kind: str = "absolute",
                    folder: str = "folder") -> DataFrame:
    """Frames at or above the threshold: given or automatic, absolute or as a share of the folder's best."""
    stats = score_stats(files, folder)
    limit = {(False, "absolute"): F.col("auto_absolute"), (False, "relative"): F.col("auto_relative")}.get(
        (threshold is not None, kind))
    if limit is None:
        limit = F.col("f_max") * F.lit(float(threshold)) if kind == "relative" else F.lit(float(threshold))
    tag = "thresh_auto" if kind == "absolute" else f"thresh_{round((threshold or 0.7) * 100)}pct"
    return (files.join(stats.select(folder, limit.alias("threshold")), folder).filter(F.col("f") >= F.col("threshold"))
            .withColumn("strategy", F.lit(tag)))


def stackable(chosen: DataFrame, folder: str = "folder", at_least: int = 2) -> DataFrame:
    """Folders and strategies with enough frames left to stack."""
    return chosen.groupBy(folder, "strategy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def grid_groups(chosen: DataFrame, by: str, at_least: int = 2) -> DataFrame:
    """Rows (by y, along x), columns (by x, along y) or all frames of a strategy (by ``all``, along x and y) to stitch.

    ``chosen`` carries strategy, x and y; frames come with their place in the group, groups that are too small are left out.
    """
    keys, along = {"y": (["strategy", "y"], ["x"]), "x": (["strategy", "x"], ["y"]), "all": (["strategy"], ["x", "y"])}[by]
    # sizes come from the ranges that number the frames: a join by group would send a group, of which there are few, to a task
    known = chosen.dropna(subset=keys)
    return ordered.range_index(known, keys, [*along, "path"], "place", "group_size").filter(F.col("group_size") >= at_least)


def merge_tree(members: DataFrame, group: str, index: str = "idx", failed: DataFrame | None = None) -> DataFrame:
    """Level-by-level plan of merging neighbours two by two.

    The node at (level, node) covers 2^level members, so every member index alone says where it starts nodes: no level
    waits for another. ``left`` and ``right`` are the first members of the two halves; a node without a right half is
    carried. Where a merge ``failed`` (group, level, node) the left half stays alone. At most 2 rows per member.
    """
    i = F.col(index)
    n = members.groupBy(group).agg((F.max(i) + 1).alias("n"))
    levels = F.ceil(F.log2(F.col("n"))).cast("int")
    step = lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    own = F.filter(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))),
                   lambda level: (F.col("n") > 1) & (level <= levels) & (i % step(level) == 0))
    nodes = members.join(n, group).select(group, i.alias("left"), "n", F.explode(own).alias("level"))
    half = F.col("left") + step(F.col("level") - 1)
    plan = nodes.select(
        group, "level", (F.col("left") / step(F.col("level"))).cast("bigint").alias("node"), "left",
        F.when(half < F.col("n"), half).alias("right"))
    if failed is not None:
        plan = plan.join(failed.select(group, "level", "node").withColumn("__failed", F.lit(True)), [group, "level", "node"], "left")
    lost = F.coalesce("__failed", F.lit(False)) if failed is not None else F.lit(False)
    action = F.when(F.col("right").isNull(), "carry").when(lost, "keep_left").otherwise("merge")
    return plan.select(group, "level", "node", "left", "right", action.alias("action"))


def tree_survivors(members: DataFrame, group: str, index: str, plan: DataFrame) -> DataFrame:
    """Members that are in the final picture: those never in the right half of a failed merge."""
    failed = plan.filter("action = 'keep_left'").select(group, "level", "node")
    top = members.groupBy(group).agg(F.ceil(F.log2(F.greatest(F.max(F.col(index)) + 1, F.lit(1)))).cast("int").alias("levels"))
    step = lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    rights = members.join(top, group).select(group, F.col(index), F.explode(F.filter(
        F.sequence(F.lit(1), F.greatest(F.col("levels"), F.lit(1))),
        lambda level: (F.col(index) % step(level)) >= step(level - 1))).alias("level"))
    lost = rights.withColumn("node", (F.col(index) / step(F.col("level"))).cast("bigint")).join(
        failed, [group, "level", "node"]).select(group, index).distinct()
    return members.join(lost, [group, index], "left_anti")


def job_outcomes(results: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    return results.groupBy(*keys).agg(F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
                                      F.count(F.lit(1)).alias("total"))
