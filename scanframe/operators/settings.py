"""Layered settings as a long table: ``scope, layer, key, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ("active", "default", "builtin")

# Camera ranges (key, low, high); tuples are checked per channel.
CAMERA_RANGES = (("exposure", 16, 220), ("temp", 2000, 15000), ("tint", 200, 2500), ("levelrange_low", 0, 255),
                 ("levelrange_high", 0, 255), ("contrast", -100, 100), ("hue", -180, 180), ("saturation", 0, 255),
                 ("brightness", -64, 64), ("gamma", 20, 180), ("wbgain", -127, 127), ("sharpening", 0, 500), ("linear", 0, 1))

# Built-in automation settings.
AUTOMATION_DEFAULTS = {
    "tile_size": "48", "stride": "48", "top_percent": "0.15", "min_score": "50.0", "soft_min_score": "35.0",
    "inset_left_pct": "0.1", "inset_top_pct": "0.0", "inset_right_pct": "0.1", "inset_bottom_pct": "0.0",
    "scale_factor": "1.0", "image_name_template": "Y{y} X{x} Z{z} F{f}", "zero_pad": "true", "delimiter": "."}
MARGIN_KEYS = ("inset_left_pct", "inset_top_pct", "inset_right_pct", "inset_bottom_pct")


def resolve(files: DataFrame, builtin: dict[str, str]) -> DataFrame:
    """Effective value per scope and built-in key, with the layer it came from.

    A scope's whole active file counts if it has one, else its default file; keys missing there fall to the built-in
    value, unknown keys are ignored. The built-in side is a literal of fixed size.
    """
    spoken = files.filter(F.col("layer").isin("active", "default"))
    chosen = spoken.groupBy("scope").agg(F.min("layer").alias("layer"))  # 'active' sorts before 'default'
    values = spoken.join(chosen, ["scope", "layer"]).groupBy("scope", "layer", "key").agg(F.max("value").alias("value"))
    known = F.explode(F.create_map(*[F.lit(v) for kv in builtin.items() for v in kv])).alias("key", "fallback")
    wanted = files.select("scope").distinct().select("scope", known)
    return wanted.join(values, ["scope", "key"], "left").select(
        "scope", "key", F.coalesce("value", "fallback").alias("value"), F.coalesce("layer", F.lit("builtin")).alias("layer"))


def violations(settings: DataFrame, ranges: tuple = CAMERA_RANGES) -> DataFrame:
    """Values outside their range; lists like ``[0, 0, 300]`` are checked per channel, text that is no number counts."""
    table = F.create_map(*[x for k, low, high in ranges for x in (
        F.lit(k), F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")))])
    limit = F.get(F.array(F.try_element_at(table, F.col("key"))), F.lit(0))
    numbers = F.transform(F.split(F.regexp_replace("value", r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double"))
    good = F.forall(F.col("numbers"), lambda v: F.coalesce(v.between(F.col("limit.low"), F.col("limit.high")), F.lit(False)))
    return settings.withColumns({"limit": limit, "numbers": numbers}).filter(F.col("limit").isNotNull() & ~good).drop(
        "limit", "numbers")


def unknown_keys(settings: DataFrame, known: list[str]) -> DataFrame:
    return settings.filter(~F.col("key").isin(*known)).withColumn(
        "reason", F.concat(F.lit("Unknown setting '"), F.col("key"), F.lit("'")))


def override(resolved: DataFrame, updates: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Partial update (scope, key, value): given keys replace, others keep, margins are clamped to 0..1.

    The second table holds updates of unknown keys, which are errors and change nothing.
    """
    good = updates.filter(F.col("key").isin(*known)).groupBy("scope", "key").agg(F.max("value").alias("new_value"))
    number = F.col("value").try_cast("double")
    clamped = F.when(F.col("key").isin(*MARGIN_KEYS),
                     F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))).cast("string")).otherwise(F.col("value"))
    merged = resolved.join(good, ["scope", "key"], "left").select(
        "scope", "key", F.coalesce("new_value", "value").alias("value"),
        F.when(F.col("new_value").isNotNull(), "update").otherwise(F.col("layer")).alias("layer"))
    return merged.withColumn("value", clamped), unknown_keys(updates, known)


def expired_backups(files: DataFrame, keep: int = 5) -> DataFrame:
    """Backups beyond the newest ``keep`` of their scope.

    The newest ones are found with a top-``keep`` ranking that is cut before the shuffle; the rest is an anti join, so
    a scope with very many backups is never sorted in one task.
    """
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("mtime"), F.desc("path")))
    kept = files.select("scope", "path", "mtime").withColumn("__rank", rank).filter(F.col("__rank") <= keep)
    return files.join(kept.select("scope", "path"), ["scope", "path"], "left_anti")


def typed(resolved: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per scope with typed columns."""
    pick = lambda k, t: F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(t).alias(k)
    return resolved.groupBy("scope").agg(*[pick(k, t) for k, t in types.items()])


def slot_ticks(slots: DataFrame, mm: Column | None = None) -> DataFrame:
    from scanframe.functions.geometry import mm_to_ticks
    return slots.withColumns({a: mm_to_ticks(F.col(f"{a}_mm")) for a in ("x", "y", "z")})
