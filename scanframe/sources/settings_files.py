"""Settings files (flat YAML) and the slot map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample slots of the stage, millimetres (slot 1 to 20); y and z are the same for all.
SLOT_X_MM = (22.12, 33.47, 44.44, 53.28, 64.55, 75.70, 87.24, 98.60, 110.16, 122.00, 132.96, 144.46, 156.04, 167.44, 179.08,
             190.72, 202.04, 213.36, 224.88, 224.88)
SLOT_Y_MM, SLOT_Z_MM = 200.00, 29.00


def slot_map(spark: SparkSession) -> DataFrame:
    """The twenty built-in slots; a literal table, so it may be broadcast."""
    rows = [(i + 1, x, SLOT_Y_MM, SLOT_Z_MM) for i, x in enumerate(SLOT_X_MM)]
    return spark.createDataFrame(rows, "slot int, x_mm double, y_mm double, z_mm double")


def unquoted(value: Column) -> Column:
    bare = F.trim(F.regexp_replace(value, r"""^\s*("[^"]*"|'[^']*'|[^#]*?)\s*(#.*)?$""", "$1"))
    return F.regexp_replace(bare, r"""^(["'])(.*)\1$""", "$2")


def parse_flat(lines: DataFrame) -> DataFrame:
    """``key: value`` lines (column value) as key and value; comments, blank and indented lines give no rows."""
    v = F.col("value")
    return lines.filter(v.rlike(r"^[A-Za-z_]\w*\s*:")).withColumns({
        "key": F.trim(F.substring_index(v, ":", 1)),
        "value": unquoted(F.regexp_replace(v, r"^[A-Za-z_]\w*\s*:", ""))}).filter("value <> ''")


def parse_slots(lines: DataFrame) -> DataFrame:
    """``1: { x: 22.12, y: 200.00, z: 29.00 }`` lines as slot rows; a missing coordinate stays NULL."""
    number = lambda a: F.nullif(F.regexp_extract("value", rf"{a}:\s*([-\d.]+)", 1), F.lit("")).try_cast("double")
    slot = F.nullif(F.regexp_extract("value", r"^\s+(\d+)\s*:\s*\{", 1), F.lit("")).try_cast("int")
    return lines.withColumn("slot", slot).filter("slot is not null").select(
        *[c for c in lines.columns if c != "value"], "slot", *[number(a).alias(f"{a}_mm") for a in "xyz"])


def read_settings(spark: SparkSession, root: str, scope_namer: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """Settings below ``root``: scope = folder, layer = active (settings.yaml) or default (default_settings.yaml).

    ``scope_namer`` turns the folder name into the scope.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*settings.yaml").text(root)
             .withColumn("scope", scope_namer(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1)))
             .withColumn("layer", F.when(F.startswith(name, F.lit("default_")), "default").otherwise("active")))
    return parse_flat(lines).select("scope", "layer", "key", "value")


def read_slots(spark: SparkSession, root: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*settings.yaml").text(root)
    return parse_slots(lines.withColumn("scope", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1)))
