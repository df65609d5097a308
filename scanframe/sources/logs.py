"""Text logs: commands and scan status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"([-+]?[\d.]+)"
BOUNDS = (rf"^\[SCAN_SAMPLE_BOUNDS\] Y={NUMBER} → Avg\(R,G,B,Y\)=\({NUMBER},{NUMBER},{NUMBER},{NUMBER}\)\s+"
          r"Focus: hard=(\d+) soft=(\d+)")
FOCUS = rf"^\[(AF[\w-]*)\].*?Z={NUMBER}(?: \(FLOOR\))?\s+score={NUMBER}(?:\s+Δbase={NUMBER})?"


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Raw command lines with the file they came from."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def stream_commands(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def bounds_line(y: Column, r: Column, g: Column, b: Column, ylum: Column, hard: Column, soft: Column) -> Column:
    return F.format_string("[SCAN_SAMPLE_BOUNDS] Y=%.3f → Avg(R,G,B,Y)=(%.1f,%.1f,%.1f,%.3f)  Focus: hard=%d soft=%d  ", y, r, g, b,
                           ylum, hard, soft)


def parse_bounds(lines: DataFrame, column: str = "line") -> DataFrame:
    """Measurements of a bounds scan; other lines give no rows."""
    part = lambda i, kind: F.nullif(F.regexp_extract(column, BOUNDS, i), F.lit("")).try_cast(kind)
    return lines.withColumns({
        "y_mm": part(1, "double"), "r": part(2, "double"), "g": part(3, "double"), "b": part(4, "double"),
        "ylum": part(5, "double"), "hard": part(6, "int"), "soft": part(7, "int")}).filter("y_mm is not null")


def parse_focus(lines: DataFrame, column: str = "line") -> DataFrame:
    """Probes of focus searches: phase, z, score and, where given, the change from the baseline."""
    part = lambda i: F.nullif(F.regexp_extract(column, FOCUS, i), F.lit(""))
    return lines.withColumns({"phase": part(1), "z_mm": part(2).try_cast("double"), "score": part(3).try_cast("double"),
                              "delta_base": part(4).try_cast("double")}).filter("z_mm is not null")
