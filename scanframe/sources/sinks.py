"""Sinks: frame tiles, alignment documents, detection text, dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions.bands import fixed


def detection_text(marks: DataFrame, title: Column, keys: list[str], order: str) -> DataFrame:
    """One text block per frame: numbered marks with two decimals, then the mean x. Groups are the marks of a frame.

    The mean is summed in the order of the marks: a sum in the order of arrival may differ in its last bit, which shows
    where a mean lies halfway between two texts.
    """
    ordered = F.sort_array(F.collect_list(F.struct(order, "cx", "cy")))
    lines = F.transform(
        ordered,
        lambda m, i: F.concat(F.lit("  Mark "), (i + 1).cast("string"), F.lit(": ("), fixed(m["cx"], 2), F.lit(", "),
                              fixed(m["cy"], 2), F.lit(")")))
    return marks.groupBy(*keys, title.alias("title")).agg(
        lines.alias("lines"), (F.aggregate(ordered, F.lit(0.0), lambda total, m: total + m["cx"]) / F.count("cx")).alias("mean_x")).select(
        F.concat(F.col("title"), F.lit(":\n"), F.array_join("lines", "\n"), F.lit("\n"),
                 F.lit("  Mean center X: "), fixed(F.col("mean_x"), 2)).alias("value"))


def write_frame_tiles(tiles: DataFrame, path: str, sample: str = "sample_id", mode: str = "append") -> None:
    """Tile rows as parquet, one folder per sample. Rows are spread by frame within a sample, so a big sample is many files."""
    spread = [c for c in ("frame_id", "tile_row", "tile_col") if c in tiles.columns]
    tiles.repartition(sample, *spread).write.mode(mode).partitionBy(sample).parquet(path)


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Alignment documents as JSON lines, a folder per sample."""
    documents.write.mode(mode).partitionBy("sample_id").json(path)


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select("value").write.mode(mode).text(path)


def fan_out(sinks: list[Callable[[DataFrame, int], None]],
            on_error: Callable[[int, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that feeds every sink; a failing sink does not keep the batch from the others."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for number, sink in enumerate(sinks):
                try:
                    sink(batch, batch_id)
                except Exception as error:  # noqa: BLE001 - listeners are isolated from each other
                    if on_error is not None:
                        on_error(number, error)
        finally:
            batch.unpersist()
    return run
