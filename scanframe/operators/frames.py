"""Frame tables: ``frame_id, [sample_id, ...], width, height, n_channels, data``; data is row-major, blue-green-red."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanframe.functions import kernels

PIXEL_COLUMNS = ("width", "height", "n_channels", "data")


def map_frames(frames: DataFrame, keys: list[str], fields: str,
               one: Callable[[np.ndarray, dict], Iterable[tuple]]) -> DataFrame:
    """Narrow map over frames: ``one(image, keys)`` gives rows of ``fields``; the key columns are carried along.

    No shuffle and no state between frames; only the keys and the pixels reach Python.
    """
    out = T.StructType([frames.schema[k] for k in keys] + list(T._parse_datatype_string(fields).fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                key = {k: getattr(record, k) for k in keys}
                img = kernels.image(record.data, record.height, record.width, record.n_channels)
                rows.extend(tuple(key.values()) + tuple(r) for r in one(img, key))
            yield pd.DataFrame(rows, columns=out.names)

    return frames.select(*keys, *PIXEL_COLUMNS).mapInPandas(run, out)


def to_gray(frames: DataFrame, keys: list[str]) -> DataFrame:
    def one(img, _):
        g = kernels.gray(img)
        yield g.shape[1], g.shape[0], 1, g.tobytes()
    return map_frames(frames, keys, "width int, height int, n_channels int, data binary", one)


def rotate(frames: DataFrame, keys: list[str], turns: list[str]) -> DataFrame:
    def one(img, _):
        t = kernels.turned(img, turns)
        yield t.shape[1], t.shape[0], t.shape[2], t.tobytes()
    return map_frames(frames, keys, "width int, height int, n_channels int, data binary", one)


def transpose(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames mirrored along the diagonal."""
    def one(img, _):
        yield img.shape[0], img.shape[1], img.shape[2], np.ascontiguousarray(img.transpose(1, 0, 2)).tobytes()
    return map_frames(frames, keys, "width int, height int, n_channels int, data binary", one)


def resize(frames: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Area mean for a scale below 1, bilinear above; a scale that is not positive counts as 1."""
    if scale <= 0 or scale == 1.0:
        return frames.select(*keys, *PIXEL_COLUMNS)

    def one(img, _):
        planes = np.dstack([kernels.resize(img[:, :, c], scale) for c in range(img.shape[2])])
        yield planes.shape[1], planes.shape[0], planes.shape[2], planes.tobytes()
    return map_frames(frames, keys, "width int, height int, n_channels int, data binary", one)


def cut_tiles(frames: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Frames as storage tiles on a fixed grid; edge tiles are smaller."""
    def one(img, _):
        for y in range(0, img.shape[0], tile):
            for x in range(0, img.shape[1], tile):
                part = img[y:y + tile, x:x + tile]
                yield (x // tile, y // tile, x, y, part.shape[1], part.shape[0], part.shape[2],
                       np.ascontiguousarray(part).tobytes())
    return map_frames(frames, keys, "tile_col int, tile_row int, x int, y int, w int, h int, n_channels int, data binary",
                      one)


def normalise_for_storage(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with 3 or 4 channels (gray is tripled); anything else goes to the rejects with a reason."""
    ok = F.col("n_channels").isin(1, 3, 4)
    tripled = map_frames(
        frames.filter("n_channels = 1"),
        [c for c in frames.columns if c not in PIXEL_COLUMNS], "width int, height int, n_channels int, data binary",
        lambda img, _: [(img.shape[1], img.shape[0], 3, np.repeat(img, 3, axis=2).tobytes())])
    good = frames.filter("n_channels in (3, 4)").unionByName(tripled.select(*frames.columns))
    bad = frames.filter(~ok).select(
        *[c for c in frames.columns if c != "data"],
        F.concat(F.lit("unsupported channel count "), F.col("n_channels").cast("string")).alias("reason"))
    return good, bad


def pixels(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames as one row per pixel and channel bytes; the relational form for small regions and checks."""
    n = F.col("n_channels")
    at = lambda c: F.conv(F.hex(F.substring("data", F.col("pos") * n + c + 1, F.lit(1))), 16, 10).cast("int")
    cells = frames.select(*keys, "width", "n_channels", "data", F.explode(F.sequence(
        F.lit(0), F.col("width") * F.col("height") - 1)).alias("pos"))
    colour = F.when(n >= 3, at(F.lit(2)))
    return cells.select(*keys, F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
                        (F.col("pos") % F.col("width")).cast("int").alias("x"),
                        F.coalesce(colour, at(F.lit(0))).alias("r"),
                        F.coalesce(F.when(n >= 3, at(F.lit(1))), at(F.lit(0))).alias("g"), at(F.lit(0)).alias("b"))
