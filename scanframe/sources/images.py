"""Image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions import names

# Extensions the callers look for.
EXTENSIONS = {"stitch": ("tiff", "tif", "jpg", "jpeg", "png"), "marks": ("jpg", "jpeg", "png", "bmp", "tiff"),
              "convert": ("png", "tiff", "tif"), "any": ("jpg", "jpeg", "png", "tif", "tiff", "bmp")}


def has_extension(path: Column, extensions: tuple[str, ...] = EXTENSIONS["any"]) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(extensions) + ")$")


def list_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS["any"]) -> DataFrame:
    """Image files below ``root``, each once: path, folder, name, length, modified. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.col("path")
    return (files.filter(has_extension(path, extensions)).dropDuplicates(["path"])
            .select("path", names.parent_name(path).alias("folder"), names.base_name(path).alias("name"), "length",
                    F.col("modificationTime").alias("modified")))


def unique_paths(listing: DataFrame) -> DataFrame:
    return listing.dropDuplicates(["path"])


def read_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Decoded frames (path, folder, name, width, height, n_channels, data) and the files that cannot be decoded."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    path = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    frames = raw.select(path.alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                        F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))
    good = frames.filter("height > 0 and n_channels > 0").withColumns({
        "folder": names.parent_name(F.col("path")), "name": names.base_name(F.col("path"))})
    bad = frames.filter("height <= 0 or n_channels <= 0").select("path", F.lit("cannot be decoded").alias("reason"))
    return good, bad


def flatten_alpha(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with alpha composed over white; gray becomes three equal channels."""
    import numpy as np

    from scanframe.operators.frames import map_frames

    def one(img, _):
        if img.shape[2] == 4:
            alpha = img[:, :, 3:].astype(np.int32)
            img = ((img[:, :, :3].astype(np.int32) * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
        elif img.shape[2] == 1:
            img = np.repeat(img, 3, axis=2)
        yield img.shape[1], img.shape[0], 3, np.ascontiguousarray(img).tobytes()
    return map_frames(frames, keys, "width int, height int, n_channels int, data binary", one)
