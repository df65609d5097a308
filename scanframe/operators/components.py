"""8-connected components of masks that may be cut into tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanframe.functions import kernels
from scanframe.session import cut_lineage


def label_tiles(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Local components of mask tiles (keys, image_w, x0, y0, w, h, mask: one byte per pixel, 0 = outside).

    One row per local component: ``node`` is the image position (y * image_w + x) of its first pixel, plus area,
    bounding box, coordinate sums and the border pixels it needs for joining its neighbours.
    """
    stats = ("node long, image_w int, area long, x_min int, x_max int, y_min int, y_max int, sum_x long, sum_y long, "
             "border array<struct<y:int,x:int>>")
    out = T.StructType([masks.schema[k] for k in keys] + list(T._parse_datatype_string(stats).fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                mask = np.frombuffer(r.mask, np.uint8).reshape(r.h, r.w) > 0
                ys, xs = np.nonzero(mask)
                if not len(ys):
                    continue
                labels = kernels.local_components(mask)[ys, xs]
                edge = (ys == 0) | (ys == r.h - 1) | (xs == 0) | (xs == r.w - 1)
                order = np.argsort(labels, kind="stable")
                starts = np.flatnonzero(np.diff(labels[order], prepend=-1))
                for part in np.split(order, starts[1:]):
                    py, px = ys[part] + r.y0, xs[part] + r.x0
                    first = int(labels[part[0]]) - 1
                    node = (first // r.w + r.y0) * r.image_w + first % r.w + r.x0
                    on_edge = edge[part]
                    border = [{"y": int(a), "x": int(b)} for a, b in zip(py[on_edge], px[on_edge])]
                    rows.append((*[getattr(r, k) for k in keys], node, r.image_w, len(part), int(px.min()), int(px.max()),
                                 int(py.min()), int(py.max()), int(px.sum()), int(py.sum()), border))
            yield pd.DataFrame(rows, columns=out.names)

    return masks.select(*keys, "image_w", "x0", "y0", "w", "h", "mask").mapInPandas(run, out)


def seam_edges(local: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs of local components that touch across a tile border, both directions."""
    pixels = local.select(*keys, "node", F.explode("border").alias("p")).select(
        *keys, "node", F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                      for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reached = pixels.select(*keys, F.col("node").alias("a"), "y", "x", F.explode(steps).alias("s")).select(
        *keys, "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    touching = reached.join(pixels.withColumnRenamed("node", "b"), [*keys, "y", "x"]).filter("a <> b")
    one_way = touching.select(*keys, "a", "b").distinct()
    return one_way.unionByName(one_way.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))


def merge_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node reachable from every node that has an edge: (keys, node, component).

    Every round takes the smallest neighbouring label and then follows that label one step; rounds grow with the
    logarithm of the component's extent in tiles for most shapes, and go on until no label moves. Only numbers per node move, never a component.
    """
    edges = cut_lineage(edges)
    labels = cut_lineage(edges.groupBy(*keys, F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        theirs = labels.select(*keys, F.col("node").alias("b"), F.col("component").alias("theirs"))
        lowest = edges.join(theirs, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(
            F.min("theirs").alias("lowest"))
        stepped = labels.join(lowest, [*keys, "node"]).select(
            *keys, "node", F.col("component").alias("before"), F.least("component", "lowest").alias("next"))
        roots = labels.select(*keys, F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = cut_lineage(stepped.join(roots, [*keys, "next"], "left").select(
            *keys, "node", "before", F.least("next", F.coalesce("beyond", "next")).alias("component")))
        labels = moved.drop("before")
        if moved.filter("component <> before").isEmpty():
            return labels


def components(masks: DataFrame, keys: list[str], whole_images: bool = False) -> DataFrame:
    """One row per component: area, bounding box, centroid; ``component`` is the position of its first pixel.

    With ``whole_images`` every mask tile is a whole image, so nothing can touch across a border.
    """
    local = label_tiles(masks, keys)
    if whole_images:
        named = local.withColumn("component", F.col("node"))
    else:
        local = cut_lineage(local)
        merged = merge_labels(seam_edges(local, keys), keys)
        named = local.join(merged, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
    area = F.sum("area")
    return named.groupBy(*keys, "component").agg(
        area.alias("area"), F.min("x_min").alias("x"), F.min("y_min").alias("y"),
        (F.max("x_max") - F.min("x_min") + 1).alias("w"), (F.max("y_max") - F.min("y_min") + 1).alias("h"),
        (F.sum("sum_x") / area).alias("cx"), (F.sum("sum_y") / area).alias("cy"))
