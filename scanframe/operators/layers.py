"""Pictures that exist only as canvas tiles, aligned with each other and assembled again.

A layer (one row of a grid of frames, say) is a mosaic of its own: keyed tiles, never one picture. Layers are stacked along y
in order of ``seq``. Two neighbours are compared where the lower edge of one meets the upper edge of the next; each tile column
compares its own part of the edges and gives exact whole-number sums per candidate, which add up over the columns to the
correlation of the whole edges. So the work of a pair is spread over its width, and a task holds one column of two strips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import kernels
from scanframe.operators import canvas, ordered
from scanframe.operators.align import PAIR, Search, correlation_of
from scanframe.session import cut_lineage

LAYER = ["sample_id", "seq"]
SPEC = ["o_from", "o_to", "o_step", "s_from", "s_to", "s_step"]
SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]
PIECE = "pair_idx long, side int, band int, x int, y int, w int, h int, data binary"


def neighbours(layers: DataFrame, search: Search) -> DataFrame:
    """Pairs of consecutive layers (sample_id, seq, width, height) with the range of their overlap."""
    near = ordered.with_neighbours(layers, ["sample_id"], "seq", lambda w: {
        "next_seq": F.lead("seq").over(w), "next_w": F.lead("width").over(w), "next_h": F.lead("height").over(w)}, after=1)
    least = F.least("height", "next_h")
    return near.filter(F.col("next_seq") == F.col("seq") + 1).select(
        "sample_id", F.col("seq").alias("pair_idx"), F.col("width").alias("wa"), F.col("height").alias("ha"), F.col("next_w").alias("wb"),
        F.col("next_h").alias("hb"), (least * search.min_overlap).cast("int").alias("low"), (least * search.max_overlap).cast("int").alias("high"))


def edges(tiles: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """Gray parts of the edges, by pair and tile column: the upper layer's own columns, the lower one's with ``reach`` more on both sides.

    Pixels that no frame covers are black, as they are in the canvas. x counts from the start of the column, y from the
    start of the strip.
    """
    above = pairs.select("sample_id", F.col("pair_idx").alias("seq"), "pair_idx", F.lit(0).alias("side"), F.col("ha").alias("height"), "high")
    below = pairs.select("sample_id", (F.col("pair_idx") + 1).alias("seq"), "pair_idx", F.lit(1).alias("side"), F.col("hb").alias("height"), "high")
    first = F.when(F.col("side") == 0, F.col("height") - F.col("high")).otherwise(0)  # rows of the layer that the strip holds
    last = F.when(F.col("side") == 0, F.col("height")).otherwise(F.col("high"))
    asked = above.unionByName(below).select(*LAYER, "pair_idx", "side", first.cast("int").alias("first"), last.cast("int").alias("last"))
    top = F.col("tile_row") * F.col("size")
    cut = tiles.join(asked, LAYER).filter((top < F.col("last")) & (top + F.col("size") > F.col("first")))
    kind = tiles.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                y0, size = r.tile_row * r.size, r.size
                gray = kernels.gray(np.frombuffer(r.data, np.uint8).reshape(size, size, r.n_channels))
                gray = np.where(np.frombuffer(r.covered, np.uint8).reshape(size, size) > 0, gray, 0).astype(np.uint8)
                part = gray[max(0, r.first - y0):min(size, r.last - y0)]
                y = max(y0, r.first) - r.first
                for band, x, x0, x1 in [(0, 0, 0, size)] if r.side == 0 else [(-1, size, 0, min(size, reach)), (0, 0, 0, size), (1, -reach, size - reach, size)]:
                    if x1 > x0 >= 0 and r.tile_col + band >= 0:
                        piece = np.ascontiguousarray(part[:, x0:x1])
                        out.append((r.sample_id, r.pair_idx, r.side, r.tile_col + band, x, y, piece.shape[1], piece.shape[0], piece.tobytes()))
            yield pd.DataFrame(out, columns=["sample_id", *[f.split()[0] for f in PIECE.split(", ")]])

    return cut.select("sample_id", "pair_idx", "side", "tile_col", "tile_row", "size", "n_channels", "data", "covered", "first", "last").mapInPandas(
        run, f"sample_id {kind}, {PIECE}")


def candidate_sums(pieces: DataFrame, pairs: DataFrame, spec: DataFrame, tile: int, reach: int, min_width: int) -> DataFrame:
    """(sample_id, pair_idx, overlap, shift, n, sa, sb, saa, sbb, sab) of every candidate of ``spec``, summed over the tile columns.

    A positive shift places the lower layer further to the right. Candidates that compare ``min_width`` columns or fewer are left out.
    """
    rows = pieces.join(pairs.select(*PAIR, "wa", "wb", "high"), PAIR).join(spec, PAIR)
    kind = pieces.schema["sample_id"].dataType.simpleString()
    names = [*PAIR, "overlap", "shift", *SUMS[1:]]

    def column(head, upper: np.ndarray, lower: np.ndarray) -> Iterator[tuple]:
        start, depth, end = int(head.band) * tile, int(head.high), (int(head.band) + 1) * tile
        overlaps = range(max(1, int(head.o_from)), min(depth, int(head.o_to)) + 1, int(head.o_step))
        for shift in range(int(head.s_from), int(head.s_to) + 1, int(head.s_step)):
            x0, x1 = max(start, shift, 0), min(end, int(head.wa), int(head.wb) + shift)  # columns of the upper layer that both have
            if x1 <= x0:
                continue
            a, b = upper[:, x0 - start:x1 - start], lower[:, x0 - start - shift + reach:x1 - start - shift + reach]
            # rows from the bottom up and from the top down: an overlap's own sums are running ones
            sa, saa = (np.cumsum(v.sum(1)[::-1]).tolist() for v in (a, a * a))
            sb, sbb = (np.cumsum(v.sum(1)).tolist() for v in (b, b * b))
            for o in overlaps:
                yield head.sample_id, head.pair_idx, o, shift, sa[o - 1], sb[o - 1], saa[o - 1], sbb[o - 1], int(np.einsum("ij,ij->", a[depth - o:], b[:o]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, head, upper, lower = None, None, None, None
        for batch in batches:  # rows come sorted: a column's pieces follow each other
            out = []
            for r in batch.itertuples(index=False):
                if (r.sample_id, r.pair_idx, r.band) != key:
                    if key is not None:
                        out.extend(column(head, upper, lower))
                    key, head = (r.sample_id, r.pair_idx, r.band), r
                    upper, lower = np.zeros((int(r.high), tile), np.int64), np.zeros((int(r.high), tile + 2 * reach), np.int64)
                into, x = (upper, r.x) if r.side == 0 else (lower, r.x + reach)
                into[r.y:r.y + r.h, x:x + r.w] = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame(column(head, upper, lower), columns=names)

    dealt = rows.repartition(*PAIR, "band").sortWithinPartitions(*PAIR, "band")
    sums = dealt.mapInPandas(run, f"sample_id {kind}, pair_idx long, overlap int, shift int, " + ", ".join(f"{c} long" for c in SUMS[1:]))
    whole = sums.groupBy(*PAIR, "overlap", "shift").agg(*[F.sum(c).alias(c) for c in SUMS[1:]]).join(pairs.select(*PAIR, "wa", "wb"), PAIR)
    # columns that both layers have; where neither has a tile there is nothing to add to the sums, but the pixels count
    width = F.least("wa", F.col("wb") + F.col("shift")) - F.greatest(F.lit(0), "shift")
    return whole.filter(width > min_width).select(*PAIR, "overlap", "shift", (F.col("overlap") * width).cast("bigint").alias("n"), *SUMS[1:])


def _best(sums: DataFrame) -> DataFrame:
    """The candidate with the highest correlation, on a tie that with the smaller overlap, then shift; flat ones don't count."""
    score = correlation_of(*[F.col(c) for c in SUMS])
    scored = sums.withColumn("score", score).filter("score is not null")
    return scored.groupBy(*PAIR).agg(F.min(F.struct((-F.col("score")).alias("lost"), "overlap", "shift")).alias("best"), F.count(F.lit(1)).alias("n")).select(
        *PAIR, (-F.col("best.lost")).alias("score"), "best.overlap", "best.shift", F.col("n").alias("tried"))


def _spec(**bounds: Column) -> list[Column]:
    return [bounds[c].cast("int").alias(c) for c in SPEC]


def align_layers(tiles: DataFrame, layers: DataFrame, search: Search = Search(), tile: int = 1024) -> DataFrame:
    """(sample_id, pair_idx, overlap, shift, score, coarse_overlap, coarse_score) of consecutive layers.

    The grids are those of ``align.find_alignments`` turned by a quarter: overlaps along y, shifts along x. Each of the
    three steps is one pass over the stored edges.
    """
    reach = max(search.y_tiers) + search.fine_radius[1]
    pairs = cut_lineage(neighbours(layers, search))
    pieces = cut_lineage(edges(tiles, pairs, reach))

    def best(spec: DataFrame) -> DataFrame:
        return _best(candidate_sums(pieces, pairs, spec.select(*PAIR, *SPEC), tile, reach, search.min_height))

    low, high = F.col("low"), F.col("high")
    step = F.greatest(F.lit(search.coarse_step), F.floor((high - low) / 40))
    coarse = best(pairs.select(*PAIR, *_spec(o_from=low, o_to=high - 1, o_step=step, s_from=F.lit(0), s_to=F.lit(0), s_step=F.lit(1))))
    radius = F.lit(search.y_tiers[3])
    for limit, r in reversed(list(zip((0.98, 0.96, 0.94), search.y_tiers, strict=False))):
        radius = F.when(F.col("coarse_score") > limit, r).otherwise(radius)
    known = pairs.join(coarse.select(*PAIR, F.col("overlap").alias("coarse_overlap"), F.col("score").alias("coarse_score")), PAIR, "left").withColumns({
        "coarse_overlap": F.coalesce("coarse_overlap", "low"), "coarse_score": F.coalesce("coarse_score", F.lit(-1.0))})
    known = cut_lineage(known.withColumns({"reach": radius, "x_lo": F.greatest(low, F.col("coarse_overlap") - search.x_range),
                                           "x_hi": F.least(high, F.col("coarse_overlap") + search.x_range)}))
    grid = best(known.select(*PAIR, *_spec(o_from=F.col("x_lo"), o_to=F.col("x_hi"), o_step=F.lit(search.grid[0]), s_from=-F.col("reach"), s_to=F.col("reach"),
                                           s_step=F.lit(search.grid[1]))))
    found = known.join(grid.select(*PAIR, "overlap", "shift", "score"), PAIR, "left")
    found = cut_lineage(found.withColumns({"overlap": F.coalesce("overlap", "coarse_overlap"), "shift": F.coalesce("shift", F.lit(0)), "score": F.coalesce("score", F.lit(-1.0))}))
    (ro, rs), (so, ss) = search.fine_radius, search.fine_step
    # steps count from the winner; the first one inside the allowed range is where they start
    first = lambda centre, r, step, least: centre - r + F.greatest(F.lit(0), F.ceil((least - (centre - r)) / step)) * step
    fine = best(found.select(*PAIR, *_spec(
        o_from=first(F.col("overlap"), ro, so, F.col("x_lo")), o_to=F.least(F.col("overlap") + ro, F.col("x_hi")), o_step=F.lit(so),
        s_from=first(F.col("shift"), rs, ss, -F.col("reach")), s_to=F.least(F.col("shift") + rs, F.col("reach")), s_step=F.lit(ss))))
    both = found.join(fine.select(*PAIR, F.struct("overlap", "shift", "score").alias("fine")), PAIR, "left")
    better = F.col("fine.score") > F.col("score")
    return both.select(*PAIR, *[F.when(better, F.col(f"fine.{c}")).otherwise(F.col(c)).alias(c) for c in ("overlap", "shift", "score")], "coarse_overlap", "coarse_score")


def place_layers(layers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Layers with x_pos and y_pos: y adds up height - overlap, x adds up the shifts, from the least on."""
    turned = layers.select(*LAYER, F.col("height").alias("width"), F.col("width").alias("height"))
    along = canvas.placements(turned, pairs.select(*PAIR, F.col("overlap").alias("x_overlap"), F.col("shift").alias("y_offset")), accumulate_y=True)
    placed = along.select(*LAYER, F.col("height").alias("width"), F.col("width").alias("height"), F.col("y_pos").alias("x_pos"), F.col("x_pos").alias("y_pos"))
    left = placed.groupBy("sample_id").agg(F.min("x_pos").alias("__left"))
    return placed.join(left, "sample_id").withColumn("x_pos", F.col("x_pos") - F.col("__left")).drop("__left")


def compose_layers(tiles: DataFrame, placed: DataFrame, tile: int = 1024) -> DataFrame:
    """Canvas tiles of all layers of a sample; where several cover a pixel, the last layer wins. Tiles are cut along the new canvas's tiles."""
    kind = tiles.schema["sample_id"].dataType.simpleString()
    fields = "seq long, tile_col int, tile_row int, px int, py int, w int, h int, n_channels int, data binary, write_order binary, mask binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                size = r.size
                value = np.frombuffer(r.data, np.uint8).reshape(size, size, r.n_channels)
                mask = np.frombuffer(r.covered, np.uint8).reshape(size, size)
                x, y = int(r.x_pos) + r.tile_col * size, int(r.y_pos) + r.tile_row * size
                for row in range(y // tile, (y + size - 1) // tile + 1):
                    for col in range(x // tile, (x + size - 1) // tile + 1):
                        y0, y1 = max(y, row * tile), min(y + size, (row + 1) * tile)
                        x0, x1 = max(x, col * tile), min(x + size, (col + 1) * tile)
                        at = (slice(y0 - y, y1 - y), slice(x0 - x, x1 - x))
                        if mask[at].any():
                            out.append((r.sample_id, r.seq, col, row, x0 - col * tile, y0 - row * tile, x1 - x0, y1 - y0, r.n_channels,
                                        np.ascontiguousarray(value[at]).tobytes(), np.full(x1 - x0, r.seq, "<i8").tobytes(), np.ascontiguousarray(mask[at]).tobytes()))
            yield pd.DataFrame(out, columns=["sample_id", *[f.split()[0] for f in fields.split(", ")]])

    where = tiles.join(placed.select(*LAYER, "x_pos", "y_pos"), LAYER).select(*LAYER, "x_pos", "y_pos", "tile_col", "tile_row", "size", "n_channels", "data", "covered")
    return canvas.compose(where.mapInPandas(run, f"sample_id {kind}, {fields}"), tile)


def transposed_tiles(tiles: DataFrame) -> DataFrame:
    """Canvas tiles mirrored along the diagonal."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turned = batch.copy()
            shapes = list(zip(batch["size"], batch["n_channels"], strict=True))
            turned["data"] = [np.frombuffer(d, np.uint8).reshape(s, s, c).transpose(1, 0, 2).tobytes() for d, (s, c) in zip(batch["data"], shapes, strict=True)]
            turned["covered"] = [np.frombuffer(d, np.uint8).reshape(s, s).T.tobytes() for d, (s, _) in zip(batch["covered"], shapes, strict=True)]
            turned["tile_col"], turned["tile_row"] = batch["tile_row"], batch["tile_col"]
            yield turned
    return tiles.mapInPandas(run, tiles.schema)


def tile_checksums(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per canvas tile: covered pixels, their sum and a sum weighted by place (first channel), instead of the pixels."""
    kinds = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                mask = np.frombuffer(r.covered, np.uint8).reshape(r.size, r.size) > 0
                value = np.frombuffer(r.data, np.uint8).reshape(r.size, r.size, r.n_channels)[:, :, 0].astype(np.int64)
                place = np.arange(1, r.size * r.size + 1).reshape(r.size, r.size)
                out.append((*[getattr(r, k) for k in keys], r.tile_col, r.tile_row, int(mask.sum()), int(value[mask].sum()), int((value * place)[mask].sum())))
            yield pd.DataFrame(out, columns=[*keys, "tile_col", "tile_row", "n_covered", "total", "weighted"])

    return tiles.select(*keys, "tile_col", "tile_row", "size", "n_channels", "data", "covered").mapInPandas(
        run, f"{kinds}, tile_col int, tile_row int, n_covered long, total long, weighted long")
