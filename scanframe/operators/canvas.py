"""Mosaics as keyed canvas tiles; no task ever holds more than one tile and the piece it is folding in."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.functions import kernels
from scanframe.operators import ordered
from scanframe.operators.frames import map_frames

TILE_KEY = ["sample_id", "tile_col", "tile_row"]
LATER = 1 << 40   # priority step between the two passes
FOLDED = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}   # what the fields of a fold may be
HELD_ROWS, HELD_BYTES = 1024, 16 << 20   # folded rows that wait before they are handed on


def placements(frames_meta: DataFrame, pairs: DataFrame, accumulate_y: bool = False) -> DataFrame:
    """Canvas position of every frame (sample_id, seq, width, height) from its pair with the frame before.

    x adds up width - overlap; y is the pair's own offset unless ``accumulate_y``.
    """
    steps = frames_meta.join(
        pairs.select("sample_id", (F.col("pair_idx") + 1).alias("seq"), "x_overlap", "y_offset"), ["sample_id", "seq"], "left")
    lagged = ordered.with_neighbours(steps, ["sample_id"], "seq", lambda w: {"__prev_w": F.lag("width").over(w)}, before=1)
    step = F.coalesce(F.col("__prev_w") - F.col("x_overlap"), F.lit(0)).cast("bigint")
    own_y = F.coalesce("y_offset", F.lit(0)).cast("bigint")
    placed = ordered.running(lagged, ["sample_id"], "seq", {"x_pos": ("sum", step), "y_sum": ("sum", own_y)})
    return placed.withColumn("y_pos", F.col("y_sum") if accumulate_y else own_y).drop("__prev_w", "y_sum")


def extents(placed: DataFrame, sample: str = "sample_id") -> DataFrame:
    return placed.groupBy(sample).agg(
        F.max(F.col("x_pos") + F.col("width")).alias("canvas_w"),
        (F.max(F.col("y_pos") + F.col("height")) - F.min("y_pos")).alias("canvas_h"), F.min("y_pos").alias("min_y"))


def with_neighbour_positions(placed: DataFrame) -> DataFrame:
    """Adds what the centre rule needs to know of the frames before and after, and the canvas row offset."""
    near = ordered.with_neighbours(placed, ["sample_id"], "seq", lambda w: {
        "prev_x": F.lag("x_pos").over(w), "prev_w": F.lag("width").over(w), "next_x": F.lead("x_pos").over(w),
        "next_w": F.lead("width").over(w), "next_overlap": F.lead("x_overlap").over(w)}, before=1, after=1)
    return near.join(extents(placed).select("sample_id", "min_y"), "sample_id")


def _column_priority(key: dict, width: int, center_rule: bool) -> np.ndarray:
    """Write order of every frame column: the last write wins.

    Pass one lays frames down in order. Pass two goes through neighbouring frames and gives each overlapping canvas
    column to the frame whose centre is nearer, the later frame on a tie.
    """
    seq, x = int(key["seq"]), int(key["x_pos"])
    order = np.full(width, seq, np.int64)
    if not center_rule:
        return order
    canvas = x + np.arange(width)
    known = lambda v: v is not None and v == v  # noqa: E731 - NULL reaches pandas as NaN
    if known(key["prev_x"]) and known(key["x_overlap"]) and key["x_overlap"] > 0:
        px, pw = int(key["prev_x"]), int(key["prev_w"])
        shared = (canvas >= x) & (canvas < px + pw) & (canvas >= px)
        nearer = np.abs(canvas - (px + pw // 2)) >= np.abs(canvas - (x + width // 2))
        order = np.where(shared & nearer, LATER + seq - 1, order)
    if known(key["next_x"]) and known(key["next_overlap"]) and key["next_overlap"] > 0:
        nx, nw = int(key["next_x"]), int(key["next_w"])
        shared = (canvas >= nx) & (canvas < x + width) & (canvas < nx + nw)
        nearer = np.abs(canvas - (x + width // 2)) < np.abs(canvas - (nx + nw // 2))
        order = np.where(shared & nearer, LATER + seq, order)
    return order


def cut_pieces(frames: DataFrame, placed: DataFrame, tile: int = 1024, center_rule: bool = True) -> DataFrame:
    """Frames cut along the canvas tiles they touch; every piece carries its columns' write order.

    Positions are joined to pixels last; each frame's pixels are then shuffled once, as pieces.
    """
    where = with_neighbour_positions(placed).select("sample_id", "seq", "x_pos", (F.col("y_pos") - F.col("min_y")).alias("y_pos"),
                                                    "x_overlap", "prev_x", "prev_w", "next_x", "next_w", "next_overlap")
    located = frames.join(where, ["sample_id", "seq"])
    keys = ["sample_id", "seq", "x_pos", "y_pos", "x_overlap", "prev_x", "prev_w", "next_x", "next_w", "next_overlap"]

    def one(img, key):
        h, w, c = img.shape
        x, y = int(key["x_pos"]), int(key["y_pos"])
        order = _column_priority(key, w, center_rule)
        for row in range(y // tile, (y + h - 1) // tile + 1):
            for col in range(x // tile, (x + w - 1) // tile + 1):
                y0, y1 = max(y, row * tile), min(y + h, (row + 1) * tile)
                x0, x1 = max(x, col * tile), min(x + w, (col + 1) * tile)
                part = img[y0 - y:y1 - y, x0 - x:x1 - x]
                yield (col, row, x0 - col * tile, y0 - row * tile, x1 - x0, y1 - y0, c,
                       np.ascontiguousarray(part).tobytes(), order[x0 - x:x1 - x].astype("<i8").tobytes())

    return map_frames(located, keys, "tile_col int, tile_row int, px int, py int, w int, h int, n_channels int, data binary, "
                                     "write_order binary", one).drop(*keys[2:])


def fold(rows: DataFrame, keys: list[str], fields: str, start: Callable, add: Callable, finish: Callable) -> DataFrame:
    """Grouped fold in constant memory: rows of a key stream through ``add(state, row)``; ``finish`` gives one row.

    Keys come sorted through one map: a key costs no call of its own, however few rows it has.
    """
    named = [f.split() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = schema = None
        done, held = [], 0

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            kind = namedtuple("Row", batch.schema.names, rename=True)
            at = [batch.schema.names.index(k) for k in keys]
            schema = schema or pa.schema([*[pa.field(k, batch.schema.field(k).type) for k in keys], *[pa.field(n, FOLDED[t]) for n, t in named]])
            for row in map(kind._make, zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                own = tuple([row[i] for i in at])
                if own != key:
                    if state is not None:
                        done.append(key + tuple(finish(state)))
                        held += sum(len(v) for v in done[-1] if isinstance(v, bytes))
                        if len(done) >= HELD_ROWS or held >= HELD_BYTES:
                            yield handed_on()
                            done, held = [], 0
                    key, state = own, start(row)
                add(state, row)
        if state is not None:
            done.append(key + tuple(finish(state)))
            yield handed_on()

    out = ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys], fields])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def compose(pieces: DataFrame, tile: int = 1024) -> DataFrame:
    """Canvas tiles (sample_id, tile_col, tile_row, size, n_channels, data, covered): last write wins per pixel.

    Pieces with a ``mask`` write only where it is set. A tile gets the pieces that touch it, whose number the overlap bounds.
    """
    masked = "mask" in pieces.columns

    def start(row):
        return {"value": np.zeros((tile, tile, row.n_channels), np.uint8), "order": np.full((tile, tile), -1, np.int64)}

    def add(state, row):
        part = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.n_channels)
        order = np.broadcast_to(np.frombuffer(row.write_order, "<i8")[None, :], (row.h, row.w))
        at = (slice(row.py, row.py + row.h), slice(row.px, row.px + row.w))
        wins = order > state["order"][at]
        if masked:
            wins &= np.frombuffer(row.mask, np.uint8).reshape(row.h, row.w) > 0
        state["value"][at][wins] = part[wins]
        state["order"][at][wins] = order[wins]

    def finish(state):
        covered = state["order"] >= 0
        return tile, state["value"].shape[2], state["value"].tobytes(), covered.astype(np.uint8).tobytes()

    return fold(pieces, TILE_KEY, "size int, n_channels int, data binary, covered binary", start, add, finish)


def blend(pieces: DataFrame, tile: int = 1024, salts: int = 8) -> DataFrame:
    """Canvas tiles of the truncated mean of all pieces with weight (mask) over 0.

    Sums and weights add up in any order, so pieces of a crowded tile are summed in ``salts`` parts first.
    """
    def start(row):
        return {"sum": np.zeros((tile, tile, row.n_channels), np.int64), "weight": np.zeros((tile, tile), np.int64)}

    def add_piece(state, row):
        part = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.n_channels).astype(np.int64)
        mask = np.frombuffer(row.mask, np.uint8).reshape(row.h, row.w).astype(np.int64)
        at = (slice(row.py, row.py + row.h), slice(row.px, row.px + row.w))
        state["sum"][at] += part * mask[:, :, None]
        state["weight"][at] += mask

    def add_sums(state, row):
        state["sum"] += np.frombuffer(row.sums, "<i8").reshape(tile, tile, row.n_channels)
        state["weight"] += np.frombuffer(row.weights, "<i8").reshape(tile, tile)

    def finish_sums(state):
        return state["sum"].shape[2], state["sum"].astype("<i8").tobytes(), state["weight"].astype("<i8").tobytes()

    def finish(state):
        weight = state["weight"]
        mean = state["sum"] // np.maximum(weight, 1)[:, :, None]
        return tile, mean.shape[2], mean.astype(np.uint8).tobytes(), (weight > 0).astype(np.uint8).tobytes()

    salted = pieces.withColumn("salt", (F.col("seq") % salts).cast("int"))
    partial = fold(salted, [*TILE_KEY, "salt"], "n_channels int, sums binary, weights binary", start, add_piece, finish_sums)
    return fold(partial, TILE_KEY, "size int, n_channels int, data binary, covered binary", start, add_sums, finish)


def covered_box(tiles: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Bounding box of the covered canvas pixels per sample."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                ys, xs = np.nonzero(np.frombuffer(r.covered, np.uint8).reshape(r.size, r.size))
                if len(ys):
                    rows.append((r.sample, int(xs.min()) + r.tile_col * r.size, int(xs.max()) + r.tile_col * r.size,
                                 int(ys.min()) + r.tile_row * r.size, int(ys.max()) + r.tile_row * r.size))
            yield pd.DataFrame(rows, columns=["sample", "x0", "x1", "y0", "y1"])
    kind = tiles.schema[sample].dataType.simpleString()
    boxes = tiles.select(F.col(sample).alias("sample"), "tile_col", "tile_row", F.col("size"), "covered").mapInPandas(
        run, f"sample {kind}, x0 int, x1 int, y0 int, y1 int")
    return boxes.groupBy(F.col("sample").alias(sample)).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"),
                                                            F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def canvas_pixels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Covered canvas pixels as rows, for checks and small regions: canvas_x, canvas_y, v (first channel)."""
    out = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys) + ", canvas_y int, canvas_x int, v int"
    rest = [k for k in keys]

    def run(batches):
        for batch in batches:
            parts = []
            for r in batch.itertuples(index=False):
                mask = np.frombuffer(r.covered, np.uint8).reshape(r.size, r.size)
                value = np.frombuffer(r.data, np.uint8).reshape(r.size, r.size, r.n_channels)[:, :, 0]
                ys, xs = np.nonzero(mask)
                frame = {k: getattr(r, k) for k in rest}
                parts.append(pd.DataFrame({**frame, "canvas_y": ys + r.tile_row * r.size, "canvas_x": xs + r.tile_col * r.size,
                                           "v": value[ys, xs].astype(int)}, index=range(len(ys))))
            if parts:
                yield pd.concat(parts)
    columns = list(dict.fromkeys([*keys, "tile_col", "tile_row", "size", "n_channels", "data", "covered"]))
    return tiles.select(*columns).mapInPandas(run, out)


def focus_stack(frames: DataFrame, stack: str = "sample_id", tile: int = 256, salts: int = 16) -> DataFrame:
    """Fused tiles: every pixel comes from the frame of its stack that is sharpest there, the earliest on a tie.

    "Sharpest" is our own rule: highest absolute Laplacian of the blurred gray frame. The pick is a maximum, so crowded
    stacks are reduced in ``salts`` parts before the last step; frames of a stack must have one size.
    """
    from scanframe.operators.focus import local_sharpness
    parts = local_sharpness(frames.withColumnRenamed(stack, "sample_id"), ["sample_id", "seq"], tile)
    parts = parts.withColumn("source", F.lit(None).cast("binary"))
    fields = "w int, h int, n_channels int, data binary, sharpness binary, source binary"

    def start(row):
        return {"value": np.zeros((row.h, row.w, row.n_channels), np.uint8), "sharp": np.full((row.h, row.w), -1, np.int64),
                "seq": np.full((row.h, row.w), np.iinfo(np.int64).max, np.int64)}

    def add(state, row):
        shape = (row.h, row.w)
        sharp = np.frombuffer(row.sharpness, "<i4").reshape(shape).astype(np.int64)
        seq = np.full(shape, row.seq, np.int64) if row.source is None else np.frombuffer(row.source, "<i8").reshape(shape)
        wins = (sharp > state["sharp"]) | ((sharp == state["sharp"]) & (seq < state["seq"]))
        state["value"][wins] = np.frombuffer(row.data, np.uint8).reshape(*shape, row.n_channels)[wins]
        state["sharp"][wins], state["seq"][wins] = sharp[wins], seq[wins]

    def finish(state):
        h, w, c = state["value"].shape
        return (w, h, c, state["value"].tobytes(), state["sharp"].astype("<i4").tobytes(),
                state["seq"].astype("<i8").tobytes())

    salted = parts.withColumn("salt", (F.col("seq") % salts).cast("int"))
    first = fold(salted, [*TILE_KEY, "salt"], fields, start, add, finish).withColumn("seq", F.lit(0).cast("bigint"))
    return fold(first, TILE_KEY, fields, start, add, finish).withColumnRenamed("sample_id", stack)


def stacked_pixels(tiles: DataFrame, stack: str, tile: int) -> DataFrame:
    """Fused tiles as rows: y, x, v (first channel), the frame it came from."""
    kind = tiles.schema[stack].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                value = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.n_channels)[:, :, 0]
                source = np.frombuffer(r.source, "<i8").reshape(r.h, r.w)
                yy, xx = np.mgrid[0:r.h, 0:r.w]
                yield pd.DataFrame({"stack": r.stack, "y": (yy + r.tile_row * tile).ravel(), "x": (xx + r.tile_col * tile).ravel(),
                                    "v": value.ravel().astype(int), "source_seq": source.ravel()})
    return (tiles.withColumnRenamed(stack, "stack")
            .select("stack", "tile_col", "tile_row", "w", "h", "n_channels", "data", "source")
            .mapInPandas(run, f"stack {kind}, y int, x int, v int, source_seq long").withColumnRenamed("stack", stack))


#: Source positions are rounded to 1 / FRACTION of a pixel; weights are whole numbers that add up to FRACTION squared.
FRACTION = 32
AT_ONCE = 1 << 16   # canvas pixels that are mapped back in one go


def adjugate(m: np.ndarray) -> np.ndarray:
    """Inverse of a 3x3 map up to a factor, which a projective map does not need."""
    a, b, c, d, e, f, g, h, i = m.ravel()
    return np.array([[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]])


def _shifted(key: dict) -> np.ndarray:
    """The map onto the canvas: the frame's own, moved by tx and ty."""
    m, tx, ty = np.asarray(key["matrix"], float).reshape(3, 3), float(key["tx"]), float(key["ty"])
    return np.array([m[0] + tx * m[2], m[1] + ty * m[2], m[2]])


def _weighed(values: np.ndarray, first, rows, cols, left, top, back, xx: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the canvas pixels (xx, yy) have weight in their part of a frame, the weighted sums of its pixels there, and the weights.

    A part lies in ``values`` (pixels by channels) from ``first`` on, has ``rows`` x ``cols`` pixels and starts at (left, top) of its frame; these and the
    nine numbers of ``back`` are one for all pixels or an array.
    """
    w = back[6] * xx + back[7] * yy + back[8]
    with np.errstate(divide="ignore", invalid="ignore"):
        sx = np.floor((back[0] * xx + back[1] * yy + back[2]) / w * FRACTION + 0.5)
        sy = np.floor((back[3] * xx + back[4] * yy + back[5]) / w * FRACTION + 0.5)
    near = np.flatnonzero((sx > (left - 1) * FRACTION) & (sx < (left + cols) * FRACTION) & (sy > (top - 1) * FRACTION) & (sy < (top + rows) * FRACTION))
    first, rows, cols, left, top = (v[near] if np.ndim(v) else v for v in (first, rows, cols, left, top))
    sx, sy = (v[near].astype(np.int64) for v in (sx, sy))
    ix, iy, ax, ay = sx // FRACTION - left, sy // FRACTION - top, sx % FRACTION, sy % FRACTION
    total, weight = np.zeros((len(near), values.shape[1]), np.int64), np.zeros(len(near), np.int64)
    for dy, dx, part in ((0, 0, (FRACTION - ay) * (FRACTION - ax)), (0, 1, (FRACTION - ay) * ax), (1, 0, ay * (FRACTION - ax)), (1, 1, ay * ax)):
        x, y = ix + dx, iy + dy
        inside = (x >= 0) & (x < cols) & (y >= 0) & (y < rows)
        part = np.where(inside, part, 0)
        total += part[:, None] * values[first + np.where(inside, y * cols + x, 0)]
        weight += part
    return near, total, weight


def warp_sums(img: np.ndarray, back: np.ndarray, y0: int, y1: int, x0: int, x1: int) -> tuple[np.ndarray, np.ndarray]:
    """For the canvas pixels [y0, y1) x [x0, x1), the weighted sum of the pixels of ``img`` that their source positions lie between, and the weight."""
    yy, xx = (v.ravel() for v in np.mgrid[y0:y1, x0:x1].astype(float))
    channels = img.shape[2]
    total, weight = np.zeros((len(xx), channels), np.int64), np.zeros(len(xx), np.int64)
    near, total[near], weight[near] = _weighed(img.reshape(-1, channels), 0, *img.shape[:2], 0, 0, back.ravel(), xx, yy)
    return total.reshape(y1 - y0, x1 - x0, channels), weight.reshape(y1 - y0, x1 - x0)


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes add up to ``most`` or less; a larger one is alone."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if held:
        yield slice(begin, len(sizes))


def _pair_sums(pairs: pd.DataFrame, source: int, tile: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """For pairs of a canvas tile's window and a storage tile, of one number of channels: places in the window that have weight, sums and weights there.

    What several storage tiles of a frame give adds up.
    """
    column = {c: pairs[c].to_numpy() for c in ("tile_col", "tile_row", "to_col", "to_row", "px", "py", "w", "sw", "sh")}
    values = np.frombuffer(b"".join(pairs["data"]), np.uint8).reshape(-1, int(pairs["n_channels"].iloc[0]))
    back = np.array(pairs["back"].tolist(), float)
    stored, sizes = column["sw"].astype(np.int64) * column["sh"], column["w"].astype(np.int64) * pairs["h"].to_numpy()
    first, ends = np.cumsum(stored) - stored, np.cumsum(sizes)
    parts, count = [], np.zeros(len(pairs), np.int64)
    for lo in range(0, int(ends[-1]), AT_ONCE):
        pixel = np.arange(lo, min(lo + AT_ONCE, int(ends[-1])))
        of = np.searchsorted(ends, pixel, "right")
        at = {c: v[of] for c, v in column.items()}
        place = pixel - (ends - sizes)[of]
        y, x = np.divmod(place, at["w"])
        near, total, weight = _weighed(values, first[of], at["sh"], at["sw"], at["tile_col"] * source, at["tile_row"] * source, back[of].T,
                                       (x + at["px"] + at["to_col"] * tile).astype(float), (y + at["py"] + at["to_row"] * tile).astype(float))
        parts.append((place[near].astype("<i4"), total.astype("<i4"), weight.astype("<i2")))
        count += np.bincount(of[near], minlength=len(pairs))
    cuts = np.cumsum(count)[:-1]
    return tuple([v.tobytes() for v in np.split(np.concatenate(p), cuts)] for p in zip(*parts, strict=True))


def _warped(total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 outside the frame, and which pixels have at least half their weight inside."""
    unit = FRACTION * FRACTION
    return ((total + unit // 2) // unit).astype(np.uint8), (2 * weight >= unit).astype(np.uint8)


def _reach(matrix: np.ndarray, width: int, height: int, canvas_w: int, canvas_h: int) -> tuple[int, int, int, int]:
    """Canvas columns and rows where a pixel of the frame can have weight: its corners, one pixel further out, span them."""
    edge = matrix @ np.array([[-1, width, width, -1], [-1, -1, height, height], [1, 1, 1, 1]], float)
    ex, ey = edge[0] / edge[2], edge[1] / edge[2]
    return (max(0, int(np.floor(ex.min()))), min(canvas_w, int(np.ceil(ex.max())) + 1), max(0, int(np.floor(ey.min()))), min(canvas_h, int(np.ceil(ey.max())) + 1))


def _located(frames: DataFrame, homographies: DataFrame, corners: DataFrame) -> DataFrame:
    return (frames.join(homographies.select("sample_id", "seq", F.col("h").alias("matrix")), ["sample_id", "seq"])
            .join(corners.select("sample_id", "tx", "ty", "canvas_w", "canvas_h"), "sample_id"))


def warp_pieces(frames: DataFrame, homographies: DataFrame, tile: int = 1024) -> DataFrame:
    """Frames (sample_id, seq) mapped by their 3x3 matrix onto the canvas, cut into canvas tiles with a coverage mask.

    Values are interpolated linearly, in whole numbers, with 0 outside; a pixel counts as covered where at least half its
    weight is inside. The canvas is shifted only by the part of its extent that is negative.
    """
    located = _located(frames, homographies, warp_extents(frames, homographies))
    keys = ["sample_id", "seq", "matrix", "tx", "ty", "canvas_w", "canvas_h"]

    def one(img, key):
        matrix = _shifted(key)
        back = adjugate(matrix)
        x_lo, x_hi, y_lo, y_hi = _reach(matrix, img.shape[1], img.shape[0], int(key["canvas_w"]), int(key["canvas_h"]))
        for row in range(y_lo // tile, (max(y_hi, y_lo + 1) - 1) // tile + 1):
            for col in range(x_lo // tile, (max(x_hi, x_lo + 1) - 1) // tile + 1):
                y0, y1 = max(y_lo, row * tile), min(y_hi, (row + 1) * tile)
                x0, x1 = max(x_lo, col * tile), min(x_hi, (col + 1) * tile)
                if y1 <= y0 or x1 <= x0:
                    continue
                data, mask = _warped(*warp_sums(img, back, y0, y1, x0, x1))
                if mask.any():
                    yield col, row, x0 - col * tile, y0 - row * tile, x1 - x0, y1 - y0, img.shape[2], data.tobytes(), mask.tobytes()

    return map_frames(located, keys, "tile_col int, tile_row int, px int, py int, w int, h int, n_channels int, data binary, "
                                     "mask binary", one).drop(*keys[2:])


def warp_stored_tiles(stored: DataFrame, sizes: DataFrame, homographies: DataFrame, source: int, tile: int = 1024) -> DataFrame:
    """``warp_pieces`` for frames too large for one task, from their storage tiles (sample_id, seq, tile_col, tile_row, data, ...) of side ``source``.

    Every canvas tile that a frame reaches is mapped back onto the frame; the storage tiles it meets there are joined by
    equality. Each pair gives weighted sums, which add up to the frame's piece of the canvas tile. ``sizes`` has a row
    (sample_id, seq, width, height) per frame.
    """
    located = _located(sizes.select("sample_id", "seq", "width", "height"), homographies, warp_extents(sizes, homographies))
    key = "sample_id", "seq"
    kind = ", ".join(f"{k} {stored.schema[k].dataType.simpleString()}" for k in key)
    asks = "tile_col int, tile_row int, to_col int, to_row int, px int, py int, w int, h int, back array<double>"

    def meets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                matrix = _shifted(r._asdict())
                back = adjugate(matrix)
                x_lo, x_hi, y_lo, y_hi = _reach(matrix, r.width, r.height, int(r.canvas_w), int(r.canvas_h))
                for row in range(y_lo // tile, (max(y_hi, y_lo + 1) - 1) // tile + 1):
                    for col in range(x_lo // tile, (max(x_hi, x_lo + 1) - 1) // tile + 1):
                        y0, y1 = max(y_lo, row * tile), min(y_hi, (row + 1) * tile)
                        x0, x1 = max(x_lo, col * tile), min(x_hi, (col + 1) * tile)
                        if y1 <= y0 or x1 <= x0:
                            continue
                        at = back @ np.array([[x0, x1, x1, x0], [y0, y0, y1, y1], [1, 1, 1, 1]], float)
                        span = [0, r.width - 1, 0, r.height - 1]
                        if (at[2] > 0).all() or (at[2] < 0).all():  # else the tile holds the map's horizon: the whole frame is asked
                            sx, sy = at[0] / at[2], at[1] / at[2]
                            span = [max(0, int(np.floor(sx.min())) - 1), min(r.width - 1, int(np.ceil(sx.max())) + 1),
                                    max(0, int(np.floor(sy.min())) - 1), min(r.height - 1, int(np.ceil(sy.max())) + 1)]
                        out.extend((r.sample_id, r.seq, c, q, col, row, x0 - col * tile, y0 - row * tile, x1 - x0, y1 - y0, back.ravel().tolist())
                                   for c in range(span[0] // source, span[1] // source + 1) for q in range(span[2] // source, span[3] // source + 1))
            yield pd.DataFrame(out, columns=[*key, *[f.split()[0] for f in asks.split(", ")]])

    # dealt out by frames, whichever side the joins above sent whole, and to a number of tasks that is kept: a frame's row is short, its work isn't
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = located.repartition(tasks, *key).mapInPandas(meets, f"{kind}, {asks}")
    parts = asked.join(stored.select(*key, "tile_col", "tile_row", F.col("w").alias("sw"), F.col("h").alias("sh"), "n_channels", "data"), [*key, "tile_col", "tile_row"])
    fields = "to_col int, to_row int, px int, py int, w int, h int, n_channels int, places binary, sums binary, weights binary"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, alike in batch.groupby("n_channels"):
                for some in _runs((alike["w"] * alike["h"]).to_numpy(), AT_ONCE):
                    pairs = alike.iloc[some]
                    places, total, weight = _pair_sums(pairs, source, tile)
                    out = pairs[[*key, "to_col", "to_row", "px", "py", "w", "h", "n_channels"]].assign(places=places, sums=total, weights=weight)
                    yield out[[len(p) > 0 for p in places]]

    def start(row):
        return {"row": row, "sum": np.zeros((row.h * row.w, row.n_channels), np.int64), "weight": np.zeros(row.h * row.w, np.int64)}

    def add(state, row):
        at = np.frombuffer(row.places, "<i4")  # no place twice
        state["sum"][at] += np.frombuffer(row.sums, "<i4").reshape(-1, row.n_channels)
        state["weight"][at] += np.frombuffer(row.weights, "<i2")

    def finish(state):
        r = state["row"]
        data, mask = _warped(state["sum"], state["weight"])
        return r.px, r.py, r.w, r.h, r.n_channels, data.tobytes(), mask.tobytes()

    pieces = fold(parts.mapInPandas(sums, f"{kind}, {fields}").withColumnsRenamed({"to_col": "tile_col", "to_row": "tile_row"}), [*key, "tile_col", "tile_row"],
                  "px int, py int, w int, h int, n_channels int, data binary, mask binary", start, add, finish)
    return pieces.filter(F.contains("mask", F.lit(b"\x01")))  # weight below one half everywhere covers nothing


def warp_extents(frames: DataFrame, homographies: DataFrame) -> DataFrame:
    """Canvas of the mapped corners per sample: size and the shift that makes coordinates positive."""
    meta = frames.select("sample_id", "seq", "width", "height").join(homographies, ["sample_id", "seq"])
    m = lambda i: F.col("h")[i]

    def corner(x, y):
        w = m(6) * x + m(7) * y + m(8)
        return F.struct(((m(0) * x + m(1) * y + m(2)) / w).alias("x"), ((m(3) * x + m(4) * y + m(5)) / w).alias("y"))

    zero = F.lit(0.0)
    points = meta.select("sample_id", F.explode(F.array(
        corner(zero, zero), corner(F.col("width"), zero), corner(F.col("width"), F.col("height")),
        corner(zero, F.col("height")))).alias("p"))
    low = lambda c: F.floor(F.round(F.min(f"p.{c}"), 9)).cast("int")
    high = lambda c: F.ceil(F.round(F.max(f"p.{c}"), 9)).cast("int")
    box = points.groupBy("sample_id").agg(low("x").alias("x_min"), low("y").alias("y_min"), high("x").alias("x_max"),
                                          high("y").alias("y_max"))
    return box.withColumns({
        "tx": F.when(F.col("x_min") < 0, -F.col("x_min")).otherwise(0), "ty": F.when(F.col("y_min") < 0, -F.col("y_min")).otherwise(0),
        "canvas_w": F.col("x_max") - F.col("x_min"), "canvas_h": F.col("y_max") - F.col("y_min")})
