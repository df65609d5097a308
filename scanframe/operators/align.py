"""Finding the overlap of consecutive frames by normalised cross-correlation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanframe.functions import geometry, kernels
from scanframe.operators import pairs as pair_ops
from scanframe.operators.frames import map_frames
from scanframe.session import cut_lineage

PAIR = ["sample_id", "pair_idx"]


@dataclass(frozen=True)
class Search:
    """Candidate grids. Steps and radii are in pixels; (x, y) order."""
    min_overlap: float = 0.3
    max_overlap: float = 0.95
    coarse_step: int = 10          # at least; otherwise a fortieth of the range
    x_range: int = 30              # graduated search around the coarse winner
    grid: tuple[int, int] = (6, 4)
    fine_radius: tuple[int, int] = (9, 6)
    fine_step: tuple[int, int] = (3, 2)
    y_tiers: tuple[int, int, int, int] = (5, 8, 12, 15)
    min_height: int = 50           # compared height must exceed this

    def y_radius(self, coarse_score: float) -> int:
        for limit, radius in zip((0.98, 0.96, 0.94), self.y_tiers):
            if coarse_score > limit:
                return radius
        return self.y_tiers[3]


def edge_strips(frames: DataFrame, axis: str = "x", rotate: int = 0, max_overlap: float = 0.95) -> DataFrame:
    """Gray strips of every frame (sample_id, seq), turned upright: side 0 is its right one, which meets the next frame, side 1 its left one."""
    turns = geometry.rotations(axis, rotate)

    def one(img, key):
        g = kernels.gray(kernels.turned(img, turns))
        keep = min(int(g.shape[1] * max_overlap), g.shape[1])
        for side, part in ((0, g[:, g.shape[1] - keep:]), (1, g[:, :keep])):
            yield side, part.shape[1], part.shape[0], g.shape[1], g.shape[0], np.ascontiguousarray(part).tobytes()

    return map_frames(frames, ["sample_id", "seq"], "side int, w int, h int, full_w int, full_h int, data binary", one)


def paired(strips: DataFrame) -> DataFrame:
    """Strips (sample_id, pair_idx, side, ...) put side by side: one row per pair that has both."""
    side = lambda s: F.any_value(F.when(F.col("side") == s, F.struct("w", "h", "full_w", "full_h", "data")), True)
    # shuffled before it is aggregated: with two rows per key there is nothing to combine, or to sort, on the map side
    return strips.repartition(*PAIR).groupBy(*PAIR).agg(side(0).alias("a"), side(1).alias("b")).filter("a is not null and b is not null")


def strips(frames: DataFrame, axis: str = "x", rotate: int = 0, max_overlap: float = 0.95) -> DataFrame:
    """Pairs of consecutive frames with both gray strips: one row per (sample_id, pair_idx).

    ``frames`` carry sample_id and seq. Every frame is decoded once and sends its right strip to the pair it opens and
    its left strip to the pair it closes, so one shuffle moves only the compared columns, two rows per key.
    """
    cut = edge_strips(frames, axis, rotate, max_overlap).withColumn("pair_idx", (F.col("seq") - F.col("side")).cast("bigint"))
    return paired(cut.filter("pair_idx >= 0"))


def map_pairs(rows: DataFrame, keep: list[str], fields: str, one) -> DataFrame:
    """Narrow map over pairs of strips: ``one(left, right, row)`` gives a tuple of ``fields``."""
    out = T.StructType([rows.schema[k] for k in keep] + list(T._parse_datatype_string(fields).fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                left = np.frombuffer(row.a_data, np.uint8).reshape(row.a_h, row.a_w)
                right = np.frombuffer(row.b_data, np.uint8).reshape(row.b_h, row.b_w)
                done.append(tuple(getattr(row, k) for k in keep) + tuple(one(left, right, row)))
            yield pd.DataFrame(done, columns=out.names).astype({f.name: object for f in out if isinstance(
                f.dataType, (T.IntegerType, T.LongType))})

    flat = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("a", "b") for f in ("w", "h", "data")]
    return rows.select(*[c for c in rows.columns if c not in ("a", "b")], *flat).mapInPandas(run, out)


def find_alignments(pair_strips: DataFrame, search: Search = Search(), planned: bool = False) -> DataFrame:
    """Best overlap and y offset of every pair: coarse overlap scan, then the graduated search around its winner.

    With ``planned`` the rows carry overlap_min/overlap_max and, where known, y_center/y_std from earlier pairs.
    """
    fields = ("x_overlap int, y_offset int, score double, coarse_overlap int, coarse_score double, coarse_tried int, "
              "fine_tried int, width int, height int")
    keep = [*PAIR] + (["plan_key"] if planned else [])

    def one(left: np.ndarray, right: np.ndarray, row) -> tuple:
        width = min(left.shape[1], right.shape[1])
        low, high = int(width * search.min_overlap), int(width * search.max_overlap)
        if planned and row.overlap_mean is not None and not np.isnan(row.overlap_mean):
            buffer = max(100.0, 2 * row.overlap_std)
            low, high = max(low, int(row.overlap_mean - buffer)), min(high, int(row.overlap_mean + buffer))
        step = max(search.coarse_step, (high - low) // 40)
        flat = ((o, 0) for o in range(low, high, step))
        any_height = kernels.pair_scorer(left, right, 0)
        tall = lambda dy: min(left.shape[0] - max(dy, 0), right.shape[0] - max(-dy, 0)) > search.min_height
        score = lambda overlap, dy: any_height(overlap, dy) if tall(dy) else None
        even = min(left.shape[0], right.shape[0])  # the coarse scan compares the middle rows of unequal frames
        middle = [s[(s.shape[0] - even) // 2:][:even] for s in (left, right)]
        coarse_o, _, coarse_s, coarse_n = kernels.best_of(kernels.pair_scorer(*middle, 0), flat, (low, 0, -1.0))
        y0, reach = 0, search.y_radius(coarse_s)
        if planned and row.y_mean is not None and not np.isnan(row.y_mean):
            y0 = int(round(row.y_mean))
            k, extra, floor = next((t for limit, t in ((0.98, (1.5, 3, 5)), (0.96, (2.0, 4, 6)), (0.94, (2.5, 5, 8)))
                                    if coarse_s > limit), (3.0, 6, 10))
            reach = min(max(floor, int(k * row.y_std + extra)), 15)
        x_lo, x_hi = max(low, coarse_o - search.x_range), min(high, coarse_o + search.x_range)
        grid = ((x, y) for x in range(x_lo, x_hi + 1, search.grid[0])
                for y in range(y0 - reach, y0 + reach + 1, search.grid[1]))
        gx, gy, gs, gn = kernels.best_of(score, grid, (coarse_o, y0, -1.0))
        (rx, ry), (sx, sy) = search.fine_radius, search.fine_step
        fine = ((x, y) for x in range(gx - rx, gx + rx + 1, sx) if x_lo <= x <= x_hi
                for y in range(gy - ry, gy + ry + 1, sy) if abs(y - y0) <= reach)
        fx, fy, fs, fn = kernels.best_of(score, fine, (gx, gy, gs))
        return fx, fy, float(fs), coarse_o, float(coarse_s), coarse_n, gn + fn, int(row.a_full_w), int(row.a_full_h)

    rows = pair_strips.withColumns({"a_full_w": F.col("a.full_w"), "a_full_h": F.col("a.full_h")})
    return map_pairs(rows, keep, fields, one)


def _history(results: DataFrame) -> DataFrame:
    """Per pair what up to three earlier accepted results say; ``plan_key`` names the plan."""
    from scanframe.operators import ordered

    def columns(w) -> dict[str, Column]:
        n, mean, std = pair_ops._history(w, 3, "x_overlap")
        _, y_mean, y_std = pair_ops._history(w, 3, "y_offset")
        return {"overlap_mean": F.when(n >= 2, mean), "overlap_std": F.when(n >= 2, std),
                "y_mean": F.when(n >= 3, y_mean), "y_std": F.when(n >= 3, y_std)}

    seen = ordered.with_neighbours(results.select(*PAIR, "x_overlap", "y_offset"), ["sample_id"], "pair_idx", columns, before=3)
    plan = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("overlap_mean", "overlap_std", "y_mean", "y_std")]
    return seen.select(*PAIR, "overlap_mean", "overlap_std", "y_mean", "y_std", F.concat_ws("|", *plan).alias("plan_key"))


def align_with_history(pair_strips: DataFrame, search: Search = Search()) -> DataFrame:
    """Search windows that follow the earlier pairs of a sample, as when pairs are taken one after the other.

    Every round plans all pairs from the last results and searches again only those whose plan changed. A pair depends
    on earlier ones only, so after round r the first r pairs are final; in practice a handful of rounds settle all.
    """
    stored = cut_lineage(pair_strips)
    results = cut_lineage(find_alignments(stored, search).withColumn("plan_key", F.lit("-|-|-|-")))
    while True:
        plan = cut_lineage(_history(results).join(results.select(*PAIR, F.col("plan_key").alias("last")), PAIR))
        changed = plan.filter("plan_key <> last").drop("last")
        if changed.isEmpty():
            return results.drop("plan_key")
        fresh = find_alignments(stored.join(changed, PAIR), search, planned=True)
        results = cut_lineage(results.join(changed.select(*PAIR), PAIR, "left_anti").unionByName(fresh))


def score_at(pair_strips: DataFrame, offsets: DataFrame, min_height: int = 10) -> DataFrame:
    """Correlation of every pair at given offsets; ``status`` says why a score is missing."""
    def one(left: np.ndarray, right: np.ndarray, row) -> tuple:
        overlap, dy = int(row.x_overlap), int(row.y_offset)
        if overlap <= 0 or overlap > min(left.shape[1], right.shape[1]):
            return None, "No overlap"
        if min(left.shape[0] - max(dy, 0), right.shape[0] - max(-dy, 0)) <= min_height:
            return None, "Insufficient height"
        return kernels.pair_score(left, right, overlap, dy, min_height), "OK"

    rows = pair_strips.join(offsets.select(*PAIR, "x_overlap", "y_offset"), PAIR)
    return map_pairs(rows, [*PAIR, "x_overlap", "y_offset"], "score double, status string", one)


def overlap_sums(pixels: DataFrame, overlaps: Column, shifts: Column, width: int) -> DataFrame:
    """Relational form for very small frames: sums per pair, overlap and dy from pixel rows (sample_id, seq, y, x, g).

    Every candidate turns the pixels of the first frame into the coordinates of the second, so the match is an equality
    join; ``correlation_of`` finishes the score. The kernel path does the same on whole strips.
    """
    right = pixels.select("sample_id", (F.col("seq") - 1).alias("pair_idx"), F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("g").alias("b"))
    left = (pixels.select("sample_id", F.col("seq").alias("pair_idx"), "y", "x", F.col("g").alias("a"), F.explode(overlaps).alias("overlap"))
            .withColumn("dy", F.explode(shifts))
            .withColumns({"ry": F.col("y") - F.col("dy"), "rx": F.col("x") - (width - F.col("overlap"))}).filter("rx >= 0"))
    both = left.join(right, ["sample_id", "pair_idx", "ry", "rx"])
    a, b = F.col("a").cast("bigint"), F.col("b").cast("bigint")
    return both.groupBy(*PAIR, "overlap", "dy").agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"),
        F.sum(a * b).alias("sab"))


def correlation_of(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Correlation from exact sums; NULL where a region is flat."""
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return F.when((va > 0) & (vb > 0), (n * sab - sa * sb) / (F.sqrt(va.cast("double")) * F.sqrt(vb.cast("double"))))


def refine(pair_strips: DataFrame, plan: DataFrame, min_overlap_px: int = 50, min_height: int = 50) -> DataFrame:
    """Second search of the planned (weak) pairs only: new_overlap, new_y_offset, new_score, tried."""
    steps = ["search_center", "search_min", "search_max", "search_y", "search_y_range", "coarse_x_radius", "coarse_x_step",
             "coarse_y_step", "fine_x_radius", "fine_y_radius"]

    def one(left: np.ndarray, right: np.ndarray, row) -> tuple:
        c, low, high, y0, reach, rx, sx, sy, frx, fry = (int(getattr(row, s)) for s in steps)
        ok = lambda x: max(low, min_overlap_px) <= x <= high
        coarse = ((x, y) for x in range(c - rx, c + rx + 1, sx) if ok(x) for y in range(y0 - reach, y0 + reach + 1, sy))
        score = kernels.pair_scorer(left, right, min_height)
        bx, by, bs, n1 = kernels.best_of(score, coarse, (c, y0, -1.0))
        fine = ((x, y) for x in range(bx - frx, bx + frx + 1, 2) if ok(x)
                for y in range(by - fry, by + fry + 1) if abs(y - y0) <= reach + 2)
        fx, fy, fs, n2 = kernels.best_of(score, fine, (bx, by, bs))
        return fx, fy, float(fs), n1 + n2

    rows = plan.select(*PAIR, *steps).join(pair_strips, PAIR)
    return map_pairs(rows, PAIR, "new_overlap int, new_y_offset int, new_score double, tried int", one)


def small_search(**changes) -> Search:
    """Grid for very small frames (checks and demos)."""
    return replace(Search(coarse_step=1, x_range=2, grid=(2, 1), fine_radius=(1, 1), fine_step=(1, 1), y_tiers=(1, 1, 2, 2),
                          min_height=3), **changes)
