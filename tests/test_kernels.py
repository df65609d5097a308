import numpy as np
import pytest
from helpers import frame_row, frames_df, texture
from pyspark.sql import functions as F

from scanframe.functions import kernels
from scanframe.operators import channels, focus, frames
from scanframe.plans import imaging


def test_laplacian_of_impulse_is_the_kernel():
    a = np.zeros((5, 5), np.uint8)
    a[2, 2] = 1
    assert kernels.abs_laplacian(a, 3)[1:4, 1:4].tolist() == [[2, 0, 2], [0, 8, 0], [2, 0, 2]]


def test_laplacian_of_ramp_is_zero_inside():
    ramp = np.tile(np.arange(9, dtype=np.uint8) * 10, (9, 1))
    assert (kernels.abs_laplacian(ramp, 3)[:, 1:-1] == 0).all()
    assert (kernels.abs_laplacian(ramp, 7)[:, 3:-3] == 0).all()


def test_blur_rounds_and_mirrors():
    a = np.zeros((3, 3), np.uint8)
    a[1, 1] = 16
    assert kernels.blur(a).tolist() == [[4, 4, 4], [4, 4, 4], [4, 4, 4]]  # mirrored border doubles the outer taps


@pytest.mark.parametrize("scale,expected", [(0.5, [[10, 20], [30, 40]]), (1.0, None)])
def test_resize_area(scale, expected):
    a = np.kron(np.array([[10, 20], [30, 40]]), np.ones((2, 2))).astype(np.uint8)
    out = kernels.resize(a, scale)
    assert out.tolist() == (expected or a.tolist())


def test_four_turns_are_identity():
    img = texture(6, 9)[:, :, None]
    assert (kernels.turned(img, ["ccw"] * 4) == img).all()
    assert (kernels.turned(img, ["ccw", "cw"]) == img).all()
    assert (kernels.turned(img, ["half", "half"]) == img).all()


def test_close_fills_a_hole_and_keeps_the_rest():
    a = np.zeros((7, 7), np.uint8)
    a[2:5, 2:5] = 200
    a[3, 3] = 0
    closed = kernels.close_cross(a)
    assert closed[3, 3] == 200 and closed[0, 0] == 0


def test_tile_grid_drops_remainder_and_clips_small_images(spark):
    rows = [frame_row(1, texture(100, 130)), frame_row(2, texture(20, 30))]
    got = focus.tile_scores(frames_df(spark, rows), ["frame_id"], 48, 48).groupBy("frame_id").count().collect()
    assert {r.frame_id: r["count"] for r in got} == {1: 4, 2: 1}


def test_flat_tile_scores_zero_and_correlates_with_nothing(spark):
    flat = np.full((48, 48), 77, np.uint8)
    assert focus.tile_scores(frames_df(spark, [frame_row(1, flat)]), ["frame_id"]).first().score == 0.0
    assert kernels.pair_score(flat, flat, 20, 0, 10) is None


def test_tile_score_against_numpy(spark):
    img = texture(96, 144)
    lap = kernels.abs_laplacian(kernels.blur(img)[48:96, 96:144], 3)
    want = 0.5 * (lap.var() + np.percentile(lap, 90))
    got = focus.tile_scores(frames_df(spark, [frame_row(1, img)]), ["frame_id"]).filter("x = 96 and y = 48").first().score
    assert got == pytest.approx(want, rel=1e-12)


def test_arrow_and_relational_paths_agree(spark):
    """Tile score from the kernel equals the score from a stencil join over pixel rows."""
    img = texture(12, 12, 3)
    df = frames_df(spark, [frame_row(1, img)])
    px = frames.pixels(df, ["frame_id"]).select("frame_id", "y", "x", "g")
    mirror = lambda v, n: F.when(v < 0, -v).when(v >= n, 2 * (n - 1) - v).otherwise(v)

    def stencil(src, taps, n):
        kernel = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("wt")) for dy, dx, w in taps if w]))
        reach = src.select("frame_id", "y", "x", kernel.alias("k")).select(
            "frame_id", "y", "x", "k.wt", mirror(F.col("y") + F.col("k.dy"), n).alias("sy"), mirror(F.col("x") + F.col("k.dx"), n).alias("sx"))
        right = src.select("frame_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "g")
        return reach.join(right, ["frame_id", "sy", "sx"]).groupBy("frame_id", "y", "x").agg(F.sum(F.col("wt") * F.col("g")).alias("s"))

    binomial = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    laplace = [(dy, dx, kernels.LAPLACE_3[dy + 1][dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    blurred = stencil(px, binomial, 12).select("frame_id", "y", "x", F.floor((F.col("s") + 8) / 16).cast("int").alias("g"))
    v = F.abs("s")
    want = stencil(blurred, laplace, 12).agg(F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.percentile(v, 0.9).alias("p90")).first()
    got = focus.tile_scores(df, ["frame_id"], 12, 12).first()
    assert (got.s1, got.s2) == (want.s1, want.s2)
    assert got.p90 == pytest.approx(want.p90, abs=1e-9)


def test_black_frame_is_graded_and_empty_interior_counts_as_black(spark):
    noisy = np.dstack([texture(20, 20, s) for s in (1, 2, 3)])
    flat_red = noisy.copy()
    flat_red[:, :, 2] = 9
    df = frames_df(spark, [frame_row(1, noisy), frame_row(2, flat_red)])
    got = {r.frame_id: r.is_black for r in channels.black_frames(df, ["frame_id"]).collect()}
    assert got == {1: False, 2: True}
    assert all(r.is_black for r in channels.black_frames(df, ["frame_id"], (0.5, 0.5, 0, 0)).collect())
    scored = {r.frame_id: r.score for r in imaging.frame_focus(df, ["frame_id"]).collect()}
    assert scored[1] > 0 and scored[2] is None


def test_crop_rejects(spark):
    df = frames_df(spark, [frame_row(1, texture(20, 20))])
    assert focus.crop_rejects(df, ["frame_id"], (0.6, 0.6, 0.0, 0.0)).count() == 1
    assert focus.quadrant_scores(df, ["frame_id"], 7, (0.6, 0.6, 0.0, 0.0)).count() == 0


def test_scaled_tiles_map_back(spark):
    df = frames_df(spark, [frame_row(1, texture(192, 192))])
    tiles = focus.tile_scores(df, ["frame_id"], 48, 48, scale=0.5).orderBy("y", "x").collect()
    assert len(tiles) == 16 and {(t.w, t.h) for t in tiles} == {(48, 48)}
    assert [t.x for t in tiles[:4]] == [0, 48, 96, 144]


def test_average_color_order_and_roi(spark):
    img = np.zeros((4, 4, 3), np.uint8)
    img[:, :, 0], img[:, :, 2] = 10, 200          # blue, red
    df = frames_df(spark, [frame_row(1, img)])
    rgb = imaging.frame_color(df, ["frame_id"]).first()
    assert (rgb.r, rgb.g, rgb.b) == (200, 0, 10)
    assert imaging.frame_color(df, ["frame_id"], roi=(10, 10, 5, 5)).count() == 0
    hsv = imaging.frame_color(df, ["frame_id"], space="HSV").first()
    assert (hsv.s, hsv.v) == (255, 200) and hsv.h in (178, 179)
