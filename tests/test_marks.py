import numpy as np
from helpers import frame_row, frames_df
from pyspark.sql import functions as F

from scanframe.operators import components, marks
from scanframe.plans import imaging


def squares(flip=False):
    """Five dark red squares, half-width 12, on a light 800x400 picture (blue, green, red order)."""
    img = np.full((400, 800, 3), 240, np.uint8)
    for i in range(5):
        cx, cy = 100 + 130 * i, 150
        img[cy - 12:cy + 13, cx - 12:cx + 13] = (10, 10, 150)
    return img[::-1].copy() if flip else img


def test_five_squares(spark):
    found = imaging.registration_marks(frames_df(spark, [frame_row(1, squares())]), ["frame_id"]).orderBy("cx").collect()
    # all marks have the frame's one positive value, so nothing exceeds its own percentile: the threshold is strict
    assert found == []
    mixed = squares()
    mixed[200:203, 400:403] = (200, 200, 210)      # faint reddish speck below the marks
    masks = marks.red_masks(frames_df(spark, [frame_row(1, mixed)]), ["frame_id"], percentile=0.1)
    got = components.components(masks, ["frame_id"], whole_images=True).filter("area > 50").orderBy("cx").collect()
    assert [(r.cx, r.cy, r.w, r.h, r.area) for r in got] == [(100.0 + 130 * i, 150.0, 25, 25, 625) for i in range(5)]


def test_tiled_masks_give_the_same_components(spark):
    rng = np.random.default_rng(3)
    img = np.zeros((40, 50, 3), np.uint8)
    img[:, :, 2] = np.where(rng.random((40, 50)) < 0.12, 200, np.where(rng.random((40, 50)) < 0.5, 30, 0))
    df = frames_df(spark, [frame_row(1, img), frame_row(2, img[:, ::-1].copy())])
    whole = components.components(marks.red_masks(df, ["frame_id"], 5.0), ["frame_id"], whole_images=True)
    tiled = components.components(marks.red_masks(df, ["frame_id"], 5.0, tile=7), ["frame_id"])
    columns = ["frame_id", "component", "area", "x", "y", "w", "h"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, tiled.select(*columns).collect()))
    assert whole.count() > 20


def test_status_of_marks(spark):
    rows = [(1, i, 100, 90 + i * 3, 300, 10, 10, 100.0 + i, 310.0) for i in range(5)]
    rows += [(1, 8, 100, 700, 300, 10, 10, 705.0, 310.0), (1, 9, 100, 90, 10, 10, 10, 100.0, 20.0), (1, 10, 30, 0, 0, 5, 6, 1., 300.),
             (1, 11, 100, 0, 0, 50, 2, 1., 300.)]
    found = spark.createDataFrame(rows, "frame_id long, component long, area long, x int, y int, w int, h int, cx double, cy double")
    graded = marks.classify(found.withColumn("image_h", F.lit(400)), ["frame_id"])
    assert {r.component: r.status for r in graded.collect()} == {
        **{i: "valid" for i in range(5)}, 8: "outlier", 9: "upper_half"}
    assert marks.rejected(graded).count() == 2
    s = marks.summary(graded, ["frame_id"]).first()
    assert (s.n_valid, s.n_rejected, s.mean_x) == (5, 2, 102.0)


def test_red_dominance_numbers(spark):
    r = imaging.red_dominance(frames_df(spark, [frame_row(1, squares())]), ["frame_id"]).first()
    assert r.diff_min == 240 - 480 and r.diff_max == 150 - 20 and r.positive == 5 * 625
    assert abs(r.positive_pct - 5 * 625 / 320000 * 100) < 1e-12
    assert sum(r.per_x) == sum(r.per_y) == 5 * 625 * 130


def test_no_red_gives_default_threshold(spark):
    df = frames_df(spark, [frame_row(1, np.zeros((8, 8, 3), np.uint8))])
    assert marks.red_thresholds(df, ["frame_id"]).select("threshold", F.col("n_positive")).first() == (50.0, 0)
