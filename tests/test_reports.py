import math

import pytest

from scanframe.plans import reports, selection


@pytest.fixture(scope="module")
def catalogue(spark):
    cameras = spark.createDataFrame([(*c, 0.65) for c in reports.CAMERAS], "title string, nx int, ny int, pixel_um double, na double")
    return reports.sampling_report(cameras, (40,), (1, 2, 3, 4, 5, 6, 7, 8)).persist()


def test_catalogue_against_the_formulas(catalogue):
    for r in catalogue.collect():
        p_obj, p_nyq = r.pixel_um / 40, 0.55 / 2.6
        s, fc, fn = p_nyq / p_obj, 1.3 / 0.55, 1 / (2 * p_obj)
        nu = fn / fc
        mtf = 0.0 if nu >= 1 else 2 / math.pi * (math.acos(nu) - nu * math.sqrt(1 - nu * nu))
        assert (r.s, r.mtf, r.dpi) == pytest.approx((s, mtf, 25400 / p_obj))
        assert r.binning == min(b for b in range(1, 9) if b >= s)


def test_summary_text(catalogue):
    rows = {r.camera: r for r in reports.summary_table(catalogue).collect()}
    mu = rows["MU 1000-HS"]
    s = (0.55 / 2.6) / (3.45 / 40)
    assert mu.fov_mm == f"{3584 * 3.45 / 40 / 1000:.3f}×{2748 * 3.45 / 40 / 1000:.3f}"
    assert mu.base_px == "3584×2748" and mu.ideal_s == f"{s:.2f}×" and mu.ideal_bin == "3×"
    assert mu.ideal_px == f"~{round(3584 / s)}×{round(2748 / s)}" and mu.dpi_base == f"{25400 / (3.45 / 40):,.0f}"
    assert rows["TCD1304"].ideal_px == f"~{round(3648 / (0.55 / 2.6 / 0.2))}×1"


def test_undersampling_is_named(spark):
    cameras = spark.createDataFrame([("coarse", 100, 100, 50.0, 0.9)], "title string, nx int, ny int, pixel_um double, na double")
    r = reports.camera_table(reports.sampling_report(cameras, (4,))).first()
    assert r.ideal_label == "Undersampling" and r.binning == 1 and r.base.bin_factor == 1.0


def test_timing_without_run_total(spark):
    t = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 0.0)], "run_id int, category string, seconds double")
    totals = spark.createDataFrame([(1, 12.0)], "run_id int, run_seconds double")
    got = {r.category: r for r in reports.timing_summary(t, totals).collect()}
    assert (got["a"].n, got["a"].average, got["a"].pct) == (2, 3.0, 50.0) and got["b"].pct is None


def test_selection_needs_two_frames_and_a_known_strategy(spark):
    files = spark.createDataFrame([("a", "F1.png", "a/1"), ("a", "F9.png", "a/2"), ("b", "F5.png", "b/1"), ("c", "none.png", "c/1")],
                                  "folder string, name string, path string")
    got = {(r.folder, r.strategy) for r in selection.run_all_strategies(files).collect()}
    assert got == {("a", "all"), ("a", "top5"), ("a", "best_single"), ("b", "best_single")}
    kept = selection.select_frames(files, "threshold", threshold=0.5, kind="relative").collect()
    assert sorted(r.path for r in kept) == ["a/2", "b/1"]
    assert sorted(r.path for r in selection.select_frames(files, "threshold", threshold=4.0).collect()) == ["a/2", "b/1"]
    with pytest.raises(ValueError):
        selection.select_frames(files, "nope")


def test_fixed_decimals_follow_the_binary_value(spark):
    from pyspark.sql import functions as F

    from scanframe.functions import bands
    values = [0.95, 0.25, 0.35, 1.45, -0.95, 2.5, 1.25, 7.0, 1e20, 1234.05]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", bands.fixed(F.col("v"), 1).alias("t")).collect()
    assert {r.v: r.t for r in rows} == {v: f"{v:.1f}" for v in values}  # 0.95 lies below the tie: 0.9


def test_detection_text_rounds_as_printf_and_sums_in_mark_order(spark):
    from pyspark.sql import functions as F

    from scanframe.sources import sinks
    marks = spark.createDataFrame([(1, 3, 0.3, 2.675), (1, 1, 0.1, 1.005), (1, 2, 0.2, 4.0)], "frame_id long, component long, cx double, cy double")
    text = sinks.detection_text(marks.repartition(3), F.lit("a"), ["frame_id"], "component").first().value
    assert text == f"a:\n  Mark 1: (0.10, {1.005:.2f})\n  Mark 2: (0.20, 4.00)\n  Mark 3: (0.30, {2.675:.2f})\n  Mean center X: {(0.1 + 0.2 + 0.3) / 3:.2f}"
