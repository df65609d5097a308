"""Optics and timing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.functions import bands, optics

INPUTS = ("nx", "ny", "pixel_um", "mag", "na")

# Catalogue cameras (title, nx, ny, sensor pixel in micrometres).
CAMERAS = (("MU 1000-HS", 3584, 2748, 3.45), ("MU 500", 2592, 1944, 2.20), ("Mokose 4k USB Webcam", 3840, 2160, 2.00),
           ("Raspberry Pi HQ Camera", 4056, 3040, 1.55), ("Raspberry Pi GS Camera", 1456, 1088, 3.45),
           ("Arducam 120fps camera", 5496, 3672, 2.4), ("Fujifilm X-M5", 9504, 6336, 3.76), ("TCD1304", 3648, 1, 8.0))


def sampling_report(cameras: DataFrame, magnifications: tuple[int, ...], binnings: tuple[int, ...] = optics.BINNINGS,
                    mode: str = "ceil", lam: float = optics.WAVELENGTH_UM) -> DataFrame:
    """Sampling figures of every camera behind every magnification.

    The magnifications are a literal list per row, so the combination is a local explode, not a join.
    """
    rows = cameras.withColumn("mag", F.explode(F.array(*[F.lit(m) for m in magnifications])))
    na, mag, px = F.col("na"), F.col("mag"), F.col("pixel_um")
    rows = rows.filter(optics.domain_error(*[F.col(c) for c in INPUTS]).isNull())
    p_obj, fc = optics.object_pixel_um(px, mag), optics.optical_cutoff(na, lam)
    s = optics.oversampling(na, mag, px, lam)
    return rows.withColumns({
        "p_nyq_um": optics.nyquist_pixel_um(na, lam), "p_obj_um": p_obj, "s": s, "fov_x_um": F.col("nx") * p_obj,
        "fov_y_um": F.col("ny") * p_obj, "airy_um": optics.airy_um(na, lam), "optical_cutoff": fc,
        "pixel_nyquist": optics.pixel_nyquist(p_obj), "mtf": optics.mtf_incoherent(fc, optics.pixel_nyquist(p_obj)),
        "px_per_airy": optics.airy_um(na, lam) / p_obj, "binning": optics.ideal_binning(s, binnings, mode),
        "dpi": 25400.0 / p_obj})


def optics_errors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", optics.domain_error(*[F.col(c) for c in INPUTS])).filter("reason is not null")


def camera_table(report: DataFrame, lam: float = optics.WAVELENGTH_UM) -> DataFrame:
    """Adds the three columns of the camera table (base, fractional ideal, rounded ideal) and the resolution label."""
    cell = lambda b: optics.binned(b, F.col("nx"), F.col("ny"), F.col("na"), F.col("mag"), F.col("pixel_um"), lam)
    out = report.withColumns({"base": cell(F.lit(1.0)), "ideal": cell(F.col("s")), "rounded": cell(F.col("binning").cast("double"))})
    label = F.when(F.col("s") < 1.0, "Undersampling").otherwise(
        F.concat(F.lit("~"), F.col("ideal.nx").cast("string"), F.lit("×"), F.col("ideal.ny").cast("string")))
    return out.withColumn("ideal_label", label)


def summary_table(report: DataFrame) -> DataFrame:
    """The comparison table as text columns."""
    t = camera_table(report)
    by = lambda a, b: F.concat(a, F.lit("×"), b)
    text = lambda c: F.col(c).cast("string")
    return t.select(
        F.col("title").alias("camera"), by(bands.fixed(F.col("fov_x_um") / 1000, 3), bands.fixed(F.col("fov_y_um") / 1000, 3)).alias("fov_mm"),
        by(text("nx"), text("ny")).alias("base_px"), bands.fixed(F.col("p_obj_um"), 3).alias("obj_px_um"),
        F.format_number(F.bround("dpi"), 0).alias("dpi_base"), F.format_number(F.bround("ideal.dpi"), 0).alias("dpi_ideal"),
        F.concat(bands.fixed(F.col("s"), 2), F.lit("×")).alias("ideal_s"), F.col("ideal_label").alias("ideal_px"),
        F.concat(text("binning"), F.lit("×")).alias("ideal_bin"), by(text("rounded.nx"), text("rounded.ny")).alias("binned_px"))


def timing_summary(timings: DataFrame, run_totals: DataFrame) -> DataFrame:
    """Count, total, average and range per run and category, and the share of the run's wall time."""
    per = timings.groupBy("run_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("average"),
        F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    return per.join(run_totals, "run_id", "left").withColumn(
        "pct", F.when(F.col("total") > 0, F.try_divide("total", F.nullif("run_seconds", F.lit(0.0))) * 100.0)).drop("run_seconds")
