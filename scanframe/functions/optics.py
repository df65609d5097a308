"""Sampling and diffraction figures of a camera behind an objective."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WAVELENGTH_UM = 0.55
BINNINGS = (1, 2, 3, 4, 8)


def nyquist_pixel_um(na: Column, lam: float = WAVELENGTH_UM) -> Column:
    return lam / (4.0 * na)


def object_pixel_um(pixel_um: Column, mag: Column) -> Column:
    return pixel_um / mag


def oversampling(na: Column, mag: Column, pixel_um: Column, lam: float = WAVELENGTH_UM) -> Column:
    return nyquist_pixel_um(na, lam) / object_pixel_um(pixel_um, mag)


def airy_um(na: Column, lam: float = WAVELENGTH_UM) -> Column:
    return 1.22 * lam / na


def optical_cutoff(na: Column, lam: float = WAVELENGTH_UM) -> Column:
    return 2.0 * na / lam


def pixel_nyquist(object_px: Column) -> Column:
    return 1.0 / (2.0 * object_px)


def mtf_incoherent(cutoff: Column, f: Column) -> Column:
    """Diffraction-limited contrast; nothing passes beyond the cutoff."""
    nu = F.least(f / cutoff, F.lit(1.0))
    return F.when(f >= cutoff, F.lit(0.0)).otherwise(2.0 / F.pi() * (F.acos(nu) - nu * F.sqrt(1.0 - nu * nu)))


def ideal_binning(s: Column, binnings: tuple[int, ...] = BINNINGS, mode: str = "ceil") -> Column:
    bins = sorted({int(b) for b in binnings if b >= 1})
    if not bins:
        raise ValueError("at least one positive binning is needed")
    options = F.array(*[F.lit(b) for b in bins])
    if mode == "ceil":
        return F.coalesce(F.array_min(F.filter(options, lambda b: b >= s)), F.lit(bins[-1]))
    if mode == "floor":
        return F.coalesce(F.array_max(F.filter(options, lambda b: b <= s)), F.lit(bins[0]))
    ranked = F.transform(options, lambda b: F.struct(F.abs(b - s).alias("d"), b.alias("b")))
    return F.array_min(ranked)["b"]


def binned(bin_factor: Column, nx: Column, ny: Column, na: Column, mag: Column, pixel_um: Column,
           lam: float = WAVELENGTH_UM) -> Column:
    """Figures after binning, as a struct."""
    p_obj = bin_factor * pixel_um / mag
    bx = F.greatest(F.lit(1), F.bround(nx / bin_factor).cast("int"))
    by = F.greatest(F.lit(1), F.bround(ny / bin_factor).cast("int"))
    fc, fn = optical_cutoff(na, lam), pixel_nyquist(p_obj)
    return F.struct(
        bin_factor.cast("double").alias("bin_factor"), bx.alias("nx"), by.alias("ny"),
        F.bround(bx.cast("bigint") * by / 1e6, 3).alias("mpix"), p_obj.alias("p_obj_um"),
        (airy_um(na, lam) / p_obj).alias("px_per_airy"), fn.alias("f_nyquist"), (fn / fc).alias("fn_to_fc"),
        mtf_incoherent(fc, fn).alias("mtf"), (nyquist_pixel_um(na, lam) / p_obj).alias("s"),
        (25400.0 / p_obj).alias("dpi"))


def domain_error(nx: Column, ny: Column, pixel_um: Column, mag: Column, na: Column) -> Column:
    """Why a row cannot be computed; NULL for good rows."""
    return (F.when(~(F.coalesce(na, F.lit(0.0)) > 0), "na must be > 0")
            .when(~(F.coalesce(pixel_um, F.lit(0.0)) > 0) | ~(F.coalesce(mag, F.lit(0.0)) > 0),
                  "sensor pixel and magnification must be > 0")
            .when(~(F.coalesce(nx, F.lit(0)) > 0) | ~(F.coalesce(ny, F.lit(0)) > 0), "nx and ny must be > 0"))
