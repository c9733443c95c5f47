"""Expressions over the peak arrays of one spectrum row; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionweave.config import PROTON_MASS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def zipped(mz="mz", intensity="intensity") -> Column:
    """Peaks as an array of (mz, intensity) structs in DOUBLE."""
    return F.zip_with(_c(mz), _c(intensity),
                      lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def passes_quality(mz="mz", min_peaks: int = 5, min_range: float = 250.0) -> Column:
    m = _c(mz).cast("array<double>")
    return (F.size(m) >= min_peaks) & (F.array_max(m) - F.array_min(m) >= F.lit(float(min_range)))


def precursor_line(pmz, charge, z) -> Column:
    """m/z of the precursor reduced to charge ``z``."""
    mass = _c(pmz) * _c(charge) - F.lit(PROTON_MASS) * _c(charge)
    return mass / z + F.lit(PROTON_MASS)


def without_precursor(peaks: Column, pmz="precursor_mz", charge="precursor_charge",
                      tol: float = 1.5) -> Column:
    """Peaks farther than ``tol`` from the precursor and its charge-reduced lines."""
    lines = F.transform(F.sequence(F.lit(1), F.greatest(_c(charge), F.lit(1))),
                        lambda z: precursor_line(pmz, charge, z))
    kept = F.filter(peaks, lambda p: F.forall(lines, lambda line: F.abs(p["mz"] - line) > F.lit(tol)))
    return F.when(_c(charge) > 0, kept).otherwise(peaks)


def strongest(peaks: Column, k: int) -> Column:
    """The ``k`` most intense peaks; ties go to the lower m/z, then the earlier peak."""
    keyed = F.transform(peaks, lambda p, pos: F.struct(
        (-p["intensity"]).alias("neg"), p["mz"].alias("mz"), pos.alias("pos"), p["intensity"].alias("intensity")))
    return F.slice(F.array_sort(keyed), 1, k)


def sqrt_scaled(intensity: Column, top: Column) -> Column:
    return F.when(top > 0, F.sqrt(intensity / top)).otherwise(intensity)


def bin_index(mz, mz_min: float = 50.0, width: float = 0.02) -> Column:
    """Bin number, truncated toward zero."""
    return ((_c(mz) - F.lit(mz_min)) / F.lit(width)).cast("int")


def unit_mz(mz, mz_min: float = 50.0, mz_max: float = 1500.0) -> Column:
    return F.least(F.greatest((_c(mz) - F.lit(mz_min)) / F.lit(mz_max - mz_min), F.lit(0.0)), F.lit(1.0))


def tokens(peaks: Column, k: int = 150, mz_min: float = 50.0, mz_max: float = 1500.0) -> Column:
    """Unpadded (norm_mz, norm_int) tokens of the strongest peaks in m/z order."""
    top = strongest(peaks, k)
    by_mz = F.array_sort(F.transform(top, lambda p: F.struct(
        p["mz"].alias("mz"), p["pos"].alias("pos"), p["intensity"].alias("intensity"))))
    peak_max = F.array_max(F.transform(top, lambda p: p["intensity"]))
    return F.transform(by_mz, lambda p: F.struct(
        unit_mz(p["mz"], mz_min, mz_max).alias("norm_mz"),
        sqrt_scaled(p["intensity"], peak_max).alias("norm_int")))


def binned(peaks: Column, k: int = 150, mz_min: float = 50.0, width: float = 0.02,
           n_bins: int = 72_500) -> Column:
    """Sparse (bin, value) pairs of the strongest peaks; a bin may occur more than once."""
    top = strongest(peaks, k)
    peak_max = F.array_max(F.transform(top, lambda p: p["intensity"]))
    pairs = F.transform(top, lambda p: F.struct(
        bin_index(p["mz"], mz_min, width).alias("bin"),
        sqrt_scaled(p["intensity"], peak_max).alias("v")))
    return F.filter(pairs, lambda b: (b["bin"] >= 0) & (b["bin"] < n_bins))
