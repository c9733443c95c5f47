"""Precursor-mass expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionweave.config import PROTON_MASS

# Modification name and monoisotopic mass shift in dalton.
MODIFICATION_SHIFTS = {
    "Phosphorylation": 79.9663,
    "Acetylation": 42.0106,
    "Oxidation": 15.9949,
    "Methylation": 14.0157,
    "Deamidation": 0.9840,
    "Carbamidomethyl": 57.0215,
    "Ubiquitination(GG)": 114.0429,
}
MODIFICATION_TOLERANCE = 0.02


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def neutral_mass(precursor_mz, charge) -> Column:
    """Neutral monoisotopic mass; an unknown charge counts as one."""
    z = F.greatest(_c(charge), F.lit(1))
    return (_c(precursor_mz).cast("double") - F.lit(PROTON_MASS)) * z


def modification_name(delta) -> Column:
    """Name of the modification whose shift matches ``delta``, else the empty string.

    The tolerance windows do not overlap, so the branch order does not matter.
    """
    d = _c(delta)
    out = F.lit("")
    for name, shift in MODIFICATION_SHIFTS.items():
        out = F.when(F.abs(d - F.lit(shift)) <= F.lit(MODIFICATION_TOLERANCE), F.lit(name)).otherwise(out)
    return out


def charges_compatible(z_i, z_j) -> Column:
    """Equal charges, or at least one unknown."""
    return (_c(z_i) == _c(z_j)) | (F.least(_c(z_i), _c(z_j)) <= 0)


def within_ppm(pmz_i, z_i, pmz_j, ppm: float) -> Column:
    """Directed relative test: the tolerance is taken from the query side i."""
    z = F.greatest(F.lit(1), _c(z_i))
    return F.abs(_c(pmz_i) - _c(pmz_j)) * z <= (_c(pmz_i) - F.lit(PROTON_MASS)) * z * F.lit(ppm) * F.lit(1e-6)


def precursor_score(pmz_i, z_i, pmz_j, z_j, tol_da: float) -> Column:
    """Linear closeness in dalton, zero on a charge conflict."""
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(_c(pmz_i) - _c(pmz_j)) / F.lit(tol_da))
    return F.when(charges_compatible(z_i, z_j), score).otherwise(F.lit(0.0))


def edge_weight(cos, pmz_i, z_i, pmz_j, z_j, ppm: float, tol_da: float) -> Column:
    """Weight of a directed candidate pair, or NULL when the precursors disagree.

    With ``ppm`` > 0 the relative test decides and the weight is the cosine; otherwise
    the window in dalton decides and the cosine is scaled by the precursor score.
    """
    if ppm and ppm > 0:
        ok = charges_compatible(z_i, z_j) & within_ppm(pmz_i, z_i, pmz_j, ppm)
        return F.when(ok, _c(cos))
    ok = F.abs(_c(pmz_i) - _c(pmz_j)) <= F.lit(tol_da)
    return F.when(ok, _c(cos) * precursor_score(pmz_i, z_i, pmz_j, z_j, tol_da))
