"""Vegetation indices and derived layers as column expressions of a spectrum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spectra import band, safe_inverse, zero_divide

Band = Callable[[float], Column]


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))


def positive(a: Column, b: Column) -> Column:
    return F.when(b > 1e-10, F.try_divide(a, b)).otherwise(F.lit(0.0))


#: Formulas, wavelengths and guards of the indices, each a function of "reflectance at nm"; users may add their own.
INDICES: dict[str, Callable[[Band], Column]] = {
    "NDVI": lambda r: ratio(r(800), r(670)),
    "GNDVI": lambda r: ratio(r(800), r(550)),
    "ARI": lambda r: safe_inverse(r(550)) - safe_inverse(r(700)),
    "RVSI": lambda r: (r(714) + r(752)) / 2 - r(733),
    "ZTM": lambda r: positive(r(750), r(710)),
    "CRI": lambda r: safe_inverse(r(510)) - safe_inverse(r(550)),
    "PRI": lambda r: ratio(r(531), r(570)),
    "mARI": lambda r: (safe_inverse(r(550)) - safe_inverse(r(700))) * r(800),
    "SIPI": lambda r: zero_divide(r(800) - r(445), r(800) - r(680)),
    "WBI": lambda r: positive(r(900), r(970)),
    "REP": lambda r: F.when(F.abs(r(720) - r(710)) > 1e-10, 700 + 40 * F.try_divide((r(700) + r(740)) / 2 - r(710), r(720) - r(710))).otherwise(F.lit(700.0)),
    "BES": lambda r: (r(450) - r(400)) / 50,
    "FLAVI": lambda r: positive(r(400), r(420) * r(700)),
}


def all_indices(spectrum: Column, wavelengths: list[float], enabled: list[str] | None = None) -> dict[str, Column]:
    """Columns by name; an unknown name is an error."""
    names = list(INDICES) if enabled is None else enabled
    unknown = set(names) - set(INDICES)
    if unknown:
        raise ValueError(f"unknown indices {sorted(unknown)}")
    return {n: INDICES[n](lambda nm: band(spectrum, wavelengths, nm)) for n in names}


def fixed_layers(spectrum: Column, wavelengths: list[float]) -> dict[str, Column]:
    """Five bands, FRI, NDRE and NBI, and the layers derived from them (fixed values: wavelengths and formulas)."""
    r = {nm: band(spectrum, wavelengths, nm) for nm in (410, 460, 670, 700, 800)}
    fri = safe_inverse(r[410]) - safe_inverse(r[460])
    ndre = zero_divide(r[800] - r[700], r[800] + r[700])
    nbi = zero_divide(ndre, fri)

    def log(x: Column) -> Column:
        return F.when(F.abs(x) > 1e-10, F.ln(F.abs(x) + 1e-10)).otherwise(F.lit(0.0))

    return {
        **{f"R{nm}": c for nm, c in r.items()}, "FRI": fri, "NDRE": ndre, "NBI": nbi,
        "logR460_R410": log(zero_divide(r[460], r[410])), "R670_R460": zero_divide(r[670], r[460]), "R800_R460": zero_divide(r[800], r[460]),
        "FRI_x_NDRE": fri * ndre, "logNBI": F.ln(F.greatest(nbi, F.lit(0.0)) + 1),
    }
