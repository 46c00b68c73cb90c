"""Text and class rules: names, symptoms, bins, feature names, effect sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .indices import INDICES

#: Substrings of a normalised symptom and their class, in order: the first hit counts; any other is class 3.
SYMPTOMS = [
    ("healthy", 0),
    ("flavescence doree", 1), ("flavescence dor ee", 1),
    ("green leafhopper", 2), ("buffalo treehopper", 2), ("wood diseases", 2), ("mildew", 2),
    ("water stress", 3), ("senescence", 3), ("damaged", 3), ("deficiency", 3), ("chlorosis", 3), ("discoloration", 3),
]
#: What a feature's name starts with that comes from an index: the indices' own names, and those of three layers.
INDEX_NAMES = [*INDICES, "FRI", "NDRE", "NBI"]


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalise(text: Column, ascii_only: bool = False) -> Column:
    """Trimmed, lower case, blanks squeezed, accents dropped (the one step outside the JVM; skipped for ascii_only)."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return plain if ascii_only else without_accents(plain)


def symptom_class(normalised: Column, patterns: list[tuple[str, int]] | None = None, default: int = 3) -> Column:
    out = F.lit(default)
    for pattern, label in reversed(SYMPTOMS if patterns is None else patterns):
        out = F.when(F.contains(normalised, F.lit(pattern)), label).otherwise(out)
    return out


def flavonol_class(value: Column) -> Column:
    """0 from 2.5, 2 from 1.5, else 3; 3 without a value."""
    return F.when(value.isNull() | F.isnan(value), 3).when(value >= 2.5, 0).when(value >= 1.5, 2).otherwise(3)


def bin_index(value: Column, edges: Column) -> Column:
    """Count of inner edges at or below the value; -1 without a value, 0 where only one edge is left."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(value.isNull() | F.isnan(value), -1).when(F.size(edges) < 3, 0).otherwise(F.size(F.filter(inner, lambda e: e <= value)))


def uniform_edges(value: Column, bins: int) -> Column:
    low, high = F.min(value), F.max(value)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: low + (high - low) * i / bins))


def feature_wavelength(name: Column) -> Column:
    """nm of a band's feature (snv_R670, d1snv_R670, R670_mean), else null."""
    return F.nullif(F.regexp_extract(name, r"^(?:(?:snv|d1snv)_R(?=\d+$)|R(?=\d+_(?:mean|std|p25|p75)$))(\d+)", 1), F.lit("")).cast("int")


def feature_category(name: Column) -> Column:
    """snv, d1snv, fixed_band, index, continuum, edge or other, by the feature's name."""
    return (
        F.when(name.rlike(r"^snv_R\d+$"), "snv").when(name.rlike(r"^d1snv_R\d+$"), "d1snv").when(name.rlike(r"^R\d+_(mean|std|p25|p75)$"), "fixed_band")
        .when(name.rlike(f"^({'|'.join(INDEX_NAMES)})"), "index").when(F.startswith(name, F.lit("cont_")), "continuum")
        .when(name.rlike("^d1_(red|blue|all)_"), "edge").otherwise("other")
    )


def feature_names(wavelengths: list[float], layers: list[str], indices: list[str]) -> list[str]:
    """The order of the feature vector: statistics of layers and indices, spectra, absorption, peaks."""
    stats = [f"{n}_{s}" for n in [*layers, *indices] for s in ("mean", "std", "p25", "p75")]
    spectra = [f"{kind}_R{round(w)}" for kind in ("snv", "d1snv") for w in wavelengths]
    return stats + spectra + ["cont_BandI_depth", "cont_BandI_area"] + [f"d1_{e}_peak_{v}" for e in ("red", "blue", "all") for v in ("wl", "value")]


def effect_label(delta: Column) -> Column:
    size = F.abs(delta)
    return (
        F.when(delta.isNull() | F.isnan(delta), "n/a").when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    )
