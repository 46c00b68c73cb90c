"""Functions of one spectrum, an array<double> column: bands, guards, scatter correction, smoothing, shape.

Positions are 0-based as in the wavelength axis; a wavelength axis is a list of numbers in nm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the guards.
DIVIDE_EPS, INVERSE_EPS = 1e-9, 1e-10


def find_band(wavelengths: list[float], nm: float) -> int:
    """Position of the nearest band, the first on ties."""
    return int(np.abs(np.asarray(wavelengths, float) - nm).argmin())


def band(spectrum: Column, wavelengths: list[float], nm: float) -> Column:
    return F.get(spectrum, F.lit(find_band(wavelengths, nm)))


def nearest_position(axis: Column, nm: Column) -> Column:
    """find_band() for an axis that is a column itself."""
    away = F.transform(axis, lambda w: F.abs(w - nm))
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def safe_divide(a: Column, b: Column, eps: float = DIVIDE_EPS) -> Column:
    """a / b, with a denominator smaller than eps replaced by eps."""
    return a / F.when(F.abs(b) < eps, F.lit(eps)).otherwise(b)


def zero_divide(a: Column, b: Column, eps: float = INVERSE_EPS) -> Column:
    """a / b, 0 where the denominator is smaller than eps."""
    return F.when(F.abs(b) < eps, F.lit(0.0)).otherwise(F.try_divide(a, b))


def safe_inverse(x: Column, eps: float = INVERSE_EPS) -> Column:
    return F.when(x > eps, F.try_divide(F.lit(1.0), x)).otherwise(F.lit(0.0))


def safe_log(x: Column, eps: float = INVERSE_EPS) -> Column:
    return F.when(F.abs(x) > eps, F.ln(F.abs(x) + eps)).otherwise(F.lit(0.0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, not again for each element that uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snv(spectrum: Column) -> Column:
    """(x - mean) / population standard deviation of the spectrum; a deviation of 0 counts as 1."""

    def scaled(mean: Column) -> Column:
        centred = F.transform(spectrum, lambda x: x - mean)
        spread = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x) / F.size(spectrum))
        return bound(F.when(spread == 0, F.lit(1.0)).otherwise(spread), lambda d: F.transform(spectrum, lambda x: (x - mean) / d))

    return bound(total(spectrum) / F.size(spectrum), scaled)


def first_difference(spectrum: Column, spacing: float = 1.0) -> Column:
    """One band shorter."""
    n = F.size(spectrum)
    return F.zip_with(F.slice(spectrum, F.lit(2), n - 1), F.slice(spectrum, F.lit(1), n - 1), lambda b, a: (b - a) / spacing)


def savgol_matrix(bands: int, window: int = 11, order: int = 2, derivative: int = 0) -> np.ndarray:
    """The matrix that smooths a spectrum of so many bands: local least-squares polynomials, at the edges
    the polynomial of the first or last whole window."""
    if window > bands or window % 2 == 0:
        raise ValueError("the window must be odd and no longer than the spectrum")
    half, out = window // 2, np.zeros((bands, bands))
    for i in range(bands):
        first = min(max(i - half, 0), bands - window)
        powers = np.vander(np.arange(first, first + window) - i, order + 1, increasing=True)
        out[i, first : first + window] = np.linalg.pinv(powers)[derivative] * (1, 1, 2)[derivative]
    return out


def running_maximum_continuum(rows: np.ndarray) -> np.ndarray:
    """Each value over the largest one at or right of it (0 counts as 1e-9)."""
    top = np.maximum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]
    return rows / np.where(top == 0, 1e-9, top)


def line_continuum(rows: np.ndarray) -> np.ndarray:
    """Each value over the line between the spectrum's ends (0 counts as 1e-9)."""
    line = rows[:, :1] + (rows[:, -1:] - rows[:, :1]) * np.linspace(0, 1, rows.shape[1])
    return rows / np.where(line == 0, 1e-9, line)


def msc(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """(x - a) / b of the regression of each spectrum on the reference; unchanged where b is about 0."""
    centred = reference - reference.mean()
    slope = (rows @ centred) / (centred @ centred)
    level = rows.mean(axis=1) - slope * reference.mean()
    flat = np.abs(slope) < 1e-10
    return np.where(flat[:, None], rows, (rows - level[:, None]) / np.where(flat, 1, slope)[:, None])


def band_absorption(rows: np.ndarray, wavelengths: list[float], low: float = 410, high: float = 510) -> tuple[np.ndarray, np.ndarray]:
    """(depth, area) below the straight baseline between low and high nm; 0, 0 with fewer than three bands."""
    axis = np.asarray(wavelengths, float)
    inside = (axis >= low) & (axis <= high)
    if inside.sum() < 3:
        return np.zeros(len(rows)), np.zeros(len(rows))
    x, y = axis[inside], rows[:, inside]
    ends = np.stack((y[:, 0], y[:, -1]), axis=1)
    ends = np.where(np.isfinite(ends) & (ends > 0), ends, 1e-9)
    base = ends[:, :1] + (ends[:, 1:] - ends[:, :1]) * (x - x[0]) / (x[-1] - x[0])
    removed = y / np.where(base == 0, 1e-9, base)
    below = np.maximum(1 - removed, 0)
    return 1 - removed.min(axis=1), ((below[:, 1:] + below[:, :-1]) / 2 * np.diff(x)).sum(axis=1)


def derivative_peak(spectrum: Column, wavelengths: list[float], low: float | None = None, high: float | None = None) -> Column:
    """Struct (wavelength, value) of the largest absolute value between low and high nm, the first on ties; zeros if none."""
    chosen = [i for i, w in enumerate(wavelengths) if (low is None or w >= low) and (high is None or w <= high)]
    if not chosen:
        return F.struct(F.lit(0.0).alias("wavelength"), F.lit(0.0).alias("value"))
    tried = F.array(*(F.struct(F.abs(F.get(spectrum, F.lit(i))).alias("size"), F.lit(-i).alias("order"), F.lit(float(wavelengths[i])).alias("wavelength"), F.get(spectrum, F.lit(i)).alias("value")) for i in chosen))
    best = F.array_max(tried)
    return F.struct(best["wavelength"].alias("wavelength"), best["value"].alias("value"))


#: Steps by name on a block of spectra; users may add their own.
STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sg": lambda rows: rows @ savgol_matrix(rows.shape[1]).T,
    "sg_d1": lambda rows: rows @ savgol_matrix(rows.shape[1], derivative=1).T,
    "snv": lambda rows: (rows - rows.mean(1, keepdims=True)) / np.where(rows.std(1, keepdims=True) == 0, 1, rows.std(1, keepdims=True)),
    "d1": lambda rows: np.diff(rows, axis=1),
    "continuum": running_maximum_continuum,
    "continuum_line": line_continuum,
}


def map_spectra(df: DataFrame, column: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a function of a block of equally long spectra to an array column, batch by batch."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(at)
                rows = change(np.asarray(values.flatten(), float).reshape(batch.num_rows, -1))
                offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())), *batch.columns[at + 1 :]], batch.schema.names)

    schema = ", ".join(f"`{n}` {'array<double>' if n == column else t}" for n, t in df.dtypes)
    return df.mapInArrow(run, schema)


def preprocess(df: DataFrame, column: str, steps: list[str], reference: np.ndarray | None = None) -> DataFrame:
    """The steps in order, in one pass; `msc` takes the given reference, or else the table's mean spectrum."""
    unknown = set(steps) - set(STEPS) - {"msc"}
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    if "msc" in steps and reference is None:
        before = preprocess(df, column, steps[: steps.index("msc")])
        means = before.select(F.posexplode(column)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # one row a band
        reference = np.array([r["m"] for r in means])
    chain = [(lambda rows: msc(rows, reference)) if s == "msc" else STEPS[s] for s in steps]

    def change(rows: np.ndarray) -> np.ndarray:
        for step in chain:
            rows = step(rows)
        return rows

    return map_spectra(df, column, change) if steps else df


def preprocess_dataset(df: DataFrame, column: str, bands: int, window: int = 11) -> DataFrame:
    """Smoothing where the spectrum is long enough (an even window grows by one), then SNV."""
    window += window % 2 == 0
    matrix = savgol_matrix(bands, window) if bands >= window else np.eye(bands)
    return map_spectra(df, column, lambda rows: STEPS["snv"](rows @ matrix.T))
