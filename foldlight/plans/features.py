"""From masked pixels to one feature row for each image.

A row has the statistics of 13 layers and 13 indices, the standardised mean spectrum, its smoothed first
derivative, one absorption band and three derivative peaks: 112 + 2 x bands values. Pixels are read once
for the statistics and once for the mean spectrum; all that follows works on one row an image.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indices, spectra
from ..functions.labels import feature_names
from ..operators.pixels import layer_statistics, mean_spectra

STATS = ("mean", "std", "p25", "p75")


def finite(x: Column) -> Column:
    """The value, 0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def number(c: str) -> Column:
    """The value, null for NaN."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


def usable_images(pixels: DataFrame, image: str, spectrum: str, mask: str) -> DataFrame:
    """(image, bands, inside, failure): `empty mask`, `other width` (not the number of bands most images have,
    the smaller on ties) or `mixed widths`; null for images that can be used."""
    each = pixels.groupBy(image).agg(F.min(F.size(spectrum)).alias("bands"), F.max(F.size(spectrum)).alias("_most"), F.count_if(mask).alias("inside"))
    usual = each.groupBy("bands").agg(F.count("*").alias("n")).agg(F.max_by("bands", F.struct("n", -F.col("bands"))).alias("_usual"))
    failure = F.when(F.col("bands") != F.col("_most"), "mixed widths").when(F.col("inside") == 0, "empty mask").when(F.col("bands") != F.col("_usual"), "other width")
    return each.crossJoin(F.broadcast(usual)).select(image, "bands", "inside", failure.alias("failure"))  # one row


def names(wavelengths: list[float]) -> list[str]:
    """The names of a feature row, in order."""
    x = F.lit(None).cast("array<double>")
    return feature_names(wavelengths, list(indices.fixed_layers(x, wavelengths)), list(indices.INDICES))


def feature_rows(pixels: DataFrame, image: str, spectrum: str, mask: str, wavelengths: list[float], snv: bool = True, derivative: bool = True) -> DataFrame:
    """(image, features): the row of names(wavelengths) for every image. Without `snv` the mean spectrum stays as it
    is, without `derivative` its values are 0; the number of columns is the same. Values that aren't finite are 0."""
    clean = F.transform(F.col(spectrum).cast("array<double>"), finite)
    layers = {**indices.fixed_layers(F.col("_x"), wavelengths), **indices.all_indices(F.col("_x"), wavelengths)}
    columns = {f"_l{i}": c for i, c in enumerate(layers.values())}
    rows = pixels.select(image, F.col(mask).alias("_in"), clean.alias("_x")).withColumns(columns)
    stats = layer_statistics(rows, image, list(columns), "_in")
    flat = stats.select(image, F.array(*(F.col(f"{c}_{s}") for c in columns for s in STATS)).alias("stats"))

    long = mean_spectra(pixels.select(image, mask, F.col(spectrum).cast("array<double>").alias("s")), image, "s", mask)
    means = long.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("mean"))  # one entry a band

    bands = len(wavelengths)
    smooth = spectra.savgol_matrix(bands, derivative=1)

    def change(block: np.ndarray) -> np.ndarray:
        whole = spectra.STEPS["snv"](block) if snv else block
        slope = whole @ smooth.T if derivative else np.zeros_like(whole)
        depth, area = spectra.band_absorption(block, wavelengths)
        return np.nan_to_num(np.concatenate((whole, slope, depth[:, None], area[:, None]), axis=1), nan=0.0, posinf=0.0, neginf=0.0)

    derived = spectra.map_spectra(means, "mean", change)
    slope = F.slice("mean", bands + 1, bands)
    windows = [(680, 760), (430, 510), (None, None)]
    peaks = [F.array(p["wavelength"], p["value"]) for p in (spectra.derivative_peak(F.col("_d"), wavelengths, *w) for w in windows)]
    done = derived.withColumn("_d", slope).select(image, F.concat("mean", *peaks).alias("rest"))
    return flat.join(done, image).select(image, F.transform(F.concat("stats", "rest"), finite).alias("features"))


def build_dataset(pixels: DataFrame, image: str, spectrum: str, mask: str, wavelengths: list[float], **switches: bool) -> tuple[DataFrame, DataFrame]:
    """(feature rows of the images that can be used, (image, failure) of the others)."""
    checked = usable_images(pixels, image, spectrum, mask).withColumn("failure", F.coalesce("failure", F.when(F.col("bands") != len(wavelengths), "other width")))
    good = checked.where(F.col("failure").isNull()).select(image)
    rows = feature_rows(pixels.join(good, image, "left_semi"), image, spectrum, mask, wavelengths, **switches)
    return rows, checked.where(F.col("failure").isNotNull()).select(image, "failure")


def band_image_statistics(pixels: DataFrame, image: str, band: str, value: str, bands: list[int]) -> DataFrame:
    """Mean, population deviation, p25 and p75 of each band as columns `b<band>_<statistic>`; one shuffle."""
    stats = []
    for b in bands:
        v = F.when(F.col(band) == b, F.col(value))
        stats += [F.avg(v).alias(f"b{b}_mean"), F.stddev_pop(v).alias(f"b{b}_std"), F.percentile(v, F.lit(0.25)).alias(f"b{b}_p25"), F.percentile(v, F.lit(0.75)).alias(f"b{b}_p75")]
    return pixels.where(F.col(band).isin(bands)).groupBy(image).agg(*stats)


def overview(name: str, df: DataFrame, features: str, targets: list[str], group: str) -> DataFrame:
    """One row: name, samples, features, groups, and finite values of each target."""
    counts = (F.count(F.when(~F.isnan(F.col(t).cast("double")), F.col(t))).alias(f"n_{t}") for t in targets)
    return df.agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.max(F.size(features)).alias("p"), F.count_distinct(group).alias("groups"), *counts)


def class_profile(df: DataFrame, features: str, label: str) -> DataFrame:
    """(pos, label, mean, n): each band's mean in each class, of the values that are numbers; n counts rows."""
    return df.select(label, F.posexplode(features)).groupBy("pos", label).agg(F.avg(number("col")).alias("mean"), F.count("*").alias("n"))


def feature_profile(df: DataFrame, features: str) -> DataFrame:
    """(pos, mean, std): over all rows' values that are numbers, population deviation."""
    return df.select(F.posexplode(features)).groupBy("pos").agg(F.avg(number("col")).alias("mean"), F.stddev_pop(number("col")).alias("std"))


def image_profile(pixels: DataFrame, image: str, spectrum: str, mask: str) -> DataFrame:
    """(image, pos, mean, std, n): each band over the mask's pixels, population deviation."""
    return pixels.where(F.col(mask)).select(image, F.posexplode(spectrum)).groupBy(image, "pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("std"), F.count("*").alias("n"))


def group_structure(df: DataFrame, group: str) -> DataFrame:
    """(grp, n): rows of each group."""
    return df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))


def target_histogram(df: DataFrame, target: str) -> DataFrame:
    """(bin, n, mean): as many bins of equal width as a fifth of the finite values, 5 to 30; other rows don't count.
    Values that are all equal are in bin 0."""
    rows = df.select(F.col(target).cast("double").alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf")))
    e = rows.agg(F.min("y").alias("_low"), F.max("y").alias("_high"), F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.count("*") / 5))).alias("_bins"))
    at = F.least(F.col("_bins") - 1, F.floor(F.coalesce(F.try_divide((F.col("y") - F.col("_low")) * F.col("_bins"), F.col("_high") - F.col("_low")), F.lit(0.0)))).cast("int")
    return rows.crossJoin(F.broadcast(e)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("mean"))  # one row
