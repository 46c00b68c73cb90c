"""Reports on chosen features: how often, by how many models, of which kind and where in the spectrum.

Input tables are (model, feature): one row for each feature a model chose, `feature` named as in
functions.labels.feature_names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import feature_category, feature_wavelength

#: Categories whose features belong to one wavelength.
BANDED = ["snv", "d1snv", "fixed_band"]


def selection_frequency(scores: DataFrame, keys: list[str], features: int, arm: str = "nested") -> DataFrame:
    """(keys, pos, frequency): the share of an arm's folds that chose each feature, 0 for those never chosen."""
    rows = scores.where(F.col("arm") == arm)
    folds = rows.groupBy(*keys).agg(F.count("*").alias("folds"))
    hits = rows.select(*keys, F.explode("chosen").alias("pos")).groupBy(*keys, "pos").agg(F.count("*").alias("n"))
    grid = folds.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(features - 1))))
    return grid.join(hits, [*keys, "pos"], "left").select(*keys, "pos", (F.coalesce("n", F.lit(0)) / F.col("folds")).alias("frequency"))


def chosen_names(scores: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, arm, fold, feature): the names at chosen positions; `names` is as long as a feature vector."""
    table = F.array(*map(F.lit, names))
    return scores.select(*keys, "arm", "fold", F.explode(F.transform("chosen", lambda p: F.get(table, p))).alias("feature"))


def parsed(selected: DataFrame) -> DataFrame:
    """Adds `category` and `wavelength` (null for features of no single band)."""
    return selected.withColumns({"category": feature_category(F.col("feature")), "wavelength": feature_wavelength(F.col("feature"))})


def consensus(selected: DataFrame, share: float = 0.6) -> DataFrame:
    """(wavelength, models, strong): by how many models a wavelength was chosen; strong from max(2, round(share x
    models)). Order by models descending, wavelength, for a top list."""
    total = selected.agg(F.greatest(F.lit(2), F.rint(F.count_distinct("model") * share)).alias("least"))
    counts = parsed(selected).where(F.col("category").isin(BANDED) & F.col("wavelength").isNotNull()).groupBy("wavelength").agg(F.count_distinct("model").alias("models"))
    return counts.crossJoin(F.broadcast(total)).select("wavelength", "models", (F.col("models") >= F.col("least")).alias("strong"))  # one row


def top_bands(counts: DataFrame, n: int = 25) -> DataFrame:
    """The n wavelengths that most models chose."""
    return counts.orderBy(F.desc("models"), "wavelength").limit(n)


def by_category(selected: DataFrame) -> DataFrame:
    """(model, category, n, wavelengths): features of each kind, and their different wavelengths in order."""
    return parsed(selected).groupBy("model", "category").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("wavelength")).alias("wavelengths"))  # a set of bands


def region(wavelength: Column) -> Column:
    """VIS from 400 nm, Red-Edge from 700, NIR from 740 to 1000; else null."""
    return F.when((wavelength >= 400) & (wavelength < 700), "VIS").when((wavelength >= 700) & (wavelength < 740), "Red-Edge").when((wavelength >= 740) & (wavelength <= 1000), "NIR")


def wavelength_histogram(selected: DataFrame, low: int = 400, high: int = 1000, width: int = 10) -> DataFrame:
    """(category, low_nm, region, n): chosen bands in bins of `width` nm; the last bin holds `high` itself."""
    w = F.col("wavelength")
    at = F.least(F.floor((w - low) / width), F.lit((high - low) // width - 1)) * width + low
    inside = parsed(selected).where(F.col("category").isin(BANDED) & w.between(low, high))
    return inside.groupBy("category", at.cast("int").alias("low_nm")).agg(F.count("*").alias("n")).withColumn("region", region(F.col("low_nm")))


def first_bands(selected: DataFrame, n: int = 30) -> DataFrame:
    """The first n chosen bands by wavelength, then name."""
    rows = parsed(selected).where(F.col("wavelength").isNotNull()).select("wavelength", "feature", "category").distinct()
    return rows.orderBy("wavelength", "feature").limit(n)
