"""Significance of the bias over seeds: paired tests, effect sizes, false-discovery correction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import effect_label
from ..operators.ordered import least_from, sums_before
from ..operators.splits import met

#: Pairs up to which the signed rank test counts all sign flips.
EXACT = 50


def signed_rank_p(ranks: list[float] | None, negative: float, total: float, squares: float) -> float:
    """Two-sided p of the smaller signed rank sum: all sign flips over the midranks if they are given, else the normal
    approximation with ties, from the sums of ranks and of their squares."""
    least = min(negative, total - negative)
    if ranks is not None:
        doubled = [round(2 * r) for r in ranks]
        ways = [1] + [0] * sum(doubled)
        for r in doubled:
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: round(2 * least) + 1]) / 2 ** len(ranks))
    return min(1.0, math.erfc(-(least - total / 2) / math.sqrt(squares / 4) / math.sqrt(2)))


def paired_tests(results: DataFrame, keys: list[str], low_n: int = 6) -> DataFrame:
    """One row a key from (keys, apparent, nested): n, mean difference, whether all differences agree, signed
    rank statistic and p, Cliff's delta, Cohen's d. Tests are null where all differences agree."""
    w = Window.partitionBy(*keys)
    results = results.select(*keys, "apparent", "nested").persist()  # read more than once
    diffs = results.withColumn("d", F.col("apparent") - F.col("nested"))
    base = diffs.withColumn("first", F.min("d").over(w)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct("d").alias("n_unique_diff"), F.avg("d").alias("mean_bias"), F.stddev_samp("d").alias("sd"),
        (F.max(F.abs(F.col("d") - F.col("first")) - 1e-12 - 1e-5 * F.abs("first")) <= 0).alias("degenerate"))

    # differences by size: midranks follow from the rows of smaller ones
    size = diffs.where(F.col("d") != 0).groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") < 0).alias("below"))
    ranks = sums_before(size, keys, "size", ["c"]).withColumn("rank", F.col("c_before") + (F.col("c") + 1) / 2.0)
    sums = ranks.groupBy(*keys).agg(F.sum("c").alias("m"), F.sum(F.col("rank") * F.col("below")).alias("negative"), F.sum(F.col("rank") * F.col("c")).alias("all"), F.sum(F.col("rank") * F.col("rank") * F.col("c")).alias("squares"))
    # the ranks themselves are needed for exact tests only, so for EXACT pairs at most
    few = met(ranks, sums.where(F.col("m") <= EXACT).select(*keys), keys) if keys else ranks.crossJoin(F.broadcast(sums.where(F.col("m") <= EXACT).select("m")))  # one row
    lists = few.groupBy(*keys).agg(F.flatten(F.collect_list(F.array_repeat("rank", F.col("c").cast("int")))).alias("ranks"))

    @F.pandas_udf("double")
    def p_value(ranks: pd.Series, negative: pd.Series, total: pd.Series, squares: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(None if r is None else list(r), n, t, q) for r, n, t, q in zip(ranks, negative, total, squares, strict=True)])

    tests = met(sums, lists, keys, "left").select(*keys, F.least(F.col("negative"), F.col("all") - F.col("negative")).alias("wilcoxon_stat"), p_value("ranks", "negative", "all", "squares").alias("p_value"))

    # each apparent value against the nested ones below and above it
    both = results.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("apparent").alias("v")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("nested").alias("v")))).alias("s")).select(*keys, "s.*").where(F.col("v").isNotNull())
    values = sums_before(both.groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), keys, "v", ["b"])
    delta = values.groupBy(*keys).agg(F.sum(F.col("a") * (2.0 * F.col("b_before") + F.col("b"))).alias("won"), F.sum("a").alias("na"), F.sum("b").alias("nb")).select(*keys, (F.col("won") / F.col("na") / F.col("nb") - 1).alias("cliffs_delta"))

    out = met(met(base, tests, keys, "left"), delta, keys, "left")
    defined = ~F.col("degenerate")
    out = out.withColumns({
        "wilcoxon_stat": F.when(defined, F.col("wilcoxon_stat")), "p_value": F.when(defined, F.col("p_value")), "cliffs_delta": F.when(defined, F.col("cliffs_delta")),
        "cohens_d": F.when(defined & (F.col("n") > 1), F.try_divide("mean_bias", "sd")), "low_n_warning": F.col("n") < low_n}).drop("sd")
    return out.withColumn("cliffs_interpretation", effect_label(F.col("cliffs_delta")))


def false_discovery(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds p_value_fdr and significant_fdr (Benjamini and Hochberg) over the non-null p: the least of p x tests / rank
    over this p and larger ones. Equal p share the highest of their ranks. Works on counts of distinct p in parts (see
    operators.ordered), so that no task sees all tests."""
    df = df.persist()  # one row a test, read more than once
    each = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n")).persist()  # read more than once
    total = each.agg(F.sum("__n").alias("__m"))
    ranks = sums_before(each, [], "__p", ["__n"]).crossJoin(F.broadcast(total))  # one row
    rates = least_from(ranks, "__p", F.col("__p") * F.col("__m") / (F.col("__n_before") + F.col("__n")), "__rate").select("__p", F.least(F.lit(1.0), "__rate").alias("p_value_fdr"))
    done = df.join(rates, F.col(p) == F.col("__p"), "left").drop("__p")
    return done.withColumn("significant_fdr", F.coalesce(F.col("p_value_fdr") < alpha, F.lit(False)))


def overall(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_combos"), F.count_if(F.col("mean_bias") > 0).alias("n_positive"), F.count_if("significant_fdr").alias("n_significant"), F.count("p_value").alias("n_tested"), F.count_if("degenerate").alias("n_degenerate"))


def arm_histogram(results: DataFrame, keys: list[str], bins: int = 24) -> DataFrame:
    """(keys, arm, bin, n): common bins over both arms."""
    long = results.select(*keys, F.explode(F.array(F.struct(F.lit("apparent").alias("arm"), F.col("apparent").alias("v")), F.struct(F.lit("nested").alias("arm"), F.col("nested").alias("v")))).alias("s")).select(*keys, "s.*")
    edges = long.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("low")) * bins, F.col("high") - F.col("low")), F.lit(0.0)))).cast("int")
    return long.join(edges, keys).groupBy(*keys, "arm", at.alias("bin")).agg(F.count("*").alias("n"))
