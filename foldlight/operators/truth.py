"""Ground truth joined to samples by name; group keys; task grids; outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


#: Characters of the pieces by which names that contain each other are found.
GRAM = 3


def pieces(text: str, size: int) -> Column:
    """All substrings of one size."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def holding(inner: DataFrame, outer: DataFrame, row: str) -> DataFrame:
    """Pairs (_in, _out, row) where a text of outer (_out, row) contains one of inner (_in).

    A text is looked up by its rarest piece of GRAM characters, which all texts that contain it hold (shorter
    texts by themselves), so only such candidates are compared.
    """
    held = F.array_distinct(F.flatten(F.array_compact(F.array(*(pieces("_out", n) for n in range(1, GRAM + 1))))))
    listed = outer.select("_out", row, F.explode(held).alias("_piece"))
    counts = listed.groupBy("_piece").agg(F.count("*").alias("_n"))
    own = inner.select("_in", F.explode(F.array_distinct(F.coalesce(pieces("_in", GRAM), F.array("_in")))).alias("_piece"))
    rarest = own.join(counts, "_piece").groupBy("_in").agg(F.min(F.struct("_n", "_piece")).alias("_p"))
    return listed.join(rarest.select("_in", F.col("_p._piece").alias("_piece")), "_piece").where(F.contains("_out", "_in")).select("_in", "_out", row)


def match_by_name(samples: DataFrame, truth: DataFrame, name: str, truth_name: str, order: str, last: bool = False, both_ways: bool = False) -> DataFrame:
    """Each sample with the truth row of its name (trimmed, lower case; the first by `order`, or the last); left
    over samples by a truth name that contains theirs (or, both_ways, either way). Adds `matched` (exact,
    contains or null). Only samples without an exact match look for texts that contain each other."""
    pick = F.max_by if last else F.min_by
    keyed = truth.withColumn("_t", F.lower(F.trim(truth_name))).where(F.col("_t").isNotNull() & (F.col("_t") != ""))
    fields = [c for c in truth.columns]
    unique = keyed.groupBy("_t").agg(pick(F.struct(*fields), F.col(order)).alias("_row"), (F.max if last else F.min)(order).alias("_order"))
    rows = samples.withColumn("_n", F.lower(F.trim(name)))
    exact = rows.join(unique, rows["_n"] == unique["_t"], "left")
    done = exact.where(F.col("_row").isNotNull()).select(*samples.columns, "_row", F.lit("exact").alias("matched"))
    open_ = exact.where(F.col("_row").isNull()).select(*samples.columns, "_n")
    names = open_.select("_n").where(F.col("_n").isNotNull() & (F.col("_n") != "")).distinct()
    texts = unique.select(F.col("_t").alias("_out"), F.struct("_row", "_order").alias("_of"))
    pairs = holding(names.select(F.col("_n").alias("_in")), texts, "_of").select(F.col("_in").alias("_n"), "_of")
    if both_ways:
        around = holding(unique.select(F.col("_t").alias("_in")), names.select(F.col("_n").alias("_out"), F.col("_n").alias("_name")), "_name")
        pairs = pairs.unionByName(around.join(texts.withColumnRenamed("_out", "_text"), F.col("_in") == F.col("_text")).select(F.col("_name").alias("_n"), "_of"))
    near = pairs.groupBy("_n").agg(pick("_of._row", F.col("_of._order")).alias("_row"))
    rest = open_.join(near, "_n", "left").select(*samples.columns, "_row", F.when(F.col("_row").isNotNull(), "contains").alias("matched"))
    return done.unionByName(rest).select(*samples.columns, *(F.col(f"_row.{c}").alias(c) for c in fields if c not in samples.columns), "matched")


def class_of(samples: DataFrame, truth: DataFrame, name: str, truth_name: str, label: str, order: str, value: str | None = None) -> DataFrame:
    """Adds `class`: the last truth row of the sample's name, exact, or containing either way, gives the class of
    its text `label`; without such a row or text, the class of its measured flavonols `value`; then 3."""
    from ..functions.labels import flavonol_class, normalise, symptom_class

    keep = [c for c in samples.columns]
    found = match_by_name(samples, truth.select(truth_name, order, label, *([value] if value else [])), name, truth_name, order, last=True, both_ways=True)
    text = F.when(F.trim(F.col(label)) != "", symptom_class(normalise(F.col(label))))
    measured = flavonol_class(F.col(value).cast("double")) if value else F.lit(3)
    return found.select(*keep, F.coalesce(text, measured).alias("class"), "matched")


def group_key(*parts: Column) -> Column:
    """Parts joined by a bar; a blank result is `unknown`."""
    joined = F.concat_ws("|", *(F.trim(p.cast("string")) for p in parts))
    return F.when(F.regexp_replace(joined, r"[|\s]", "") == "", "unknown").otherwise(joined)


def value_counts(df: DataFrame, column: str, known: list[object] | None = None) -> DataFrame:
    """(value, n): counts, with 0 for known values that don't occur."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if known is None:
        return counts
    return df.sparkSession.createDataFrame([(v,) for v in known], f"value {dict(df.dtypes)[column]}").join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def task_grid(targets: DataFrame, selectors: list[str], models: list[str], seeds: list[int], done: DataFrame | None = None, least: int = 20) -> DataFrame:
    """(dataset, target, selector, model, seed) for targets (dataset, target, n_finite) with enough values, without
    what is done already."""
    spark = targets.sparkSession
    axes = spark.createDataFrame([(s, m, x) for s in selectors for m in models for x in seeds], "selector string, model string, seed int")
    grid = targets.where(F.col("n_finite") >= least).select("dataset", "target").crossJoin(F.broadcast(axes))  # the caller's lists
    return grid if done is None else grid.join(done, ["dataset", "target", "selector", "model", "seed"], "left_anti")


def default_tasks(targets: DataFrame, selectors: list[str], seeds: list[int], combos: list[tuple[str, str, str]] | None = None, excluded: list[str] | None = None, model: str = "pls", done: DataFrame | None = None, least: int = 20) -> DataFrame:
    """(dataset, target, selector, model, seed) for targets (dataset, target, position, n_finite).

    combos lists (dataset, target, model); a dataset that it doesn't name takes its first target by position with
    `model`. Datasets in `excluded` (say, those with yes-or-no targets) are left out unless combos names them. Targets
    that don't exist or have too few values are left out, and what is done already.
    """
    spark = targets.sparkSession
    named = spark.createDataFrame(combos or [], "dataset string, target string, model string")
    listed = targets.join(F.broadcast(named), ["dataset", "target"]).select("dataset", "target", "model", "n_finite")  # the caller's list
    rest = targets.join(F.broadcast(named.select("dataset").distinct()), "dataset", "left_anti").where(~F.col("dataset").isin(excluded or []))
    first = rest.groupBy("dataset").agg(F.min_by(F.struct("target", "n_finite"), "position").alias("t")).select("dataset", "t.target", F.lit(model).alias("model"), "t.n_finite")
    axes = spark.createDataFrame([(s, x) for s in selectors for x in seeds], "selector string, seed int")
    grid = listed.union(first).where(F.col("n_finite") >= least).crossJoin(F.broadcast(axes)).select("dataset", "target", "selector", "model", "seed")  # the caller's lists
    return grid if done is None else grid.join(done, ["dataset", "target", "selector", "model", "seed"], "left_anti")


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """One row with low and high bounds of each column, of its non-null and non-NaN values."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("s.*")
    quartiles = exact_quantiles(long, ["name"], "v", [0.25, 0.75], weights=True)
    aggs = []
    for c in columns:
        q1, q3 = (F.max(F.when(F.col("name") == c, F.get("quantiles", F.lit(i)))) for i in (0, 1))
        aggs += [(q1 - factor * (q3 - q1)).alias(f"{c}_low"), (q3 + factor * (q3 - q1)).alias(f"{c}_high")]
    return quartiles.agg(*aggs)


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Adds `outlier_<column>` booleans and `reasons` (iqr_<column>, joined by commas); values without a number are none."""
    out = df.crossJoin(F.broadcast(iqr_bounds(df, columns, factor)))  # one row
    flags = {f"outlier_{c}": F.coalesce((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")), F.lit(False)) for c in columns}
    out = out.withColumns(flags).drop(*(f"{c}_{s}" for c in columns for s in ("low", "high")))
    return out.withColumn("reasons", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"outlier_{c}"), f"iqr_{c}") for c in columns))), ","))


def isolation_scores(df: DataFrame, features: str, key: str, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds `isolation`: 2 ** (-mean path / expected path) over trees of small seeded samples. Trees (trees x
    sample rows at most) are built from a bounded sample by hash and sent to the tasks; every row is scored."""
    rows = df.where(F.col(features).isNotNull()).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).limit(sample * 16).select(features).collect()
    x = np.nan_to_num(np.array([r[0] for r in rows], float), nan=0.0, posinf=0.0, neginf=0.0)
    rng, depth, forest = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, sample)))), []

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(part: np.ndarray, level: int) -> tuple:
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(x.shape[1])
        if level >= depth or len(part) < 2 or not spread.any():
            return (level + expected(len(part)),)
        f = rng.choice(np.flatnonzero(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        return (f, cut, grow(part[part[:, f] < cut], level + 1), grow(part[part[:, f] >= cut], level + 1))

    size = min(sample, len(x))
    if size >= 10:
        forest = [grow(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(trees)]
    norm = expected(size) or 1.0

    def walk(tree: tuple, part: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if len(tree) == 1:
            out[at] += tree[0]
        elif len(at):
            left = part[at, tree[0]] < tree[1]
            walk(tree[2], part, at[left], out)
            walk(tree[3], part, at[~left], out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            block = np.nan_to_num(np.stack(part[features].to_numpy()).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
            paths = np.zeros(len(block))
            for tree in forest:
                walk(tree, block, np.arange(len(block)), paths)
            yield part.assign(isolation=2 ** (-paths / max(1, len(forest)) / norm) if forest else 0.0)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", isolation double"
    return df.where(F.col(features).isNotNull()).mapInPandas(run, schema)


def isolation_outliers(df: DataFrame, features: str, key: str, contamination: float = 0.05, **options: int) -> DataFrame:
    """Adds `outlier_isolation`: the score is above the quantile that leaves `contamination`."""
    scored = isolation_scores(df, features, key, **options)
    cut = exact_quantiles(scored, [], "isolation", [1 - contamination]).select(F.get("quantiles", F.lit(0)).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("outlier_isolation", F.col("isolation") > F.col("_cut")).drop("_cut")  # one row


def outlier_report(df: DataFrame, columns: list[str], features: str | None = None, key: str | None = None, contamination: float = 0.05, factor: float = 1.5, **options: int) -> DataFrame:
    """iqr_outliers() and, if features are given, isolation_outliers(): adds `outlier`, true if any of them says
    so, and all reasons, `isolation` last. Rows without features can only be outliers by their columns."""
    out = iqr_outliers(df, columns, factor)
    by_column = F.greatest(*(F.col(f"outlier_{c}") for c in columns), F.lit(False))
    if features is None:
        return out.withColumn("outlier", by_column)
    scored = isolation_outliers(out, features, key, contamination, **options).unionByName(out.where(F.col(features).isNull()), allowMissingColumns=True)
    far = F.coalesce("outlier_isolation", F.lit(False))
    reasons = F.concat_ws(",", F.when(F.col("reasons") != "", F.col("reasons")), F.when(far, F.lit("isolation")))
    return scored.withColumns({"outlier_isolation": far, "reasons": reasons, "outlier": by_column | far})


def act_on_outliers(df: DataFrame, flags: list[str], action: str = "warn") -> DataFrame:
    """`none` and `warn` pass all rows (warn keeps the flags), `drop` leaves those without a flag."""
    if action not in ("none", "warn", "drop"):
        raise ValueError(f"unknown action {action}")
    if action == "warn":
        return df
    hit = F.greatest(*(F.col(f).cast("int") for f in flags), F.lit(0)) == 1
    return (df.where(~hit) if action == "drop" else df).drop(*flags)


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= n).drop("_at")
