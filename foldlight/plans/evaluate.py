"""How much of a cross-validated score comes from choosing features on rows that the folds reuse.

apparent: features chosen once on all rows, then cross-validated on the same rows; nested: features chosen
inside each training fold. bias = apparent - nested. Both arms are means over folds; pooled forms go by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..operators.models import MODELS, SEARCHES, SHARED, Search, get_selector, mask_fitness, top_k
from ..operators.moments import Moments, centred, r2, test_errors
from ..operators.rowselect import RowSelector, get_row_selector


def choices(m: Moments, selector: str, model: str, k: int, seed: int = 42) -> list[np.ndarray]:
    """Chosen positions: on all rows, then on each fold's train rows."""
    choose, fit = get_selector(selector), {"fit": MODELS[model]} if selector in SEARCHES else {}
    return [choose(m.by_fold, k, seed, **fit), *(choose(m.train_folds(i), k, seed, **fit) for i in range(len(m.folds)))]


def fold_scores(m: Moments, selector: str, model: str, k: int, seed: int = 42, chosen_by: list[np.ndarray] | None = None) -> list[dict[str, object]]:
    """One row for each fold and arm: squared error, total squares, n, mean of the (shifted) target, chosen positions."""
    fit, out = MODELS[model], []
    outer, *inner = choices(m, selector, model, k, seed) if chosen_by is None else chosen_by
    for i, fold in enumerate(m.folds):
        for arm, chosen in (("apparent", outer), ("nested", inner[i])):
            sse, sst, n = test_errors(m.by_fold[i], *fit(m.train(i), chosen))
            mean = float(m.by_fold[i][0, -1] / n)
            out.append({"arm": arm, "fold": int(fold), "sse": sse, "sst": sst, "n": n, "mean_y": mean, "r2": r2(sse, sst), "rmse": float(np.sqrt(max(sse, 0) / n)), "chosen": chosen.tolist()})
    return out


SCORES = "arm string, fold int, sse double, sst double, n double, mean_y double, r2 double, rmse double, chosen array<int>"


KEYS = ["dataset", "selector", "model", "k", "seed"]
MOMENTS_KEYS = "dataset string, selector string, model string, k int, seed int"
#: Masks in a population and generations of searches in a grid.
POPULATION, GENERATIONS = 40, 25


def spread(rows: DataFrame, n: int) -> DataFrame:
    """Few rows with much work each: about as many partitions as rows, up to four a core."""
    return rows.repartition(max(1, min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism)))


def scores_of(m: Moments, model: str, part: int, chosen: np.ndarray) -> list[dict[str, object]]:
    """A choice's rows: of all rows (part -1) the apparent arm of every fold, of a fold's train rows the fold's nested one."""
    out = []
    for i in range(len(m.folds)) if part < 0 else [part]:
        sse, sst, n = test_errors(m.by_fold[i], *MODELS[model](m.train(i), chosen))
        out.append({"arm": "apparent" if part < 0 else "nested", "fold": int(m.folds[i]), "sse": sse, "sst": sst, "n": n, "mean_y": float(m.by_fold[i][0, -1] / n), "r2": r2(sse, sst), "rmse": float(np.sqrt(max(sse, 0) / n)), "chosen": chosen.tolist()})
    return out


def search_together(searches: list[tuple[str, str, int, int, int]], moments: dict[str, Moments], spark: SparkSession, population: int = POPULATION, generations: int = GENERATIONS) -> dict[tuple[str, str, int, int, int], Search]:
    """Searches (dataset, model, k, seed, part) that go through their generations together.

    In each, the masks of all searches that nobody has scored yet are one table, scored in tasks against the moments
    that were sent once; searches of the same dataset, model and part share scores. The driver holds populations
    (searches x population x features bits) and scores and breeds; it fits nothing.
    """
    sent = spark.sparkContext.broadcast(moments)  # folds x (features + 2)^2 values a dataset
    running = {s: Search(moments[s[0]].p, s[2], s[3], population) for s in searches}
    shared: dict[tuple[str, str, int], dict[bytes, float]] = {}
    for s, search in running.items():
        search.known = shared.setdefault((s[0], s[1], s[4]), search.known)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            out = []
            for row in part.itertuples():
                key = (row.dataset, row.part)
                if key not in folds:
                    m = sent.value[row.dataset]
                    inner = m.by_fold if row.part < 0 else m.train_folds(row.part)
                    folds[key] = inner, inner.sum(axis=0) - inner
                out.append(mask_fitness(*folds[key], row.mask, MODELS[row.model]))
            yield part.assign(fitness=out)

    schema = "dataset string, model string, part int, mask binary"
    for generation in range(generations + 1):
        wanted = {(s[0], s[1], s[4], mask): None for s, search in running.items() for mask in search.unknown()}
        if wanted:
            table = spread(spark.createDataFrame(pd.DataFrame(list(wanted), columns=["dataset", "model", "part", "mask"]), schema), len(wanted))
            for r in table.mapInPandas(run, f"{schema}, fitness double").toPandas().itertuples():
                shared[r.dataset, r.model, r.part][bytes(r.mask)] = r.fitness
        if generation < generations:
            for search in running.values():
                search.breed()
    return running


def evaluate_grid(combos: DataFrame, moments: dict[str, Moments], population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """fold_scores() for every row (dataset, selector, model, k, seed) of combos.

    A row of work is a selector on one part of a dataset (all rows, or a fold's train rows), for all k and models that
    need it, so that a path that serves every k is made once and no task holds more than one part's; searches go
    through search_together() first. Moments are sent whole: their size is folds x (features + 2)^2 for each dataset,
    whatever the rows were.
    """
    spark = combos.sparkSession
    sent = spark.sparkContext.broadcast(moments)
    listed = [tuple(r) for r in combos.select(*KEYS).distinct().collect()]  # the caller's combinations
    parts = {d: range(-1, len(m.folds)) for d, m in moments.items()}
    found = [(d, s, f, k, x, part) for d, s, f, k, x in listed if s in SEARCHES for part in parts[d]]
    searches = search_together([(d, f, k, x, part) for d, _, f, k, x, part in found], moments, spark, population, generations) if found else {}
    work: dict[tuple, list] = {}
    for d, s, f, k, x in listed:
        for part in parts[d]:
            if s in SEARCHES:
                work[d, s, x, part, f, k] = [(k, f, searches[d, f, k, x, part].best().tolist())]
            else:
                # selectors without a shared part are chosen by k
                work.setdefault((d, s, x, part, None, None if s in SHARED else k), []).append((k, f, None))
    rows = [(*key[:4], uses) for key, uses in sorted(work.items(), key=str)]
    table = spread(spark.createDataFrame(rows, "dataset string, selector string, seed int, part int, uses array<struct<k:int,model:string,chosen:array<int>>>"), len(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                m = sent.value[row.dataset]
                inner = m.by_fold if row.part < 0 else m.train_folds(row.part)
                prepare, choose = SHARED.get(row.selector, (None, None))
                ready = prepare(inner) if prepare else None
                chosen: dict[int, np.ndarray] = {}
                out = []
                for use in row.uses:
                    if use["chosen"] is not None:
                        chosen[use["k"]] = np.array(use["chosen"], int)
                    elif use["k"] not in chosen:
                        chosen[use["k"]] = choose(ready, use["k"]) if prepare else get_selector(row.selector)(inner, use["k"], row.seed)
                    for score in scores_of(m, use["model"], row.part, chosen[use["k"]]):
                        out.append({"dataset": row.dataset, "selector": row.selector, "model": use["model"], "k": use["k"], "seed": row.seed, **score})
                yield pd.DataFrame(out)[[*KEYS, "arm", "fold", "sse", "sst", "n", "mean_y", "r2", "rmse", "chosen"]]

    return table.mapInPandas(run, f"{MOMENTS_KEYS}, {SCORES}")


def choices_by_rows(df: DataFrame, key: str | None, features: str, target: str, fold: str, k: int, selector: str | RowSelector) -> list[np.ndarray]:
    """The k features of the largest score by a row selector (a name or a function): on all rows, then on each fold's
    train rows. All train sets are scored together; what comes back is one number a set and feature. Scores are compared
    to nine digits, the lower position first on ties; a feature without a score has 0."""
    score = get_row_selector(selector) if isinstance(selector, str) else selector
    folds = [r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]  # one row a fold
    # the set of all rows and each fold's train rows, by number
    member = F.array_compact(F.array(F.lit(0), *(F.when(F.col(fold) != f, F.lit(i)) for i, f in enumerate(folds, 1))))
    found: dict[int, dict[int, float]] = {}
    for r in score(df.withColumn("_set", F.explode(member)), features, target, key, "_set").collect():
        found.setdefault(r["_set"], {})[r["pos"]] = round(r["score"] or 0.0, 9)
    return [top_k(np.array([found[i][j] for j in range(len(found[i]))]), k) for i in sorted(found)]


def informative_choices(df: DataFrame, features: str, target: str, fold: str, k: int) -> list[np.ndarray]:
    """choices_by_rows() by mutual information over quantile bins."""
    return choices_by_rows(df, None, features, target, fold, k, "mutual_info_binned")


def nearest_choices(df: DataFrame, key: str, features: str, target: str, fold: str, k: int) -> list[np.ndarray]:
    """choices_by_rows() by mutual information from distances to nearest neighbours."""
    return choices_by_rows(df, key, features, target, fold, k, "mutual_info")


def score_choices(spark: SparkSession, dataset: str, m: Moments, selector: str, chosen_by: list[np.ndarray], models: list[str], seed: int = 42) -> DataFrame:
    """fold_scores() of each model for choices made elsewhere, in the form of evaluate_grid()."""
    rows = [{"dataset": dataset, "selector": selector, "model": f, "k": len(chosen_by[0]), "seed": seed, **s} for f in models for s in fold_scores(m, selector, f, len(chosen_by[0]), seed, chosen_by)]
    return spark.createDataFrame(rows, f"dataset string, selector string, model string, k int, seed int, {SCORES}")


def grid_choices(combos: DataFrame, moments: dict[str, Moments], population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """(dataset, selector, model, k, seed, arm, fold, chosen) for every row of combos: the features on which models
    that need rows are then fitted. Searches score their masks by ridge."""
    keys = ["dataset", "selector", "k", "seed"]
    linear = evaluate_grid(combos.withColumn("model", F.lit("ridge")).distinct(), moments, population, generations)
    return combos.select(*KEYS).join(linear.select(*keys, "arm", "fold", "chosen"), keys).select(*KEYS, "arm", "fold", "chosen")


def tree_grid(df: DataFrame, key: str, features: str, target: str, fold: str, choices_: DataFrame, small: int = trees.SMALL) -> DataFrame:
    """The rows of evaluate_grid() for tree models: each model of the choices (trees.TREES by name) is fitted on the
    chosen features of each fold's train rows, all folds, arms and combinations at once, and scored on the fold."""
    spark, out = df.sparkSession, None
    rows = [r.asDict() for r in choices_.collect()]  # combinations x folds x arms, each with its k positions
    for name in sorted({r["model"] for r in rows}):
        mine = [r for r in rows if r["model"] == name]
        # arms that chose the same are one fit
        same = {x: i for i, x in enumerate(dict.fromkeys((r["fold"], tuple(r["chosen"]), r["seed"]) for r in mine))}
        sums = trees.tree_sums(df, key, features, target, fold, [trees.Fit(i, f, c, s) for (f, c, s), i in same.items()], trees.TREES[name], small)
        named = spark.createDataFrame([(*(r[k] for k in KEYS), r["arm"], r["fold"], same[r["fold"], tuple(r["chosen"]), r["seed"]], r["chosen"]) for r in mine], f"{MOMENTS_KEYS}, arm string, fold int, fit int, chosen array<int>")
        part = named.join(sums, "fit")
        out = part if out is None else out.union(part)
    sst = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    score = F.when(sst > 1e-12, 1 - F.col("sse") / sst).otherwise((F.col("sse") <= 1e-12).cast("double"))
    return out.select(*KEYS, "arm", "fold", "sse", sst.alias("sst"), "n", (F.col("s") / F.col("n")).alias("mean_y"), score.alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "chosen")


def pooled(of: Callable[[str], Column]) -> Column:
    """One R2 over all rows from per-fold sums: total squares are those inside folds and those between their means."""
    between = F.sum(of("n") * of("mean_y") * of("mean_y")) - F.sum(of("n") * of("mean_y")) * F.sum(of("n") * of("mean_y")) / F.sum(of("n"))
    return 1 - F.try_divide(F.sum(of("sse")), F.sum(of("sst")) + between)


def bias_table(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fold-mean and pooled scores of both arms and their differences, one row for each key. `_r2_pooled` is one
    R2 over all out-of-fold rows; `_r2_within` takes each fold's own mean."""
    keys = keys or KEYS

    def of(arm: str, value: Column) -> Column:
        return F.when(F.col("arm") == arm, value)

    arms = scores.groupBy(*keys).agg(
        *(f(of(a, F.col(c))).alias(f"{a}_{c}{s}") for a in ("apparent", "nested") for c in ("r2", "rmse") for f, s in ((F.avg, ""), (F.stddev_pop, "_std"))),
        *((1 - F.sum(of(a, F.col("sse"))) / F.sum(of(a, F.col("sst")))).alias(f"{a}_r2_within") for a in ("apparent", "nested")),
        *(pooled(lambda c, a=a: of(a, F.col(c))).alias(f"{a}_r2_pooled") for a in ("apparent", "nested")),
    )
    return arms.withColumns({
        "bias": F.col("apparent_r2") - F.col("nested_r2"), "bias_rmse": F.col("nested_rmse") - F.col("apparent_rmse"),
        "bias_pooled": F.col("apparent_r2_pooled") - F.col("nested_r2_pooled")})


def summary_table(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """bias_table() with the nested fold scores as one text, in fold order, at four decimals."""
    keys = keys or KEYS
    nested = F.sort_array(F.collect_list(F.when(F.col("arm") == "nested", F.struct("fold", "r2"))))
    texts = scores.groupBy(*keys).agg(F.array_join(F.transform(nested, lambda s: F.format_string("%.4f", s["r2"])), ";").alias("fold_scores"))  # one entry a fold
    return bias_table(scores, keys).join(texts, keys)


def score_predictions(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """R2, RMSE and MAE of long predictions by keys; null where a group's truth has no spread."""
    error = F.col(y_true) - F.col(y_pred)
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(error * error).alias("sse"), F.sum(F.abs(error)).alias("sae"), (F.var_pop(y_true) * F.count("*")).alias("sst"))
    return sums.select(*keys, "n", (1 - F.try_divide("sse", "sst")).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"))


def fold_mean_scores(by_fold: DataFrame, keys: list[str]) -> DataFrame:
    return by_fold.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("r2", "rmse", "mae") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))), F.count("*").alias("folds"))


def three_pipelines(random: DataFrame, grouped: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P1: apparent on random folds, P2: apparent on group folds, P3: nested on group folds (from fold scores of
    both splits). group_leak = P1 - P2, sel_leak = P2 - P3. With fewer groups than folds some folds have no group, so
    their scores are missing among the grouped ones: P2 and both differences are null then."""
    keys = keys or KEYS
    p1 = random.where(F.col("arm") == "apparent").groupBy(*keys).agg(F.avg("r2").alias("p1"), F.count_distinct("fold").alias("_folds"))
    rest = grouped.groupBy(*keys).agg(F.avg(F.when(F.col("arm") == "apparent", F.col("r2"))).alias("p2"), F.avg(F.when(F.col("arm") == "nested", F.col("r2"))).alias("p3"), F.count_distinct("fold").alias("_grouped"))
    both = p1.join(rest, keys, "left").withColumn("p2", F.when(F.col("_grouped") >= F.col("_folds"), F.col("p2"))).drop("_folds", "_grouped")
    return both.withColumns({"group_leak": F.col("p1") - F.col("p2"), "sel_leak": F.col("p2") - F.col("p3")})


def mask_overlap(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean share of the apparent choice found again, Jaccard similarity and sizes, over folds."""
    keys = keys or KEYS
    both = scores.where(F.col("arm") == "apparent").select(*keys, "fold", F.col("chosen").alias("a")).join(scores.where(F.col("arm") == "nested").select(*keys, "fold", F.col("chosen").alias("b")), [*keys, "fold"])
    common = F.size(F.array_intersect("a", "b"))
    return both.groupBy(*keys).agg(
        F.avg(common / F.size("a")).alias("mean_overlap_frac"), F.avg(common / F.size(F.array_union("a", "b"))).alias("mean_jaccard"),
        F.avg(F.size("a")).alias("mean_apparent_k"), F.avg(F.size("b")).alias("mean_nested_k"))


def pipelines_over_seeds(pipelines: DataFrame, keys: list[str]) -> DataFrame:
    """three_pipelines() rows over seeds: n, mean and sample deviation (0 for one seed) of each pipeline and leak."""
    values = ["p1", "p2", "p3", "group_leak", "sel_leak"]
    return pipelines.groupBy(*keys).agg(F.count("*").alias("n"), *(f.alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg(c)), ("std", F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, F.lit(0.0))))))


def fold_models(spark: SparkSession, m: Moments, selector: str, model: str, k: int, seed: int = 42, arm: str = "nested") -> DataFrame:
    """(fold, intercept, coef) for predict(): the model of each fold, on the features' own scale."""
    outer, *inner = choices(m, selector, model, k, seed)
    rows = []
    for i, fold in enumerate(m.folds):
        b0, coef = MODELS[model](m.train(i), inner[i] if arm == "nested" else outer)
        rows.append((int(fold), float(b0 + m.shift[m.p] - coef @ m.shift[: m.p]), coef.tolist()))
    return spark.createDataFrame(rows, "fold int, intercept double, coef array<double>")


def model_comparison(spark: SparkSession, m: Moments, chosen: np.ndarray, models: list[str] | None = None) -> DataFrame:
    """Every model on all features and on the chosen ones, cross-validated: R2, RMSE, RPD (deviation over RMSE), differences."""
    _, _, syy, _, _, n = centred(m.total)
    rows = []
    for name in models or list(MODELS):
        row: list[object] = [name]
        for positions in (np.arange(m.p), chosen):
            sse = sum(test_errors(m.by_fold[i], *MODELS[name](m.train(i), positions))[0] for i in range(len(m.folds)))
            rmse = float(np.sqrt(max(sse, 0) / n))
            row += [len(positions), r2(sse, syy), rmse, float(np.sqrt(syy / n)) / rmse if rmse > 0 else 0.0]
        rows.append(tuple(row))
    fields = ", ".join(f"n_features_{s} int, r2_{s} double, rmse_{s} double, rpd_{s} double" for s in ("full", "selected"))
    out = spark.createDataFrame(rows, f"model string, {fields}")
    return out.withColumns({f"delta_{c}": F.col(f"{c}_selected") - F.col(f"{c}_full") for c in ("r2", "rmse", "rpd")})


def check_rebuilt(rebuilt: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """(keys, rebuilt, stored): rows whose stored value isn't met within the tolerance, or is missing on one side."""
    both = rebuilt.select(*keys, F.col(value).alias("rebuilt")).join(stored.select(*keys, F.col(value).alias("stored")), keys, "full")
    return both.where(~F.coalesce(F.abs(F.col("rebuilt") - F.col("stored")) <= tolerance, F.col("rebuilt").isNull() & F.col("stored").isNull()))


def compare_aggregations(pooled_rows: DataFrame, fold_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means over seeds of pooled and fold-mean (apparent, nested) rows side by side, their differences, and
    whether the sign of the bias differs. Keys without fold-mean rows stay, with nulls."""
    bias = F.col("apparent") - F.col("nested")
    left = pooled_rows.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *(f(c).alias(f"{n}_pooled_{s}") for n, c in (("apparent", "apparent"), ("nested", "nested"), ("bias", bias)) for s, f in (("mean", F.avg), ("std", F.stddev_samp))))
    right = fold_rows.groupBy(*keys).agg(F.avg("apparent").alias("apparent_foldmean_mean"), F.avg("nested").alias("nested_foldmean_mean"), F.avg(bias).alias("bias_foldmean_mean"))
    return left.join(right, keys, "left").withColumns({
        "bias_delta": F.col("bias_pooled_mean") - F.col("bias_foldmean_mean"), "apparent_delta": F.col("apparent_pooled_mean") - F.col("apparent_foldmean_mean"),
        "sign_flips": F.signum("bias_pooled_mean") != F.signum("bias_foldmean_mean")})


def comparison_row(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The overall row of compare_aggregations(): counts, exact median, names of the flips in order."""
    flips = F.sort_array(F.collect_list(F.when(F.col("sign_flips"), F.concat_ws("/", *keys))))  # one entry a combination that flips
    return summary.agg(
        F.count("*").alias("n_combos"), F.count_if(F.col("bias_pooled_mean") > 0).alias("n_positive_pooled"), F.count_if(F.col("bias_foldmean_mean") > 0).alias("n_positive_foldmean"),
        F.count_if(F.col("apparent_delta") > 0).alias("n_apparent_pooled_exceeds"), F.median("apparent_delta").alias("median_apparent_delta"),
        F.count_if("sign_flips").alias("n_sign_flips"), F.array_join(flips, "; ").alias("sign_flip_combos"))


def sign_agreement(summary: DataFrame, first: str, second: str) -> DataFrame:
    """Adds `agrees` (both differences have one sign) and `gap`; sort by abs(gap) for the largest."""
    return summary.withColumns({"agrees": F.signum(first) == F.signum(second), "gap": F.col(first) - F.col(second)})


def experiment_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Over repeats: n, mean, population deviation, least and largest of both arms, mean bias."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("repeats"),
        *(f(a).alias(f"{a}_{n}") for a in ("apparent", "nested") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))),
        F.avg(F.col("apparent") - F.col("nested")).alias("bias_mean"))


def headline_kinds(summary: DataFrame, headline: Column, bias: str = "bias_mean") -> DataFrame:
    """Adds `kind`: headline, exception (the bias is negative) or normal."""
    return summary.withColumn("kind", F.when(headline, "headline").when(F.col(bias) < 0, "exception").otherwise("normal"))


def predict(df: DataFrame, features: str, coefficients: DataFrame, fold: str = "fold") -> DataFrame:
    """Adds `y_pred`: each row by the model not trained on its fold, from (fold, intercept, coef array)."""
    dot = F.aggregate(F.zip_with(features, "coef", lambda x, c: x * c), F.col("intercept"), lambda a, x: a + x)
    return df.join(coefficients, fold).withColumn("y_pred", dot).drop("intercept", "coef")


def seed_summary(results: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """Over seeds: count, mean, sample deviation, least and largest of both arms, mean and deviation of the bias."""
    bias = F.col("apparent") - F.col("nested")
    return results.groupBy(*keys).agg(
        F.count_distinct(seed).alias("n_seeds"),
        *(f(a).alias(f"{a}_{n}") for a in ("apparent", "nested") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))),
        F.avg(bias).alias("bias_mean"), F.stddev_samp(bias).alias("bias_std"))
