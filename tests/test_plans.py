"""Evaluation summaries, feature rows and band reports against plain numpy on small data."""

import numpy as np
import pytest
from foldlight.functions import indices, spectra
from foldlight.operators import models, moments, splits
from foldlight.plans import bands, evaluate, features, resample
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 10)) + 50
    y = x[:, 1] - 0.7 * x[:, 4] + 0.3 * rng.standard_normal(90)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 5) for i in range(90)], "id long, x array<double>, y double, fold int")
    return x, y, df, moments.fold_moments(df, "x", ["y"], "fold")


def test_pooled_scores_and_predictions_agree(data, spark):
    x, y, df, m = data
    table = evaluate.evaluate_grid(spark.createDataFrame([("d", "correlation", "ridge", 3, 1)], "dataset string, selector string, model string, k int, seed int"), {"d": m})
    row = evaluate.summary_table(table).first()
    for arm in ("nested", "apparent"):
        out = evaluate.predict(df, "x", evaluate.fold_models(spark, m, "correlation", "ridge", 3, arm=arm)).toPandas()
        error = ((out["y"] - out["y_pred"]) ** 2).sum()
        assert row[f"{arm}_r2_pooled"] == pytest.approx(1 - error / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    assert len(row["fold_scores"].split(";")) == 5 and row["bias"] == pytest.approx(row["apparent_r2"] - row["nested_r2"])


def test_lasso_validates_on_inner_folds(data):
    x, y, _, m = data
    chosen = models.select_lasso(m.by_fold, 10)
    assert {1, 4} <= set(chosen.tolist())
    sd, grid = x.std(0), None
    z = (x - x.mean(0)) / sd
    grid = np.abs(z.T @ (y - y.mean()) / 90).max() * np.logspace(0, -3, 30)
    loss = np.zeros(30)
    for k in range(5):
        test = np.arange(90) % 5 == k
        a, b = z[~test] - z[~test].mean(0), y[~test] - y[~test].mean()
        for i, w in enumerate(models.lasso_path(a.T @ a / len(a), a.T @ b / len(a), grid)):
            pred = y[~test].mean() + (z[test] - z[~test].mean(0)) @ w
            loss[i] += ((y[test] - pred) ** 2).mean()
    best = models.lasso_path(z.T @ z / 90, z.T @ (y - y.mean()) / 90, grid)[loss.argmin()]
    assert chosen.tolist() == np.flatnonzero(best).tolist()


def test_search_and_comparison(data, spark):
    _, _, df, m = data
    chosen, log = models.searched_subsets(m.by_fold, 5, 1, 12, 5, fit=models.pls)
    assert {1, 4} <= set(chosen.tolist()) and [g for g, *_ in log] == list(range(5)) and log[-1][1] >= log[0][1]
    assert models.selector_family("search") == "search" and models.selector_family("lasso") == "embedded"
    rows = evaluate.model_comparison(spark, m, np.array([1, 4])).collect()
    assert {r["model"] for r in rows} == set(models.MODELS) and all(r["delta_r2"] == pytest.approx(r["r2_selected"] - r["r2_full"]) for r in rows)
    assert all(r["rpd_full"] > 1 for r in rows if r["model"] == "ols")
    done = spark.createDataFrame([("rfe", "ridge", 3)], "selector string, model string, k int")
    grid = resample.permutation_grid(df, "id", "x", "y", "fold", [("correlation", "ridge", 3), ("rfe", "ridge", 3)], 6, done=done).collect()
    assert [(r["selector"], r["n_perm"]) for r in grid] == [("correlation", 6)] and grid[0]["perm_p_value"] == pytest.approx(1 / 7)


def test_seed_tables(spark):
    rows = spark.createDataFrame([("a", s, 0.5, 0.4, 0.3) for s in range(3)] + [("b", 0, 0.5, None, 0.1)], "k string, seed int, p1 double, p2 double, p3 double")
    out = {r["k"]: r for r in evaluate.pipelines_over_seeds(rows.withColumns({"group_leak": F.col("p1") - F.col("p2"), "sel_leak": F.col("p2") - F.col("p3")}), ["k"]).collect()}
    assert out["a"]["sel_leak_mean"] == pytest.approx(0.1) and out["b"]["p1_std"] == 0 and out["b"]["p2_mean"] is None and out["b"]["p2_std"] is None
    pooled = spark.createDataFrame([("a", 0.6, 0.5), ("b", 0.3, 0.2), ("c", 0.1, 0.0)], "k string, apparent double, nested double")
    fold = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.1, 0.2)], "k string, apparent double, nested double")
    both = evaluate.compare_aggregations(pooled, fold, ["k"])
    row = evaluate.comparison_row(both, ["k"]).first()
    assert (row["n_combos"], row["n_sign_flips"], row["sign_flip_combos"]) == (3, 1, "b") and row["median_apparent_delta"] == pytest.approx(0.15)
    differing = evaluate.check_rebuilt(pooled, pooled.withColumn("apparent", F.col("apparent") + F.when(F.col("k") == "b", 1e-3).otherwise(1e-9)), ["k"], "apparent")
    assert [r["k"] for r in differing.collect()] == ["b"]


def test_feature_rows(spark):
    rng = np.random.default_rng(5)
    waves = [400 + 20.0 * i for i in range(31)]
    cube = rng.random((2, 12, 31))
    rows = [(f"i{i}", cube[i, j].tolist(), j < 8) for i in range(2) for j in range(12)]
    rows += [("empty", [0.5] * 31, False), ("short", [0.5] * 5, True)]
    px = spark.createDataFrame(rows, "image string, s array<double>, m boolean")
    out, failed = features.build_dataset(px, "image", "s", "m", waves)
    assert {(r["image"], r["failure"]) for r in failed.collect()} == {("empty", "empty mask"), ("short", "other width")}
    names = features.names(waves)
    got = {r["image"]: dict(zip(names, r["features"], strict=True)) for r in out.collect()}
    assert set(got) == {"i0", "i1"} and len(names) == 112 + 2 * 31
    inside, f = cube[0, :8], got["i0"]
    r800, r670 = inside[:, spectra.find_band(waves, 800)], inside[:, spectra.find_band(waves, 670)]
    ndvi = (r800 - r670) / (r800 + r670)
    assert [f[f"NDVI_{s}"] for s in features.STATS] == pytest.approx([ndvi.mean(), ndvi.std(), np.quantile(ndvi, 0.25), np.quantile(ndvi, 0.75)])
    mean = inside.mean(0)
    snv = (mean - mean.mean()) / mean.std()
    slope = spectra.savgol_matrix(31, derivative=1) @ snv
    assert [f[f"snv_R{round(w)}"] for w in waves] == pytest.approx(snv.tolist()) and [f[f"d1snv_R{round(w)}"] for w in waves] == pytest.approx(slope.tolist())
    top = int(np.abs(slope).argmax())
    assert (f["d1_all_peak_wl"], f["d1_all_peak_value"]) == (waves[top], pytest.approx(slope[top]))
    bare = features.feature_rows(px.where("image = 'i0'"), "image", "s", "m", waves, snv=False, derivative=False).first()["features"]
    assert len(bare) == len(names) and bare[104 : 104 + 31] == pytest.approx(mean.tolist()) and not any(bare[104 + 31 : 104 + 62])
    assert list(indices.INDICES)[0] + "_mean" in names


def test_band_reports(spark):
    sel = spark.createDataFrame([("a", "snv_R700"), ("a", "d1snv_R700"), ("b", "R700_mean"), ("b", "NDVI_std"), ("c", "snv_R1000"), ("c", None)], "model string, feature string")
    counts = {r["wavelength"]: (r["models"], r["strong"]) for r in bands.consensus(sel).collect()}
    assert counts == {700: (2, True), 1000: (1, False)}
    histogram = {(r["category"], r["low_nm"]): (r["n"], r["region"]) for r in bands.wavelength_histogram(sel).collect()}
    assert histogram["snv", 990] == (1, "NIR") and histogram["fixed_band", 700] == (1, "Red-Edge")
    assert [r["wavelength"] for r in bands.top_bands(bands.consensus(sel), 1).collect()] == [700]
    scores = spark.createDataFrame([("x", "nested", 0, [0, 2]), ("x", "nested", 1, [2])], "k string, arm string, fold int, chosen array<int>")
    assert {r["pos"]: r["frequency"] for r in bands.selection_frequency(scores, ["k"], 3).collect()} == {0: 0.5, 1: 0, 2: 1}
    assert {r["feature"] for r in bands.chosen_names(scores, ["k"], ["p", "q", "r"]).collect()} == {"p", "r"}


def test_locked_holdout(spark):
    df = spark.range(200).select("id", (F.col("id") % 20).alias("g"), (F.col("id") % 3).alias("c"))
    for options in ({"group": "g", "label": "c", "seeds": [1, 2]}, {"group": "g", "label": "c"}, {"group": "g"}):
        out = splits.lock_holdout(df, "id", **options)
        assert out.count() == 200 and splits.group_leakage(out, "g", "is_test").first()["leaked"] == 0 and out.where("is_test").count() >= 20
    sides = splits.side_counts(splits.lock_holdout(df, "id", label="c"), "c").where("is_test").collect()
    assert sorted(r["n"] for r in sides) == [13, 13, 13]
