"""The library against plain numpy on small data."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from foldlight.functions import indices, labels, permute, spectra
from foldlight.operators import models, moments, ordered, pixels, quantiles, splits, truth
from foldlight.plans import evaluate, features, resample, stats
from foldlight.sources import cubes, tables
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 12)) @ rng.standard_normal((12, 12)) + 1e4
    y = x[:, 2] - 0.5 * x[:, 7] + rng.standard_normal(120)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 5, i % 11) for i in range(120)], "id long, x array<double>, y double, fold int, grp int")
    return x, y, df.repartition(3)


def row_fit(name, x, y):
    mx, my = x.mean(0), y.mean()
    a, b = x - mx, y - my
    if name == "ridge":
        w = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ b)
    elif name == "ols":
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    else:
        sd, sy = a.std(0, ddof=1), b.std(ddof=1)
        e, f, ws, ps, qs = a / sd, b / sy, [], [], []
        for _ in range(min(10, a.shape[1])):
            w = e.T @ f
            w /= np.linalg.norm(w)
            t = e @ w
            p, q = e.T @ t / (t @ t), f @ t / (t @ t)
            e, f = e - np.outer(t, p), f - t * q
            ws, ps, qs = [*ws, w], [*ps, p], [*qs, q]
        w = np.array(ws).T @ np.linalg.solve(np.array(ps) @ np.array(ws).T, np.array(qs)) * sy / sd
    return lambda z: my + (z - mx) @ w


@pytest.mark.parametrize("model", ["ridge", "ols", "pls"])
def test_moments_equal_row_fits(data, model):
    x, y, df = data
    m = moments.fold_moments(df, "x", ["y"], "fold")
    scores = {(s["arm"], s["fold"]): s for s in evaluate.fold_scores(m, "correlation", model, 4)}
    for k in range(5):
        test = np.arange(120) % 5 == k
        chosen = scores["nested", k]["chosen"]
        corr = np.abs([np.corrcoef(x[~test, j], y[~test])[0, 1] for j in range(12)])
        assert chosen == sorted(np.argsort(-corr, kind="stable")[:4].tolist())
        pred = row_fit(model, x[~test][:, chosen], y[~test])(x[test][:, chosen])
        want = 1 - ((y[test] - pred) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum()
        assert abs(scores["nested", k]["r2"] - want) < 1e-6


def test_selectors(data):
    m = moments.fold_moments(data[2], "x", ["y"], "fold")
    for name in models.SELECTORS:
        assert len(models.get_selector(name)(m.total, 3, 1)) <= 3
    assert len(models.select_rfe(m.total, 3)) == 3
    assert len(models.subset_search(m.by_fold, 5, 1, 12, 4)) >= 1
    with pytest.raises(ValueError):
        models.get_selector("nothing")


def test_searches_go_through_generations_together(data, spark):
    """The best mask and log of every search are those of a whole search in one process; grids of searches agree."""
    m = moments.fold_moments(data[2], "x", ["y"], "fold")
    asked = [("e", f, 5, seed, part) for f in ("ridge", "pls") for seed in (1, 2) for part in (-1, 0, 3)]
    found = evaluate.search_together(asked, {"e": m}, spark, 14, 6)
    for key in asked:
        _, f, k, seed, part = key
        inner = m.by_fold if part < 0 else m.train_folds(part)
        best, log = models.searched_subsets(inner, k, seed, 14, 6, fit=models.MODELS[f])
        assert found[key].best().tolist() == best.tolist() and [x for r in found[key].log for x in r] == pytest.approx([x for r in log for x in r]) and len(log) == 6
    grid = evaluate.evaluate_grid(spark.createDataFrame([("e", "search", "pls", 5, 2)], evaluate.MOMENTS_KEYS), {"e": m}, 14, 6).collect()
    assert {(r["arm"], r["fold"]) for r in grid} == {(a, i) for a in ("apparent", "nested") for i in range(5)}
    assert next(r["chosen"] for r in grid if r["arm"] == "nested" and r["fold"] == 3) == found["e", "pls", 5, 2, 3].best().tolist()


def test_grid_equals_single_fits(data, spark):
    """Work dealt out by part and shared over k gives the rows of fold_scores()."""
    m = moments.fold_moments(data[2], "x", ["y"], "fold")
    combos = [("e", s, f, k, 42) for s in models.SELECTORS for f in ("ridge", "ols") for k in (2, 5)]
    got = {(r["selector"], r["model"], r["k"], r["arm"], r["fold"]): (r["r2"], r["chosen"]) for r in evaluate.evaluate_grid(spark.createDataFrame(combos, evaluate.MOMENTS_KEYS), {"e": m}).collect()}
    want = {(s, f, k, r["arm"], r["fold"]): (r["r2"], r["chosen"]) for _, s, f, k, _ in combos for r in evaluate.fold_scores(m, s, f, k)}
    assert got.keys() == want.keys() and all(got[x][1] == want[x][1] and got[x][0] == pytest.approx(want[x][0]) for x in want)


def test_nested_choice_ignores_test_rows(data, spark):
    x, y, df = data
    changed = df.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * -3).otherwise(F.col("y")))
    a, b = (evaluate.fold_scores(moments.fold_moments(d, "x", ["y"], "fold"), "correlation", "ridge", 3) for d in (df, changed))
    pick = lambda s: next(r["chosen"] for r in s if r["arm"] == "nested" and r["fold"] == 0)
    assert pick(a) == pick(b)


def test_trees_and_permutations(data):
    scores = evaluate.score_predictions(models.tree_predictions(data[2], "x", "y", "fold", trees=3).withColumn("y_true", F.col("y")), ["fold"])
    assert scores.count() == 5
    tests = resample.permutation_test(data[2], "id", "x", "y", "fold", k=3, n_perm=8)
    s = resample.permutation_summary(tests).first()
    assert s["n_perm"] == 8 and s["perm_p_value"] == pytest.approx(1 / 9)
    wide, names = resample.permuted_targets(data[2], "id", "y", 4)
    rows = wide.toPandas()
    assert all(sorted(rows[n]) == sorted(rows["y"]) for n in names) and not (rows["y_1"] == rows["y"]).all()


def test_splits(data, spark):
    df = data[2]
    for out in (splits.group_folds(df.drop("fold"), "grp"), splits.stratified_group_folds(df.drop("fold").withColumn("c", F.col("id") % 2), "grp", "c")):
        assert out.count() == 120 and out.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in splits.shuffled_folds(df.drop("fold"), "id").groupBy("fold").count().collect()]
    assert sizes == [24] * 5
    assert splits.regression_strata(df, "y").select("stratum").distinct().count() == 5
    assert splits.group_leakage(splits.holdout(df, "id", group="grp"), "grp", "is_test").first()["leaked"] == 0
    assert splits.holdout(df, "id", label="fold").where("is_test").count() == 25
    assert splits.grouped_holdout(df.drop("fold").withColumn("c", F.col("id") % 2), "grp", "c").where("is_test").count() > 0


def test_statistics(spark):
    d = [0.3, 0.1, -0.1, 0.25, 0.4, -0.2, 0.35, 0.15, 0.5, 0.45, 0.3, 0.2]
    df = spark.createDataFrame([("a", 0.5 + x, 0.5) for x in d] + [("b", 0.7, 0.6)] * 5, "k string, apparent double, nested double")
    out = {r["k"]: r for r in stats.paired_tests(df, ["k"]).collect()}
    size = np.round(np.abs(d), 9)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    signs = np.array(np.meshgrid(*[[0, 1]] * 12)).reshape(12, -1)
    sums = ranks @ signs
    least = min(ranks[np.array(d) < 0].sum(), ranks[np.array(d) > 0].sum())
    assert out["b"]["degenerate"] and out["b"]["p_value"] is None
    assert out["a"]["p_value"] == pytest.approx(2 * (sums <= least).mean())
    assert stats.signed_rank_p(ranks.tolist(), ranks[np.array(d) < 0].sum(), ranks.sum(), (ranks**2).sum()) == pytest.approx(2 * (sums <= least).mean())
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.00048828125] * 7 + [0.00537109375, None])], "i int, p_value double")
    fdr = {r["i"]: r["p_value_fdr"] for r in stats.false_discovery(p).collect()}
    assert fdr[0] == pytest.approx(0.00055803571) and fdr[7] == pytest.approx(0.00537109375) and fdr[8] is None


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_statistics_in_parts(spark, monkeypatch, few):
    """Many pairs with ties, a null key, in small parts or whole: ranks, effects and rates as from sorted lists."""
    monkeypatch.setattr(ordered, "FEW", few)
    rng = np.random.default_rng(12)
    rows = [(k, float(a), float(b)) for k, n in (("a", 300), (None, 90), ("c", 20)) for a, b in zip(np.round(rng.normal(0.1, 1, n), 1), np.round(rng.normal(0, 1, n), 1), strict=True)]
    out = {r["k"]: r for r in stats.paired_tests(spark.createDataFrame(rows, "k string, apparent double, nested double").repartition(5), ["k"]).collect()}
    for key in ("a", None, "c"):
        a, b = (np.array([r[i] for r in rows if r[0] == key]) for i in (1, 2))
        d = a - b
        size = np.abs(d[d != 0])
        ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        low = min(ranks[d[d != 0] < 0].sum(), ranks[d[d != 0] > 0].sum())
        assert out[key]["wilcoxon_stat"] == pytest.approx(low) and out[key]["cliffs_delta"] == pytest.approx(np.sign(a[:, None] - b).mean())
        if len(ranks) > stats.EXACT:
            z = (low - ranks.sum() / 2) / np.sqrt((ranks**2).sum() / 4)
            assert out[key]["p_value"] == pytest.approx(2 * NormalDist().cdf(z))
        else:
            assert 0 < out[key]["p_value"] <= 1
    p = np.round(rng.random(400) ** 3, 3)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(1000, None)], "i int, p_value double")
    got = {r["i"]: (r["p_value_fdr"], r["significant_fdr"]) for r in stats.false_discovery(frame).collect()}
    order = np.argsort(p)
    want = np.minimum(1, np.minimum.accumulate((p[order] * 400 / np.arange(1, 401))[::-1])[::-1])
    assert [got[i][0] for i in order.tolist()] == pytest.approx(want.tolist()) and got[1000] == (None, False) and len(got) == 401


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(200)
    y = 3 * x + 0.5 * rng.standard_normal(200)
    rows = [("a", i, float(y[i]), float(3 * x[i])) for i in range(200)] + [("flat", i, 5.0, float(x[i])) for i in range(9)] + [(None, i, float(y[i]), float(3 * x[i])) for i in range(50)] + [("one", 1, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, id long, y_true double, y_pred double")
    found = resample.bootstrap_intervals(df, ["k"], ["id"], 400).collect()
    out = {r["k"]: r for r in found}
    assert len(found) == 4 and out["flat"]["method"] == out["one"]["method"] == "degenerate"
    a = out["a"]
    assert a["method"] == "BCa" and a["n_boot"] == 400 and 0.5 < a["low"] <= a["r2"] <= a["high"] <= 1
    again = {r["k"]: r for r in resample.bootstrap_intervals(df.repartition(5), ["k"], ["id"], 400).collect()}
    assert all(again[None][c] == pytest.approx(out[None][c], abs=1e-12) for c in ("r2", "low", "high"))
    # in small buckets: exact numbers of draws, and intervals as from a plain resampler
    small = {r["k"]: r for r in resample.bootstrap_intervals(df, ["k"], ["id"], 2000, bucket_rows=7).collect()}
    rng, t, p = np.random.default_rng(5), y, 3 * x
    score = lambda t, p: 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    plain = np.array([score(t[i], p[i]) for i in rng.integers(0, 200, (4000, 200))])
    left = np.array([score(np.delete(t, i), np.delete(p, i)) for i in range(200)])
    away = left.mean() - left
    low, high, method = resample.bca_interval(score(t, p), plain, (away**2).sum(), (away**3).sum())
    for got in (a, small["a"]):
        assert got["method"] == method and got["r2"] == pytest.approx(score(t, p), abs=1e-9)
        assert (got["low"], got["high"]) == pytest.approx((low, high), abs=0.25 * (high - low))


def test_draws_of_resamples(spark):
    """Every replicate draws as many rows as the key has; counts of rows and of their pairs are multinomial; equal rows
    and hot row keys are drawn as often as their number says."""
    rows = [("a", i, float(i), 0.0) for i in range(60)] + [("a", 1000, 500.0, 0.0)] * 40 + [("b", i, 1.0, 1.0) for i in range(13)] + [("c", 7, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "by string, id long, y double, e2 double")
    n, many = 3000, {"a": 100, "b": 13, "c": 1}
    for bucket_rows in (4096, 5):
        out = resample.resampled_sums(df.repartition(3), n, 9, 100, bucket_rows).collect()
        assert len(out) == 3 * n and all(r["n"] == many[r["by"]] for r in out)
        s = np.array([r["s"] for r in out if r["by"] == "a"])
        values = np.array([r[2] for r in rows if r[0] == "a"])
        assert abs(s.mean() - values.sum()) < 4 * values.std() * 10 / np.sqrt(n) and abs(s.std() / (values.std() * 10) - 1) < 0.06
        again = resample.resampled_sums(df.orderBy(F.rand(1)).repartition(7), n, 9, 100, bucket_rows).collect()
        assert sorted((r["by"], r["b"], round(r["s"], 6), round(r["ss"], 6)) for r in again) == sorted((r["by"], r["b"], round(r["s"], 6), round(r["ss"], 6)) for r in out)
    path = [{"level": 0, "node": 0, "n": 100, "left": 30}, {"level": 1, "node": 1, "n": 70, "left": 0}]
    assert (resample.bucket_draws("a", path, 2, 50, 1) == 0).all()
    both = resample.bucket_draws("a", path[:1], 0, 50, 1) + resample.bucket_draws("a", path, 3, 50, 1)
    assert (both == 100).all()


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.standard_normal(30_000), "b": np.repeat([1.0, 2.0], [5000, 4000]), "c": np.array([3.0]), "d": rng.random(500), None: rng.random(7)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["g"], "v", at).collect() if r["g"] is not None}
    assert set(got) == {"a", "b", "c", "d"}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], at).tolist(), abs=1e-12)
    every = np.concatenate(list(groups.values()))
    assert quantiles.exact_quantiles(df, [], "v", at).first()["quantiles"] == pytest.approx(np.quantile(every, at).tolist(), abs=1e-12)


def test_groups_go_to_the_lightest_fold(spark):
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = np.sort(rng.integers(1, rng.choice([3, 20, 400]), rng.integers(1, 60)))[::-1]
        folds, load, want = int(rng.integers(2, 6)), [0] * 6, []
        load = load[:folds]
        for n in sizes.tolist():
            k = min(range(folds), key=lambda i: (load[i], i))  # noqa: B023
            want.append((n, k))
            load[k] += n
        values, counts = np.unique(sizes, return_counts=True)
        got = [(n, turn[i % len(turn)]) for n, first, end, turn in splits.dealt_sizes([(int(v), int(c)) for v, c in zip(values[::-1], counts[::-1], strict=True)], folds) for i in range(end - first)]
        assert got == want
    many = splits.dealt_sizes([(10**6, 3), (1, 10**12)], 5)
    assert len(many) < 20 and many[-1][2] == 10**12
    rows = spark.createDataFrame([(g if g else None, i) for g in range(30) for i in range(1 + g % 4)], "g long, i long")
    out = splits.group_folds(rows, "g", 3)
    assert out.count() == rows.count() and sorted(r["count"] for r in out.groupBy("fold").count().collect()) == [24, 24, 25]


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_ROWS", 5)
    monkeypatch.setattr(splits, "SPAN", 3)
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("by"))
    got = splits.ranked(df, splits.shuffle_key(F.col("id"), 1)).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(300), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())
    inside = splits.ranked(df, splits.shuffle_key(F.col("id"), 1), ["by"]).collect()
    assert sorted((r["by"] or 0, r["rank"]) for r in inside) == [(b, i) for b in range(3) for i in range(100)]


def test_missing_groups_labels_and_clashing_names(spark):
    """Rows without a group or label stay; columns that the splits would use by themselves come back as they were."""
    rows = [(i, None if i % 10 == 0 else i % 7, None if i % 9 == 0 else "ab"[i % 2], i, -i, 2 * i) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g long, c string, rank long, _n long, _order long")
    for out in (splits.holdout(df, "id", group="g"), splits.holdout(df, "id", label="c"), splits.holdout(df, "id"), splits.shuffled_folds(df, "id"), splits.stratified_folds(df, "id", "c"), splits.lock_holdout(df, "id", group="g", label="c", seeds=[1, 2, 3])):
        assert out.columns[:6] == df.columns and sorted(tuple(r)[3:6] for r in out.collect()) == sorted(r[3:] for r in rows)
    held = splits.holdout(df, "id", group="g")
    assert held.groupBy("g").agg(F.count_distinct("is_test").alias("n")).where("n <> 1").count() == 0
    assert splits.holdout(df, "id", label="c").where("is_test and c is null").count() == 2
    tries = {r["seed"]: r for r in splits.split_search(df, "g", "c", [1, 2, 3]).collect()}
    assert all(r["leaked"] == 0 for r in tries.values())


def test_many_kinds_of_groups(spark, monkeypatch):
    """However few kinds the driver may hold, groups stay whole, no row is lost and classes are spread over the folds."""
    rng = np.random.default_rng(17)
    rows = [(g, "abc"[int(rng.integers(0, 3))]) for g in range(300) for _ in range(int(rng.integers(1, 9)))] + [(None, None), (None, "a")]
    df = spark.createDataFrame(rows, "g long, c string")
    for most in (20_000, 60, 10):
        monkeypatch.setattr(splits, "MOST_KINDS", most)
        out = splits.stratified_group_folds(df, "g", "c")
        assert out.count() == len(rows) and out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
        sizes = {(r["fold"], r["c"]): r["count"] for r in out.groupBy("fold", "c").count().collect()}
        for c in "abc":
            mine = [sizes[f, c] for f in range(5)]
            assert max(mine) - min(mine) <= (4 if most == 20_000 else 0.5 * np.mean(mine)), (most, c, mine)


def test_splits_by_row_leak(spark):
    """Groups on both sides are counted, and the ranking prefers seeds that tear none apart."""
    rng = np.random.default_rng(3)
    rows = [(i, int(g), "xy"[int(c)]) for i, (g, c) in enumerate(zip(rng.integers(0, 40, 120), rng.integers(0, 2, 120), strict=True))] + [(500, None, None), (501, None, None)]
    df = spark.createDataFrame(rows, "id long, g long, c string")
    got = {r["seed"]: r for r in splits.row_split_search(df, "id", "g", "c", [1, 2, 3]).collect()}
    for seed in (1, 2, 3):
        test = set()
        for c in ("x", "y", None):
            mine = sorted((i for i, _, k in rows if k == c), key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())
            test |= set(mine[: int(np.floor(len(mine) * 0.2 + 0.5))])
        torn = len({g for i, g, _ in rows if i in test} & {g for i, g, _ in rows if i not in test})
        share = lambda side: np.array([sum(k == c and ((i in test) == side) for i, _, k in rows) for c in ("x", "y", None)])  # noqa: B023, E731
        p, q = share(False) / share(False).sum() + 1e-9, share(True) / share(True).sum() + 1e-9
        assert got[seed]["leaked"] == torn > 0 and got[seed]["kl"] == pytest.approx((p * np.log(p / q)).sum()) and got[seed]["score"] == pytest.approx(got[seed]["kl"] + 100 * torn)
    assert splits.best_split(spark.createDataFrame([(1, 0.1, 2), (2, 0.9, 0), (3, 0.8, 0)], "seed int, kl double, leaked long")) == 3
    assert splits.best_split(spark.createDataFrame([(1, 0.1, 2), (2, 0.9, 1), (3, 0.8, 1)], "seed int, kl double, leaked long")) == 3


def test_profiles_of_odd_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", [1.0, nan]), ("a", [3.0, 5.0]), ("b", [nan, nan])], "c string, x array<double>")
    assert {r["pos"]: (r["mean"], r["std"]) for r in features.feature_profile(df, "x").collect()} == {0: (2.0, 1.0), 1: (5.0, 0.0)}
    assert {(r["pos"], r["label"]): (r["mean"], r["n"]) for r in features.class_profile(df.withColumnRenamed("c", "label"), "x", "label").collect()} == {(0, "a"): (2.0, 2), (1, "a"): (5.0, 2), (0, "b"): (None, 1), (1, "b"): (None, 1)}
    y = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,)] * 50 + [(nan,)] * 3 + [(float("inf"),)], "y double")
    bins = {r["bin"]: r["n"] for r in features.target_histogram(y, "y").collect()}
    assert bins == dict.fromkeys(range(10), 5)
    assert [tuple(r) for r in features.target_histogram(y.where("y = 3"), "y").collect()] == [(0, 1, 3.0)]
    # an image without a number, and pixels without an image, keep all their rows and have an empty mask
    px = spark.createDataFrame([("a", 0.1, 0.1 + 0.02 * i) for i in range(20)] + [("none", nan, nan)] * 4 + [(None, 0.1, 0.9)] * 12 + [("few", None, 0.5)], "image string, red double, nir double")
    got = pixels.ndvi_mask(px, "image", "red", "nir")
    assert got.count() == 37 and got.where("image = 'none' and in_mask").count() == 0 and got.where("image is null").count() == 12
    assert {r["image"] for r in pixels.otsu_thresholds(px, "image", "nir").collect()} == {"a", "none", None, "few"}
    assert pixels.hybrid_mask(px, "image", F.col("nir"), F.lit(False)).count() == 37
    assert pixels.layer_statistics(px, "image", ["nir"]).where("image = 'a'").first()["nir_p75"] == pytest.approx(np.quantile(0.1 + 0.02 * np.arange(20), 0.75))


def test_pipelines_with_few_groups(spark, data):
    """Three groups can't fill five folds: the second pipeline is missing."""
    df = data[2].drop("fold").withColumn("grp", F.col("id") % 3)
    combos = spark.createDataFrame([("e", "correlation", "ridge", 3, 1)], evaluate.MOMENTS_KEYS)
    score = lambda d: evaluate.evaluate_grid(combos, {"e": moments.fold_moments(d, "x", ["y"], "fold")})
    random = score(splits.shuffled_folds(df, "id"))
    few = evaluate.three_pipelines(random, score(splits.group_folds(df, "grp"))).first()
    assert few["p1"] is not None and few["p3"] is not None and few["p2"] is None and few["group_leak"] is None and few["sel_leak"] is None
    many = evaluate.three_pipelines(random, score(splits.group_folds(df.withColumn("grp", F.col("id") % 8), "grp"))).first()
    assert many["p2"] is not None


def test_names_that_contain_each_other(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    names, texts = [word(int(rng.integers(1, 7))) for _ in range(60)] + ["é", "", None], [word(int(rng.integers(1, 9))) for _ in range(50)] + ["xéx"]
    samples = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    table = spark.createDataFrame(list(enumerate(texts)), "o long, text string")
    for both_ways in (False, True):
        for last in (False, True):
            pick = max if last else min
            out = {r["i"]: (r["o"], r["matched"]) for r in truth.match_by_name(samples, table, "name", "text", "o", last, both_ways).collect()}
            for i, n in enumerate(names):
                same = [o for o, t in enumerate(texts) if n and t == n]
                near = [pick(o for o, u in enumerate(texts) if u == t) for t in texts if n and (n in t or both_ways and t in n)]
                assert out[i] == ((pick(same), "exact") if same else (pick(near), "contains") if near else (None, None))
    truth_rows = spark.createDataFrame([("leaf 1", 1, None, 2.6), ("leaf 1", 2, " ", 1.6), ("leaf 22", 3, "nothing known", 2.6)], "name string, o long, label string, flav double")
    asked = spark.createDataFrame([("Leaf 1",), ("leaf 22 b",), ("other",)], "sample string")
    assert {r["sample"]: r["class"] for r in truth.class_of(asked, truth_rows, "sample", "name", "label", "o", "flav").collect()} == {"Leaf 1": 2, "leaf 22 b": 3, "other": 3}


def test_outlier_report(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).tolist(), float(rng.standard_normal())) for i in range(300)] + [(900, [30.0] * 4, 0.0), (901, [0.0] * 4, 99.0), (902, None, -99.0), (903, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    out = {r["id"]: r for r in truth.outlier_report(df, ["y"], "x", "id", 0.02, trees=50).collect()}
    assert len(out) == 304 and out[900]["reasons"] == "isolation" and "iqr_y" in out[901]["reasons"] and out[902]["reasons"] == "iqr_y" and not out[903]["outlier"]
    assert all(r["outlier"] == (r["reasons"] != "") for r in out.values())
    flagged = truth.outlier_report(df, ["y"])
    n = flagged.where("outlier").count()
    assert truth.act_on_outliers(flagged, ["outlier"], "drop").count() == 304 - n and truth.act_on_outliers(flagged, ["outlier"], "warn").columns == flagged.columns


def test_noise(spark):
    df = spark.range(3000)
    rows = np.array([[*r["features"], r["y"]] for r in resample.noise_rows(df, "id", 6, [3]).collect()])
    assert abs(rows.mean(0)).max() < 0.08 and abs(rows.std(0) - 1).max() < 0.05 and abs(np.corrcoef(rows.T) - np.eye(7)).max() < 0.08
    one, two = (resample.null_moments(df.repartition(n), "id", 6, [3, 8]) for n in (2, 5))
    assert set(one) == {"3", "8"} and not np.allclose(one["3"].by_fold, one["8"].by_fold)
    for s, m in one.items():
        assert np.allclose(m.by_fold, two[s].by_fold) and m.folds == [0, 1, 2, 3, 4] and (m.by_fold[:, 0, 0] == 600).all()


def test_spectra(spark):
    rng = np.random.default_rng(2)
    rows = rng.random((6, 25))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, x array<double>")
    got = np.array([r["x"] for r in spectra.preprocess(df, "x", ["sg"]).orderBy("id").collect()])
    fit = [np.polyval(np.polyfit(np.arange(11), r[5:16], 2), 5) for r in rows]
    assert np.allclose(got[:, 10], fit)
    assert np.allclose(got[:, 0], [np.polyval(np.polyfit(np.arange(11), r[:11], 2), 0) for r in rows])
    assert np.allclose(spectra.msc(2 * rows + 1, rows[0])[0], rows[0])
    snv = np.array([r["s"] for r in df.select(spectra.snv(F.col("x")).alias("s"), "id").orderBy("id").collect()])
    assert np.allclose(snv, (rows - rows.mean(1, keepdims=True)) / rows.std(1, keepdims=True))
    with pytest.raises(ValueError):
        spectra.preprocess(df, "x", ["nothing"])
    ndvi = spark.createDataFrame([([0.2, 0.8, 0.0],)], "s array<double>").select(indices.all_indices(F.col("s"), [670, 800, 550], ["NDVI"])["NDVI"]).first()[0]
    assert ndvi == pytest.approx(0.6)


def plain_raster(mask, steps):
    """Raster steps cell by cell."""
    h, w = mask.shape
    near = lambda m, i, j: [m[a, b] if 0 <= a < h and 0 <= b < w else False for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1)]

    def flood(m, seeds):
        seen, todo = set(), [s for s in seeds if m[s]]
        while todo:
            i, j = todo.pop()
            if (i, j) not in seen:
                seen.add((i, j))
                todo += [(a, b) for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < h and 0 <= b < w and m[a, b]]
        return seen

    cells = [(i, j) for i in range(h) for j in range(w)]
    for step in steps:
        if step in ("dilate", "erode"):
            mask = np.array([(any if step == "dilate" else all)(near(mask, *c)) for c in cells]).reshape(h, w)
        elif step == "fill_holes":
            out = flood(~mask, [c for c in cells if c[0] in (0, h - 1) or c[1] in (0, w - 1)])
            mask = np.array([c not in out for c in cells]).reshape(h, w)
        else:
            mask = np.array([bool(mask[c]) and len(flood(mask, [c])) >= 0.005 * mask.size for c in cells]).reshape(h, w)
    return mask


CLEAN = ["dilate", "dilate", "erode", "erode", "fill_holes", "erode", "dilate"]


def test_rasters(spark):
    rng = np.random.default_rng(9)
    mask = np.zeros((12, 12), bool)
    mask[2:9, 2:9] = True
    mask[5, 5] = False
    mask[10, 10] = True
    clean = pixels.clean_up(mask)
    assert clean[5, 5] and clean[3:8, 3:8].all()
    assert pixels.components(mask)[1] == 2 and not pixels.without_small(mask, 0.02)[10, 10]
    apart = np.zeros((9, 16), bool)
    apart[2:7, 2:6] = apart[2:7, 9:13] = True  # three pixels between them
    assert pixels.clean_up(apart)[3:6, 6:9].all()
    for share in (0.2, 0.45, 0.6, 0.8):
        some = rng.random((17, 23)) < share
        assert (pixels.clean_up(some) == plain_raster(some, CLEAN)).all()
        assert (pixels.white_disk(some) == plain_raster(some, ["dilate", "erode", "fill_holes", "dilate", "dilate"])).all()
        assert (pixels.without_small(some) == plain_raster(some, ["small"])).all()
    rows = spark.createDataFrame([("a", int(i), int(j), bool(mask[i, j])) for i in range(12) for j in range(12)], "image string, row int, col int, in_mask boolean")
    out = pixels.raster_step(rows, "image", ["clean_up"])
    assert out.where("in_mask").count() == clean.sum()
    assert pixels.best_mask(rows.withColumn("in_mask", F.lit(False)), out, "image").where("in_mask").count() == clean.sum()


def test_masks_by_name(spark):
    """A leaf, a white disk and a dark background in each image; the last image has neither."""
    rng, waves = np.random.default_rng(10), [450.0, 550.0, 670.0, 750.0, 800.0]
    leaf, white, dark = [0.05, 0.12, 0.06, 0.5, 0.55], [0.8, 0.82, 0.81, 0.8, 0.82], [0.02] * 5
    rows = []
    for image in ("a", "b", "bare"):
        for i in range(20):
            for j in range(20):
                kind = dark if image == "bare" else leaf if 3 <= i < 12 and 3 <= j < 12 else white if 15 <= i < 18 and 14 <= j < 18 else dark
                rows.append((image, i, j, [float(v) for v in np.array(kind) * (1 + (image != "bare") * 0.02 * rng.standard_normal(5))]))
    px = spark.createDataFrame(rows, "image string, row int, col int, s array<double>")
    for method in ("hybrid", "ndvi", "kmeans", "pca"):
        got = pixels.segment(px.where("image <> 'bare'"), "image", "s", waves, method).where("in_mask").groupBy("image").agg(F.count("*").alias("n"), F.max("row").alias("low")).collect()
        # principal scores keep all but the darkest cluster: the disk too
        assert {r["image"]: (r["n"], r["low"]) for r in got} == dict.fromkeys("ab", (93, 17) if method == "pca" else (81, 11)), method
    best = pixels.leaf_masks(px, "image", "s", waves)
    assert {r["image"]: r["n"] for r in best.groupBy("image").agg(F.count_if("in_mask").alias("n")).collect()} == {"a": 81, "b": 81}
    with pytest.raises(ValueError):
        pixels.segment(px, "image", "s", waves, "nothing")


@pytest.mark.parametrize("method", ["kmeans", "pca"])
def test_clusters_of_all_images_together(spark, method):
    """The same masks as image by image, with images of few, equal or unnamed pixels among them."""
    rng, rows = np.random.default_rng(14), []
    for image, n in (("a", 180), ("b", 90), (None, 60)):
        middle = rng.standard_normal((3, 6)) * 2
        rows += [(image, i, (middle[i % 3] + 0.5 * rng.standard_normal(6)).tolist()) for i in range(n)]
    rows += [("two", 0, [0.0] * 6), ("two", 1, [1.0] + [0.0] * 5)] + [("same", i, [2.0] * 6) for i in range(9)]
    df = spark.createDataFrame(rows, "image string, i long, s array<double>").withColumn("score", F.get("s", F.lit(1)))
    one, all_ = ({(r["image"], r["i"]): r["in_mask"] for r in f(df.repartition(n), "image", "s", "score", method, place=["i"]).collect()} for f, n in ((pixels.cluster_mask, 2), (pixels.cluster_mask_together, 5)))
    named = [k for k in one if k[0] not in ("two", "same")]
    assert one.keys() == all_.keys() and len(one) == len(rows) and [one[k] for k in named] == [all_[k] for k in named]
    assert 0 < sum(one[k] for k in named) < len(named)
    again = {(r["image"], r["i"]): r["in_mask"] for r in pixels.cluster_mask(df.orderBy("score").repartition(3), "image", "s", "score", method, place=["i"]).collect()}
    assert [again[k] for k in named] == [one[k] for k in named]


def test_cubes(spark):
    cube = np.arange(3 * 4 * 5, dtype=np.float32).reshape(3, 4, 5)
    forms = {"bil": cube.transpose(0, 2, 1), "bsq": cube.transpose(2, 0, 1), "bip": cube}
    df = spark.createDataFrame([(k, bytearray(v.tobytes()), "float32", k, 3, 4, 5) for k, v in forms.items()], "image string, content binary, dtype string, interleave string, lines int, samples int, bands int")
    for r in cubes.read_pixels(df).collect():
        assert r["spectrum"] == cube[r["row"], r["col"]].tolist()
    assert cubes.read_pixels(df).count() == 36
    shape = spark.range(1).select(cubes.repaired_shape(F.lit(80).cast("long"), F.lit(5), F.lit(9), F.lit(9)).alias("s")).first()["s"]
    assert (shape["lines"], shape["samples"]) == (4, 4)
    header = "ENVI\n; note\nSamples = 4\nlines = 3\nbands = 5\ndata type = 12\ninterleave = BSQ\nwavelength = {400.0,\n 500, 600,700,\n800}\n"
    h = cubes.parse_headers(spark.createDataFrame([("p", bytearray(header.encode()))], "path string, content binary")).first()
    assert (h["samples"], h["lines"], h["bands"], h["dtype"], h["interleave"], h["wavelengths"]) == (4, 3, 5, "uint16", "bsq", [400, 500, 600, 700, 800])


def test_ground_truth(spark):
    text = "﻿name;chl\n\"Leaf A;1,5\"\nLeaf B;x;more\nleaf a;9\nlong leaf c name\n"
    rows = tables.read_ground_truth(spark.createDataFrame([("p", bytearray(text.encode()))], "path string, content binary"), ["name", "chl"], ["chl"])
    assert [(r["name"], r["chl"]) for r in rows.orderBy("line").collect()] == [("Leaf A", 1.5), ("Leaf B", None), ("leaf a", 9.0), ("long leaf c name", None)]
    names = spark.createDataFrame([(1, " LEAF A "), (2, "leaf c"), (3, "none")], "id int, sample string")
    first = {r["id"]: (r["chl"], r["matched"]) for r in truth.match_by_name(names, rows, "sample", "name", "line").collect()}
    last = {r["id"]: r["chl"] for r in truth.match_by_name(names, rows, "sample", "name", "line", last=True, both_ways=True).collect()}
    assert first == {1: (1.5, "exact"), 2: (None, "contains"), 3: (None, None)} and last[1] == 9.0
    got = spark.createDataFrame([("  Flavéscence   Dorée ",), ("x",)], "t string").select(labels.symptom_class(labels.normalise(F.col("t"))).alias("c")).collect()
    assert [r["c"] for r in got] == [1, 3]


def test_resume(spark, tmp_path):
    grid = truth.task_grid(spark.createDataFrame([("d", "t", 30), ("d", "u", 5)], "dataset string, target string, n_finite int"), ["a", "b"], ["m"], [1, 2])
    assert grid.count() == 4
    tables.write_results(grid.limit(3), f"{tmp_path}/r", "k20")
    keys = ["dataset", "target", "selector", "model", "seed"]
    assert tables.remaining(grid, tables.read_results(spark, f"{tmp_path}/r", "k20"), keys).count() == 1


def test_default_tasks(spark):
    targets = spark.createDataFrame([("a", "t1", 0, 30), ("a", "t2", 1, 30), ("b", "u2", 1, 50), ("b", "u1", 0, 40), ("few", "v", 0, 19), ("binary", "w", 0, 90)], "dataset string, target string, position int, n_finite int")
    rows = lambda *a, **k: {tuple(r)[:2] + (r["model"],) for r in truth.default_tasks(targets, ["rfe"], [1, 2], *a, **k).collect()}
    assert rows() == {("a", "t1", "pls"), ("b", "u1", "pls"), ("binary", "w", "pls")}
    combos = [("a", "t2", "ridge"), ("a", "t1", "rf"), ("a", "none", "pls"), ("few", "v", "pls")]
    assert rows(combos, ["binary"]) == {("a", "t2", "ridge"), ("a", "t1", "rf"), ("b", "u1", "pls")}
    assert rows([*combos, ("binary", "w", "svm")], ["binary"]) == {("a", "t2", "ridge"), ("a", "t1", "rf"), ("b", "u1", "pls"), ("binary", "w", "svm")}
    done = truth.default_tasks(targets, ["rfe"], [1])
    assert truth.default_tasks(targets, ["rfe"], [1, 2], done=done).count() == 3 == done.count()


def test_runs_resume(spark, tmp_path):
    """A run that breaks off in its third batch and starts again evaluates every combination, none of the finished twice."""
    grid = spark.createDataFrame([(d, s, x) for d in ("a", None) for s in ("rfe", "lasso") for x in (1, 2, 3)], "dataset string, selector string, seed int")
    keys, seen, path = ["dataset", "selector", "seed"], [], f"{tmp_path}/runs"

    def evaluate_(batch, broken=False):
        rows = [tuple(r) for r in batch.collect()]
        if broken and len(seen) >= 6:
            raise RuntimeError("stopped")
        seen.extend(rows)
        return batch.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("r2", F.lit(0.5))

    with pytest.raises(RuntimeError):
        tables.run_grid(grid, lambda b: evaluate_(b, True), path, "k20", keys, batch=3)
    assert len(seen) == 6
    out = tables.run_grid(grid, evaluate_, path, "k20", keys, batch=3)
    assert len(seen) == 12 and len(set(seen)) == 12
    assert sorted(map(str, (tuple(r) for r in out.select(*keys, "fold").collect()))) == sorted(str((*r, f)) for r in set(seen) for f in (0, 1))
    assert tables.run_grid(grid, evaluate_, path, "k20", keys).count() == 24 and len(seen) == 12
    assert tables.run_grid(grid.limit(2), evaluate_, path, "other", keys).count() == 4 and len(seen) == 14
    with pytest.raises(ValueError):
        tables.run_grid(grid, lambda b: evaluate_(b).where("seed = 1"), f"{tmp_path}/lost", "k20", keys, batch=5)


def test_cubes_in_ranges(spark, tmp_path):
    """Each layout cut in three ranges of lines; a header whose sizes are wrong; a file that fits nothing."""
    cube = np.random.default_rng(4).integers(0, 5000, (7, 4, 5)).astype(np.uint16)
    forms = {"bil": cube.transpose(0, 2, 1), "bsq": cube.transpose(2, 0, 1), "bip": cube}
    rows = []
    for kind, data in forms.items():
        (tmp_path / f"{kind}.dat").write_bytes(np.ascontiguousarray(data).tobytes())
        rows.append((kind, f"file:{tmp_path}/{kind}.dat", 280, "uint16", kind, 7, 4, 5))
    (tmp_path / "wrong.dat").write_bytes(np.zeros(9 * 5, np.uint16).tobytes())
    rows += [("wrong", f"{tmp_path}/wrong.dat", 90, "uint16", "bip", 512, 512, 5), ("none", f"{tmp_path}/wrong.dat", 91 * 2, "uint16", "bip", 512, 512, 5)]
    df = spark.createDataFrame(rows, "image string, path string, length long, dtype string, interleave string, lines int, samples int, bands int")
    ranges = cubes.cube_ranges(df, 3 * 4 * 5 * 2)
    assert sorted((r["first"], r["n"]) for r in ranges.where("image = 'bsq'").collect()) == [(0, 3), (3, 3), (6, 1)]
    for task_bytes in (1, 120, 1 << 20):
        got = cubes.read_cubes(df, task_bytes).collect()
        assert len(got) == 3 * 28 + 9 and len({(r["image"], r["row"], r["col"]) for r in got}) == len(got)
        assert all(r["spectrum"] == cube[r["row"], r["col"]].tolist() for r in got if r["image"] in forms)
        assert {(r["row"], r["col"]) for r in got if r["image"] == "wrong"} == {(i, j) for i in range(3) for j in range(3)}


def test_grey_pixels(spark, tmp_path):
    """Colour images become grey by weight; the statistics of each band are those of the grey values."""
    rng, want = np.random.default_rng(6), {}
    (tmp_path / "set1").mkdir()
    for b in range(1, 7):
        rows = rng.integers(0, 256, (5, 4, 3)) if b % 2 else rng.integers(0, 256, (5, 4))
        (tmp_path / "set1" / f"IMG_9_{b}.png").write_bytes(png(rows.reshape(5, -1).tolist(), 2 if b % 2 else 0, 4))
        want[b] = ((rows[..., 0] * 19595 + rows[..., 1] * 38470 + rows[..., 2] * 7471 + 32768) // 65536 if b % 2 else rows).ravel().astype(float)
    values = cubes.grey_pixels(cubes.read_band_images(spark, str(tmp_path / "set1")))
    assert values.count() == 120
    got = features.band_image_statistics(values, "image", "band", "value", [1, 2, 3, 4, 5, 6]).first()
    for b, v in want.items():
        for name, f in (("mean", np.mean), ("std", np.std), ("p25", lambda x: np.quantile(x, 0.25)), ("p75", lambda x: np.quantile(x, 0.75))):
            assert got[f"b{b}_{name}"] == pytest.approx(f(v))
    assert cubes.grey_values(bytes([10, 20, 30, 255]), 4).tolist() == [(30 * 19595 + 20 * 38470 + 10 * 7471 + 32768) // 65536]


def png(rows, kind=0, width=None):
    """A PNG file of 8-bit rows: grey, or colour (kind 2) of so many pixels a row."""
    import struct
    import zlib

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width or len(rows[0]), len(rows), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + part(b"IEND", b"")


def test_files(spark, tmp_path):
    """Headers, masked cubes, band images, annotations and measurements as files."""
    import io

    for leaf, names in (("x/leaf1", ["b.hdr", "a.hdr", "c.txt"]), ("x/y/leaf2", ["z.hdr"])):
        (tmp_path / leaf / "results").mkdir(parents=True)
        for n in names:
            (tmp_path / leaf / "results" / n).write_text("ENVI")
    (tmp_path / "x" / "stray.hdr").write_text("ENVI")
    found = {r["leaf_dir"].rsplit("/", 1)[1]: r["path"].rsplit("/", 1)[1] for r in cubes.find_headers(spark, str(tmp_path / "x")).collect()}
    assert found == {"leaf1": "a.hdr", "leaf2": "z.hdr"}
    sizes = spark.createDataFrame([(512 * 512 * 204 * 4,), (204 * 4 * 7,), (204 * 4 * 7 + 1,), (0,)], "n long").select(cubes.size_is_valid(F.col("n")).alias("ok")).collect()
    assert [r["ok"] for r in sizes] == [True, True, False, False]

    data, mask = np.random.default_rng(1).random((3, 90, 70)), np.random.default_rng(2).random((90, 70)) < 0.5
    packed = io.BytesIO()
    np.savez(packed, data=data, mask=np.stack([mask, mask, mask & False]))
    rows = cubes.read_npz(spark.createDataFrame([("p", bytearray(packed.getvalue()))], "path string, content binary")).collect()
    assert len(rows) == 6300 and all(r["in_mask"] == mask[r["row"], r["col"]] and r["spectrum"] == data[:, r["row"], r["col"]].astype(np.float32).tolist() for r in rows)

    for image, n in (("1", 6), ("2", 5)):
        for b in range(1, n + 1):
            (tmp_path / "set7").mkdir(exist_ok=True)
            (tmp_path / "set7" / f"IMG_{image}_{b}.png").write_bytes(png([[10 * b, 20 * b], [0, 5]]))
    images = cubes.read_band_images(spark, str(tmp_path / "set7"))
    assert {(r["set"], r["image"], r["band"]) for r in images.collect()} == {("set7", "1", b) for b in range(1, 7)}
    grey = images.select("image", "band", F.explode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("double"))).alias("v"))
    stats = features.band_image_statistics(grey, "image", "band", "v", [1, 2, 3, 4, 5, 6]).first()
    assert stats["b3_mean"] == pytest.approx(np.mean([30, 60, 0, 5])) and stats["b6_std"] == pytest.approx(np.std([60, 120, 0, 5]))

    notes = '{"a": {"type": "leaf", "FD": true}, "b": {"type": "calibration_panel"}, "c": null, "d": {"FD": false, "ESCA": true}}'
    got = {r["image"]: (r["type"], r["FD"], r["ESCA"]) for r in tables.read_annotations(spark.createDataFrame([(bytearray(notes.encode()),)], "content binary")).collect()}
    assert got == {"a": ("leaf", 1.0, 0.0), "d": (None, 0.0, 1.0)}
    (tmp_path / "m.csv").write_text("Sample_Index,Field,SPAD,RWC\n1,1,40.5,x\n2,1,41,0.5\n9,1,1,1\n")
    measured = tables.read_measurements(spark, str(tmp_path / "m.csv"), spark.createDataFrame([(1,), (2,), (2,), (3,)], "Sample_Index int")).orderBy("Sample_Index").collect()
    assert [(r["Sample_Index"], r["chlorophyll"], r["rwc"]) for r in measured] == [(1, 40.5, None), (2, 41.0, 0.5)]


def test_datasets(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, [1.0, 2.0]), ("b", None, [3.0, 4.0])], "filename string, y double, features array<double>")
    tables.write_dataset(df, "features", ["f1", "f2"], f"{tmp_path}/d")
    back, names = tables.read_dataset(spark, f"{tmp_path}/d", ["filename", "y"])
    assert names == ["f1", "f2"] and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        tables.read_dataset(spark, f"{tmp_path}/d", ["other"])
    checks = tables.dataset_checks(df, keys=["y"]).first()
    assert (checks["n"], checks["least_features"], checks["most_features"], checks["null_y"]) == (2, 2, 2, 1)
    tables.LOADERS["mine"] = lambda s: df
    assert tables.load(spark, "mine") is df
    with pytest.raises(ValueError):
        tables.load(spark, "yours")
    assert tables.normalise_names(spark.createDataFrame([(1, "x")], "imageID int, directoryName string")).columns == ["imageID", "filename"]
    assert tables.normalise_names(spark.createDataFrame([(1, "x")], "q int, z string")).columns == ["filename", "z"]
    tables.write_summary(df.select("filename", "y"), df.agg(F.count("*").alias("n")), f"{tmp_path}/s")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/s/overall").first()["n"] == "2"


def test_dataset_preprocessing(spark):
    rows = np.random.default_rng(3).random((5, 20))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, x array<double>")
    for window in (11, 10, 51):
        odd = window + (window % 2 == 0)
        smooth = rows @ spectra.savgol_matrix(20, odd).T if odd <= 20 else rows
        want = (smooth - smooth.mean(1, keepdims=True)) / smooth.std(1, keepdims=True)
        got = np.array([r["x"] for r in spectra.preprocess_dataset(df, "x", 20, window).orderBy("id").collect()])
        assert np.allclose(got, want)
    line = np.array([r["x"] for r in spectra.preprocess(df, "x", ["continuum_line"]).orderBy("id").collect()])
    assert np.allclose(line, rows / np.linspace(rows[:, 0], rows[:, -1], 20, axis=1))


def test_splitter_by_task(data):
    df = data[2].drop("fold").withColumn("c", F.col("id") % 3)
    plain = splits.make_folds(df, "id")
    assert sorted(r["count"] for r in plain.groupBy("fold").count().collect()) == [24] * 5
    by_class = splits.make_folds(df, "id", task="classification", label="c").groupBy("fold", "c").count().collect()
    assert {r["count"] for r in by_class} == {8}
    assert splits.make_folds(df, "id", target="y", stratify=True).groupBy("fold", "stratum").count().agg(F.min("count")).first()[0] >= 4
    for grouped in (splits.make_folds(df, "id", group="grp"), splits.make_folds(df, "id", task="classification", group="grp", label="c")):
        assert grouped.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_more_models_against_rows(data):
    """Elastic net by its optimality conditions; boosted trees predict every row out of fold."""
    x, y, df = data
    m = moments.fold_moments(df, "x", ["y"], "fold").total
    _, coef = models.elastic_net(m, np.arange(12))
    z = (x - x.mean(0)) / x.std(0)
    w = coef * x.std(0)
    slope = z.T @ (y - y.mean() - z @ w) / 120 - 0.05 * w
    assert np.allclose(slope[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= 0.05 + 1e-5).all()
    out = models.tree_predictions(df, "x", "y", "fold", "boosted_trees", trees=3)
    assert out.count() == 120 and out.where(F.col("y_pred").isNull()).count() == 0


def test_strata_lower_their_number_in_two_passes(spark):
    """Ties, missing values and empty tables: as many bins as leave a row for every fold, else one."""
    rng = np.random.default_rng(3)
    value = np.round(rng.exponential(2, 90), 1)
    rows = [(i, None if i % 30 == 0 else float(v)) for i, v in enumerate(value)]
    frame = spark.createDataFrame(rows, "id long, v double")
    known = np.array([v for _, v in rows if v is not None])
    for folds, bins in ((3, 6), (8, 12), (20, 5), (60, 4)):
        got = {r["id"]: r["stratum"] for r in splits.regression_strata(frame, "v", folds, bins).collect()}
        want = dict.fromkeys(range(90), 0)
        for n in range(bins, 1, -1):
            edges = np.unique(np.quantile(known, [i / n for i in range(n + 1)]))
            tried = {i: -1 if v is None else int((edges[1:-1] <= v + 1e-12).sum()) for i, v in rows}
            counts = np.unique(list(tried.values()), return_counts=True)[1]
            if len(counts) > 1 and counts.min() >= folds:
                want = tried
                break
        assert got == want
    assert splits.regression_strata(frame.limit(0), "v").count() == 0
    assert {r["stratum"] for r in splits.regression_strata(frame.withColumn("v", F.lit(None).cast("double")), "v").collect()} == {0}
