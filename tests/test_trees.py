"""Histogram trees of all fits at once against plain row fits."""

import numpy as np
import pytest
from foldlight.operators import moments, trees
from foldlight.plans import evaluate
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((150, 6))
    x[:, 4] = rng.integers(0, 3, 150)  # few values
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 4] + 0.1 * rng.standard_normal(150) + 500
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 4, "z") for i in range(150)] + [(900, [1.0] * 6, None, 0, "z"), (901, [float("nan")] * 6, 1.0, 0, "z"), (902, [1.0] * 6, 1.0, None, "z")], "id long, x array<double>, y double, fold int, unit string")
    ids = np.array([r["h"] for r in df.where("id < 900").orderBy("id").select(F.xxhash64("id").alias("h")).collect()], np.int64)
    return x, y, ids, df.repartition(5)


def plain_tree(bins, y, w, depth, columns, l2, at=1, out=None):
    """A tree by recursion over rows: every cut of every feature tried."""
    out = {} if out is None else out
    value = (w * y).sum() / (w.sum() + l2)
    best = None
    base = (w * y).sum() ** 2 / (w.sum() + l2)
    if at < 1 << depth:
        for f in columns:
            for cut in sorted(set(bins[:, f]))[:-1]:
                a = bins[:, f] <= cut
                gain = sum((w[m] * y[m]).sum() ** 2 / (w[m].sum() + l2) for m in (a, ~a)) - base
                if best is None or gain > best[0] * (1 + 1e-9):
                    best = gain, f, cut
    if best and best[0] > trees.LEAST_GAIN * (base + 1e-12):
        _, f, cut = best
        a = bins[:, f] <= cut
        out[at] = f, cut
        for m, child in ((a, 2 * at), (~a, 2 * at + 1)):
            plain_tree(bins[m], y[m], w[m], depth, columns, l2, child, out)
    else:
        out[at] = value
    return out


def plain_value(tree, row):
    at = 1
    while isinstance(tree[at], tuple):
        f, cut = tree[at]
        at = 2 * at + int(row[f] > cut)
    return tree[at]


def plain_sums(x, y, ids, fold, fit, model):
    y = y - y.mean()
    train, own = fold != fit.fold, x[:, list(fit.chosen)]
    edges = [np.unique(np.quantile(own[train, j], np.arange(1, model.bins) / model.bins)) for j in range(own.shape[1])]
    bins = np.array([[(e < v).sum() for e, v in zip(edges, row, strict=True)] for row in own])
    base, left, total = y[train].mean(), y.copy(), np.zeros(len(y))
    for t in range(model.trees):
        w = trees.tree_weights(ids, train, fit, t, model)
        tree = plain_tree(bins[w > 0], (left - base if model.rate else left)[w > 0], w[w > 0], model.depth, trees.tree_columns(fit, t, model), model.l2)
        values = np.array([plain_value(tree, b) for b in bins])
        total += values
        left = left - model.rate * values
    p = (base + model.rate * total if model.rate else total / model.trees)[~train]
    return ((y[~train] - p) ** 2).sum()


@pytest.mark.parametrize("model", [trees.TreeModel(trees=4, depth=4, bins=8), trees.TreeModel(trees=5, depth=3, bins=16, rate=0.3, l2=1.0, rows=0.8, columns=0.7)])
def test_trees_equal_row_fits(spark, data, monkeypatch, model):
    """Sent to the tasks, or in passes over blocks of rows with several lots of fits."""
    x, y, ids, df = data
    fold = np.arange(150) % 4
    fits = [trees.Fit(0, 0, (0, 1, 4), 7), trees.Fit(1, 1, (0, 1, 2, 3, 4, 5), 7), trees.Fit(2, 3, (5,), 8), trees.Fit(3, 0, (0, 1, 4), 9)]
    want = [plain_sums(x, y, ids, fold, f, model) for f in fits]
    monkeypatch.setattr(trees, "LOT_NODES", 2 * model.trees << (model.depth + 1))
    for small, rows in ((trees.SMALL, trees.BLOCK_ROWS), (0, 1 << 18), (0, 11)):
        got = {r["fit"]: r for r in trees.tree_sums(df, "id", "x", "y", "fold", fits, model, small, rows).collect()}
        assert [got[i]["sse"] for i in range(4)] == pytest.approx(want, rel=1e-6)
        assert [got[i]["n"] for i in range(4)] == [(fold == f.fold).sum() for f in fits]
    assert trees.tree_sums(df.limit(0), "id", "x", "y", "fold", fits, model).count() == 0


def test_trees_in_the_nested_grid(spark, data, monkeypatch):
    """Tree rows stand beside linear ones: same keys, same columns, nested choices that don't see the fold."""
    x, y, ids, df = data
    monkeypatch.setitem(trees.TREES, "few", trees.TreeModel(trees=6, depth=4, bins=8))
    m = moments.fold_moments(df.where("fold is not null"), "x", ["y"], "fold")
    combos = spark.createDataFrame([("e", "correlation", "few", 2, 5), ("e", "rfe", "few", 3, 5)], evaluate.MOMENTS_KEYS)
    chosen = evaluate.grid_choices(combos, {"e": m})
    grid = evaluate.tree_grid(df, "id", "x", "y", "fold", chosen)
    linear = evaluate.evaluate_grid(combos.replace("few", "ridge", "model"), {"e": m})
    assert dict(grid.dtypes) == dict(linear.dtypes)
    rows = grid.collect()
    same = {(r["selector"], r["arm"], r["fold"]): r["chosen"] for r in linear.collect()}
    assert len(rows) == 16 and all(same[r["selector"], r["arm"], r["fold"]] == r["chosen"] for r in rows)
    fold = np.arange(150) % 4
    for r in rows:
        sse = plain_sums(x, y, ids, fold, trees.Fit(0, r["fold"], tuple(r["chosen"]), 5), trees.TREES["few"])
        truth = y[fold == r["fold"]]
        assert r["sse"] == pytest.approx(sse, rel=1e-6) and r["r2"] == pytest.approx(1 - sse / ((truth - truth.mean()) ** 2).sum(), rel=1e-6)
    both = evaluate.bias_table(grid.unionByName(linear)).collect()
    assert len(both) == 4 and all(r["apparent_r2"] is not None and r["nested_r2_pooled"] is not None for r in both)
