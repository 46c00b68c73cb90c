"""Nearest-neighbour information against brute force."""

import numpy as np
import pandas as pd
import pytest
from foldlight.operators import information, rowselect
from foldlight.plans import evaluate
from pyspark.sql import functions as F

psi = lambda n: sum(1 / i for i in range(1, int(n))) - information.EULER


def brute(x, y, k=3):
    scale = lambda v: v / (v.std() if v.std() > 0 else 1)
    x, y = scale(x), scale(y)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    far = np.maximum(dx, dy) + np.diag(np.full(len(x), np.inf))
    r = np.sort(far, axis=1)[:, k - 1]
    count = lambda d: np.where(r > 0, (d < r[:, None]).sum(1), (d == 0).sum(1))
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(n) for n in count(dx)]) - np.mean([psi(n) for n in count(dy)]))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    y = rng.standard_normal(260)
    x = np.stack([y + 0.3 * rng.standard_normal(260), rng.standard_normal(260), np.round(y), np.where(rng.random(260) < 0.4, 0.0, rng.random(260)), np.full(260, 2.5), rng.exponential(1, 260) ** 4], axis=1)
    x[:30], y[:30] = x[0], y[0]  # equal points
    return x, y


@pytest.mark.parametrize("tile", [2048, 12, 3])
def test_information_equals_brute_force(spark, data, tile):
    x, y = data
    frame = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 2) for i in range(len(y))] + [(900, [float("nan")] * 6, 1.0, 0), (901, [1.0] * 6, None, 1), (902, None, 1.0, 1)], "id long, x array<double>, y double, part int").repartition(3)
    got = {r["pos"]: r["mi"] for r in information.nearest_information(frame, "x", "y", tile=tile).collect()}
    assert [got[j] for j in range(6)] == pytest.approx([brute(x[:, j], y) for j in range(6)], abs=1e-9) and got[0] > 0.5 > got[1]
    if tile == 12:
        sets = {(r["part"], r["pos"]): r["mi"] for r in information.nearest_information(frame, "x", "y", by="part", tile=tile).collect()}
        rows = np.arange(len(y)) % 2
        assert [sets[s, j] for s in (0, 1) for j in range(6)] == pytest.approx([brute(x[rows == s, j], y[rows == s]) for s in (0, 1) for j in range(6)], abs=1e-9)
        few = information.nearest_information(frame.where("id < 33 and id > 29"), "x", "y").collect()
        assert len(few) == 6 and all(r["mi"] is None for r in few)


@pytest.mark.parametrize("parts", [1, 5, information.COMPILED, information.COMPILED + 1])
def test_parts_of_values(spark, parts):
    edges = [i / parts for i in range(1, parts)]
    values = [-1.0, 0.0, *edges, *(e + 1e-9 for e in edges), 0.999, 2.0]
    rows = spark.createDataFrame([(v, edges) for v in values], "v double, e array<double>")
    got = rows.select("v", information.part_of(F.col("v"), "e", parts).alias("part"))
    assert [r["part"] for r in got.orderBy("v").collect()] == [int(n) for n in np.searchsorted(edges, sorted(values))]
    assert ("lambdafunction" in got._jdf.queryExecution().optimizedPlan().toString()) == (parts > information.COMPILED)


def test_jitter_orders_equal_values(spark, data):
    """Values moved by a hash: repeatable, and near what any tiny noise gives."""
    x, y = data
    x, y = x[30:], y[30:]
    frame = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(len(y))], "id long, x array<double>, y double")
    one, two = ({r["pos"]: r["mi"] for r in information.nearest_information(frame.repartition(n), "x", "y", "id", tile=20).collect()} for n in (2, 5))
    assert one == pytest.approx(two, abs=1e-9)
    rng = np.random.default_rng(1)
    noisy = [brute(x[:, j] + 1e-10 * rng.standard_normal(len(y)), y) for j in (0, 1, 2)]
    assert [one[j] for j in (0, 1, 2)] == pytest.approx(noisy, abs=0.05)


def test_choices_by_nearest_information(spark, data):
    x, y = data
    frame = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3) for i in range(30, len(y))], "id long, x array<double>, y double, fold int")
    chosen = evaluate.nearest_choices(frame, "id", "x", "y", "fold", 2)
    fold = np.arange(30, len(y)) % 3
    for part, got in zip((None, 0, 1, 2), chosen, strict=True):
        rows = np.arange(30, len(y))[fold != part] if part is not None else np.arange(30, len(y))
        mi = [brute(x[rows, j] + 1e-10 * j, y[rows]) for j in range(6)]
        assert 0 in got and set(got.tolist()) <= set(np.argsort(mi)[-4:].tolist())
    assert frame.where(F.col("fold") == 1).count() > 0


def test_row_selectors_by_name(spark, data):
    """Rank correlations equal pandas' with ties and gaps; a selector of one's own takes part by its name."""
    x, y = data
    x = x.copy()
    x[::7, 1] = np.nan
    frame = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x[i]], float(y[i]) if i % 9 else None, i % 2) for i in range(len(y))], "id long, x array<double>, y double, part int")
    got = {(r["part"], r["pos"]): r["score"] for r in rowselect.rank_correlation(frame, "x", "y", None, "part").collect()}
    keep = np.arange(len(y)) % 9 > 0
    for s in (0, 1):
        rows = keep & (np.arange(len(y)) % 2 == s)
        for j in range(6):
            want = pd.Series(x[rows, j]).where(pd.notna(x[rows, j])).rank()
            both = pd.notna(want)
            r = pd.Series(x[rows, j])[both].rank().corr(pd.Series(y[rows])[both].rank())
            assert got[s, j] == pytest.approx(0.0 if np.isnan(r) else abs(r), abs=1e-12)
    assert rowselect.rank_correlation(frame.limit(0), "x", "y", None, "part").count() == 0

    def last_wins(rows, features, target, key, by):
        return rows.select(by, F.posexplode(features).alias("pos", "v")).groupBy(by, "pos").agg(F.max(F.col("pos").cast("double")).alias("score"))

    rowselect.ROW_SELECTORS["last_wins"] = last_wins
    try:
        chosen = evaluate.choices_by_rows(frame, "id", "x", "y", "part", 2, "last_wins")
    finally:
        del rowselect.ROW_SELECTORS["last_wins"]
    assert [c.tolist() for c in chosen] == [[4, 5]] * 3
    with pytest.raises(ValueError, match="unknown selector"):
        evaluate.choices_by_rows(frame, "id", "x", "y", "part", 2, "no_such")
