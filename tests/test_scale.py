import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlight.functions.permute import feistel
from foldlight.plans import resample
from foldlight.operators import information, pixels, quantiles, splits, sums, trees, truth


def test_quantiles_of_copies_round_as_duckdb_does(spark):
    # place 0.4 * 7, d = 0.8 of the way from a value to its copy: weights give the number below it
    v = next(x for x in np.arange(1, 1000) / 100 if x * (1 - 0.8000000000000003) + x * 0.8000000000000003 != x)
    df = spark.createDataFrame([(float(v),)] * 8, "v double")
    (d,) = {7 * 0.4 - 2}
    assert quantiles.exact_quantiles(df, [], "v", [0.4], weights=True).first()[0] == [v * (1 - d) + v * d]
    assert quantiles.exact_quantiles(df, [], "v", [0.4]).first()[0] == [v]
    assert v * (1 - d) + v * d in quantiles.quantile_edges(df, "v", 5).first()[0]


def test_quantiles_leave_rows_where_they_are(spark):
    """The rows of a group don't meet in a task: only sketches, counts and rows in bands are shuffled."""
    df = spark.range(40_000, numPartitions=4).select((F.col("id") % 1).alias("name"), F.col("id").cast("double").alias("v"))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quantiles.exact_quantiles(df, ["name"], "v", [0.25, 0.75])
        assert out.first()["quantiles"] == [9999.75, 29999.25]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert truth.iqr_bounds(df, ["v"]).first()[0] == 9999.75 - 1.5 * 19999.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert "BroadcastHashJoin" in plan


def test_ranked_deals_large_tables_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(splits, "TASK_ROWS", 100)
    monkeypatch.setattr(splits, "BUCKET_ROWS", 16)
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("c"))
    out = splits.ranked(df, splits.shuffle_key(F.col("id"), 1), ["c"], size="n")
    assert out.rdd.getNumPartitions() >= 20  # and not as few as spark.sql.shuffle.partitions
    want = sorted((hashlib.md5(f"1|{i}".encode()).hexdigest(), i) for i in range(2000))
    place, seen = {}, {0: 0, 1: 0, 2: 0}
    for _, i in want:
        place[i] = seen[i % 3]
        seen[i % 3] += 1
    assert all(r["rank"] == place[r["id"]] and r["n"] == seen[r["id"] % 3] for r in out.collect())


def test_cluster_rounds_are_one_job_each(spark):
    df = spark.createDataFrame([(i % 2, i, [float((i * 37 % 101) ** 2 % 89), float(i * 53 % 97)]) for i in range(400)], "image int, i long, s array<double>").withColumn("score", F.get("s", F.lit(1)))
    sc = spark.sparkContext
    sc.setJobGroup("clusters", "")
    try:
        out = pixels.cluster_mask_together(df, "image", "s", "score", place=["i"])
        jobs = len(sc.statusTracker().getJobIdsForGroup("clusters"))
        masks = {r["i"]: r["in_mask"] for r in out.collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert masks == {r["i"]: r["in_mask"] for r in pixels.cluster_mask(df, "image", "s", "score", place=["i"]).collect()}
    assert jobs < 75  # and not several a round


@pytest.mark.parametrize("model", [trees.TreeModel(trees=4, depth=5, bins=8), trees.TreeModel(trees=4, depth=3, bins=8, rate=0.2, l2=1.0, rows=0.9, columns=0.9)])
def test_trees_of_a_fit_grow_in_one_task_as_by_levels(spark, model, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5)).round(2)
    df = spark.createDataFrame([(i, x[i].tolist(), float(x[i, 0] - x[i, 3] ** 2), i % 3) for i in range(300)], "id long, x array<double>, y double, fold int").repartition(3)
    fits = [trees.Fit(0, 0, (0, 3), 1), trees.Fit(1, 1, (3, 1, 0), 1), trees.Fit(2, 2, (4,), 2)]
    sums = lambda **ways: {r["fit"]: tuple(r)[1:] for r in trees.tree_sums(df, "id", "x", "y", "fold", fits, model, **ways).collect()}
    levels, sent = sums(small=0, fit_rows=0), sums()
    monkeypatch.setattr(trees, "level_splits", None)  # no pass over the rows for each level
    dealt = sums(small=0)
    for i in range(3):
        assert dealt[i] == pytest.approx(levels[i], abs=1e-9) and dealt[i] == pytest.approx(sent[i], abs=1e-9)


def test_information_in_lots_leaves_nothing_behind(spark):
    df = spark.createDataFrame([(i, [float(i * 37 % 101), float(i * 53 % 97), float(i % 7)], float(i * 11 % 89), i % 2) for i in range(200)], "id long, x array<double>, y double, part int")
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    whole = {(r["part"], r["pos"]): r["mi"] for r in information.nearest_information(df, "x", "y", by="part", tile=40).collect()}
    had = held()
    lots = {(r["part"], r["pos"]): r["mi"] for r in information.nearest_information(df, "x", "y", by="part", tile=40, lot=200).collect()}
    assert lots == pytest.approx(whole, abs=1e-12) and len(lots) == 6
    assert held() <= had + 1  # scales of sets and features


def test_plans_of_many_tiles_stay_small(spark):
    """The driver describes a plan at each of its stages: plans begin at files, which go with the lot."""
    df = spark.createDataFrame([(i, [float(i * 37 % 101), float(i * 53 % 97)], float(i * 11 % 89)) for i in range(260)], "id long, x array<double>, y double")
    whole = {r["pos"]: r["mi"] for r in information.nearest_information(df, "x", "y", "id").collect()}
    folder, store = Path(sums.shared_folder(spark).removeprefix("file:")), spark._jsparkSession.sharedState().statusStore()

    def described() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        all_ = store.executionsList()
        return {e.executionId(): len(e.physicalPlanDescription()) for e in map(all_.apply, range(all_.size()))}

    had, files = described(), set(folder.iterdir())
    tiles = {r["pos"]: r["mi"] for r in information.nearest_information(df, "x", "y", "id", tile=12).collect()}
    assert tiles == pytest.approx(whole, abs=1e-12)
    sizes = [n for i, n in described().items() if i not in had]
    assert sizes and max(sizes) < 200_000  # and not 100 million
    assert set(folder.iterdir()) == files


def test_noise_is_drawn_from_spark_hashes(spark):
    rows = spark.range(50).withColumn("h", F.xxhash64(F.lit(7), F.col("id").cast("string")))
    unit = lambda i, part: (F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("id").cast("string"), F.lit(i), F.lit(part)), 11) + 1).cast("double") / float(1 << 53)
    want = rows.select("h", *(F.sqrt(-2 * F.ln(unit(i, 0))) * F.cos(2 * np.pi * unit(i, 1)) for i in range(3))).collect()
    got = resample.normal_numbers(np.array([r["h"] for r in want]), 3)
    assert got == pytest.approx(np.array([list(r)[1:] for r in want]), abs=1e-12)


def test_md5_of_many_keys(spark, monkeypatch):
    texts = [b"", *(b"|" + bytes([65 + i % 26]) * (i % 90) for i in range(150))]
    for head in (b"42|7", b"42|199"):
        assert resample.key_hashes(texts, head).tolist() == [int(hashlib.md5(head + t).hexdigest()[:8], 16) for t in texts]


def test_poisson_intervals_repeat_no_rows(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("k"), F.sin("id").alias("y_true"), F.when(F.col("id") % 5 > 0, F.sin("id") * 0.9 + 0.1).alias("y_pred"))
    out = resample.poisson_intervals(df, ["g"], "k", n_boot=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "md5(" not in plan
    rows, steps = df.collect(), np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(9)])
    for r in out.collect():
        mine, scores = [x for x in rows if x["g"] == r["g"]], []
        for b in range(1, 21):
            w = np.array([(int(hashlib.md5(f"42|{b}|{x['k']}".encode()).hexdigest()[:8], 16) / 2**32 >= steps).sum() for x in mine])
            y = np.array([x["y_true"] for x in mine])
            e = np.array([0.0 if x["y_pred"] is None else (x["y_true"] - x["y_pred"]) ** 2 for x in mine])
            scores.append(1 - (w * e).sum() / ((w * y * y).sum() - (w * y).sum() ** 2 / w.sum()))
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(scores, [0.025, 0.975])), abs=1e-9) and r["n_boot"] == 20


def test_points_meet_few_cells():
    """Neighbours inside a tile equal brute force, copies included, and so do counts on an axis."""
    rng = np.random.default_rng(4)
    x, y, m = rng.standard_normal(3000).round(2), rng.standard_normal(3000), np.where(rng.random(3000) < 0.1, 3, 1)
    cells = information.Cells(x, y, m, 3)
    near, own = cells.own(len(x), 3)
    near = cells.search(x, y, near[:, 3], near, own)[:, 1:]
    far = np.maximum(np.abs(x[:, None] - np.repeat(x, m)), np.abs(y[:, None] - np.repeat(y, m)))
    assert (np.sort(far, axis=1)[:, 1:4] == near).all()
    values, of = np.unique(x, return_inverse=True)
    upto = np.concatenate(([0], np.cumsum(np.bincount(of, m)).astype(int)))
    r = near[:, 2]
    assert information.nearer_than(values, upto, x, r).tolist() == [m[np.abs(x - a) < b].sum() if b > 0 else m[x == a].sum() for a, b in zip(x, r, strict=True)]


def test_leaf_masks_read_the_pixels_once_more_at_most(spark):
    """One pass for each mask method's bits and one for the result; an image without a first mask takes the second."""
    rows = [(im, r, c, [0.1, 0.2, 0.1, (0.9 if im else 0.02) if 2 < r < 9 and 2 < c < 9 else 0.01]) for im in (0, 1) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, "image int, row int, col int, s array<double>")
    out = pixels.leaf_masks(df, "image", "s", [450, 550, 670, 800], "ndvi")
    assert out.where("in_mask").groupBy("image").count().collect() == [(1, 36)]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapGroupsInArrow") + plan.count("FlatMapGroupsInPandas") == 1


def test_resampled_rows_carry_no_paths(spark, monkeypatch):
    """The tree's path is one row a bucket, and larger keys are dealt to more tasks."""
    monkeypatch.setattr(resample, "TASK_ROWS", 50)
    df = spark.range(1000).select(F.lit("a").alias("by"), F.xxhash64("id").alias("id"), F.sin("id").alias("y"), F.cos("id").alias("e2"))
    out = resample.resampled_sums(df, 5, 1, 1000, bucket_rows=64)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "RepartitionByExpression" in plan and ", 20" in plan
    assert [r["n"] for r in out.collect()] == [1000] * 5


def test_rank_correlations_in_parts(spark, monkeypatch):
    """Ranks counted in parts equal those of whole sets, ties included; rows aren't joined with their ranks."""
    from foldlight.operators import rowselect

    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("s"), F.round(F.sin("id"), 1).alias("y"), F.array(F.round(F.sin(F.col("id") + 1), 2), F.lit(0.0), F.col("id") * 1.0).alias("x"))
    whole = {(r["s"], r["pos"]): r["score"] for r in rowselect.rank_correlation(df, "x", "y", None, "s").collect()}
    monkeypatch.setattr(rowselect, "TILE", 30)
    out = rowselect.rank_correlation(df, "x", "y", None, "s")
    assert {(r["s"], r["pos"]): r["score"] for r in out.collect()} == pytest.approx(whole, abs=1e-12) and len(whole) == 6
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_shuffled_targets_meet_in_blocks(spark, monkeypatch):
    """Each shuffle is the keyed permutation of ranks; no row is made for each row and shuffle, features move once."""
    monkeypatch.setattr(resample, "SHUFFLED_ROWS", 16, raising=False)
    df = spark.range(300).select("id", (F.col("id") * 7 % 301).alias("y"))
    wide, names = resample.permuted_targets(df, "id", "y", 30, seed=5)
    assert "Generate" not in wide._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(range(300), key=lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())
    y, rows = np.array([i * 7 % 301 for i in order]), {r["id"]: r for r in wide.collect()}
    assert len(rows) == 300 and all(rows[i]["y_0"] == i * 7 % 301 for i in rows)
    for p in (1, 2, 30):
        assert [rows[i][f"y_{p}"] for i in order] == y[feistel(np.arange(300), 300, (5 << 20) + p)].tolist()
    for size in (1, 2, 300, 5000):
        assert (feistel(feistel(np.arange(size), size, 9), size, 9, back=True) == np.arange(size)).all()


def test_rows_that_do_not_count_are_not_shuffled(spark):
    """A row without a target or with a NaN leaves the others as they are, observed and shuffled."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 4))
    good = spark.createDataFrame([(i, x[i].tolist(), float(x[i, 1] + 0.5 * x[i, 3] + 0.1 * i % 1), i % 3) for i in range(60)], "id long, x array<double>, y double, fold int")
    bad = spark.createDataFrame([(100, [1.0] * 4, None, 0), (101, [float("nan")] * 4, 1.0, 1), (102, None, 1.0, 1)], good.schema)
    run = lambda df: resample.permutation_grid(df, "id", "x", "y", "fold", [("correlation", "ridge", 2)], 20).first().asDict()
    alone = run(good)
    assert run(good.unionByName(bad)) == pytest.approx(alone, abs=1e-9) and alone["observed_nested_r2"] > 0.5
