"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import indices, labels, spectra
from .operators import information, models, moments, pixels, quantiles, rowselect, splits, truth
from .plans import bands, evaluate, features, resample, stats
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
WAVES = [400 + 600 * i / 63 for i in range(64)]
MOMENTS_GRID = evaluate.MOMENTS_KEYS


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_number(text: Column) -> Column:
    """A number in [0, 1) from md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra with a target, group folds by vec_id % 25 and folds."""
    e = F.col("embedding").cast("array<double>")
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("x"))
    y = 2 * F.get("x", F.lit(6)) - 1.5 * F.get("x", F.lit(32)) + F.get("x", F.lit(50)) + 0.25 * unit_number(F.col("vec_id").cast("string"))
    return df.withColumns({"y": y, "grp": F.col("vec_id") % 25, "fold": (F.col("vec_id") % 5).cast("int")})


SAMPLES = """s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, vec_id % 25 AS grp, CAST(vec_id % 5 AS INTEGER) AS fold,
  2 * CAST(embedding[7] AS DOUBLE) - 1.5 * CAST(embedding[33] AS DOUBLE) + CAST(embedding[51] AS DOUBLE) + 0.25 * (CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0) AS y FROM embeddings)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null and -0.0 as 0.0, so that engines agree."""
    return df.select(*((F.round(F.when(~F.isnan(c), F.col(c)), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- one feature, one line: how much is R2 inflated -------------------------------------------------------


@query(f"""
WITH {SAMPLES}, long AS (SELECT vec_id, fold, y, unnest(range(64)) AS pos, unnest(x) AS v FROM s),
tr AS (SELECT f.fold AS k, pos, abs(corr(v, y)) AS c FROM long JOIN (SELECT DISTINCT fold FROM s) f ON long.fold <> f.fold GROUP BY ALL),
pick AS (SELECT k AS fold, arg_max(pos, (round(c, 9), -pos)) AS nested FROM tr GROUP BY k),
whole AS (SELECT arg_max(pos, (round(c, 9), -pos)) AS apparent FROM (SELECT pos, abs(corr(v, y)) AS c FROM long GROUP BY pos)),
arms AS (SELECT fold, 'nested' AS arm, nested AS pos FROM pick UNION ALL SELECT fold, 'apparent', apparent FROM pick, whole),
fit AS (SELECT a.fold, a.arm, a.pos, regr_slope(l.y, l.v) AS b, regr_intercept(l.y, l.v) AS b0 FROM arms a JOIN long l ON l.pos = a.pos AND l.fold <> a.fold GROUP BY ALL)
SELECT f.arm, f.fold, CAST(f.pos AS INTEGER) AS pos, round(1 - sum((l.y - b0 - b * l.v) ^ 2) / (var_pop(l.y) * count(*)), 6) AS r2
FROM fit f JOIN long l ON l.pos = f.pos AND l.fold = f.fold GROUP BY f.arm, f.fold, f.pos
""")
def inflation_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.fold_moments(samples(spark, sf_dir), "x", ["y"], "fold")
    combos = spark.createDataFrame([("e", "correlation", "ols", 1, 42)], "dataset string, selector string, model string, k int, seed int")
    scores = evaluate.evaluate_grid(combos, {"e": m})
    return rounded(scores.select("arm", "fold", F.get("chosen", F.lit(0)).alias("pos"), "r2"))


ONE = """pr AS (SELECT DISTINCT fold AS k FROM s), lg AS (SELECT vec_id, fold, y, unnest(range(64)) AS pos, unnest(x) AS v FROM s),
st AS (SELECT k, pos, count(*) AS n, avg(v) AS mx, avg(y) AS my, regr_sxx(y, v) AS sxx, regr_sxy(y, v) AS sxy, abs(corr(v, y)) AS c FROM lg JOIN pr ON lg.fold <> k GROUP BY ALL),
al AS (SELECT arg_max(pos, (round(c, 9), -pos)) AS pos FROM (SELECT pos, abs(corr(v, y)) AS c FROM lg GROUP BY pos)),
ch AS (SELECT k, 'nested' AS arm, arg_max(pos, (round(c, 9), -pos)) AS pos FROM st GROUP BY k UNION ALL SELECT k, 'apparent', al.pos FROM pr, al),
md AS (SELECT k, arm, pos, mx, my, unnest([{'m': 'ols', 'b': sxy / sxx}, {'m': 'pls', 'b': sxy / sxx}, {'m': 'ridge', 'b': sxy / (sxx + 1)},
  {'m': 'elastic_net', 'b': sign(sxy) * greatest(abs(sxy / sqrt(sxx / n) / n) - 0.05, 0) / 1.05 / sqrt(sxx / n)}]) AS f FROM ch JOIN st USING (k, pos)),
fs AS (SELECT f.m AS model, arm, k, count(*) AS n, avg(y) AS m, sum((y - my - f.b * (v - mx)) ^ 2) AS sse, var_pop(y) * count(*) AS sst FROM md JOIN lg ON lg.pos = md.pos AND lg.fold = k GROUP BY ALL),
sc AS (SELECT *, 1 - sse / sst AS r2, sqrt(sse / n) AS rmse FROM fs)"""
ARM = ", ".join(f"round(avg({c}) FILTER (WHERE arm = '{a}'), 6) AS {a}_{c}, round(stddev_pop({c}) FILTER (WHERE arm = '{a}'), 6) AS {a}_{c}_std" for a in ("apparent", "nested") for c in ("r2", "rmse"))
POOLED = {a: f"(1 - sum(sse) FILTER (WHERE arm = '{a}') / (sum(sst) FILTER (WHERE arm = '{a}') + sum(n * m * m) FILTER (WHERE arm = '{a}') - (sum(n * m) FILTER (WHERE arm = '{a}')) ^ 2 / sum(n) FILTER (WHERE arm = '{a}')))" for a in ("apparent", "nested")}
WITHIN = {a: f"(1 - sum(sse) FILTER (WHERE arm = '{a}') / sum(sst) FILTER (WHERE arm = '{a}'))" for a in ("apparent", "nested")}


def chosen_by_correlation(spark: SparkSession, df: DataFrame, fits: list[str], k: int) -> DataFrame:
    m = moments.fold_moments(df, "x", ["y"], "fold")
    return evaluate.evaluate_grid(spark.createDataFrame([("e", "correlation", f, k, 42) for f in fits], "dataset string, selector string, model string, k int, seed int"), {"e": m})


@query(f"""
WITH {SAMPLES}, {ONE}
SELECT model, {ARM}, round({WITHIN["apparent"]}, 6) AS apparent_r2_within, round({WITHIN["nested"]}, 6) AS nested_r2_within, round({POOLED["apparent"]}, 6) AS apparent_r2_pooled, round({POOLED["nested"]}, 6) AS nested_r2_pooled,
  round(avg(r2) FILTER (WHERE arm = 'apparent') - avg(r2) FILTER (WHERE arm = 'nested'), 6) + 0.0 AS bias, round(avg(rmse) FILTER (WHERE arm = 'nested') - avg(rmse) FILTER (WHERE arm = 'apparent'), 6) + 0.0 AS bias_rmse, round({POOLED["apparent"]} - {POOLED["nested"]}, 6) + 0.0 AS bias_pooled
FROM sc GROUP BY model
""")
def bias_of_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linear model on the one feature that correlates best, chosen on all rows or inside each fold's train rows."""
    scores = chosen_by_correlation(spark, samples(spark, sf_dir), ["ols", "pls", "ridge", "elastic_net"], 1)
    return rounded(evaluate.bias_table(scores, ["model"]))


@query(f"""
WITH {SAMPLES}, {ONE} SELECT model, string_agg(printf('%.4f', r2), ';' ORDER BY k) AS fold_scores FROM sc WHERE arm = 'nested' GROUP BY model
""")
def fold_scores_of_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = chosen_by_correlation(spark, samples(spark, sf_dir), ["ols", "pls", "ridge", "elastic_net"], 1)
    return evaluate.summary_table(scores, ["model"]).select("model", "fold_scores")


@query(f"""
WITH {SAMPLES}, lg AS (SELECT vec_id, fold, y, unnest(range(64)) AS pos, unnest(x) AS v FROM s), pr AS (SELECT DISTINCT fold AS k FROM s UNION ALL SELECT -1),
tr AS (SELECT k, lg.* FROM lg JOIN pr ON lg.fold <> k),
ed AS (SELECT k, pos, quantile_cont(v, [1/8, 2/8, 3/8, 4/8, 5/8, 6/8, 7/8]) AS ex, quantile_cont(y, [1/8, 2/8, 3/8, 4/8, 5/8, 6/8, 7/8]) AS ey FROM tr GROUP BY ALL),
jt AS (SELECT k, pos, len(list_filter(ex, lambda q: q <= v)) AS bx, len(list_filter(ey, lambda q: q <= y)) AS by_, count(*) AS n FROM tr JOIN ed USING (k, pos) GROUP BY ALL),
mi AS (SELECT k, pos, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY k, pos, bx) AS nx, sum(n) OVER (PARTITION BY k, pos, by_) AS ny, sum(n) OVER (PARTITION BY k, pos) AS t FROM jt) GROUP BY ALL),
bs AS (SELECT k, arg_max(pos, (round(mi, 9), -pos)) AS pos FROM mi GROUP BY k),
ch AS (SELECT k, 'nested' AS arm, pos FROM bs WHERE k >= 0 UNION ALL SELECT k, 'apparent', (SELECT pos FROM bs WHERE k = -1) FROM bs WHERE k >= 0),
ft AS (SELECT ch.*, regr_slope(y, v) AS b, regr_intercept(y, v) AS b0 FROM ch JOIN lg ON lg.pos = ch.pos AND lg.fold <> k GROUP BY ALL)
SELECT ft.arm, CAST(ft.k AS INTEGER) AS fold, CAST(ft.pos AS INTEGER) AS pos, round(1 - sum((y - b0 - b * v) ^ 2) / (var_pop(y) * count(*)), 6) AS r2 FROM ft JOIN lg ON lg.pos = ft.pos AND lg.fold = ft.k GROUP BY ALL
""")
def inflation_by_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inflation_one_feature with the feature of the most mutual information."""
    df = samples(spark, sf_dir)
    m, chosen = moments.fold_moments(df, "x", ["y"], "fold"), evaluate.informative_choices(df, "x", "y", "fold", 1)
    scores = evaluate.score_choices(spark, "e", m, "mutual_info", chosen, ["ols"])
    return rounded(scores.select("arm", "fold", F.get("chosen", F.lit(0)).alias("pos"), "r2"))


@query(f"""
WITH {SAMPLES}, lg AS (SELECT vec_id, fold, y, unnest(range(64)) AS pos, unnest(x) AS v FROM s), pr AS (SELECT DISTINCT fold AS k FROM s UNION ALL SELECT -1),
rk AS (SELECT k, pos, rank() OVER (PARTITION BY k, pos ORDER BY v) + (count(*) OVER (PARTITION BY k, pos, v) - 1) / 2 AS rx, rank() OVER (PARTITION BY k, pos ORDER BY y) + (count(*) OVER (PARTITION BY k, pos, y) - 1) / 2 AS ry FROM lg JOIN pr ON lg.fold <> k),
sc AS (SELECT k, pos, abs(corr(rx, ry)) AS c FROM rk GROUP BY ALL), bs AS (SELECT k, arg_max(pos, (round(c, 9), -pos)) AS pos FROM sc GROUP BY k),
ch AS (SELECT k, 'nested' AS arm, pos FROM bs WHERE k >= 0 UNION ALL SELECT k, 'apparent', (SELECT pos FROM bs WHERE k = -1) FROM bs WHERE k >= 0),
ft AS (SELECT ch.*, regr_slope(y, v) AS b, regr_intercept(y, v) AS b0 FROM ch JOIN lg ON lg.pos = ch.pos AND lg.fold <> k GROUP BY ALL)
SELECT ft.arm, CAST(ft.k AS INTEGER) AS fold, CAST(ft.pos AS INTEGER) AS pos, round(1 - sum((y - b0 - b * v) ^ 2) / (var_pop(y) * count(*)), 6) AS r2 FROM ft JOIN lg ON lg.pos = ft.pos AND lg.fold = ft.k GROUP BY ALL
""")
def inflation_by_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inflation_one_feature with a selector that needs rows: the feature of the largest rank correlation."""
    df = samples(spark, sf_dir)
    m, chosen = moments.fold_moments(df, "x", ["y"], "fold"), evaluate.choices_by_rows(df, "vec_id", "x", "y", "fold", 1, "rank_correlation")
    scores = evaluate.score_choices(spark, "e", m, "rank_correlation", chosen, ["ols"])
    return rounded(scores.select("arm", "fold", F.get("chosen", F.lit(0)).alias("pos"), "r2"))


@query(f"""
WITH {SAMPLES}, lg AS (SELECT vec_id, y, unnest(range(64)) AS pos, CASE WHEN vec_id % 3 > 0 THEN round(unnest(x), 1) END AS v FROM s),
rk AS (SELECT pos, rank() OVER (PARTITION BY pos ORDER BY v) + (count(*) OVER (PARTITION BY pos, v) - 1) / 2 AS rx, rank() OVER (PARTITION BY pos ORDER BY y) + (count(*) OVER (PARTITION BY pos, y) - 1) / 2 AS ry FROM lg WHERE v IS NOT NULL)
SELECT CAST(pos AS INTEGER) AS pos, round(coalesce(abs(corr(rx, ry)), 0), 6) AS score FROM rk GROUP BY pos
""")
def rank_correlations_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of features that are rounded (ties) and missing in a third of the rows."""
    coarse = F.transform("x", lambda v: F.when(F.col("vec_id") % 3 > 0, F.round(v, 1)))
    df = samples(spark, sf_dir).select("y", coarse.alias("x"), F.lit(0).alias("part"))
    return rounded(rowselect.rank_correlation(df, "x", "y", None, "part").select("pos", "score"))


GAPS = SAMPLES.replace(" FROM embeddings)", " FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 13 <> 0)")


@query(ORACLE["inflation_one_feature"].replace(SAMPLES, GAPS))
def inflation_of_finite_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inflation_one_feature where some targets are NaN or missing: their rows don't count."""
    y = F.when(F.col("vec_id") % 11 == 0, float("nan")).when(F.col("vec_id") % 13 != 0, F.col("y"))
    scores = chosen_by_correlation(spark, samples(spark, sf_dir).withColumn("y", y), ["ols"], 1)
    return rounded(scores.select("arm", "fold", F.get("chosen", F.lit(0)).alias("pos"), "r2"))


FIVE = """pr AS (SELECT DISTINCT fold AS k FROM s), lg AS (SELECT vec_id, fold, y, unnest(range(64)) AS pos, unnest(x) AS v FROM s),
nc AS (SELECT k, pos FROM (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY abs(corr(v, y)) DESC, pos) AS rk FROM lg JOIN pr ON lg.fold <> k GROUP BY k, pos) WHERE rk <= 5),
ac AS (SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY abs(corr(v, y)) DESC, pos) AS rk FROM lg GROUP BY pos) WHERE rk <= 5)"""


@query(f"WITH {SAMPLES}, {FIVE} SELECT CAST(p.pos AS INTEGER) AS pos, count(nc.k) / (SELECT count(*) FROM pr) AS frequency FROM (SELECT unnest(range(64)) AS pos) p LEFT JOIN nc USING (pos) GROUP BY p.pos")
def frequency_of_correlated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = chosen_by_correlation(spark, samples(spark, sf_dir), ["ols"], 5)
    return rounded(bands.selection_frequency(scores, ["model"], 64).drop("model"))


@query(f"""
WITH {SAMPLES}, {FIVE}, o AS (SELECT k, count(ac.pos) AS common FROM nc LEFT JOIN ac USING (pos) GROUP BY k)
SELECT 'ols' AS model, round(avg(common / 5), 6) AS mean_overlap_frac, round(avg(common / (10 - common)), 6) AS mean_jaccard, 5.0::DOUBLE AS mean_apparent_k, 5.0::DOUBLE AS mean_nested_k FROM o
""")
def overlap_of_correlated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.mask_overlap(chosen_by_correlation(spark, samples(spark, sf_dir), ["ols"], 5), ["model"]))


def one_by_split(name: str, fold: str) -> str:
    """Fold-mean R2 of both arms of the best correlated feature for one way of making folds."""
    return f"""{name}s AS (SELECT vec_id, y, x, {fold} AS fold FROM s), {name}g AS (SELECT fold, y, unnest(range(64)) AS pos, unnest(x) AS v FROM {name}s),
{name}t AS (SELECT k, pos, regr_slope(y, v) AS b, regr_intercept(y, v) AS b0, abs(corr(v, y)) AS c FROM {name}g JOIN (SELECT DISTINCT fold AS k FROM {name}s) ON fold <> k GROUP BY ALL),
{name}c AS (SELECT k, 'nested' AS arm, arg_max(pos, (round(c, 9), -pos)) AS pos FROM {name}t GROUP BY k UNION ALL SELECT DISTINCT k, 'apparent', (SELECT arg_max(pos, (round(c, 9), -pos)) FROM (SELECT pos, abs(corr(v, y)) AS c FROM {name}g GROUP BY pos)) FROM {name}t),
{name}r AS (SELECT arm, avg(r2) AS r2 FROM (SELECT arm, k, 1 - sum((y - b0 - b * v) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM {name}c JOIN {name}t USING (k, pos) JOIN {name}g ON {name}g.pos = {name}c.pos AND {name}g.fold = k GROUP BY ALL) GROUP BY arm)"""


@query(f"""
WITH {SAMPLES}, gr AS (SELECT grp, (row_number() OVER (ORDER BY md5('42|' || grp)) - 1) % 5 AS gf FROM (SELECT DISTINCT grp FROM s)),
{one_by_split("pa", "(row_number() OVER (ORDER BY md5('42|' || vec_id)) - 1) % 5")},
{one_by_split("pb", "(SELECT gf FROM gr WHERE gr.grp = s.grp)")},
p AS (SELECT (SELECT r2 FROM par WHERE arm = 'apparent') AS p1, (SELECT r2 FROM pbr WHERE arm = 'apparent') AS p2, (SELECT r2 FROM pbr WHERE arm = 'nested') AS p3)
SELECT 'ols' AS model, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p1 - p2, 6) + 0.0 AS group_leak, round(p2 - p3, 6) + 0.0 AS sel_leak FROM p
""")
def three_pipelines_of_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random folds against whole groups (all of one size here), apparent against nested choice."""
    df = samples(spark, sf_dir).drop("fold")
    random, grouped = (chosen_by_correlation(spark, f, ["ols"], 1) for f in (splits.shuffled_folds(df, "vec_id"), splits.group_folds(df, "grp")))
    return rounded(evaluate.three_pipelines(random, grouped, ["model"]))


@query(f"""
WITH {SAMPLES}, {one_by_split("pa", "(row_number() OVER (ORDER BY md5('42|' || vec_id)) - 1) % 5")}, {one_by_split("pb", "vec_id % 3")}
SELECT 'ols' AS model, round((SELECT r2 FROM par WHERE arm = 'apparent'), 6) AS p1, CAST(NULL AS DOUBLE) AS p2, round((SELECT r2 FROM pbr WHERE arm = 'nested'), 6) AS p3, CAST(NULL AS DOUBLE) AS group_leak, CAST(NULL AS DOUBLE) AS sel_leak
""")
def three_pipelines_of_few_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups can't fill five folds, so the second pipeline and the differences from it are missing."""
    df = samples(spark, sf_dir).drop("fold").withColumn("grp", F.col("vec_id") % 3)
    random, grouped = (chosen_by_correlation(spark, f, ["ols"], 1) for f in (splits.shuffled_folds(df, "vec_id"), splits.group_folds(df, "grp")))
    return rounded(evaluate.three_pipelines(random, grouped, ["model"]))


def grid_scores(spark: SparkSession, sf_dir: str, fold: str | None = None) -> DataFrame:
    df = samples(spark, sf_dir)
    df = splits.group_folds(df.drop("fold"), "grp") if fold == "group" else splits.shuffled_folds(df.drop("fold"), "vec_id") if fold == "random" else df
    m = moments.fold_moments(df, "x", ["y"], "fold")
    combos = [("e", s, f, k, 42) for s in models.SELECTORS for f in models.MODELS for k in (5, 20)]
    return evaluate.evaluate_grid(spark.createDataFrame(combos, "dataset string, selector string, model string, k int, seed int"), {"e": m})


@query()
def selection_bias_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.bias_table(grid_scores(spark, sf_dir, "group")))


@query()
def three_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.three_pipelines(grid_scores(spark, sf_dir, "random"), grid_scores(spark, sf_dir, "group")))


@query()
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.mask_overlap(grid_scores(spark, sf_dir, "group")))


@query()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.permutation_summary(resample.permutation_test(samples(spark, sf_dir), "vec_id", "x", "y", "fold", n_perm=200)))


@query()
def null_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal noise for every vector: what nested and apparent scores are when there is nothing to find."""
    m = resample.null_moments(table(spark, sf_dir, "embeddings"), "vec_id", 64, list(range(30)))
    combos = spark.createDataFrame([(d, "correlation", "ridge", 20, 42) for d in m], MOMENTS_GRID)
    return rounded(evaluate.bias_table(evaluate.evaluate_grid(combos, m)))


@query(f"""
WITH {SAMPLES}, e AS (SELECT pos, quantile_cont(v, [1/8, 2/8, 3/8, 4/8, 5/8, 6/8, 7/8]) AS ex, quantile_cont(y, [1/8, 2/8, 3/8, 4/8, 5/8, 6/8, 7/8]) AS ey FROM (SELECT y, unnest(range(64)) AS pos, unnest(x) AS v FROM s) GROUP BY pos),
b AS (SELECT l.pos, len(list_filter(ex, lambda q: q <= l.v)) AS bx, len(list_filter(ey, lambda q: q <= l.y)) AS by_ FROM (SELECT y, unnest(range(64)) AS pos, unnest(x) AS v FROM s) l JOIN e USING (pos)),
j AS (SELECT pos, bx, by_, count(*) AS n FROM b GROUP BY ALL)
SELECT CAST(pos AS INTEGER) AS pos, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi
FROM (SELECT *, sum(n) OVER (PARTITION BY pos, bx) AS nx, sum(n) OVER (PARTITION BY pos, by_) AS ny, sum(n) OVER (PARTITION BY pos) AS t FROM j) GROUP BY pos
""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.mutual_information(samples(spark, sf_dir), "x", "y"))


def seed_moments(spark: SparkSession, sf_dir: str, seeds: list[int]) -> dict[str, moments.Moments]:
    """Moments of random folds for each seed; the dataset's name is the seed."""
    df = samples(spark, sf_dir).drop("fold")
    return {str(s): moments.fold_moments(splits.shuffled_folds(df, "vec_id", seed=s), "x", ["y"], "fold") for s in seeds}


@query(f"""
WITH {SAMPLES}, l AS (SELECT vec_id, y, unnest(range(64)) AS pos, unnest(x) AS v FROM s),
p AS (SELECT vec_id, pos, v / stddev_pop(v) OVER (PARTITION BY pos) AS v, y / stddev_pop(y) OVER (PARTITION BY pos) AS y FROM l),
d AS (SELECT a.pos, a.vec_id, abs(a.v - b.v) AS dv, abs(a.y - b.y) AS dy, a.vec_id = b.vec_id AS own FROM p a JOIN p b USING (pos)),
r AS (SELECT pos, vec_id, min(greatest(dv, dy), 3) FILTER (WHERE NOT own) AS near FROM d GROUP BY ALL),
c AS (SELECT d.pos, d.vec_id, count(*) FILTER (WHERE dv < near[3]) AS nv, count(*) FILTER (WHERE dy < near[3]) AS ny FROM d JOIN r USING (pos, vec_id) GROUP BY ALL),
h AS (SELECT i, sum(1 / i) OVER (ORDER BY i) - 1 / i - 0.5772156649015329 AS psi FROM (SELECT unnest(range(1, (SELECT count(*) FROM s) + 1)) AS i))
SELECT CAST(c.pos AS INTEGER) AS pos, round(greatest(0, any_value(n.psi) + any_value(k.psi) - avg(a.psi) - avg(b.psi)), 6) + 0.0 AS mi
FROM c JOIN h a ON a.i = c.nv JOIN h b ON b.i = c.ny, h n, h k WHERE n.i = (SELECT count(*) FROM s) AND k.i = 3 GROUP BY c.pos
""")
def information_by_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of every feature with the target, from the distances to three nearest neighbours."""
    return rounded(information.nearest_information(samples(spark, sf_dir), "x", "y"))


@query()
def inflation_by_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five features of the most information by nearest neighbours, chosen on all rows or inside each fold's train rows."""
    df = samples(spark, sf_dir)
    m, chosen = moments.fold_moments(df, "x", ["y"], "fold"), evaluate.nearest_choices(df, "vec_id", "x", "y", "fold", 5)
    return rounded(evaluate.bias_table(evaluate.score_choices(spark, "e", m, "mutual_info", chosen, list(models.MODELS))))


@query()
def selection_bias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genetic search as the selector: chosen on all rows, or on each fold's train rows."""
    m = moments.fold_moments(splits.group_folds(samples(spark, sf_dir).drop("fold"), "grp"), "x", ["y"], "fold")
    combos = spark.createDataFrame([("e", "search", f, 20, s) for f in ("ridge", "pls") for s in (1, 2)], MOMENTS_GRID)
    return rounded(evaluate.summary_table(evaluate.evaluate_grid(combos, {"e": m}, population=150, generations=150)))


@query()
def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and mean fitness of each generation of a search on all rows; masks are scored in tasks."""
    m = moments.fold_moments(samples(spark, sf_dir), "x", ["y"], "fold")
    search = evaluate.search_together([("e", "ridge", 20, 42, -1)], {"e": m}, spark)["e", "ridge", 20, 42, -1]
    return rounded(spark.createDataFrame(search.log, "generation int, best double, mean double, n_features int"))


@query()
def pipelines_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random folds differ by seed, group folds don't."""
    seeds, keys = list(range(1, 13)), ["selector", "model", "k"]
    by_seed, grouped = seed_moments(spark, sf_dir, seeds), moments.fold_moments(splits.group_folds(samples(spark, sf_dir).drop("fold"), "grp"), "x", ["y"], "fold")
    combos = spark.createDataFrame([(str(x), s, "pls", 20, x) for s in models.SELECTORS for x in seeds], MOMENTS_GRID)
    both = (evaluate.evaluate_grid(combos, m) for m in (by_seed, dict.fromkeys(by_seed, grouped)))
    return rounded(evaluate.pipelines_over_seeds(evaluate.three_pipelines(*both), keys))


@query()
def null_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genetic search on normal noise: repeats summed up by arm."""
    m = resample.null_moments(table(spark, sf_dir, "embeddings"), "vec_id", 64, list(range(30)))
    combos = spark.createDataFrame([(d, "search", "ridge", 20, 42) for d in m], MOMENTS_GRID)
    table_ = evaluate.bias_table(evaluate.evaluate_grid(combos, m)).select("selector", F.col("apparent_r2").alias("apparent"), F.col("nested_r2").alias("nested"))
    return rounded(evaluate.experiment_summary(table_, ["selector"]))


@query()
def permutation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = [(s, f, 20) for s in ("correlation", "rfe") for f in ("ridge", "pls")]
    return rounded(resample.permutation_grid(samples(spark, sf_dir), "vec_id", "x", "y", "fold", combos, n_perm=200))


@query()
def full_against_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.fold_moments(samples(spark, sf_dir), "x", ["y"], "fold")
    return rounded(evaluate.model_comparison(spark, m, models.select_rfe(m.total, 20)))


@query(f"""
WITH {SAMPLES}, f AS (SELECT k.fold, regr_slope(y, x[7]) AS b, regr_intercept(y, x[7]) AS b0 FROM s JOIN (SELECT DISTINCT fold FROM s) k ON s.fold <> k.fold GROUP BY k.fold)
SELECT vec_id, s.fold, round(y, 6) + 0.0 AS y, round(b0 + b * x[7], 6) + 0.0 AS y_pred FROM s JOIN f USING (fold)
""")
def out_of_fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row by the one-feature model that wasn't fitted on its fold (feature 6 of 0 .. 63 alone is offered)."""
    df = samples(spark, sf_dir).withColumn("x", F.array(F.get("x", F.lit(6))))
    m = moments.fold_moments(df, "x", ["y"], "fold")
    coefficients = evaluate.fold_models(spark, m, "correlation", "ols", 1)
    return rounded(evaluate.predict(df, "x", coefficients).select("vec_id", "fold", "y", "y_pred"))


@query()
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).select("x", "y", "fold")
    out = models.tree_predictions(df, "x", "y", "fold", trees=100).withColumn("y_true", F.col("y"))
    return rounded(evaluate.score_predictions(out, ["fold"]))


@query()
def tree_bias_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree models in both arms: forests and boosted trees of 100 trees on features chosen on all rows, or inside each
    fold's train rows, beside ridge on the same features."""
    df = splits.group_folds(samples(spark, sf_dir).drop("fold"), "grp")
    m = moments.fold_moments(df, "x", ["y"], "fold")
    combos = spark.createDataFrame([("e", s, f, 20, 42) for s in ("correlation", "rfe") for f in ("random_forest", "boosted_trees")], MOMENTS_GRID)
    chosen = evaluate.grid_choices(combos, {"e": m})
    linear = evaluate.evaluate_grid(combos.withColumn("model", F.lit("ridge")), {"e": m})
    return rounded(evaluate.bias_table(evaluate.tree_grid(df, "vec_id", "x", "y", "fold", chosen).unionByName(linear)), 4)


@query()
def band_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bands.selection_frequency(grid_scores(spark, sf_dir, "group"), ["selector", "model", "k"], 64))


@query()
def chosen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the features each selector chose on all rows, with their kind and wavelength."""
    scores = grid_scores(spark, sf_dir, "group").where((F.col("arm") == "apparent") & (F.col("model") == "pls"))
    named = bands.chosen_names(scores, ["selector", "k"], [f"snv_R{round(w)}" for w in WAVES])
    return bands.parsed(named.drop("arm", "fold").distinct())


# --- folds and hold-outs -----------------------------------------------------------------------------------

RANK = "row_number() OVER ({0}ORDER BY md5('42|' || CAST({1} AS VARCHAR))) - 1"


@query(f"SELECT o_orderkey, CAST(({RANK.format('', 'o_orderkey')}) % 5 AS INTEGER) AS fold FROM orders")
def folds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shuffled_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, o_orderpriority, CAST(({RANK.format('PARTITION BY o_orderpriority ', 'o_orderkey')}) % 5 AS INTEGER) AS fold FROM orders")
def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query("""
WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)),
w(i, load, groups) AS (
  SELECT CAST(0 AS BIGINT), [0::BIGINT, 0, 0, 0, 0], [0::BIGINT, 0, 0, 0, 0]
  UNION ALL
  SELECT w.i + 1, list_transform(load, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN g.n ELSE 0 END),
         list_transform(groups, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN 1 ELSE 0 END)
  FROM w JOIN g ON g.i = w.i + 1)
SELECT CAST(unnest(range(5)) AS INTEGER) AS fold, unnest(load) AS n, unnest(groups) AS groups FROM (SELECT * FROM w ORDER BY i DESC LIMIT 1)
""")
def folds_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_folds(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query()
def folds_stratified_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).select("vec_id", "grp", "label")
    return splits.stratified_group_folds(df, "grp", "label").groupBy("fold", "label").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT label, grp, count(*) AS n FROM (SELECT label, vec_id % 25 AS grp FROM embeddings) GROUP BY ALL)
SELECT label, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY label
""")
def classes_over_grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified group folds lose no row and split no group: rows by class of groups that lie in one fold."""
    df = splits.stratified_group_folds(samples(spark, sf_dir).select("vec_id", "grp", "label"), "grp", "label")
    whole = df.groupBy("grp").agg(F.count_distinct("fold").alias("folds")).where(F.col("folds") == 1)
    return df.join(whole, "grp", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || CAST(o_custkey AS VARCHAR))) - 1 AS rank, count(*) OVER () AS n FROM g)
SELECT o_orderkey, rank < ceil(n * 0.2) AS is_test FROM orders JOIN r USING (o_custkey)
""")
def holdout_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", group="o_custkey").select("o_orderkey", "is_test")


@query("""
WITH c AS (SELECT o_custkey AS g, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT g, seed FROM (SELECT DISTINCT g FROM c), (VALUES (1), (2), (3), (4), (5)) v(seed)),
r AS (SELECT seed, g, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '|' || CAST(g AS VARCHAR))) <= ceil(count(*) OVER (PARTITION BY seed) * 0.2) AS is_test FROM t),
s AS (SELECT seed, c, coalesce(sum(n) FILTER (WHERE is_test), 0) AS test, coalesce(sum(n) FILTER (WHERE NOT is_test), 0) AS train FROM r JOIN c USING (g) GROUP BY ALL),
p AS (SELECT seed, train / sum(train) OVER (PARTITION BY seed) + 1e-9 AS p, test / sum(test) OVER (PARTITION BY seed) + 1e-9 AS q FROM s)
SELECT p.seed, round(sum(p * ln(p / q)), 9) AS kl, (SELECT count(*) FROM (SELECT g FROM r WHERE r.seed = p.seed GROUP BY g HAVING count(DISTINCT is_test) > 1)) AS leaked FROM p GROUP BY p.seed
""")
def split_seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.split_search(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", [1, 2, 3, 4, 5]), 9)


@query("""
WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || CAST(o_custkey AS VARCHAR))) - 1 AS rank, count(*) OVER () AS n FROM g)
SELECT rank < ceil(n * 0.2) AS is_test, o_orderpriority, count(*) AS n FROM orders JOIN r USING (o_custkey) GROUP BY ALL
""")
def holdout_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return splits.side_counts(splits.lock_holdout(orders, "o_orderkey", group="o_custkey"), "o_orderpriority")


@query(f"""
WITH r AS (SELECT o_orderkey, {RANK.format('PARTITION BY o_orderpriority ', 'o_orderkey')} AS rank, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, rank < round(n * 0.2) AS is_test FROM r
""")
def holdout_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.lock_holdout(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", label="o_orderpriority").select("o_orderkey", "is_test")


@query(f"WITH r AS (SELECT o_orderkey, {RANK.format('', 'o_orderkey')} AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rank < round(n * 0.2) AS is_test FROM r")
def holdout_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.lock_holdout(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "is_test")


@query("""
WITH g AS (SELECT o_orderkey % 97 AS g, count(DISTINCT o_orderkey % 2) AS sides FROM orders GROUP BY 1) SELECT count(*) FILTER (WHERE sides > 1) AS leaked FROM g
""")
def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a split by row (even keys) puts on both sides."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("g"), (F.col("o_orderkey") % 2).alias("side"))
    return splits.group_leakage(orders, "g", "side")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS g FROM orders), d AS (SELECT DISTINCT g FROM o),
r AS (SELECT g, row_number() OVER (ORDER BY md5('42|' || coalesce(CAST(g AS VARCHAR), ''))) - 1 AS rank, count(*) OVER () AS n FROM d)
SELECT o_orderkey, rank < ceil(n * 0.2) AS is_test FROM o JOIN r ON o.g IS NOT DISTINCT FROM r.g
""")
def holdout_with_missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a customer's group are one group of their own."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("g"))
    return splits.holdout(orders, "o_orderkey", group="g").select("o_orderkey", "is_test")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS c FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY c ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) - 1 AS rank, count(*) OVER (PARTITION BY c) AS n FROM o)
SELECT o_orderkey, rank < round(n * 0.2) AS is_test FROM r
""")
def holdout_with_missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("c"))
    return splits.holdout(orders, "o_orderkey", label="c").select("o_orderkey", "is_test")


@query("""
WITH t AS (SELECT o_orderkey, o_custkey AS g, o_orderpriority AS c, seed FROM orders, (VALUES (1), (2), (3), (4), (5)) v(seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, c ORDER BY md5(CAST(seed AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR))) <= round(count(*) OVER (PARTITION BY seed, c) * 0.2) AS is_test FROM t),
s AS (SELECT seed, c, count(*) FILTER (WHERE is_test) AS test, count(*) FILTER (WHERE NOT is_test) AS train FROM r GROUP BY ALL),
p AS (SELECT seed, train / sum(train) OVER (PARTITION BY seed) + 1e-9 AS p, test / sum(test) OVER (PARTITION BY seed) + 1e-9 AS q FROM s),
k AS (SELECT seed, sum(p * ln(p / q)) AS kl FROM p GROUP BY seed),
l AS (SELECT seed, count(*) AS leaked FROM (SELECT seed, g FROM r GROUP BY ALL HAVING count(DISTINCT is_test) > 1) GROUP BY seed)
SELECT seed, round(kl, 9) AS kl, leaked, round(kl + 100 * leaked, 9) AS score FROM k JOIN l USING (seed)
""")
def row_splits_that_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-outs by order within priorities tear customers apart; divergence and torn customers by seed."""
    return rounded(splits.row_split_search(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderpriority", [1, 2, 3, 4, 5]), 9)


def strata_sql(table_: str, key: str, value: str, folds: int, bins: int) -> str:
    """Quantile bins, as many as leave a row for every fold, and folds inside them."""
    low, high = "l[CAST(floor(place) AS INTEGER) + 1]", "l[CAST(ceil(place) AS INTEGER) + 1]"
    return f"""
WITH l AS (SELECT list({value} ORDER BY {value}) AS l, count(*) AS m FROM {table_}), n AS (SELECT unnest(range(2, {bins + 1})) AS n),
q AS (SELECT n, (m - 1) * (i / n) AS place, l FROM (SELECT n, unnest(range(0, n + 1)) AS i FROM n), l),
e AS (SELECT n, list_sort(list_distinct(list({low} + ({high} - {low}) * (place - floor(place))))) AS e FROM q GROUP BY n),
s AS (SELECT n, {key}, CASE WHEN len(e) < 3 THEN 0 ELSE len(list_filter(e[2:len(e) - 1], lambda x: x <= {value})) END AS stratum FROM {table_}, e),
c AS (SELECT n FROM (SELECT n, stratum, count(*) AS c FROM s GROUP BY ALL) GROUP BY n HAVING count(*) >= 2 AND min(c) >= {folds}),
b AS (SELECT {key}, stratum FROM s WHERE n = (SELECT max(n) FROM c) UNION ALL SELECT {key}, 0 FROM {table_} WHERE NOT EXISTS (FROM c))
SELECT {key}, CAST(stratum AS INTEGER) AS stratum, CAST(({RANK.format("PARTITION BY stratum ", key)}) % {folds} AS INTEGER) AS fold FROM b"""


@query(strata_sql("supplier", "s_suppkey", "s_acctbal", 8, 14))
def folds_by_strata_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen quantile bins of a numeric target, fewer where a bin has no row for each of eight folds."""
    strata = splits.regression_strata(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", folds=8, bins=14)
    return splits.stratified_folds(strata, "s_suppkey", "stratum", 8).select("s_suppkey", F.col("stratum").cast("int").alias("stratum"), "fold")


@query(strata_sql("part", "p_partkey", "p_size", 5, 5))
def folds_chosen_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splitter for regression with strata, on a target of many ties."""
    out = splits.make_folds(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", target="p_size", stratify=True)
    return out.select("p_partkey", F.col("stratum").cast("int").alias("stratum"), "fold")


def greedy_sql(folds: int) -> str:
    """Groups to folds by a running state: kinds by size, whole rounds to all folds, the rest each where class shares stay most even."""
    shares = f"list_transform(range(1, {folds + 1}), lambda f: (have[f][x] + CASE WHEN f = k THEN v[x] ELSE 0 END) / total[x])"
    spread = f"list_sum(list_transform(range(1, len(total) + 1), lambda x: {folds} * list_var_pop({shares})))"
    best = f"list_sort(list_transform(range(1, {folds + 1}), lambda k: {{'s': round({spread}, 12), 'n': list_sum(have[k]), 'k': k}}))[1].k"
    return f"""t AS (SELECT vec_id % 25 AS g, CAST(label AS VARCHAR) AS c, count(*) AS n FROM embeddings GROUP BY ALL),
lb AS (SELECT c, sum(n) AS total FROM t GROUP BY c),
gr AS (SELECT g, sum(n) AS n, '[' || string_agg('{{"c":"' || c || '","n":' || n || '}}', ',' ORDER BY c) || ']' AS kind FROM t GROUP BY g),
vc AS (SELECT g, list(CAST(coalesce(t.n, 0) AS DOUBLE) ORDER BY c) AS v, list(CAST(total AS DOUBLE) ORDER BY c) AS total FROM (SELECT * FROM gr, lb) LEFT JOIN t USING (g, c) GROUP BY g),
kd AS (SELECT kind, count(*) AS many, any_value(v) AS v, any_value(total) AS total, row_number() OVER (ORDER BY any_value(n) DESC, kind) AS place FROM gr JOIN vc USING (g) GROUP BY kind),
it AS (SELECT row_number() OVER (ORDER BY place, j) AS i, kind, j, many // {folds} AS even, v, total FROM (SELECT *, unnest(range(0, many % {folds} + 1)) AS j FROM kd)),
st AS (SELECT CAST(0 AS BIGINT) AS i, '' AS kind, CAST(0 AS BIGINT) AS j, list_transform(range({folds}), lambda f: list_transform(range(l), lambda x: CAST(0 AS DOUBLE))) AS have, CAST(0 AS BIGINT) AS pick FROM (SELECT count(*) AS l FROM lb)
UNION ALL SELECT i, kind, j, CASE WHEN j = 0 THEN list_transform(have, lambda h: list_transform(range(1, len(h) + 1), lambda x: h[x] + even * v[x]))
    ELSE list_transform(range(1, {folds + 1}), lambda f: CASE WHEN f = pick THEN list_transform(range(1, len(v) + 1), lambda x: have[f][x] + v[x]) ELSE have[f] END) END, pick
  FROM (SELECT it.*, have, CASE WHEN it.j > 0 THEN {best} ELSE 0 END AS pick FROM st JOIN it ON it.i = st.i + 1)),
pl AS (SELECT g, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('42|' || g)) - 1 AS r FROM gr),
fd AS (SELECT g, CAST(CASE WHEN r < even * {folds} THEN r % {folds} ELSE pick - 1 END AS INTEGER) AS fold FROM pl JOIN (SELECT DISTINCT kind, even FROM it) USING (kind) LEFT JOIN st ON st.kind = pl.kind AND st.j = r - even * {folds} + 1)"""


ORACLE["folds_stratified_grouped"] = f"WITH RECURSIVE {greedy_sql(5)} SELECT fold, label, count(*) AS n FROM embeddings JOIN fd ON vec_id % 25 = g GROUP BY ALL"


@query(f"WITH RECURSIVE {greedy_sql(5)} SELECT vec_id, fold FROM embeddings JOIN fd ON vec_id % 25 = g")
def folds_of_stratified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups to folds so that class shares stay even, row by row."""
    return splits.stratified_group_folds(samples(spark, sf_dir).select("vec_id", "grp", "label"), "grp", "label").select("vec_id", "fold")


@query(f"""
WITH RECURSIVE {greedy_sql(4)}, r AS (SELECT vec_id, fold FROM embeddings JOIN fd ON vec_id % 25 = g), c AS (SELECT fold, count(*) AS n FROM r GROUP BY fold)
SELECT vec_id, fold = (SELECT fold FROM c ORDER BY abs(n / (SELECT sum(n) FROM c) - 0.27), fold LIMIT 1) AS is_test FROM r
""")
def holdout_of_stratified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four stratified group folds, the one nearest to 27 % is held out."""
    df = samples(spark, sf_dir).select("vec_id", "grp", "label")
    return splits.lock_holdout(df, "vec_id", 0.27, group="grp", label="label").select("vec_id", "is_test")


@query("""
WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders)
SELECT CAST(least(4, floor((o_totalprice - low) * 5 / (high - low))) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1
""")
def uniform_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bins of equal width."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("v"))
    edges = orders.agg(labels.uniform_edges(F.col("v"), 5).alias("edges"))
    return orders.crossJoin(F.broadcast(edges)).groupBy(labels.bin_index(F.col("v"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))  # one row


@query("""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM orders)
SELECT o_orderkey, CAST(len(list_filter(edges[2:len(edges) - 1], lambda q: q <= o_totalprice)) AS INTEGER) AS bin FROM orders, e
""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    edges = quantiles.quantile_edges(orders, "o_totalprice", 5)
    return orders.crossJoin(F.broadcast(edges)).select("o_orderkey", labels.bin_index(F.col("o_totalprice"), F.col("edges")).alias("bin"))  # one row


# --- scores from long predictions --------------------------------------------------------------------------

PREDICTIONS = "p AS (SELECT l_returnflag, l_linestatus, CAST(l_suppkey % 5 AS INTEGER) AS fold, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) * 1500 AS q FROM lineitem)"
SCORE = "count(*) AS n, round(1 - sum((y - q) ^ 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - q) ^ 2)), 4) AS rmse, round(avg(abs(y - q)), 4) AS mae"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 5).cast("int").alias("fold"), F.col("l_extendedprice").cast("double").alias("y_true"), (F.col("l_quantity").cast("double") * 1500).alias("y_pred"))


def price_rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6 if "r2" in c else 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {PREDICTIONS} SELECT l_returnflag, l_linestatus, fold, {SCORE} FROM p GROUP BY ALL")
def scores_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_rounded(evaluate.score_predictions(predictions(spark, sf_dir), ["l_returnflag", "l_linestatus", "fold"]))


@query(f"WITH {PREDICTIONS} SELECT l_returnflag, l_linestatus, {SCORE} FROM p GROUP BY ALL")
def scores_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_rounded(evaluate.score_predictions(predictions(spark, sf_dir), ["l_returnflag", "l_linestatus"]))


@query(f"""
WITH {PREDICTIONS}, f AS (SELECT l_returnflag, l_linestatus, fold, 1 - sum((y - q) ^ 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - q) ^ 2)) AS rmse, avg(abs(y - q)) AS mae FROM p GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std,
       round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std, count(*) AS folds FROM f GROUP BY ALL
""")
def scores_fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fold = evaluate.score_predictions(predictions(spark, sf_dir), ["l_returnflag", "l_linestatus", "fold"])
    return price_rounded(evaluate.fold_mean_scores(by_fold, ["l_returnflag", "l_linestatus"]))


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("double").alias("y_true"), (F.col("l_quantity").cast("double") * 1500).alias("y_pred"))
    return rounded(resample.bootstrap_intervals(rows, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))


@query(f"""
WITH {PREDICTIONS}, f AS (SELECT l_returnflag, l_linestatus, fold, sum((y - q) ^ 2) AS sse FROM p GROUP BY ALL), w AS (SELECT l_returnflag, l_linestatus, var_pop(y) * count(*) AS sst FROM p GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(1 - sum(sse) / any_value(sst), 6) AS r2_pooled FROM f JOIN w USING (l_returnflag, l_linestatus) GROUP BY ALL
""")
def scores_pooled_from_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled R2 rebuilt from per-fold sums alone."""
    error = F.col("y_true") - F.col("y_pred")
    sums = predictions(spark, sf_dir).groupBy("l_returnflag", "l_linestatus", "fold").agg(F.count("*").alias("n"), F.avg("y_true").alias("mean_y"), F.sum(error * error).alias("sse"), (F.var_pop("y_true") * F.count("*")).alias("sst"))
    return price_rounded(sums.groupBy("l_returnflag", "l_linestatus").agg(evaluate.pooled(F.col).alias("r2_pooled")))


@query(f"""
WITH {PREDICTIONS}, a AS (SELECT l_returnflag, l_linestatus, 1 - sum((y - q) ^ 2) / (var_pop(y) * count(*)) AS rebuilt FROM p GROUP BY ALL),
f AS (SELECT l_returnflag, l_linestatus, fold, count(*) AS n, avg(y) AS m, sum((y - q) ^ 2) AS sse, var_pop(y) * count(*) AS sst FROM p GROUP BY ALL),
b AS (SELECT l_returnflag, l_linestatus, round(1 - sum(sse) / (sum(sst) + sum(n * m * m) - sum(n * m) ^ 2 / sum(n)), 6) AS stored FROM f GROUP BY ALL)
SELECT l_returnflag, l_linestatus, rebuilt, stored FROM a FULL JOIN b USING (l_returnflag, l_linestatus) WHERE NOT coalesce(abs(rebuilt - stored) <= 1e-6, rebuilt IS NULL AND stored IS NULL)
""")
def rebuilt_scores_that_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled scores from rows against those from per-fold sums: none should differ."""
    stored = scores_pooled_from_folds(spark, sf_dir).withColumnRenamed("r2_pooled", "r2")
    rebuilt = evaluate.score_predictions(predictions(spark, sf_dir), ["l_returnflag", "l_linestatus"])
    return evaluate.check_rebuilt(rebuilt, stored, ["l_returnflag", "l_linestatus"], "r2")


POISSON = ", ".join(str(c) for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402))


@query(f"""
WITH p AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) * 1500 AS q, concat_ws('-', l_orderkey, l_linenumber) AS k FROM lineitem),
b AS (SELECT *, CAST('0x' || substr(md5('42|' || b || '|' || k), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p, (SELECT unnest(range(1, 201)) AS b)),
w AS (SELECT *, len(list_filter([{POISSON}], lambda s: s <= u)) AS w FROM b),
r AS (SELECT l_returnflag, b, 1 - sum(w * (y - q) ^ 2) / (sum(w * y * y) - sum(w * y) ^ 2 / sum(w)) AS r2 FROM w GROUP BY ALL)
SELECT l_returnflag, round(quantile_cont(r2, 0.025), 4) AS low, round(quantile_cont(r2, 0.975), 4) AS high, count(*) AS n_boot FROM r GROUP BY l_returnflag
""")
def poisson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), F.col("l_extendedprice").cast("double").alias("y_true"), (F.col("l_quantity").cast("double") * 1500).alias("y_pred"))
    return rounded(resample.poisson_intervals(rows, ["l_returnflag"], "k"), 4)


# --- seeds and significance --------------------------------------------------------------------------------

RESULTS = "r AS (SELECT event_type, user_id, max(value) AS apparent, avg(value) AS nested FROM events GROUP BY ALL)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent and nested values by combination (event_type) and seed (user_id)."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("apparent"), F.avg("value").alias("nested"))


@query(f"""
WITH {RESULTS} SELECT event_type, count(DISTINCT user_id) AS n_seeds, round(avg(apparent), 6) AS apparent_mean, round(stddev_samp(apparent), 6) AS apparent_std, round(min(apparent), 6) AS apparent_min, round(max(apparent), 6) AS apparent_max,
  round(avg(nested), 6) AS nested_mean, round(stddev_samp(nested), 6) AS nested_std, round(min(nested), 6) AS nested_min, round(max(nested), 6) AS nested_max,
  round(avg(apparent - nested), 6) AS bias_mean, round(stddev_samp(apparent - nested), 6) AS bias_std FROM r GROUP BY event_type
""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.seed_summary(results(spark, sf_dir), ["event_type"], "user_id"))


@query(f"""
WITH {RESULTS}, d AS (SELECT *, apparent - nested AS d FROM r),
c AS (SELECT a.event_type, avg(sign(a.apparent - b.nested)) AS delta FROM r a JOIN r b USING (event_type) GROUP BY 1),
k AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
w AS (SELECT event_type, least(coalesce(sum(rk) FILTER (WHERE d < 0), 0), coalesce(sum(rk) FILTER (WHERE d > 0), 0)) AS stat FROM k GROUP BY 1)
SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean_bias, round(w.stat, 6) AS wilcoxon_stat, round(c.delta, 6) AS cliffs_delta, round(avg(d) / stddev_samp(d), 6) AS cohens_d,
  CASE WHEN abs(c.delta) < 0.147 THEN 'negligible' WHEN abs(c.delta) < 0.33 THEN 'small' WHEN abs(c.delta) < 0.474 THEN 'medium' ELSE 'large' END AS cliffs_interpretation
FROM d JOIN c USING (event_type) JOIN w USING (event_type) GROUP BY event_type, c.delta, w.stat
""")
def paired_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.paired_tests(results(spark, sf_dir), ["event_type"])
    return rounded(out.select("event_type", "n", "mean_bias", "wilcoxon_stat", "cliffs_delta", "cohens_d", "cliffs_interpretation"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN pow(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE, 4) END AS p FROM part),
r AS (SELECT p_partkey, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS q FROM p WHERE p IS NOT NULL),
f AS (SELECT p_partkey, least(1.0, min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r)
SELECT p.p_partkey, round(fdr, 9) AS p_value_fdr, coalesce(fdr < 0.05, false) AS significant_fdr FROM p LEFT JOIN f USING (p_partkey)
""")
def false_discovery_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini and Hochberg over a p value for each part, some of them missing."""
    p = F.when(F.col("p_partkey") % 10 != 0, F.pow(unit_number(F.col("p_partkey").cast("string")), F.lit(4.0)))
    out = stats.false_discovery(table(spark, sf_dir, "part").select("p_partkey", p.alias("p_value")))
    return rounded(out.drop("p_value"), 9)


@query()
def significance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.false_discovery(stats.paired_tests(results(spark, sf_dir), ["event_type"])), 9)


@query()
def significance_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overall(stats.false_discovery(stats.paired_tests(results(spark, sf_dir), ["event_type"])))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few pairs a nation, with ties; in every fifth nation all differences agree."""
    a, u = F.floor(F.col("s_acctbal") / 1000) / 10, F.floor(unit_number(F.col("s_suppkey").cast("string")) * 10) / 10
    return table(spark, sf_dir, "supplier").select("s_nationkey", a.alias("apparent"), F.when(F.col("s_nationkey") % 5 == 0, a - 0.25).otherwise(u).alias("nested"))


PAIRED = """r AS (SELECT s_suppkey, s_nationkey, a AS apparent, CASE WHEN s_nationkey % 5 = 0 THEN a - CAST(0.25 AS DOUBLE) ELSE u END AS nested FROM (SELECT *, floor(s_acctbal / 1000) / 10 AS a, floor(CAST('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * 10) / 10 AS u FROM supplier)),
d AS (SELECT *, apparent - nested AS d FROM r),
b AS (SELECT s_nationkey, count(*) AS n, count(DISTINCT d) AS n_unique_diff, avg(d) AS mean_bias, stddev_samp(d) AS sd, max(abs(d - f)) <= 1e-12 + 1e-5 * abs(any_value(f)) AS degenerate FROM (SELECT *, min(d) OVER (PARTITION BY s_nationkey) AS f FROM d) GROUP BY 1),
k AS (SELECT s_nationkey, d, rank() OVER (PARTITION BY s_nationkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY s_nationkey, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0),
w AS (SELECT s_nationkey, list(CAST(2 * rk AS BIGINT)) AS rs, least(coalesce(sum(rk) FILTER (WHERE d < 0), 0), coalesce(sum(rk) FILTER (WHERE d > 0), 0)) AS stat FROM k GROUP BY 1),
p AS (SELECT s_nationkey, stat, least(1.0, 2 * len(list_filter(range(CAST(2 ** len(rs) AS BIGINT)), lambda m: list_sum(list_transform(range(1, len(rs) + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN rs[i] ELSE 0 END)) <= 2 * stat)) / 2 ** len(rs)) AS p FROM w),
c AS (SELECT x.s_nationkey, avg(sign(x.apparent - y.nested)) AS delta FROM r x JOIN r y USING (s_nationkey) GROUP BY 1),
z AS (SELECT b.s_nationkey, n, n_unique_diff, mean_bias, degenerate, CASE WHEN NOT degenerate THEN stat END AS wilcoxon_stat, CASE WHEN NOT degenerate THEN p END AS p_value, CASE WHEN NOT degenerate THEN delta END AS cliffs_delta,
  CASE WHEN NOT degenerate AND n > 1 AND sd <> 0 THEN mean_bias / sd END AS cohens_d, n < 6 AS low_n_warning FROM b LEFT JOIN p USING (s_nationkey) LEFT JOIN c USING (s_nationkey)),
q AS (SELECT s_nationkey, min(x) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING) AS fdr FROM (SELECT *, p_value * count(*) OVER () / count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS x FROM z WHERE p_value IS NOT NULL)),
t AS (SELECT z.*, CASE WHEN fdr IS NOT NULL THEN least(1.0, fdr) END AS p_value_fdr, coalesce(fdr < 0.05, false) AS significant_fdr FROM z LEFT JOIN q USING (s_nationkey))"""


@query(f"""
WITH {PAIRED} SELECT s_nationkey, n, n_unique_diff, round(mean_bias, 9) + 0.0 AS mean_bias, degenerate, round(wilcoxon_stat, 9) AS wilcoxon_stat, round(p_value, 9) AS p_value, round(cliffs_delta, 9) + 0.0 AS cliffs_delta, round(cohens_d, 9) + 0.0 AS cohens_d, low_n_warning,
  CASE WHEN cliffs_delta IS NULL THEN 'n/a' WHEN abs(cliffs_delta) < 0.147 THEN 'negligible' WHEN abs(cliffs_delta) < 0.33 THEN 'small' WHEN abs(cliffs_delta) < 0.474 THEN 'medium' ELSE 'large' END AS cliffs_interpretation, round(p_value_fdr, 9) AS p_value_fdr, significant_fdr FROM t
""")
def exact_paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed rank tests over all sign flips, effect sizes and false-discovery rates of each nation's pairs."""
    return rounded(stats.false_discovery(stats.paired_tests(supplier_pairs(spark, sf_dir), ["s_nationkey"])), 9)


@query(f"WITH {PAIRED} SELECT count(*) AS n_combos, count(*) FILTER (WHERE mean_bias > 0) AS n_positive, count(*) FILTER (WHERE significant_fdr) AS n_significant, count(p_value) AS n_tested, count(*) FILTER (WHERE degenerate) AS n_degenerate FROM t")
def exact_paired_tests_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overall(stats.false_discovery(stats.paired_tests(supplier_pairs(spark, sf_dir), ["s_nationkey"])))


@query(f"""
WITH {RESULTS}, l AS (SELECT event_type, 'apparent' AS arm, apparent AS v FROM r UNION ALL SELECT event_type, 'nested', nested FROM r),
e AS (SELECT event_type, min(v) AS low, max(v) AS high FROM l GROUP BY 1)
SELECT event_type, arm, CAST(least(23, floor((v - low) * 24 / (high - low))) AS INTEGER) AS bin, count(*) AS n FROM l JOIN e USING (event_type) GROUP BY ALL
""")
def arm_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.arm_histogram(results(spark, sf_dir), ["event_type"])


SIDES = """u AS (SELECT user_id, event_type, max(value) AS a, avg(value) AS b, median(value) AS c FROM events GROUP BY ALL),
pl AS (SELECT event_type, user_id % 7 AS part, a AS apparent, b AS nested FROM u), fm AS (SELECT event_type, user_id % 7 AS part, c AS apparent, b AS nested FROM u),
cm AS (SELECT event_type, part, count(*) AS n_seeds, avg(apparent) AS pa, stddev_samp(apparent) AS pas, avg(nested) AS pn, stddev_samp(nested) AS pns, avg(apparent - nested) AS pb, stddev_samp(apparent - nested) AS pbs FROM pl GROUP BY ALL),
fo AS (SELECT event_type, part, avg(apparent) AS fa, avg(nested) AS fn, avg(apparent - nested) AS fb FROM fm GROUP BY ALL),
bo AS (SELECT *, pb - fb AS bd, pa - fa AS ad, sign(pb) <> sign(fb) AS flips FROM cm LEFT JOIN fo USING (event_type, part))"""


def aggregations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways of summing up the same seeds, by event_type and a part of the users."""
    u = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("a"), F.avg("value").alias("b"), F.median("value").alias("c"))
    part = (F.col("user_id") % 7).alias("part")
    first, second = (u.select("event_type", part, F.col(c).alias("apparent"), F.col("b").alias("nested")) for c in ("a", "c"))
    return evaluate.compare_aggregations(first, second, ["event_type", "part"])


@query(f"""
WITH {SIDES} SELECT event_type, part, n_seeds, round(pa, 6) AS apparent_pooled_mean, round(pas, 6) AS apparent_pooled_std, round(pn, 6) AS nested_pooled_mean, round(pns, 6) AS nested_pooled_std, round(pb, 6) AS bias_pooled_mean, round(pbs, 6) AS bias_pooled_std,
  round(fa, 6) AS apparent_foldmean_mean, round(fn, 6) AS nested_foldmean_mean, round(fb, 6) AS bias_foldmean_mean, round(bd, 6) AS bias_delta, round(ad, 6) AS apparent_delta, flips AS sign_flips FROM bo
""")
def aggregation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregations(spark, sf_dir))


@query(f"""
WITH {SIDES} SELECT count(*) AS n_combos, count(*) FILTER (WHERE pb > 0) AS n_positive_pooled, count(*) FILTER (WHERE fb > 0) AS n_positive_foldmean, count(*) FILTER (WHERE ad > 0) AS n_apparent_pooled_exceeds,
  round(median(ad), 6) AS median_apparent_delta, count(*) FILTER (WHERE flips) AS n_sign_flips, coalesce(string_agg(event_type || '/' || part, '; ' ORDER BY event_type || '/' || part) FILTER (WHERE flips), '') AS sign_flip_combos FROM bo
""")
def aggregation_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.comparison_row(aggregations(spark, sf_dir), ["event_type", "part"]))


@query(f"""
WITH {SIDES} SELECT event_type, part, sign(pb) = sign(fb) AS agrees, round(pb - fb, 6) AS gap, CASE WHEN event_type = 'click' AND part = 0 THEN 'headline' WHEN pb < 0 THEN 'exception' ELSE 'normal' END AS kind FROM bo
""")
def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.sign_agreement(aggregations(spark, sf_dir), "bias_pooled_mean", "bias_foldmean_mean")
    out = evaluate.headline_kinds(out, (F.col("event_type") == "click") & (F.col("part") == 0), "bias_pooled_mean")
    return rounded(out.select("event_type", "part", "agrees", "gap", "kind"))


@query(f"""
WITH {RESULTS} SELECT event_type, count(*) AS repeats, round(avg(apparent), 6) AS apparent_mean, round(stddev_pop(apparent), 6) AS apparent_std, round(min(apparent), 6) AS apparent_min, round(max(apparent), 6) AS apparent_max,
  round(avg(nested), 6) AS nested_mean, round(stddev_pop(nested), 6) AS nested_std, round(min(nested), 6) AS nested_min, round(max(nested), 6) AS nested_max, round(avg(apparent - nested), 6) AS bias_mean FROM r GROUP BY event_type
""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.experiment_summary(results(spark, sf_dir), ["event_type"]))


# --- spectra and indices -----------------------------------------------------------------------------------


def band_sql(nm: float) -> str:
    return f"e[{spectra.find_band(WAVES, nm) + 1}]"


R = {nm: band_sql(nm) for nm in (400, 420, 445, 450, 510, 531, 550, 570, 670, 680, 700, 710, 714, 720, 733, 740, 750, 752, 800, 900, 970, 410, 460)}


def inv_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 1e-10 THEN 1 / {x} ELSE 0 END)"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0 END)"


INDEX_SQL = {
    "NDVI": ratio_sql(R[800], R[670]), "GNDVI": ratio_sql(R[800], R[550]), "ARI": f"{inv_sql(R[550])} - {inv_sql(R[700])}", "RVSI": f"({R[714]} + {R[752]}) / 2 - {R[733]}",
    "ZTM": f"(CASE WHEN {R[710]} > 1e-10 THEN {R[750]} / {R[710]} ELSE 0 END)", "CRI": f"{inv_sql(R[510])} - {inv_sql(R[550])}", "PRI": ratio_sql(R[531], R[570]),
    "mARI": f"({inv_sql(R[550])} - {inv_sql(R[700])}) * {R[800]}", "SIPI": f"(CASE WHEN abs({R[800]} - {R[680]}) > 1e-10 THEN ({R[800]} - {R[445]}) / ({R[800]} - {R[680]}) ELSE 0 END)",
    "WBI": f"(CASE WHEN {R[970]} > 1e-10 THEN {R[900]} / {R[970]} ELSE 0 END)",
    "REP": f"(CASE WHEN abs({R[720]} - {R[710]}) > 1e-10 THEN 700 + 40 * (({R[700]} + {R[740]}) / 2 - {R[710]}) / ({R[720]} - {R[710]}) ELSE 700 END)",
    "BES": f"({R[450]} - {R[400]}) / 50", "FLAVI": f"(CASE WHEN {R[420]} * {R[700]} > 1e-10 THEN {R[400]} / ({R[420]} * {R[700]}) ELSE 0 END)",
}


def relative(c: Column) -> Column:
    """Six significant places for values of any size."""
    return F.round(c, 4) + F.lit(0.0)


@query("SELECT vec_id, " + ", ".join(f"round({sql}, 4) + 0.0 AS \"{n}\"" for n, sql in INDEX_SQL.items()) + " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vegetation_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return df.select("vec_id", *(relative(c.cast("double")).alias(n) for n, c in indices.all_indices(F.col("x"), WAVES).items()))


def zero_divide_sql(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) >= 1e-10 THEN ({a}) / ({b}) ELSE 0 END)"


def log_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) > 1e-10 THEN ln(abs({x}) + 1e-10) ELSE 0 END)"


FRI, NDRE = f"({inv_sql(R[410])} - {inv_sql(R[460])})", zero_divide_sql(f"{R[800]} - {R[700]}", f"{R[800]} + {R[700]}")
NBI = zero_divide_sql(NDRE, FRI)
LAYER_SQL = {f"R{nm}": R[nm] for nm in (410, 460, 670, 700, 800)} | {
    "FRI": FRI, "NDRE": NDRE, "NBI": NBI, "logR460_R410": log_sql(zero_divide_sql(R[460], R[410])), "R670_R460": zero_divide_sql(R[670], R[460]), "R800_R460": zero_divide_sql(R[800], R[460]),
    "FRI_x_NDRE": f"{FRI} * {NDRE}", "logNBI": f"ln(greatest({NBI}, 0) + 1)",
}


@query("SELECT vec_id, " + ", ".join(f"round({sql}, 4) + 0.0 AS \"{n}\"" for n, sql in LAYER_SQL.items()) + " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def derived_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("vec_id", *(relative(c).alias(n) for n, c in indices.fixed_layers(F.col("x"), WAVES).items()))


@query("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM e GROUP BY 1)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS v FROM e JOIN m USING (vec_id)
""")
def snv_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir).select("vec_id", F.posexplode(spectra.snv(F.col("x"))).alias("pos", "v")))


@query("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(d, 6) + 0.0 AS d FROM (SELECT vec_id, pos, lead(v) OVER (PARTITION BY vec_id ORDER BY pos) - v AS d FROM e) WHERE d IS NOT NULL
""")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir).select("vec_id", F.posexplode(spectra.first_difference(F.col("x"))).alias("pos", "d")))


def smoothing_sql(bands: int = 64, window: int = 11) -> str:
    """(pos, j, w): weights of least-squares parabolas through each window, by their normal equations."""
    rows = []
    for i in range(bands):
        first = min(max(i - window // 2, 0), bands - window)
        t = [first + j - i for j in range(window)]
        s = [sum(x**k for x in t) for k in range(5)]
        # value at 0 of the parabola: Cramer's rule for the first coefficient
        det = s[0] * (s[2] * s[4] - s[3] ** 2) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] ** 2)
        rows += [f"({i}, {first + j}, {((s[2] * s[4] - s[3] ** 2) - x * (s[1] * s[4] - s[3] * s[2]) + x * x * (s[1] * s[3] - s[2] ** 2)) / det!r})" for j, x in enumerate(t)]
    return "(VALUES " + ", ".join(rows) + ") w(pos, j, w)"


@query(f"""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
sg AS (SELECT vec_id, pos, sum(v * CAST(w AS DOUBLE)) AS v FROM e JOIN {smoothing_sql()} USING (j) GROUP BY ALL),
rf AS (SELECT pos, avg(v) AS r FROM sg GROUP BY pos),
ab AS (SELECT vec_id, regr_slope(v, r) AS b, regr_intercept(v, r) AS a FROM sg JOIN rf USING (pos) GROUP BY vec_id),
ms AS (SELECT vec_id, pos, CASE WHEN abs(b) < 1e-10 THEN v ELSE (v - a) / b END AS v FROM sg JOIN ab USING (vec_id)),
sn AS (SELECT vec_id, pos, (v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p = 0 THEN 1 ELSE stddev_pop(v) OVER p END AS v FROM ms WINDOW p AS (PARTITION BY vec_id))
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(d, 6) + 0.0 AS v FROM (SELECT vec_id, pos, lead(v) OVER (PARTITION BY vec_id ORDER BY pos) - v AS d FROM sn) WHERE d IS NOT NULL
""")
def preprocessing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectra.preprocess(samples(spark, sf_dir).select("vec_id", "x"), "x", ["sg", "msc", "snv", "d1"])
    return rounded(out.select("vec_id", F.posexplode("x").alias("pos", "v")))


@query("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT vec_id, pos, v, max(v) OVER (PARTITION BY vec_id ORDER BY pos DESC) AS top FROM e)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / CASE WHEN top = 0 THEN 1e-9 ELSE top END, 4) + 0.0 AS v FROM c
""")
def continuum_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectra.preprocess(samples(spark, sf_dir).select("vec_id", "x"), "x", ["continuum"])
    return rounded(out.select("vec_id", F.posexplode("x").alias("pos", "v")), 4)


#: Local parabolas over eleven bands around `mid`: mean, slope and curvature (sums of j^2 and of (j^2 - 10)^2 are 110 and 858).
PARABOLAS = """e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
w AS (SELECT pos, least(greatest(pos, 5), 58) AS mid FROM (SELECT unnest(range(64)) AS pos)),
c AS (SELECT vec_id, pos, any_value(pos - mid) AS t, avg(v) AS m, sum(v * (j - mid)) / 110 AS b1, sum(v * ((j - mid) * (j - mid) - 10)) / 858 AS b2 FROM e JOIN w ON j BETWEEN mid - 5 AND mid + 5 GROUP BY vec_id, pos)"""


@query(f"WITH {PARABOLAS} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(b1 + 2 * t * b2, 6) + 0.0 AS v FROM c")
def smoothed_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First derivative of local parabolas."""
    out = spectra.preprocess(samples(spark, sf_dir).select("vec_id", "x"), "x", ["sg_d1"])
    return rounded(out.select("vec_id", F.posexplode("x").alias("pos", "v")))


@query(f"""
WITH {PARABOLAS}, g AS (SELECT vec_id, pos, m + b1 * t + b2 * (t * t - 10) AS v FROM c)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p = 0 THEN 1 ELSE stddev_pop(v) OVER p END, 6) + 0.0 AS v FROM g WINDOW p AS (PARTITION BY vec_id)
""")
def dataset_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing, then SNV, as datasets are loaded."""
    out = spectra.preprocess_dataset(samples(spark, sf_dir).select("vec_id", "x"), "x", 64)
    return rounded(out.select("vec_id", F.posexplode("x").alias("pos", "v")))


def absorption_pair(rows: np.ndarray) -> np.ndarray:
    return np.stack(spectra.band_absorption(rows, WAVES), axis=1)


@query("""
WITH e AS (SELECT vec_id, unnest(range(63)) AS pos, unnest(list_zip(CAST(embedding[2:64] AS DOUBLE[]), CAST(embedding[1:63] AS DOUBLE[]))) AS z FROM embeddings),
d AS (SELECT vec_id, pos, 400 + 600 * pos / 63 AS wl, z[1] - z[2] AS v FROM e),
p AS (SELECT vec_id, r.name, arg_max(struct_pack(wl := wl, v := v), (abs(v), -pos)) AS b FROM d, (VALUES ('red', 680, 760), ('blue', 430, 510), ('all', 0, 9999)) r(name, low, high) WHERE wl BETWEEN low AND high GROUP BY ALL)
SELECT vec_id, name, round(b.wl, 6) AS wl, round(b.v, 6) + 0.0 AS value FROM p
""")
def derivative_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).select("vec_id", spectra.first_difference(F.col("x")).alias("d"))
    windows = {"red": (680, 760), "blue": (430, 510), "all": (None, None)}
    peaks = F.array(*(F.struct(F.lit(n).alias("name"), spectra.derivative_peak(F.col("d"), WAVES[:63], *w).alias("p")) for n, w in windows.items()))
    return rounded(d.select("vec_id", F.explode(peaks).alias("s")).select("vec_id", "s.name", F.col("s.p.wavelength").alias("wl"), F.col("s.p.value").alias("value")))


@query("""
WITH b AS (SELECT vec_id, unnest(range(2, 12)) AS i, CAST(unnest(embedding[3:12]) AS DOUBLE) AS v FROM embeddings),
p AS (SELECT vec_id, i, 400 + 600 * i / 63 AS x, v FROM b),
n AS (SELECT vec_id, CASE WHEN arg_min(v, i) > 0 THEN arg_min(v, i) ELSE 1e-9 END AS a, CASE WHEN arg_max(v, i) > 0 THEN arg_max(v, i) ELSE 1e-9 END AS z, min(x) AS x0, max(x) AS x1 FROM p GROUP BY 1),
r AS (SELECT p.vec_id, i, x, v / (a + (z - a) * (x - x0) / (x1 - x0)) AS r FROM p JOIN n USING (vec_id)),
t AS (SELECT *, lag(x) OVER w AS px, lag(r) OVER w AS pr FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round(1 - min(r), 2) + 0.0 AS depth, round(coalesce(sum((greatest(1 - r, 0) + greatest(1 - pr, 0)) / 2 * (x - px)), 0), 2) + 0.0 AS area FROM t GROUP BY vec_id
""")
def blue_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and area below the straight line from 410 to 510 nm."""
    both = spectra.map_spectra(samples(spark, sf_dir).select("vec_id", "x"), "x", absorption_pair)
    return rounded(both.select("vec_id", F.get("x", F.lit(0)).alias("depth"), F.get("x", F.lit(1)).alias("area")), 2)


# --- pixels ------------------------------------------------------------------------------------------------

PIXELS = "px AS (SELECT l_suppkey AS image, CAST(l_quantity AS DOUBLE) / 50 AS nir, CAST(l_extendedprice AS DOUBLE) / 105000 AS red, abs(CAST(l_discount AS DOUBLE)) * 10 AS green, abs(CAST(l_tax AS DOUBLE)) * 12.5 AS blue FROM lineitem)"


def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("image"), (F.col("l_quantity").cast("double") / 50).alias("nir"), (F.col("l_extendedprice").cast("double") / 105000).alias("red"), (F.abs(F.col("l_discount").cast("double")) * 10).alias("green"), (F.abs(F.col("l_tax").cast("double")) * 12.5).alias("blue"))


OTSU = """sp AS (SELECT image, min(v) AS low, max(v) AS high, count(*) AS n FROM v GROUP BY image),
bn AS (SELECT v.image, CAST(least(255, coalesce(floor((v - low) / nullif((high - low) / 256, 0)), 0)) AS INTEGER) AS bin, count(*) AS c FROM v JOIN sp USING (image) GROUP BY ALL),
gr AS (SELECT sp.image, b.bin, low + (b.bin + 0.5) * ((high - low) / 256) AS centre, coalesce(c, 0) AS c FROM sp CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN bn ON bn.image = sp.image AND bn.bin = b.bin),
cu AS (SELECT *, sum(c) OVER l AS w0, sum(c * centre) OVER l AS s0, sum(c) OVER a AS w, sum(c * centre) OVER a AS s FROM gr WINDOW l AS (PARTITION BY image ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY image)),
bt AS (SELECT image, arg_max(centre, (round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ^ 2 / w / w, 12), -bin)) AS best FROM cu WHERE bin > 0 AND w0 > 0 AND w0 < w GROUP BY image),
ot AS (SELECT sp.image, CASE WHEN n < 10 OR best IS NULL THEN 0.3 ELSE best END AS threshold FROM sp LEFT JOIN bt USING (image))"""


@query(f"WITH {PIXELS}, v AS (SELECT image, nir AS v FROM px), {OTSU} SELECT image, round(threshold, 6) AS threshold FROM ot")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.otsu_thresholds(pixel_table(spark, sf_dir), "image", "nir"))


@query(f"""
WITH {PIXELS}, v AS (SELECT image, CASE WHEN nir + red > 0.02 THEN (nir - red) / (nir + red) ELSE 0 END AS v FROM px), {OTSU}
SELECT v.image, count(*) FILTER (WHERE v > greatest(threshold, 0.15)) AS inside, count(*) AS pixels FROM v JOIN ot USING (image) GROUP BY v.image
""")
def ndvi_mask_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pixels.ndvi_mask(pixel_table(spark, sf_dir), "image", "red", "nir")
    return out.groupBy("image").agg(F.count_if("in_mask").alias("inside"), F.count("*").alias("pixels"))


@query(f"""
WITH {PIXELS}, gp AS (SELECT CASE WHEN image % 13 <> 0 THEN image END AS image, CASE WHEN image % 17 <> 0 THEN nir ELSE 'nan'::DOUBLE END AS nir, red FROM px),
w AS (SELECT coalesce(image, -1) AS image, CASE WHEN isnan(nir) THEN NULL WHEN nir + red > 0.02 THEN (nir - red) / (nir + red) ELSE 0 END AS v FROM gp), v AS (SELECT * FROM w WHERE v IS NOT NULL), {OTSU}
SELECT nullif(w.image, -1) AS image, count(*) FILTER (WHERE v > greatest(threshold, 0.15)) AS inside, count(*) AS pixels FROM w LEFT JOIN ot USING (image) GROUP BY w.image
""")
def ndvi_mask_sizes_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some images have no number at all, some pixels no image: none is lost."""
    px = pixel_table(spark, sf_dir)
    gaps = px.withColumns({"image": F.when(F.col("image") % 13 != 0, F.col("image")), "nir": F.when(F.col("image") % 17 != 0, F.col("nir")).otherwise(float("nan"))})
    out = pixels.ndvi_mask(gaps, "image", "red", "nir")
    return out.groupBy("image").agg(F.count_if("in_mask").alias("inside"), F.count("*").alias("pixels"))


@query(f"WITH {PIXELS} SELECT image, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, round(quantile_cont({c}, 0.25), 6) AS {c}_p25, round(quantile_cont({c}, 0.75), 6) AS {c}_p75" for c in ("nir", "red", "green", "blue")) + " FROM px GROUP BY image")
def layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.layer_statistics(pixel_table(spark, sf_dir), "image", ["nir", "red", "green", "blue"]))


@query(f"""
WITH {PIXELS}, e AS (SELECT image, min(red) AS a, max(red) AS b, min(green) AS c, max(green) AS d FROM px GROUP BY 1)
SELECT image, CAST(sum(coalesce(floor((red - a) * 255 / nullif(b - a, 0)), 0)) AS BIGINT) AS r, CAST(sum(coalesce(floor((green - c) * 255 / nullif(d - c, 0)), 0)) AS BIGINT) AS g FROM px JOIN e USING (image) GROUP BY image
""")
def rgb_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rgb(pixel_table(spark, sf_dir), "image", {"r": "red", "g": "green"}).groupBy("image").agg(F.sum("r").alias("r"), F.sum("g").alias("g"))


@query("SELECT l_suppkey AS image, " + ", ".join(f"round(avg(v) FILTER (WHERE b = {b}), 6) AS b{b}_mean, round(stddev_pop(v) FILTER (WHERE b = {b}), 6) AS b{b}_std, round(quantile_cont(v, 0.25) FILTER (WHERE b = {b}), 6) AS b{b}_p25, round(quantile_cont(v, 0.75) FILTER (WHERE b = {b}), 6) AS b{b}_p75" for b in range(1, 8)) + " FROM (SELECT l_suppkey, l_linenumber AS b, CAST(l_extendedprice AS DOUBLE) / 105000 AS v FROM lineitem) GROUP BY l_suppkey")
def band_image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), "l_linenumber", (F.col("l_extendedprice").cast("double") / 105000).alias("v"))
    return rounded(features.band_image_statistics(li, "image", "l_linenumber", "v", [1, 2, 3, 4, 5, 6, 7]))


# Rasters of 25 columns: pixels of an image in the order of near infrared with noise, so that its mask has a ragged
# edge. The SQL repeats the steps by windows over dense grids and by flooding from the border.

RASTER = """px AS (SELECT image, nir, red, green, blue, (row_number() OVER (PARTITION BY image ORDER BY nir + 0.5 * u, k) - 1) // 25 AS r, (row_number() OVER (PARTITION BY image ORDER BY nir + 0.5 * u, k) - 1) % 25 AS c
  FROM (SELECT l_suppkey AS image, CAST(l_quantity AS DOUBLE) / 50 AS nir, CAST(l_extendedprice AS DOUBLE) / 105000 AS red, abs(CAST(l_discount AS DOUBLE)) * 10 AS green, abs(CAST(l_tax AS DOUBLE)) * 12.5 AS blue,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS k, CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lineitem)),
ext AS MATERIALIZED (SELECT image, max(r) AS mr FROM px GROUP BY image), cel AS MATERIALIZED (SELECT image, mr, unnest(range(mr + 1)) AS r FROM ext), grd AS MATERIALIZED (SELECT image, mr, r, unnest(range(25)) AS c FROM cel)"""


def grid_sql(name: str, marked: str) -> str:
    """A dense grid (image, mr, r, c, v) of a 0/1 value of marked (image, r, c, v)."""
    return f"{name} AS MATERIALIZED (SELECT g.image, g.mr, g.r, g.c, coalesce(m.v, 0) AS v FROM grd g LEFT JOIN {marked} m USING (image, r, c))"


def moved_sql(name: str, source: str, erode: bool) -> str:
    """3 x 3 dilation or erosion; nothing lies outside of the image."""
    v = "CASE WHEN count(*) OVER w = 3 THEN min(v) OVER w ELSE 0 END" if erode else "max(v) OVER w"
    return (f"{name}_ AS MATERIALIZED (SELECT image, mr, r, c, {v} AS v FROM {source} WINDOW w AS (PARTITION BY image, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), "
            f"{name} AS MATERIALIZED (SELECT image, mr, r, c, {v} AS v FROM {name}_ WINDOW w AS (PARTITION BY image, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))")  # fmt: skip


def filled_sql(name: str, source: str) -> str:
    return (f"{name}_o(image, r, c) AS (SELECT image, r, c FROM {source} WHERE v = 0 AND (r = 0 OR c = 0 OR r = mr OR c = 24) UNION SELECT s.image, s.r, s.c FROM {name}_o o, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc), {source} s WHERE s.image = o.image AND s.r = o.r + dr AND s.c = o.c + dc AND s.v = 0), "
            f"{name} AS MATERIALIZED (SELECT s.image, s.mr, s.r, s.c, CASE WHEN o.image IS NULL THEN 1 ELSE 0 END AS v FROM {source} s LEFT JOIN {name}_o o USING (image, r, c))")  # fmt: skip


def cleaned_sql(name: str, source: str) -> str:
    """Closing by two, filled, opening by one; the last step has the given name."""
    steps = [moved_sql(f"{name}1", source, False), moved_sql(f"{name}2", f"{name}1", False), moved_sql(f"{name}3", f"{name}2", True), moved_sql(f"{name}4", f"{name}3", True), filled_sql(f"{name}5", f"{name}4"), moved_sql(f"{name}6", f"{name}5", True), moved_sql(name, f"{name}6", False)]
    return ", ".join(steps)


def large_sql(name: str, source: str) -> str:
    """Pixels of regions that reach 0.5 % of the image; seven steps suffice for images of up to 1,600 pixels."""
    reach = f"{name}_r(image, r0, c0, r, c, d) AS (SELECT image, r, c, r, c, 0 FROM {source} WHERE v = 1 UNION SELECT o.image, r0, c0, s.r, s.c, d + 1 FROM {name}_r o, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) e(dr, dc), {source} s WHERE d < 7 AND s.image = o.image AND s.r = o.r + dr AND s.c = o.c + dc AND s.v = 1)"
    return f"{reach}, {name}_n AS (SELECT image, r0 AS r, c0 AS c, count(DISTINCT r * 25 + c) AS n FROM {name}_r GROUP BY ALL), {name} AS MATERIALIZED (SELECT s.image, s.mr, s.r, s.c, CASE WHEN n >= 0.005 * (s.mr + 1) * 25 THEN 1 ELSE 0 END AS v FROM {source} s LEFT JOIN {name}_n USING (image, r, c))"


def raster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, row, col, s): s is blue, green, red and near infrared."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem")
    nir = F.col("l_quantity").cast("double") / 50
    bands_ = F.array(F.abs(F.col("l_tax").cast("double")) * 12.5, F.abs(F.col("l_discount").cast("double")) * 10, F.col("l_extendedprice").cast("double") / 105000, nir)
    rank = F.row_number().over(Window.partitionBy("image").orderBy("at", "k")) - 1  # an image's pixels
    rows = li.select(F.col("l_suppkey").alias("image"), bands_.alias("s"), key.alias("k"), (nir + 0.5 * unit_number(key)).alias("at"))
    return rows.withColumn("i", rank).select("image", F.floor(F.col("i") / 25).cast("int").alias("row"), (F.col("i") % 25).cast("int").alias("col"), "s")


def mask_facts(masks: DataFrame) -> DataFrame:
    inside = F.when(F.col("in_mask"), F.col("row") * 25 + F.col("col") + 1).otherwise(0)
    return masks.groupBy("image").agg(F.count_if("in_mask").alias("inside"), F.sum(inside).cast("long").alias("places"))


@query(f"""
WITH RECURSIVE {RASTER}, v AS (SELECT image, nir AS v FROM px), {OTSU},
mk AS MATERIALIZED (SELECT image, r, c, CASE WHEN nir > greatest(0.05, least(0.30, threshold)) THEN 1 ELSE 0 END AS v FROM px JOIN ot USING (image)),
wh AS MATERIALIZED (SELECT image, r, c, CASE WHEN (nir + red + green + blue) / 4 > 0.6 AND CASE WHEN nir + red > 0.01 THEN (nir - red) / (nir + red) ELSE 0 END < 0.4
  AND sqrt(((nir - (nir + red + green + blue) / 4) ^ 2 + (red - (nir + red + green + blue) / 4) ^ 2 + (green - (nir + red + green + blue) / 4) ^ 2 + (blue - (nir + red + green + blue) / 4) ^ 2) / 4) / ((nir + red + green + blue) / 4) < 0.2 THEN 1 ELSE 0 END AS v FROM px),
{grid_sql("w0", "wh")}, {moved_sql("w1", "w0", False)}, {moved_sql("w2", "w1", True)}, {filled_sql("w3", "w2")}, {moved_sql("w4", "w3", False)}, {moved_sql("w5", "w4", False)},
{grid_sql("m0", "mk")}, m1 AS MATERIALIZED (SELECT m0.image, m0.mr, m0.r, m0.c, CASE WHEN w5.v = 1 THEN 0 ELSE m0.v END AS v FROM m0 JOIN w5 USING (image, r, c)),
{cleaned_sql("m2", "m1")}, {large_sql("m3", "m2")}, {filled_sql("m4", "m3")}
SELECT image, count(*) FILTER (WHERE m4.v = 1) AS inside, CAST(coalesce(sum(r * 25 + c + 1) FILTER (WHERE m4.v = 1), 0) AS BIGINT) AS places FROM px JOIN m4 USING (image, r, c) GROUP BY image
""")
def hybrid_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near infrared above its threshold without the white reference, cleaned up, small regions out, holes filled."""
    return mask_facts(pixels.segment(raster_table(spark, sf_dir), "image", "s", [450, 550, 670, 800], "hybrid"))


@query(f"""
WITH RECURSIVE {RASTER}, v AS (SELECT image, CASE WHEN nir + red > 0.02 THEN (nir - red) / (nir + red) ELSE 0 END AS v FROM px), {OTSU},
mk AS MATERIALIZED (SELECT image, r, c, CASE WHEN (CASE WHEN nir + red > 0.02 THEN (nir - red) / (nir + red) ELSE 0 END) > greatest(threshold, 0.15) THEN 1 ELSE 0 END AS v FROM px JOIN ot USING (image)),
{grid_sql("m0", "mk")}, {cleaned_sql("m2", "m0")}
SELECT image, count(*) FILTER (WHERE m2.v = 1) AS inside, CAST(coalesce(sum(r * 25 + c + 1) FILTER (WHERE m2.v = 1), 0) AS BIGINT) AS places FROM px JOIN m2 USING (image, r, c) GROUP BY image
HAVING count(*) FILTER (WHERE m2.v = 1) > 0
""")
def leaf_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDVI masks, cleaned up, of the images that have any."""
    return mask_facts(pixels.leaf_masks(raster_table(spark, sf_dir), "image", "s", [450, 550, 670, 800], "ndvi"))


DARK = RASTER.replace("SELECT image, nir, red, green, blue,", "SELECT image, " + ", ".join(f"{c} * CASE WHEN image % 3 = 0 THEN 0.04 ELSE 1 END AS {c}" for c in ("nir", "red", "green", "blue")) + ",")
OTSU_N = re.sub(r"\b(sp|bn|gr|cu|bt|ot)\b", r"\1_n", OTSU).replace("FROM v ", "FROM vn ").replace("v.image", "vn.image")


@query(f"""
WITH RECURSIVE {DARK}, v AS (SELECT image, nir AS v FROM px), {OTSU},
mk AS MATERIALIZED (SELECT image, r, c, CASE WHEN nir > greatest(0.05, least(0.30, threshold)) THEN 1 ELSE 0 END AS v FROM px JOIN ot USING (image)),
wh AS MATERIALIZED (SELECT image, r, c, CASE WHEN (nir + red + green + blue) / 4 > 0.6 AND CASE WHEN nir + red > 0.01 THEN (nir - red) / (nir + red) ELSE 0 END < 0.4
  AND sqrt(((nir - (nir + red + green + blue) / 4) ^ 2 + (red - (nir + red + green + blue) / 4) ^ 2 + (green - (nir + red + green + blue) / 4) ^ 2 + (blue - (nir + red + green + blue) / 4) ^ 2) / 4) / ((nir + red + green + blue) / 4) < 0.2 THEN 1 ELSE 0 END AS v FROM px),
{grid_sql("w0", "wh")}, {moved_sql("w1", "w0", False)}, {moved_sql("w2", "w1", True)}, {filled_sql("w3", "w2")}, {moved_sql("w4", "w3", False)}, {moved_sql("w5", "w4", False)},
{grid_sql("m0", "mk")}, m1 AS MATERIALIZED (SELECT m0.image, m0.mr, m0.r, m0.c, CASE WHEN w5.v = 1 THEN 0 ELSE m0.v END AS v FROM m0 JOIN w5 USING (image, r, c)),
{cleaned_sql("m2", "m1")}, {large_sql("m3", "m2")}, {filled_sql("m4", "m3")},
vn AS (SELECT image, CASE WHEN nir + red > 0.02 THEN (nir - red) / (nir + red) ELSE 0 END AS v FROM px), {OTSU_N},
nk AS MATERIALIZED (SELECT image, r, c, CASE WHEN (CASE WHEN nir + red > 0.02 THEN (nir - red) / (nir + red) ELSE 0 END) > greatest(threshold, 0.15) THEN 1 ELSE 0 END AS v FROM px JOIN ot_n USING (image)),
{grid_sql("n0", "nk")}, {cleaned_sql("n2", "n0")},
h AS (SELECT image, count(*) FILTER (WHERE m4.v = 1) AS inside, CAST(coalesce(sum(r * 25 + c + 1) FILTER (WHERE m4.v = 1), 0) AS BIGINT) AS places FROM px JOIN m4 USING (image, r, c) GROUP BY image),
n AS (SELECT image, count(*) FILTER (WHERE n2.v = 1) AS inside, CAST(coalesce(sum(r * 25 + c + 1) FILTER (WHERE n2.v = 1), 0) AS BIGINT) AS places FROM px JOIN n2 USING (image, r, c) GROUP BY image)
SELECT image, CASE WHEN h.inside > 0 THEN h.inside ELSE n.inside END AS inside, CASE WHEN h.inside > 0 THEN h.places ELSE n.places END AS places FROM h JOIN n USING (image) WHERE h.inside > 0 OR n.inside > 0
""")
def leaf_masks_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-infrared masks; every third image is too dark for one and takes its NDVI mask."""
    rows = raster_table(spark, sf_dir)
    dim = F.when(F.col("image") % 3 == 0, 0.04).otherwise(1.0)
    return mask_facts(pixels.leaf_masks(rows.withColumn("s", F.transform("s", lambda v: v * dim)), "image", "s", [450, 550, 670, 800]))


def spectral_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pixels of images of 20; those of label 0 are background."""
    return samples(spark, sf_dir).select(F.floor(F.col("vec_id") / 20).alias("image"), "vec_id", "x", F.coalesce(F.col("label") != 0, F.lit(False)).alias("in_mask"))


STATISTICS = {"mean": "avg(v)", "std": "stddev_pop(v)", "p25": "quantile_cont(v, 0.25)", "p75": "quantile_cont(v, 0.75)"}


@query("WITH i AS (SELECT image, unnest([" + ", ".join(f"{{'n': '{n}', 'v': CAST({sql} AS DOUBLE)}}" for n, sql in (INDEX_SQL | LAYER_SQL).items()) + "], recursive := true) FROM (SELECT vec_id // 20 AS image, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label <> 0))\n"
       + " UNION ALL ".join(f"SELECT image, n || '_{s}' AS name, round({f}, 3) + 0.0 AS value FROM i GROUP BY image, n" for s, f in STATISTICS.items()))
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of feature_vectors that holds statistics of indices and layers over each image's mask."""
    wanted = [f"{n}_{s}" for n in INDEX_SQL | LAYER_SQL for s in STATISTICS]
    rows, _ = features.build_dataset(spectral_pixels(spark, sf_dir), "image", "x", "in_mask", WAVES)
    names = F.array(*map(F.lit, features.names(WAVES)))
    long = rows.select("image", F.posexplode(F.arrays_zip(names.alias("name"), "features"))).select("image", F.col("col.name").alias("name"), F.col("col.features").alias("value"))
    return rounded(long.where(F.col("name").isin(wanted)), 3)


@query("""
WITH px AS (SELECT vec_id // 20 AS image, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label <> 0),
ms AS (SELECT image, pos, 400 + 600 * pos / 63 AS wl, avg(v) AS v FROM px GROUP BY ALL),
sn AS (SELECT image, pos, wl, (v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p = 0 THEN 1 ELSE stddev_pop(v) OVER p END AS v FROM ms WINDOW p AS (PARTITION BY image)),
w AS (SELECT pos AS mid_of, least(greatest(pos, 5), 58) AS mid FROM (SELECT unnest(range(64)) AS pos)),
d AS (SELECT image, mid_of AS pos, 400 + 600 * mid_of / 63 AS wl, sum(v * (pos - mid)) / 110 + 2 * any_value(mid_of - mid) * sum(v * ((pos - mid) * (pos - mid) - 10)) / 858 AS v FROM sn JOIN w ON pos BETWEEN mid - 5 AND mid + 5 GROUP BY image, mid_of),
b AS (SELECT image, wl AS x, v, CASE WHEN first_value(v) OVER o > 0 THEN first_value(v) OVER o ELSE 1e-9 END AS a, CASE WHEN last_value(v) OVER o > 0 THEN last_value(v) OVER o ELSE 1e-9 END AS z, min(wl) OVER o AS x0, max(wl) OVER o AS x1 FROM ms WHERE wl BETWEEN 410 AND 510
  WINDOW o AS (PARTITION BY image ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r AS (SELECT image, x, v / (a + (z - a) * (x - x0) / (x1 - x0)) AS r FROM b),
t AS (SELECT *, lag(x) OVER o AS px, lag(r) OVER o AS pr FROM r WINDOW o AS (PARTITION BY image ORDER BY x)),
ab AS (SELECT image, 1 - min(r) AS depth, sum((greatest(1 - r, 0) + greatest(1 - pr, 0)) / 2 * (x - px)) AS area FROM t GROUP BY image),
pk AS (SELECT image, name, arg_max(struct_pack(wl := wl, v := v), (abs(v), -pos)) AS b FROM d, (VALUES ('red', 680, 760), ('blue', 430, 510), ('all', 0, 9999)) q(name, low, high) WHERE wl BETWEEN low AND high GROUP BY ALL)
SELECT image, 'snv_R' || CAST(round(wl) AS INTEGER) AS name, round(v, 4) + 0.0 AS value FROM sn UNION ALL SELECT image, 'd1snv_R' || CAST(round(wl) AS INTEGER), round(v, 4) + 0.0 FROM d
UNION ALL SELECT image, 'cont_BandI_depth', round(depth, 1) + 0.0 FROM ab UNION ALL SELECT image, 'cont_BandI_area', round(area, 1) + 0.0 FROM ab
UNION ALL SELECT image, 'd1_' || name || '_peak_wl', round(b.wl, 4) FROM pk UNION ALL SELECT image, 'd1_' || name || '_peak_value', round(b.v, 4) + 0.0 FROM pk
""")
def feature_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of feature_vectors that comes from each image's mean spectrum: SNV, slopes, absorption and peaks."""
    rows, _ = features.build_dataset(spectral_pixels(spark, sf_dir), "image", "x", "in_mask", WAVES)
    names = F.array(*map(F.lit, features.names(WAVES)))
    long = rows.select("image", F.posexplode(F.arrays_zip(names.alias("name"), "features"))).select("image", F.col("col.name").alias("name"), F.col("col.features").alias("value"))
    spectral = long.where(F.col("name").rlike("^(snv_R|d1snv_R|cont_|d1_)"))
    return spectral.withColumn("value", F.when(F.startswith("name", F.lit("cont_")), F.round("value", 1)).otherwise(F.round("value", 4)) + F.lit(0.0))


@query()
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = features.build_dataset(spectral_pixels(spark, sf_dir), "image", "x", "in_mask", WAVES)
    names = F.array(*map(F.lit, features.names(WAVES)))
    return rounded(rows.select("image", F.posexplode(F.arrays_zip(names.alias("name"), "features"))).select("image", F.col("col.name").alias("name"), F.col("col.features").alias("value")), 4)


@query("""
SELECT vec_id // 20 AS image, CASE WHEN count(*) FILTER (WHERE label <> 0) = 0 THEN 'empty mask' END AS failure, count(*) FILTER (WHERE label <> 0) AS inside, CAST(64 AS INTEGER) AS bands FROM embeddings GROUP BY 1
""")
def usable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.usable_images(spectral_pixels(spark, sf_dir), "image", "x", "in_mask").select("image", "failure", "inside", "bands")


@query("""
WITH e AS (SELECT vec_id // 20 AS image, label <> 0 AS m, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT image, CAST(pos AS INTEGER) AS pos, round(coalesce(avg(v) FILTER (WHERE m), avg(v)), 6) + 0.0 AS value, count(*) FILTER (WHERE m) AS n FROM e GROUP BY ALL
""")
def masked_mean_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.mean_spectra(spectral_pixels(spark, sf_dir), "image", "x", "in_mask", fall_back=True))


@query()
def cluster_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of k-means and principal-score masks of the same images."""
    px = spectral_pixels(spark, sf_dir).drop("in_mask").withColumn("score", F.get("x", F.lit(42)))
    sizes = (pixels.cluster_mask(px, "image", "x", "score", m, place=["vec_id"]).groupBy("image").agg(F.count_if("in_mask").alias("inside")).withColumn("method", F.lit(m)) for m in ("kmeans", "pca"))
    return next(sizes).unionByName(next(sizes))


@query()
def cluster_masks_of_large_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as images of hundreds of vectors, none of which is gathered: sizes of k-means and principal-score masks."""
    px = samples(spark, sf_dir).select(F.col("label").alias("image"), "vec_id", "x", F.get("x", F.lit(42)).alias("score"))
    sizes = (pixels.cluster_mask_together(px, "image", "x", "score", m, place=["vec_id"]).groupBy("image").agg(F.count_if("in_mask").alias("inside")).withColumn("method", F.lit(m)) for m in ("kmeans", "pca"))
    return next(sizes).unionByName(next(sizes))


# --- chosen features ---------------------------------------------------------------------------------------

PICKED = """m AS (SELECT label, pos, round(avg(v), 6) AS m FROM (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL),
k AS (SELECT label, pos, row_number() OVER (PARTITION BY label ORDER BY m DESC, pos) AS rk FROM m),
sel AS (SELECT label AS model, CAST(round(400 + 600 * pos / 63) AS INTEGER) AS wavelength, ['snv', 'd1snv', 'fixed_band'][pos % 3 + 1] AS category,
  CASE pos % 3 WHEN 0 THEN 'snv_R' || CAST(round(400 + 600 * pos / 63) AS INTEGER) WHEN 1 THEN 'd1snv_R' || CAST(round(400 + 600 * pos / 63) AS INTEGER) ELSE 'R' || CAST(round(400 + 600 * pos / 63) AS INTEGER) || '_mean' END AS feature FROM k WHERE rk <= 8)"""


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, feature): for each label, the eight features with the largest class mean."""
    means = samples(spark, sf_dir).select("label", F.posexplode("x")).groupBy("label", "pos").agg(F.round(F.avg("col"), 6).alias("m"))
    first = truth.first_rows(means, ["label"], [F.desc("m"), F.col("pos")], 8)
    named = F.array(*(F.lit((f"snv_R{round(w)}", f"d1snv_R{round(w)}", f"R{round(w)}_mean")[i % 3]) for i, w in enumerate(WAVES)))
    return first.select(F.col("label").alias("model"), F.get(named, F.col("pos")).alias("feature"))


@query(f"""
WITH {PICKED}, n AS (SELECT greatest(2, round_even(count(DISTINCT model) * 0.6, 0)) AS least FROM sel)
SELECT wavelength, count(DISTINCT model) AS models, count(DISTINCT model) >= any_value(least) AS strong FROM sel, n GROUP BY wavelength ORDER BY models DESC, wavelength LIMIT 25
""")
def consensus_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 wavelengths that most labels chose (a top list)."""
    return bands.top_bands(bands.consensus(picked(spark, sf_dir)))


@query(f"WITH {PICKED} SELECT model, category, count(*) AS n, array_to_string(list_sort(list(DISTINCT wavelength)), ',') AS wavelengths FROM sel GROUP BY ALL")
def chosen_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.by_category(picked(spark, sf_dir)).withColumn("wavelengths", F.array_join(F.col("wavelengths").cast("array<string>"), ","))


@query(f"""
WITH {PICKED}, h AS (SELECT category, CAST(least(wavelength // 10 * 10, 990) AS INTEGER) AS low_nm, count(*) AS n FROM sel GROUP BY ALL)
SELECT *, CASE WHEN low_nm < 700 THEN 'VIS' WHEN low_nm < 740 THEN 'Red-Edge' ELSE 'NIR' END AS region FROM h
""")
def chosen_wavelength_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.wavelength_histogram(picked(spark, sf_dir))


@query(f"WITH {PICKED} SELECT DISTINCT wavelength, feature, category FROM sel ORDER BY wavelength, feature LIMIT 30")
def first_chosen_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 chosen bands by wavelength (a top list)."""
    return bands.first_bands(picked(spark, sf_dir))


@query("SELECT 'embeddings' AS dataset, count(*) AS n, max(len(embedding)) AS p, count(DISTINCT vec_id % 25) AS groups, count(*) AS n_y FROM embeddings")
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.overview("embeddings", samples(spark, sf_dir), "x", ["y"], "grp")


# --- profiles ----------------------------------------------------------------------------------------------


@query("SELECT CAST(pos AS INTEGER) AS pos, label, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL")
def class_mean_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.class_profile(samples(spark, sf_dir), "x", "label"))


@query("SELECT CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY pos")
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.feature_profile(samples(spark, sf_dir), "x"))


GAPS = "g AS (SELECT label, pos, CASE WHEN (vec_id + pos) % 13 <> 0 THEN v END AS v FROM (SELECT vec_id, label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples() whose every thirteenth feature is NaN, and whose target is missing or NaN in some rows."""
    df = samples(spark, sf_dir)
    x = F.transform("x", lambda v, i: F.when((F.col("vec_id") + i) % 13 != 0, v).otherwise(float("nan")))
    y = F.when(F.col("vec_id") % 19 == 0, float("nan")).when(F.col("vec_id") % 17 != 0, F.col("y"))
    return df.withColumns({"x": x, "y": y})


@query(f"WITH {GAPS} SELECT CAST(pos AS INTEGER) AS pos, label, round(avg(v), 6) AS mean, count(*) AS n FROM g GROUP BY ALL")
def class_means_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.class_profile(with_gaps(spark, sf_dir), "x", "label"))


@query(f"WITH {GAPS} SELECT CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM g GROUP BY pos")
def feature_profile_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.feature_profile(with_gaps(spark, sf_dir), "x"))


@query(f"""
WITH {SAMPLES}, f AS (SELECT y FROM s WHERE vec_id % 19 <> 0 AND vec_id % 17 <> 0), e AS (SELECT min(y) AS low, max(y) AS high, least(30, greatest(5, count(*) // 5)) AS bins FROM f)
SELECT CAST(least(bins - 1, floor((y - low) * bins / (high - low))) AS INTEGER) AS bin, count(*) AS n, round(avg(y), 4) + 0.0 AS mean FROM f, e GROUP BY 1
""")
def target_histogram_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.target_histogram(with_gaps(spark, sf_dir), "y"), 4)


@query("""
WITH e AS (SELECT vec_id // 20 AS image, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label <> 0)
SELECT image, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM e GROUP BY ALL
""")
def image_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.image_profile(spectral_pixels(spark, sf_dir), "image", "x", "in_mask"))


@query("SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1")
def group_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.group_structure(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, least(30, greatest(5, count(*) // 5)) AS bins FROM orders)
SELECT CAST(least(bins - 1, floor((o_totalprice - low) * bins / (high - low))) AS INTEGER) AS bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders, e GROUP BY 1
""")
def target_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.target_histogram(table(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice"), 4)


# --- ground truth and outliers -----------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN trim(concat_ws('', p_brand, p_type, CAST(p_size AS VARCHAR))) = '' THEN 'unknown' ELSE concat_ws('|', trim(p_brand), trim(p_type), CAST(p_size AS VARCHAR)) END AS grp FROM part")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", truth.group_key(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("grp"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, coalesce(o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a), false) AS outlier_o_totalprice, CASE WHEN o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a) THEN 'iqr_o_totalprice' ELSE '' END AS reasons FROM orders, q
""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.iqr_outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey FROM orders, q WHERE NOT coalesce(o_totalprice < a - 0.1 * (b - a) OR o_totalprice > b + 0.1 * (b - a), false)
""")
def orders_without_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers by a narrow bound, dropped."""
    flagged = truth.outlier_report(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], factor=0.1)
    return truth.act_on_outliers(flagged, ["outlier"], "drop").select("o_orderkey")


@query()
def isolation_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = truth.isolation_outliers(samples(spark, sf_dir).select("vec_id", "x"), "x", "vec_id")
    return rounded(out.select("vec_id", "isolation", "outlier_isolation"))


@query()
def outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are far off by their target or their features, with all reasons."""
    out = truth.outlier_report(samples(spark, sf_dir).select("vec_id", "x", "y"), ["y"], "x", "vec_id")
    return out.select("vec_id", "outlier", "reasons")


@query("""
WITH n AS (SELECT n_nationkey, n_name, lower(trim(n_name)) AS t FROM nation), s AS (SELECT r_regionkey, lower(trim(r_name)) AS k FROM region)
SELECT s.r_regionkey, n.n_name, CASE WHEN n.t = s.k THEN 'exact' WHEN n.t IS NOT NULL THEN 'contains' END AS matched
FROM s LEFT JOIN LATERAL (SELECT n_name, t FROM n WHERE t = s.k OR contains(t, s.k) ORDER BY t = s.k DESC, n_nationkey LIMIT 1) n ON true
""")
def match_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = truth.match_by_name(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "r_name", "n_name", "n_nationkey")
    return out.select("r_regionkey", "n_name", "matched")


@query("""SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 1 WHEN contains(lower(source), 'src2') THEN 2 ELSE 3 END AS class FROM documents""")
def symptom_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = labels.normalise(F.col("source"), ascii_only=True)
    return table(spark, sf_dir, "documents").select("doc_id", labels.symptom_class(name, [("src1", 1), ("src2", 2)]).alias("class"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 3 WHEN o_totalprice / 100000 >= 2.5 THEN 0 WHEN o_totalprice / 100000 >= 1.5 THEN 2 ELSE 3 END AS class FROM orders")
def flavonol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.flavonol_class(F.col("o_totalprice").cast("double") / 100000).alias("class"))


@query("""
WITH s AS (SELECT s_suppkey, lower('Brand#' || s_suppkey % 60) AS n FROM supplier),
p AS (SELECT lower(trim(p_brand)) AS t, p_partkey, CASE p_size % 4 WHEN 1 THEN 'Healthy ' || p_type WHEN 2 THEN p_type || '  WATER   stress' WHEN 3 THEN 'mildew' ELSE ' ' END AS text, p_retailprice / 500 AS v FROM part),
r AS (SELECT t, max(p_partkey) AS p_partkey FROM p GROUP BY t),
m AS (SELECT s_suppkey, arg_max(r.p_partkey, (t = n, r.p_partkey)) AS p_partkey, bool_or(t = n) AS same FROM s JOIN r ON contains(t, n) OR contains(n, t) GROUP BY s_suppkey)
SELECT s_suppkey, CASE WHEN contains(text, 'Healthy') THEN 0 WHEN text = 'mildew' THEN 2 WHEN contains(text, 'WATER') THEN 3 WHEN v >= 2.5 THEN 0 WHEN v >= 1.5 THEN 2 ELSE 3 END AS class,
  CASE WHEN same THEN 'exact' WHEN m.p_partkey IS NOT NULL THEN 'contains' END AS matched
FROM s LEFT JOIN m USING (s_suppkey) LEFT JOIN p ON p.p_partkey = m.p_partkey
""")
def classes_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last truth row of a sample's name, exact or containing either way, gives its class by text, else by value."""
    size = F.col("p_size") % 4
    text = F.when(size == 1, F.concat(F.lit("Healthy "), "p_type")).when(size == 2, F.concat("p_type", F.lit("  WATER   stress"))).when(size == 3, "mildew").otherwise(" ")
    known = table(spark, sf_dir, "part").select("p_brand", "p_partkey", text.alias("text"), (F.col("p_retailprice") / 500).alias("v"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_suppkey") % 60).alias("name"))
    return truth.class_of(names, known, "name", "p_brand", "text", "p_partkey", "v").select("s_suppkey", "class", "matched")


@query("""
WITH t AS (SELECT o_orderpriority AS dataset, o_orderstatus AS target, count(*) AS n, min(o_orderkey) AS place FROM orders WHERE o_totalprice > 1000 GROUP BY ALL),
c AS (SELECT dataset, target, model, n FROM t JOIN (VALUES ('1-URGENT', 'P', 'ridge'), ('1-URGENT', 'F', 'pls'), ('2-HIGH', 'none', 'pls')) v(dataset, target, model) USING (dataset, target)
  UNION ALL SELECT dataset, arg_min(target, place), 'pls', arg_min(n, place) FROM t WHERE dataset NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY dataset)
SELECT dataset, target, s.selector, model, CAST(e.seed AS INTEGER) AS seed FROM c, (VALUES ('correlation'), ('lasso')) s(selector), (VALUES (1), (2), (3)) e(seed)
WHERE n >= 20 AND NOT (seed = 1 AND selector = 'lasso' AND dataset IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O'))
""")
def open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default and named targets of each dataset by selector and seed, without the excluded set and what is done."""
    orders = table(spark, sf_dir, "orders")
    targets = orders.where("o_totalprice > 1000").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("target")).agg(F.count("*").alias("n_finite"), F.min("o_orderkey").alias("position"))
    grid = truth.default_tasks(targets, ["correlation", "lasso"], [1, 2, 3], [("1-URGENT", "P", "ridge"), ("1-URGENT", "F", "pls"), ("2-HIGH", "none", "pls")], ["5-LOW"])
    done = orders.where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("dataset"), F.lit("lasso").alias("selector"), F.lit(1).alias("seed"))
    return tables.remaining(grid, done, ["dataset", "selector", "seed"])


@query("SELECT count(*) AS n, CAST(min(len(x)) AS INTEGER) AS least_features, CAST(max(len(x)) AS INTEGER) AS most_features, count(*) FILTER (WHERE grp IS NULL) AS null_grp, count(*) - count(label) AS null_label FROM (SELECT label, CASE WHEN vec_id % 7 > 0 THEN vec_id % 25 END AS grp, CASE WHEN vec_id % 9 = 0 THEN embedding[1:60] ELSE embedding END AS x FROM embeddings)")
def dataset_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, widths and missing keys of a dataset with gaps."""
    x = F.when(F.col("vec_id") % 9 == 0, F.slice("x", 1, 60)).otherwise(F.col("x"))
    df = samples(spark, sf_dir).select("label", F.when(F.col("vec_id") % 7 > 0, F.col("grp")).alias("grp"), x.alias("features"))
    return tables.dataset_checks(df, keys=["grp", "label"])
