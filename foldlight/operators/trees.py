"""Tree models on chosen features for many train sets at once: histogram trees, grown level by level.

A fit is a train set (all rows but one fold) and the positions of the features it may use; a unit is one tree of a
fit. Values become bins of the train set's own quantiles, so nothing of the test rows is used. All units of a lot
grow together: each pass over the rows sums weights, weighted targets by (unit, node, feature, bin) block by block,
the sums of the blocks are added in the order of (unit, node) as they stream by, and each node's best split comes
out. A pass shuffles a histogram for each block and node, whatever the number of rows in a block is; trees, which
have a bound by depth, go through the driver and back to the tasks.

A table of at most SMALL bytes is sent to the tasks instead and each fit grown whole in one of them: same
histograms, same splits. A larger one of at most FIT_ROWS rows is dealt out by fit, as bins of a byte, so that a task
holds the rows of one fit; only beyond that do fits grow in passes.

Ties between splits go to the first feature and the lowest bin. Rows whose target or any feature is null or not
finite don't count, nor do those with a null fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permute import mix64
from .quantiles import exact_quantiles

#: Bytes of rows that are sent to the tasks, rows of a block beyond that, and nodes of all trees of a lot.
SMALL, BLOCK_ROWS, LOT_NODES = 32 << 20, 1 << 18, 1 << 22
#: Rows of a fit that a task holds, of about 200 bytes while it grows.
FIT_ROWS = 1 << 20
#: A split must lower the squared error by this share of the node's.
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class TreeModel:
    """A forest of bootstrapped trees (rate 0), or trees boosted on what is left, each counted at the rate."""

    trees: int = 100
    depth: int = 10
    bins: int = 32
    rate: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0


TREES = {"random_forest": TreeModel(), "boosted_trees": TreeModel(depth=4, rate=0.05, l2=1.0, rows=0.9, columns=0.9)}
#: Chances of at most 0, 1, .. of a Poisson(1) number.
POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(16)])


@dataclass(frozen=True)
class Fit:
    number: int
    fold: int
    chosen: tuple[int, ...]
    seed: int


@dataclass
class Tree:
    """Nodes in heap order from 1: the place of the feature among the chosen (-1: a leaf), the last bin that goes
    left, and the value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 1 << (depth + 1)
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 2):
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + (bins[rows, np.maximum(feature, 0)] > self.cut[at]), at)
        return at


def unit_numbers(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree."""
    key = mix64(np.array([seed & 0xFFFFFFFF, tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mix64(ids.view(np.uint64) ^ key[0] ^ (key[1] << np.uint64(1))) >> np.uint64(11)).astype(float) / float(1 << 53)


def tree_weights(ids: np.ndarray, train: np.ndarray, fit: Fit, tree: int, model: TreeModel) -> np.ndarray:
    """How often each row counts in a tree: Poisson(1) for forests, 0 or 1 for boosted trees, 0 outside the train rows."""
    u = unit_numbers(ids, fit.seed, tree)
    drawn = np.searchsorted(POISSON, u, side="right").astype(float) if model.rate == 0 else (u < model.rows).astype(float)
    return drawn * train


def tree_columns(fit: Fit, tree: int, model: TreeModel) -> np.ndarray:
    """Places of the chosen features that a tree may use."""
    n = len(fit.chosen)
    if model.columns >= 1:
        return np.arange(n)
    return np.sort(np.argsort(unit_numbers(np.arange(n), fit.seed + 1, tree), kind="stable")[: max(1, int(np.ceil(n * model.columns)))])


def histogram(bins: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray, n_bins: int) -> dict[int, np.ndarray]:
    """For each node (2, features, bins): sums of weights and of weighted targets."""
    held = w > 0
    bins, node, w, wy = bins[held], node[held], w[held], wy[held]
    if not len(node):
        return {}
    nodes, rank = np.unique(node, return_inverse=True)
    k = bins.shape[1]
    place, size = rank * n_bins, len(nodes) * n_bins
    # a feature at a time, so that a cell's number is all that is made for a row
    sums = np.empty((len(nodes), 2, k, n_bins))
    for j in range(k):
        cell = place + bins[:, j]
        sums[:, 0, j], sums[:, 1, j] = (np.bincount(cell, v, size).reshape(-1, n_bins) for v in (w, wy))
    return dict(zip(nodes.tolist(), sums, strict=True))


def best_split(sums: np.ndarray, columns: np.ndarray, l2: float) -> tuple[int, int, float, float, float]:
    """(feature or -1, last bin that goes left, values of the node and its halves) from a node's histogram."""
    w, wy = sums[0, 0].sum(), sums[1, 0].sum()
    value = wy / (w + l2)
    left_w, left_y = sums[:, columns].cumsum(axis=2)
    right_w, right_y = w - left_w, wy - left_y
    able = (left_w > 0.5) & (right_w > 0.5)  # weights are whole numbers
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, left_y**2 / (left_w + l2) + right_y**2 / (right_w + l2) - wy**2 / (w + l2), -np.inf)
    # equal up to rounding: the first feature, the lowest bin
    at = int(np.argmax(gain >= gain.max() - 1e-9 * abs(gain.max()))) if np.isfinite(gain.max()) else -1
    if at < 0 or gain.flat[at] <= LEAST_GAIN * (wy**2 / (w + l2) + 1e-12):
        return -1, 0, value, value, value
    f, b = divmod(at, sums.shape[2])
    return int(columns[f]), b, value, left_y[f, b] / (left_w[f, b] + l2), right_y[f, b] / (right_w[f, b] + l2)


def split_node(tree: Tree, node: int, split: tuple[int, int, float, float, float]) -> None:
    feature, cut, tree.value[node], left, right = split
    if feature >= 0:
        tree.feature[node], tree.cut[node] = feature, cut
        tree.value[2 * node], tree.value[2 * node + 1] = left, right


def predicted(forest: list[Tree], bins: np.ndarray, model: TreeModel, base: float) -> np.ndarray:
    """The mean of a forest; the base and the scaled sum of boosted trees."""
    total = np.zeros(len(bins))
    for tree in forest:
        total += tree.value[tree.places(bins)]
    return base + model.rate * total if model.rate else total / max(1, len(forest))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of the columns of x: how many of its edges a value is above."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def quantile_steps(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def sums_of(y: np.ndarray, p: np.ndarray) -> tuple[int, float, float, float]:
    return len(y), float(y.sum()), float((y * y).sum()), float(((y - p) ** 2).sum())


def grown(fit: Fit, model: TreeModel, bins: np.ndarray, y: np.ndarray, ids: np.ndarray, train: np.ndarray, base: float) -> list[Tree]:
    """The trees of a fit whose rows are all here."""
    forest: list[Tree] = []
    left = y.copy()
    for number in range(model.trees):
        w, columns, tree = tree_weights(ids, train, fit, number, model), tree_columns(fit, number, model), Tree.empty(model.depth)
        held = np.flatnonzero(w > 0)
        mine, weight, target = bins[held], w[held], (left - base)[held] if model.rate else left[held]
        for level in range(model.depth):
            node = tree.places(mine)
            alive = node >= 1 << level  # rows that came down to this level
            if not alive.any():
                break
            for n, sums in histogram(mine[alive], node[alive], weight[alive], (weight * target)[alive], model.bins).items():
                split_node(tree, n, best_split(sums, columns, model.l2))
        forest.append(tree)
        if model.rate:
            left = left - model.rate * tree.value[tree.places(bins)]
    return forest


FIELDS = "fit int, n double, s double, ss double, sse double"


def scores_of_small(rows: pd.DataFrame, fits: list[Fit], model: TreeModel, bases: dict[int, float], spark) -> DataFrame:
    """Test sums of each fit; the rows are sent to the tasks, a fit is grown in one of them."""
    x, y = np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float)
    fold, ids = rows["fold"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((x, y, fold, ids, fits))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, fold, ids, every = sent.value
        for part in parts:
            out = []
            for i in part["i"]:
                fit = every[i]
                own, train = x[:, list(fit.chosen)], fold != fit.fold
                edges = [np.unique(np.quantile(own[train, j], quantile_steps(model.bins))) for j in range(own.shape[1])] if train.any() else [np.zeros(0)] * own.shape[1]
                bins = binned(own, edges)
                forest = grown(fit, model, bins, y, ids, train, bases[fit.fold])
                out.append((fit.number, *sums_of(y[~train], predicted(forest, bins[~train], model, bases[fit.fold]))))
            yield pd.DataFrame(out, columns=["fit", "n", "s", "ss", "sse"])

    tasks = spark.range(0, len(fits), 1, max(1, min(len(fits), 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("i"))
    return tasks.mapInPandas(run, FIELDS)


def scores_by_fit(rows: DataFrame, fits: list[Fit], model: TreeModel, edges: dict[int, list[np.ndarray]], bases: dict[int, float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Test sums of each fit; its rows, as bins, meet in one task and it is grown there."""
    sent = rows.sparkSession.sparkContext.broadcast((fits, edges, bases))
    names = ["i", "bins", "y", "fold", "id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, edges, _ = sent.value
        for x, y, fold, ids in blocks(batches, min(block_rows, 1 << 14)):
            for i, fit in enumerate(every):
                bins = binned(x[:, list(fit.chosen)], [edges[fit.fold][j] for j in fit.chosen])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (bins, y, fold, ids))], names)

    def grow(i: int, held: list[list[bytes]]) -> pa.RecordBatch:
        every, _, bases = sent.value
        fit = every[i]
        bins, y, fold, ids = (np.concatenate([np.frombuffer(h[c], t) for h in held]) for c, t in enumerate((np.uint8, float, np.int64, np.int64)))
        order = np.lexsort((y, ids))  # so that sums come out the same however the table is split
        bins, y, ids, train = bins.reshape(len(y), -1)[order], y[order], ids[order], fold[order] != fit.fold
        forest = grown(fit, model, bins, y, ids, train, bases[fit.fold])
        sums = sums_of(y[~train], predicted(forest, bins[~train], model, bases[fit.fold]))
        return pa.RecordBatch.from_arrays([pa.array([fit.number], pa.int32()), *(pa.array([float(v)]) for v in sums)], ["fit", "n", "s", "ss", "sse"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:  # sorted by fit: the rows of one fit are held at a time
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and row[0] != at:
                    yield grow(at, held)
                    held = []
                at = row[0]
                held.append(row[1:])
        if held:
            yield grow(at, held)

    dealt = rows.mapInArrow(deal, "i int, bins binary, y binary, fold binary, id binary").repartitionById(len(fits), "i").sortWithinPartitions("i")
    return dealt.mapInArrow(run, FIELDS)


def train_edges(rows: DataFrame, folds: list[int], bins: int, width: int, used: list[int]) -> dict[int, list[np.ndarray]]:
    """For each fold and used feature the distinct quantiles of the rows of all other folds: folds x features rows."""
    member = F.array_compact(F.array(*(F.when(F.col("fold") != k, F.lit(k)) for k in folds)))
    values = F.array(*(F.struct(F.lit(j).alias("pos"), F.get("x", F.lit(j)).alias("v")) for j in used))
    long = rows.select(F.explode(member).alias("set"), values.alias("x")).select("set", F.explode("x").alias("p")).select("set", "p.*")
    out = {k: [np.zeros(0)] * width for k in folds}
    for r in exact_quantiles(long, ["set", "pos"], "v", quantile_steps(bins)).collect():
        out[r["set"]][r["pos"]] = np.unique(r["quantiles"])
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, fold, id) of up to about `rows` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield unpacked(held)
            held = []
    if sum(b.num_rows for b in held):
        yield unpacked(held)


def unpacked(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    b = pa.concat_batches(held)
    y, fold, ids = (b.column(c).to_numpy() for c in ("y", "fold", "id"))
    return np.asarray(b.column("x").flatten(), float).reshape(b.num_rows, -1), y, fold, ids


def level_splits(rows: DataFrame, fits: list[Fit], forests: list[list[Tree]], growing: list[tuple[int, int]], model: TreeModel, level: int, edges: dict[int, list[np.ndarray]], bases: dict[int, float], block_rows: int) -> list[tuple[int, int, int, int, float, float, float]]:
    """(unit, node, *split) for the nodes of a level of the growing units (position of the fit, tree)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((fits, forests, growing, edges, bases))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, forests, growing, edges, bases = sent.value
        for x, y, fold, ids in blocks(batches, block_rows):
            known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for unit, (f, number) in enumerate(growing):
                fit = fits[f]
                if f not in known:
                    known.clear()
                    bins = binned(x[:, list(fit.chosen)], [edges[fit.fold][j] for j in fit.chosen])
                    left = y - predicted(forests[f][:number], bins, model, bases[fit.fold]) if model.rate else y
                    known[f] = bins, left, fold != fit.fold
                bins, left, train = known[f]
                w, node = tree_weights(ids, train, fit, number, model), forests[f][number].places(bins)
                w = w * (node >= 1 << level)
                found = histogram(bins, node, w, w * left, model.bins)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([unit] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["unit", "node", "sums"])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, _, growing, _, _ = sent.value
        key, total, out = None, None, []

        def close() -> None:
            f, number = growing[key[0]]
            shaped = total.reshape(2, len(fits[f].chosen), model.bins)
            out.append((*key, *best_split(shaped, tree_columns(fits[f], number, model), model.l2)))

        for batch in batches:  # sorted by unit and node: one histogram is held at a time
            for unit, node, packed in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(packed.as_py())
                if key == (unit, node):
                    total = total + part
                    continue
                if key is not None:
                    close()
                key, total = (unit, node), part
        if key is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["unit", "node", "feature", "cut", "value", "low", "high"])

    made = rows.mapInArrow(sums, "unit long, node long, sums binary").repartition("unit", "node").sortWithinPartitions("unit", "node")
    return [tuple(r) for r in made.mapInArrow(splits, "unit long, node long, feature long, cut long, value double, low double, high double").collect()]  # at most 2^level rows a unit


def scores_by_level(rows: DataFrame, fits: list[Fit], model: TreeModel, edges: dict[int, list[np.ndarray]], bases: dict[int, float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Test sums of each fit of a lot, grown in passes over the rows."""
    forests = [[Tree.empty(model.depth) for _ in range(model.trees)] for _ in fits]
    for step in range(model.trees if model.rate else 1):  # boosted trees wait for those before them
        growing = [(f, t) for f in range(len(fits)) for t in ([step] if model.rate else range(model.trees))]
        for level in range(model.depth):
            found = level_splits(rows, fits, forests, growing, model, level, edges, bases, block_rows)
            for unit, node, *split in found:
                f, number = growing[unit]
                split_node(forests[f][number], node, tuple(split))
            alive = {unit for unit, _, feature, *_ in found if feature >= 0}
            growing = [g for unit, g in enumerate(growing) if unit in alive]
            if not growing:
                break
    sent = rows.sparkSession.sparkContext.broadcast((fits, forests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, forests = sent.value
        total: dict[int, np.ndarray] = {}
        for x, y, fold, _ in blocks(batches, block_rows):
            for fit, forest in zip(fits, forests, strict=True):
                test = fold == fit.fold
                if test.any():
                    bins = binned(x[test][:, list(fit.chosen)], [edges[fit.fold][j] for j in fit.chosen])
                    total[fit.number] = total.get(fit.number, 0) + np.array(sums_of(y[test], predicted(forest, bins, model, bases[fit.fold])))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([float(v[i]) for v in total.values()]) for i in range(4))], ["fit", "n", "s", "ss", "sse"])

    return rows.mapInArrow(run, FIELDS).groupBy("fit").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss", "sse")))


def tree_sums(df: DataFrame, key: str, features: str, target: str, fold: str, fits: list[Fit], model: TreeModel, small: int = SMALL, block_rows: int = BLOCK_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(fit, n, s, ss, sse): rows, sums of the target (less its mean over all rows) and of its squares, and the squared
    error on each fit's test rows, those of its fold."""
    spark = df.sparkSession
    good = df.where(F.col(fold).isNotNull() & F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & ~F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    facts = good.agg(F.avg(target).alias("mean"), F.count("*").alias("n"), F.max(F.size(features)).alias("p")).first()
    if not facts["n"]:
        return spark.createDataFrame([], FIELDS)
    rows = good.select(F.xxhash64(key).alias("id"), F.col(features).alias("x"), (F.col(target).cast("double") - facts["mean"]).alias("y"), F.col(fold).cast("long").alias("fold"))
    by_fold = {r["fold"]: (r["n"], r["s"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # one row a fold
    n, s = (sum(v[i] for v in by_fold.values()) for i in (0, 1))
    bases = {k: (s - v[1]) / max(1, n - v[0]) for k, v in by_fold.items()}
    if 8 * facts["n"] * (facts["p"] + 3) <= small:
        # sorted, so that sums come out the same however the table is split
        return scores_of_small(rows.toPandas().sort_values(["id", "y"], kind="stable"), fits, model, bases, spark)
    rows, out = rows.persist(), None
    used = sorted({j for f in fits for j in f.chosen})
    edges = train_edges(rows, sorted(by_fold), model.bins, facts["p"], used) if used else {k: [np.zeros(0)] * facts["p"] for k in by_fold}
    if facts["n"] <= fit_rows:
        return scores_by_fit(rows, fits, model, edges, bases, block_rows)
    many = max(1, LOT_NODES // (model.trees << (model.depth + 1)))
    for at in range(0, len(fits), many):
        part = scores_by_level(rows, fits[at : at + many], model, edges, bases, block_rows)
        out = part if out is None else out.union(part)
    return out
