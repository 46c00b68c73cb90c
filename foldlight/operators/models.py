"""Linear models and selectors on moment matrices; tree models on rows through pyspark.ml.

A model: (moments of the train rows, chosen positions) -> (intercept, coefficients of all features).
A selector: (moments of the train rows, k, seed) -> chosen positions, ascending. The moments may be one
matrix or a stack of matrices, one for each inner fold, which selectors that validate inside the train rows
need. Both are looked up by name, and users may add their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import centred, r2, test_errors
from .quantiles import exact_quantiles

Model = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]
Selector = Callable[[np.ndarray, int, int], np.ndarray]


def full(p: int, chosen: np.ndarray, coef: np.ndarray) -> np.ndarray:
    out = np.zeros(p)
    out[chosen] = coef
    return out


def whole(m: np.ndarray) -> np.ndarray:
    """One matrix for all rows of a matrix or a stack of inner folds."""
    return m if m.ndim == 2 else m.sum(axis=0)


def ridge(m: np.ndarray, chosen: np.ndarray, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    sxx, sxy, _, mx, my, _ = centred(m)
    a = sxx[np.ix_(chosen, chosen)] + alpha * np.eye(len(chosen))
    coef = full(len(mx), chosen, np.linalg.solve(a, sxy[chosen]))
    return my - coef @ mx, coef


def least_squares(m: np.ndarray, chosen: np.ndarray) -> tuple[float, np.ndarray]:
    sxx, sxy, _, mx, my, _ = centred(m)
    coef = full(len(mx), chosen, np.linalg.lstsq(sxx[np.ix_(chosen, chosen)], sxy[chosen], rcond=None)[0])
    return my - coef @ mx, coef


def pls(m: np.ndarray, chosen: np.ndarray, components: int = 10) -> tuple[float, np.ndarray]:
    """PLS1 on features and target scaled to unit sample deviation, at most p or n - 1 components."""
    sxx, sxy, syy, mx, my, n = centred(m)
    sd, sd_y = np.sqrt(np.maximum(np.diag(sxx)[chosen], 0) / (n - 1)), np.sqrt(max(syy, 0) / (n - 1))
    sd, sd_y = np.where(sd > 1e-12, sd, 1.0), sd_y if sd_y > 1e-12 else 1.0
    c, b = sxx[np.ix_(chosen, chosen)] / np.outer(sd, sd), sxy[chosen] / (sd * sd_y)
    weights, loads, inner, left = [], [], [], b.copy()
    spread = c.copy()
    for _ in range(max(1, min(components, len(chosen), int(n) - 1))):
        size = np.linalg.norm(left)
        if size < 1e-12:
            break
        w = left / size
        tt = w @ spread @ w
        if tt < 1e-12:
            break
        load, q = spread @ w / tt, left @ w / tt
        weights.append(w)
        loads.append(load)
        inner.append(q)
        left = left - load * tt * q
        spread = spread - tt * np.outer(load, load)
    if not weights:
        return my, np.zeros(len(mx))
    w, p = np.array(weights).T, np.array(loads).T
    coef = full(len(mx), chosen, (w @ np.linalg.solve(p.T @ w, np.array(inner))) * sd_y / sd)
    return my - coef @ mx, coef


def coordinate_descent(c: np.ndarray, b: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, sweeps: int = 1000) -> np.ndarray:
    """Minimises w'cw/2 - b'w + l1 |w| + l2 |w|^2 / 2."""
    w = np.zeros(len(b)) if start is None else start.copy()
    g = b - c @ w
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if c[j, j] <= 0:
                continue
            rho = g[j] + c[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0) / (c[j, j] + l2)
            if new != w[j]:
                g -= c[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-7:
            break
    return w


def scaled(m: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean products of standardised features, and with the centred target; their deviations."""
    sxx, sxy, _, _, _, n = centred(m)
    sd = np.sqrt(np.maximum(np.diag(sxx)[chosen] / n, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    return sxx[np.ix_(chosen, chosen)] / np.outer(sd, sd) / n, sxy[chosen] / sd / n, sd


def elastic_net(m: np.ndarray, chosen: np.ndarray, alpha: float = 0.1, l1_ratio: float = 0.5) -> tuple[float, np.ndarray]:
    c, b, sd = scaled(m, chosen)
    _, _, _, mx, my, _ = centred(m)
    coef = full(len(mx), chosen, coordinate_descent(c, b, alpha * l1_ratio, alpha * (1 - l1_ratio)) / sd)
    return my - coef @ mx, coef


def top_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, the lower position first on ties; k is clipped to 1 .. p."""
    return np.sort(np.lexsort((np.arange(len(scores)), -scores))[: min(max(k, 1), len(scores))])


def select_correlation(m: np.ndarray, k: int = 20, seed: int = 42) -> np.ndarray:
    sxx, sxy, syy, *_ = centred(whole(m))
    norm = np.sqrt(np.maximum(np.diag(sxx), 0) * max(syy, 0))
    return top_k(np.abs(sxy / np.where(norm > 0, norm, 1.0)), k)


def select_rfe(m: np.ndarray, k: int = 20, seed: int = 42) -> np.ndarray:
    """Ridge, dropping a tenth of the initial number of features each round, the smallest squared coefficients first."""
    m = whole(m)
    left = np.arange(len(m) - 2)
    k, step = min(max(k, 1), len(left)), max(1, int(0.1 * len(left)))
    while len(left) > k:
        _, coef = ridge(m, left)
        drop = np.argsort(coef[left] ** 2, kind="stable")[: min(step, len(left) - k)]
        left = np.delete(left, drop)
    return left


def lasso_path(c: np.ndarray, b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Coefficients for each alpha, from large to small, each started from the one before."""
    w, out = None, []
    for alpha in grid:
        w = coordinate_descent(c, b, alpha, 0.0, w, 200)
        out.append(w)
    return np.array(out)


def lasso_weights(m: np.ndarray, alphas: int = 30) -> np.ndarray:
    """Coefficients standardised by all train rows, at the alpha of a path with the least mean squared error over the
    inner folds of a stack, or, for a single matrix, by an information criterion (BIC)."""
    total = whole(m)
    every = np.arange(len(total) - 2)
    c, b, sd = scaled(total, every)
    _, _, syy, _, _, n = centred(total)
    grid = max(np.abs(b).max(initial=0.0), 1e-12) * np.logspace(0, -3, alphas)
    path = lasso_path(c, b, grid)
    if m.ndim == 3 and len(m) > 1:
        loss = np.zeros(len(grid))
        for inner in m:
            sxx, sxy, _, mx, my, left = centred(total - inner)
            for i, w in enumerate(lasso_path(sxx / np.outer(sd, sd) / left, sxy / sd / left, grid)):
                sse, _, size = test_errors(inner, my - w / sd @ mx, w / sd)
                loss[i] += sse / max(size, 1)
    else:
        error = np.maximum(syy / n - 2 * path @ b + np.einsum("ij,jk,ik->i", path, c, path), 1e-12)
        loss = n * np.log(error) + np.log(n) * (path != 0).sum(axis=1)
    return path[int(np.argmin(loss))]


def lasso_choice(best: np.ndarray, k: int) -> np.ndarray:
    """Up to k non-zero coefficients are all taken, k is a ceiling; more or none: the k largest."""
    chosen = np.flatnonzero(best)
    return chosen if 0 < len(chosen) <= k else top_k(np.abs(best), k)


def select_lasso(m: np.ndarray, k: int = 20, seed: int = 42, alphas: int = 30) -> np.ndarray:
    return lasso_choice(lasso_weights(m, alphas), k)


class Search:
    """A genetic search over feature masks, one generation at a time, for whoever can score masks: tournaments of 3,
    uniform crossover, bit flips, an elite that stays. What it does depends on the seed and the scores alone, not on
    where they were computed."""

    def __init__(self, p: int, k: int = 20, seed: int = 42, population: int = 40, elite: int = 5) -> None:
        self.rng, self.p, self.elite = np.random.default_rng(seed), p, elite
        self.known: dict[bytes, float] = {}
        #: (generation, best, mean, size of the best)
        self.log: list[tuple[int, float, float, int]] = []
        self.masks = self.rng.random((population, p)) < min(0.5, max(5, k) / p)

    def unknown(self) -> list[bytes]:
        """Packed masks of the population that have no score yet, each once; under five features they have score 0."""
        out = {}
        for mask in self.masks:
            key = np.packbits(mask).tobytes()
            if key not in self.known:
                if mask.sum() < 5:
                    self.known[key] = 0.0
                else:
                    out[key] = None
        return list(out)

    def scores(self) -> np.ndarray:
        return np.array([self.known[np.packbits(m).tobytes()] for m in self.masks])

    def breed(self) -> None:
        """The next generation from a population whose masks are all known."""
        rng, scores, (population, p) = self.rng, self.scores(), self.masks.shape
        order = np.argsort(-scores, kind="stable")
        self.log.append((len(self.log), float(scores[order[0]]), float(scores.mean()), int(self.masks[order[0]].sum())))
        picks = rng.integers(0, population, (population, 3))
        parents = self.masks[picks[np.arange(population), scores[picks].argmax(axis=1)]]
        mates, swap = parents[rng.permutation(population)], rng.random((population, p)) < 0.5
        children = np.where(swap & (rng.random((population, 1)) < 0.7), mates, parents)
        children ^= (rng.random((population, p)) < 1 / p) & (rng.random((population, 1)) < 0.3)
        children[: self.elite] = self.masks[order[: self.elite]]
        self.masks = children

    def best(self) -> np.ndarray:
        return np.flatnonzero(self.masks[int(np.argmax(self.scores()))])


def mask_fitness(m_folds: np.ndarray, trains: np.ndarray, key: bytes, fit: Model = ridge) -> float:
    """The mean R2 of `fit` over inner folds on the features of a packed mask, at least 0; 0 where it can't be fitted.
    trains: for each inner fold the moments of all others."""
    chosen = np.flatnonzero(np.unpackbits(np.frombuffer(key, np.uint8), count=m_folds.shape[1] - 2))
    try:
        return max(0.0, float(np.mean([r2(*test_errors(m, *fit(t, chosen))[:2]) for m, t in zip(m_folds, trains, strict=True)])))
    except np.linalg.LinAlgError:
        return 0.0


def searched_subsets(m_folds: np.ndarray, k: int = 20, seed: int = 42, population: int = 40, generations: int = 25, elite: int = 5, fit: Model = ridge) -> tuple[np.ndarray, list[tuple[int, float, float, int]]]:
    """A whole Search in this process on the moments of inner folds: the best mask's positions and the log."""
    search, trains = Search(m_folds.shape[1] - 2, k, seed, population, elite), m_folds.sum(axis=0) - m_folds
    for generation in range(generations + 1):
        search.known |= {key: mask_fitness(m_folds, trains, key, fit) for key in search.unknown()}
        if generation < generations:
            search.breed()
    return search.best(), search.log


def subset_search(m_folds: np.ndarray, k: int = 20, seed: int = 42, population: int = 40, generations: int = 25, elite: int = 5, fit: Model = ridge) -> np.ndarray:
    """Positions found by searched_subsets()."""
    return searched_subsets(m_folds, k, seed, population, generations, elite, fit)[0]


MODELS: dict[str, Model] = {"ridge": ridge, "pls": pls, "elastic_net": elastic_net, "ols": least_squares}
SELECTORS: dict[str, Selector] = {"correlation": select_correlation, "rfe": select_rfe, "lasso": select_lasso}

#: Selectors whose costly part doesn't depend on k: what to compute once, and the choice of k from it.
SHARED: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, int], np.ndarray]]] = {"lasso": (lasso_weights, lasso_choice)}

#: Selectors that fit models on the inner folds of a stack: they also take the model, as `fit`.
SEARCHES: dict[str, Selector] = {"search": subset_search}


def get_selector(name: str) -> Selector:
    if name not in SELECTORS and name not in SEARCHES:
        raise ValueError(f"unknown selector {name}")
    return SELECTORS.get(name) or SEARCHES[name]


def selector_family(name: str) -> str:
    """`filter`, `embedded`, `wrapper` or `search`."""
    get_selector(name)
    return {"correlation": "filter", "lasso": "embedded", "rfe": "wrapper"}.get(name, "search" if name in SEARCHES else "user")


def tree_predictions(df: DataFrame, features: str, target: str, fold: str, model: str = "random_forest", trees: int = 100, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of a tree model: adds `y_pred`. One fit for each fold, on the cluster."""
    make = {"random_forest": lambda: RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="y_pred", numTrees=trees, seed=seed),
            "boosted_trees": lambda: GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="y_pred", maxIter=trees, seed=seed)}
    if model not in make:
        raise ValueError(f"unknown tree model {model}")
    rows = df.withColumn("_x", array_to_vector(F.col(features)))
    out = None
    for (k,) in df.select(fold).distinct().orderBy(fold).collect():  # one row a fold
        part = make[model]().fit(rows.where(F.col(fold) != k)).transform(rows.where(F.col(fold) == k)).drop("_x")
        out = part if out is None else out.union(part)
    return out


def mutual_information(df: DataFrame, features: str, target: str, bins: int = 8, by: list[str] | None = None) -> DataFrame:
    """(by, pos, mi): each feature's mutual information with the target over quantile bins of the given rows (the
    train rows: edges from elsewhere would leak). Counts are combined before the shuffle."""
    by = by or []
    grid = [i / bins for i in range(1, bins)]
    long = df.select(*by, F.col(target).alias("y"), F.posexplode(features).alias("pos", "x"))
    ex = exact_quantiles(long, [*by, "pos"], "x", grid, weights=True).withColumnRenamed("quantiles", "ex")
    ey = exact_quantiles(df.select(*by, target), by, target, grid, weights=True).withColumnRenamed("quantiles", "ey")
    edges = ex.join(ey, by) if by else ex.crossJoin(F.broadcast(ey))  # one row
    cells = long.join(edges, [*by, "pos"]).select(*by, "pos", F.size(F.filter("ex", lambda e: e <= F.col("x"))).alias("bx"), F.size(F.filter("ey", lambda e: e <= F.col("y"))).alias("by_"))
    joint = cells.groupBy(*by, "pos", "bx", "by_").agg(F.count("*").alias("n"))
    one = Window.partitionBy(*by, "pos")  # at most bins x bins rows
    each = joint.withColumns({"nx": F.sum("n").over(Window.partitionBy(*by, "pos", "bx")), "ny": F.sum("n").over(Window.partitionBy(*by, "pos", "by_")), "total": F.sum("n").over(one)})
    return each.groupBy(*by, "pos").agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))
