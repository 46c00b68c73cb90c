"""Mutual information of each feature with the target from distances to nearest neighbours, over any number of rows.

For every train set and feature the rows are points (x, y), each scaled to unit deviation. With r a point's distance
(the larger of both differences) to its k-th neighbour, and n_x, n_y the points nearer than r in x and in y alone, itself
included, the information is psi(n) + psi(k) - mean psi(n_x) - mean psi(n_y), at least 0.

Points of a (set, feature) are dealt to square tiles: parts of about equal size by x, each cut likewise by y. A task
holds one tile, in cells of a few points, so that a point is compared with those of its own cell and of the cells that its
square meets. Only points whose square reaches beyond their tile are sent to the other tiles that it meets. For n_x and
n_y the values of an axis are dealt to parts, where points look up both ends of their interval; only those whose
interval leaves their part are sent to others. Equal points are one with a number, so neither they nor a feature of few
values fill a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import PARTS, kept, released, written

#: Points of a tile on average, places of a cell, points and cells that are compared at once, and points whose tables are
#: on disk at a time (those of a feature at least).
TILE, CELL, PAIRS, LOT = 1 << 16, 32, 1 << 15, 1 << 24
#: Parts among which part_of() finds a value's by compiled code.
COMPILED = 16
EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """psi of a whole number from 1."""
    x = n.cast("double")
    small = F.element_at(F.array(*(F.lit(sum(1 / i for i in range(1, m)) - EULER) for m in range(1, 12))), F.least(n, F.lit(11)).cast("int"))
    return F.when(n < 12, small).otherwise(F.ln(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


def psi(n: np.ndarray) -> np.ndarray:
    """digamma() of whole numbers from 1."""
    x = np.maximum(n, 1).astype(float)
    small = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, 11)))) - EULER
    return np.where(n < 12, small[np.minimum(n, 11) - 1], np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


def wider(r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """r and what rounding may hide of it around v."""
    return r + 4e-15 * (np.abs(v) + r)


class Cells:
    """Points of a tile (which count m times) in cells: strips of equally many by x, each cut likewise by y. No more than
    k + 1 copies of a point have a place."""

    def __init__(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, k: int) -> None:
        of = np.repeat(np.arange(len(x)), np.minimum(m, k + 1))
        cells = -(-len(of) // (max(1, round(np.sqrt(len(of) / CELL))) * CELL))  # of a strip
        strips = -(-len(of) // (cells * CELL))
        of = of[np.argsort(x[of], kind="stable")]
        of = of[np.lexsort((y[of], np.arange(len(of)) // (cells * CELL)))]
        self.at = np.full(strips * cells * CELL, -1)
        self.at[: len(of)] = of
        held = self.at >= 0
        self.x, self.y = (np.where(held, v[self.at], np.inf).reshape(-1, CELL) for v in (x, y))
        low, high = (lambda v: v.min(axis=1)), (lambda v: np.where(np.isinf(v), -np.inf, v).max(axis=1))
        self.strips = np.stack((low(self.x.reshape(strips, -1)), high(self.x.reshape(strips, -1))))
        self.cells = np.stack((low(self.y), np.where(np.isinf(self.y[:, 0]), np.inf, high(self.y)))).reshape(2, strips, cells)

    def own(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of the n points the k + 1 least distances in its cell, its own 0 included, and its cell."""
        place = np.empty(n, np.int64)
        place[self.at[self.at >= 0]] = np.flatnonzero(self.at >= 0)
        out, x, y = np.full((len(self.at), k + 1), np.inf), np.where(np.isinf(self.x), 0, self.x), np.where(np.isinf(self.y), 0, self.y)
        for low in range(0, len(x), PAIRS // CELL):
            high = low + PAIRS // CELL
            far = np.maximum(np.abs(x[low:high, :, None] - self.x[low:high, None, :]), np.abs(y[low:high, :, None] - self.y[low:high, None, :])).reshape(-1, CELL)
            take = min(k + 1, CELL)
            out[low * CELL : low * CELL + len(far), :take] = np.sort(np.partition(far, take - 1, axis=1)[:, :take], axis=1)
        return out[place], place // CELL

    def search(self, x: np.ndarray, y: np.ndarray, within: np.ndarray, near: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """`near` (sorted distances of each asking point) with what other cells than `own` hold nearer than `within`."""
        of, far, each = [], [], self.cells.shape[2]
        wx, wy = wider(within, x), wider(within, y)
        first, last = np.searchsorted(self.strips[1], x - wx), np.searchsorted(self.strips[0], x + wx, "right")
        for strip in range(len(self.strips[0])):
            asking = np.flatnonzero((first <= strip) & (strip < last))
            low = np.searchsorted(self.cells[1, strip], y[asking] - wy[asking])
            upto = np.cumsum(np.maximum(0, np.searchsorted(self.cells[0, strip], y[asking] + wy[asking], "right") - low))
            for start in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                pair = np.arange(start, min(start + PAIRS, int(upto[-1])))
                which = np.searchsorted(upto, pair, "right")
                cell = strip * each + low[which] + pair - np.where(which > 0, upto[which - 1], 0)
                who = asking[which]
                if own is not None:
                    other = cell != own[who]
                    who, cell = who[other], cell[other]
                d = np.maximum(np.abs(x[who, None] - self.x[cell]), np.abs(y[who, None] - self.y[cell]))
                row, col = np.nonzero(d < within[who, None])
                of.append(who[row])
                far.append(d[row, col])
        if not of:
            return near
        of, far, k = np.concatenate(of), np.concatenate(far), near.shape[1]
        some, of = np.unique(of, return_inverse=True)
        of, far = np.concatenate((of, np.repeat(np.arange(len(some)), k))), np.concatenate((far, near[some].ravel()))
        order = np.lexsort((far, of))
        near = near.copy()
        near[some] = far[order][np.searchsorted(of[order], np.arange(len(some)))[:, None] + np.arange(k)]
        return near


def edges_of(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def part_of(value: Column, edges: str, parts: int) -> Column:
    """How many of the parts - 1 edges are below the value. Few are compared by compiled code, more would be too much of it."""
    if parts > COMPILED:
        return F.size(F.filter(edges, lambda e: e < value))
    return sum((F.when(F.get(edges, F.lit(i)) < value, 1).otherwise(0) for i in range(parts - 1)), F.lit(0))


def runs_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch for each combination of the whole numbers `by`, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in by], axis=1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1 if len(keys) else []
        for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if high == low:
                continue
            if held and (keys[low] != last).any():
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = keys[low]
    if held:
        yield pa.concat_batches(held)


def dealt(rows: DataFrame, by: list[str], tasks: int, run_one: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run_one() over the rows of each combination of the whole numbers `by`, which meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, by):
            yield from run_one(part)

    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def listed(near: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))


def arrays(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def tile_search(rows: DataFrame, k: int, tasks: int) -> DataFrame:
    """(s, pos, a, b, x, y, m, near) for rows (s, pos, a, b, x, y, m, r): without a row of m = 0 in its tile, each point's
    k least distances there; otherwise for the rows of m = 0, which ask with an r, the distances below it."""

    def tile(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y, m, r = arrays(b, "x", "y", "m", "r")
        here, asks = np.flatnonzero(m > 0), np.flatnonzero(m == 0)
        cells = Cells(x[here], y[here], m[here], k) if len(here) else None
        if cells is None or not (len(asks) or np.isnan(r).all()):
            return
        if len(asks):
            mine, near = asks, cells.search(x[asks], y[asks], r[asks], np.full((len(asks), k), np.inf))
        elif np.isnan(r).all():
            near, own = cells.own(len(here), k)
            mine, near = here, cells.search(x[here], y[here], near[:, k], near, own)[:, 1:]
        at = pa.array(mine)
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("s", "pos", "a", "b", "x", "y", "m")), listed(near)], ["s", "pos", "a", "b", "x", "y", "m", "near"])

    return dealt(rows.select("s", "pos", "a", "b", "x", "y", "m", "r"), ["s", "pos", "a", "b"], tasks, tile, "s int, pos int, a int, b int, x double, y double, m long, near array<double>")


def cut(points: DataFrame, by: list[str], value: str, parts: int, name: str) -> DataFrame:
    """(by, name): values that cut the points of each combination in about equal parts. To be kept or written: sketches
    may differ from run to run, and all rows must be dealt by the same."""
    return points.groupBy(*by).agg((F.percentile_approx(value, edges_of(parts), 10 * parts) if parts > 1 else F.array().cast("array<double>")).alias(name))


def reach(v: str) -> Column:
    """wider() of the column r around v."""
    return F.col("r") + 4e-15 * (F.abs(v) + F.col("r"))


def tasks_for(df: DataFrame, rows: int, groups: int, size: int) -> int:
    return max(1, min(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-rows // max(size, TILE)))


def radii(points: DataFrame, k: int, tile: int, most: int, rows: int, groups: int) -> DataFrame:
    """(s, pos, x, y, m, r): each point's distance to its k-th neighbour; of `rows` points in `groups` combinations (s, pos),
    the largest of which has `most`."""
    parts = int(min(PARTS, max(1, np.ceil(np.sqrt(most / tile)))))
    tasks = tasks_for(points, rows, groups * parts * parts, tile)
    by_x = written(cut(points, ["s", "pos"], "x", parts, "ex"))
    placed = points.join(by_x, ["s", "pos"]).withColumn("a", part_of(F.col("x"), "ex", parts)).drop("ex")
    by_y = written(cut(placed, ["s", "pos", "a"], "y", parts, "ey"))
    placed = placed.join(by_y, ["s", "pos", "a"]).withColumn("b", part_of(F.col("y"), "ey", parts)).drop("ey").withColumn("r", F.lit(float("nan")))
    kth = F.get("near", F.lit(k - 1))
    own = tile_search(placed, k, tasks)
    if parts == 1:
        return own.select("s", "pos", "x", "y", "m", kth.alias("r"))
    own = own.withColumn("r", F.least(kth, F.lit(1e300)))
    wide = own.join(by_x, ["s", "pos"]).withColumns({"a0": part_of(F.col("x") - reach("x"), "ex", parts), "a1": part_of(F.col("x") + reach("x"), "ex", parts)}).drop("ex")
    tall = lambda df: df.withColumns({"b0": part_of(F.col("y") - reach("y"), "ey", parts), "b1": part_of(F.col("y") + reach("y"), "ey", parts)}).drop("ey")
    met = written(tall(wide.join(by_y, ["s", "pos", "a"])).withColumn("settled", (F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1"))).drop("b0", "b1"))
    rest = met.where(~F.col("settled"))
    asked = tall(rest.withColumn("a2", F.explode(F.sequence("a0", "a1"))).join(by_y.withColumnRenamed("a", "a2"), ["s", "pos", "a2"])).withColumn("b2", F.explode(F.sequence("b0", "b1")))
    asking = asked.where((F.col("a2") != F.col("a")) | (F.col("b2") != F.col("b"))).select("s", "pos", F.col("a2").alias("a"), F.col("b2").alias("b"), "x", "y", F.lit(0).cast("long").alias("m"), "r")
    answers = tile_search(placed.unionByName(asking), k, tasks).where(F.col("m") == 0)
    both = rest.select("s", "pos", "x", "y", "m", "near").unionByName(answers.select("s", "pos", "x", "y", "m", "near"))
    least = both.groupBy("s", "pos", "x", "y").agg(F.max("m").alias("m"), F.get(F.sort_array(F.flatten(F.collect_list("near"))), F.lit(k - 1)).alias("r"))  # k values for each tile that a point's square meets
    return met.where("settled").select("s", "pos", "x", "y", "m", kth.alias("r")).unionByName(least)


def nearer_than(values: np.ndarray, upto: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many rows have a value whose difference from v, as it is rounded, is below r (no more than 0 for r = 0).
    values: ascending and distinct; upto: rows before each, and all."""
    inside = lambda at: np.where(r > 0, np.abs(values[at] - v) < r, values[at] == v)
    end = len(values)
    low, high = np.searchsorted(values, v - r), np.searchsorted(values, v + r, "right")
    while True:  # a rounded sum may be a few values off
        more, less = (low > 0) & inside(np.maximum(low - 1, 0)), (low < end) & (values[np.minimum(low, end - 1)] <= v) & ~inside(np.minimum(low, end - 1))
        if not (more | less).any():
            break
        low = low - more + (less & ~more)
    while True:
        more, less = (high < end) & inside(np.minimum(high, end - 1)), (high > 0) & (values[np.maximum(high - 1, 0)] >= v) & ~inside(np.maximum(high - 1, 0))
        if not (more | less).any():
            break
        high = high + more - (less & ~more)
    return np.maximum(upto[high] - upto[low], 0)


def axis_sums(points: DataFrame, tile: int, most: int, rows: int, groups: int) -> DataFrame:
    """(s, pos, psi): the sum of m (psi(n_x) + psi(n_y)) over the points (s, pos, x, y, m, r)."""
    parts = int(min(PARTS, max(1, -(-most // tile))))
    edges = written(cut(points, ["s", "pos"], "x", parts, "e0").join(cut(points, ["s", "pos"], "y", parts, "e1"), ["s", "pos"]))
    axes = F.array(*(F.struct(F.lit(i).alias("axis"), F.col(c).alias("v"), F.col(f"e{i}").alias("e")) for i, c in enumerate("xy")))
    each = points.join(edges, ["s", "pos"]).select("s", "pos", "m", "r", F.explode(axes).alias("of")).select("s", "pos", "m", "r", "of.*")
    if parts > 1:
        ends = [part_of(F.col("v") + sign * reach("v"), "e", parts) for sign in (-1, 1)]
        each = each.withColumns({"home": part_of(F.col("v"), "e", parts), "low": ends[0], "high": ends[1]}).drop("e").withColumn("part", F.explode(F.sequence("low", "high")))
        each = each.select("s", "pos", "axis", "part", "v", "r", F.when(F.col("part") == F.col("home"), F.col("m")).otherwise(0).alias("m"), (F.col("low") == F.col("high")).alias("whole"))
    else:
        each = each.select("s", "pos", "axis", F.lit(0).alias("part"), "v", "r", "m", F.lit(True).alias("whole"))

    def part(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, r, m, whole = arrays(b, "v", "r", "m", "whole")
        values, of = np.unique(v[m > 0], return_inverse=True)
        upto = np.concatenate(([0], np.cumsum(np.bincount(of, m[m > 0], len(values))).astype(np.int64)))
        n = nearer_than(values, upto, v, r) if len(values) else np.zeros(len(v), np.int64)
        out = np.flatnonzero(~whole)
        names = ["s", "pos", "axis", "part", "v", "r", "m", "n", "psi"]
        if len(out):
            at = pa.array(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names[:7]), pa.array(n[out]), pa.nulls(len(out), pa.float64())], names)
        if whole.any():
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(0, 1) for c in names[:4]), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([float((m * psi(n))[whole].sum())])], names)

    tasks = tasks_for(points, 2 * rows, 2 * groups * parts, tile)
    found = dealt(each, ["s", "pos", "axis", "part"], tasks, part, "s int, pos int, axis int, part int, v double, r double, m long, n long, psi double")
    if parts == 1:
        return found.groupBy("s", "pos").agg(F.sum("psi").alias("psi"))
    found = written(found)
    crossing = found.where(F.col("v").isNotNull()).groupBy("s", "pos", "axis", "v", "r", "part").agg(F.max("n").alias("n"), F.sum("m").alias("m")).groupBy("s", "pos", "axis", "v", "r").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    every = found.where(F.col("v").isNull()).select("s", "pos", "psi").unionByName(crossing.select("s", "pos", (F.col("m") * digamma(F.col("n"))).alias("psi")))
    return every.groupBy("s", "pos").agg(F.sum("psi").alias("psi"))


def nearest_information(df: DataFrame, features: str, target: str, key: str | None = None, by: str | None = None, k: int = 3, tile: int = TILE, jitter: float = 1e-10, lot: int = LOT) -> DataFrame:
    """(by, pos, mi): each feature's mutual information with the target, for each train set (an integer column `by`) if
    given. Values that aren't finite don't count. With a key, values are moved by about `jitter` of their size, by a hash
    of the key, so that equal values have an order; without one they stay as they are. Null for fewer than k + 1 rows.
    Features go in lots of about `lot` points, and what a lot left on disk goes before the next; a number for each set
    and feature comes to the driver."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    def every(lots: int, lot: int) -> DataFrame:
        """A row for each feature of the lot; the others of a row are never spread out."""
        places = F.when(F.size(features) > lot, F.sequence(F.lit(lot), F.size(features) - 1, F.lit(lots)))
        some = F.explode(F.transform(places, lambda p: F.struct(p.alias("pos"), F.get(features, p).cast("double").alias("x"))))
        rows = df.select((F.col(by) if by else F.lit(0)).cast("int").alias("s"), F.col(target).cast("double").alias("y"), (F.xxhash64(key) if key else F.lit(0)).alias("h"), some.alias("f"))
        return rows.select("s", "y", "h", "f.*").where(good("x") & good("y"))

    rows = every(1, 0)
    scale = rows.groupBy("s", "pos").agg(*(f(F.abs(c) if n == "m" else F.col(c)).alias(f"{n}{c}") for c in "xy" for n, f in (("d", F.stddev_pop), ("m", F.avg))), F.count("*").alias("n"))

    def scaled(c: str) -> Column:
        size = F.when(F.col(f"d{c}") > 0, F.col(f"d{c}")).otherwise(1.0)
        if not key:
            return F.col(c) / size
        u = F.shiftrightunsigned(F.xxhash64("h", "pos" if c == "x" else F.lit(-1)), 11).cast("double") / float(1 << 53) - 0.5
        return F.col(c) / size + u * jitter * F.greatest(F.lit(1.0), F.col(f"m{c}") / size)

    def found(some: DataFrame) -> DataFrame:
        points = written(some.join(F.broadcast(scale), ["s", "pos"]).select("s", "pos", (scaled("x") + 0.0).alias("x"), (scaled("y") + 0.0).alias("y")).groupBy("s", "pos", "x", "y").agg(F.count("*").alias("m")))
        sizes = points.groupBy("s", "pos").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count("*").alias("groups")).first()
        size = (tile, sizes["most"] or 1, sizes["rows"] or 1, sizes["groups"] or 1)
        far = written(radii(points, k, *size).where(F.col("r") < 1e300))
        counted = far.groupBy("s", "pos").agg(F.sum("m").alias("n"))
        sums = counted.join(axis_sums(far, *size), ["s", "pos"])
        mi = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(k)) - F.col("psi") / F.col("n")))
        return sums.select("s", "pos", mi.alias("mi"))

    scale = kept(scale)  # sets x features rows
    known = scale.agg(F.sum("n").alias("n"), F.count_distinct("pos").alias("p")).first()
    lots = max(1, min(known["p"], -(-(known["n"] or 0) // lot)))
    rows_found = []
    for i in range(lots):
        with released(df):
            rows_found += [tuple(r) for r in found(every(lots, i)).collect()]
    out = scale.select("s", "pos").join(df.sparkSession.createDataFrame(rows_found, "s int, pos int, mi double"), ["s", "pos"], "left")
    return out.select(*([F.col("s").alias(by)] if by else []), "pos", "mi")
