"""Selectors that need rows, by name: each scores the features of all train sets at once, as a table.

A row selector is f(rows, features, target, key, by) -> (by, pos, score): rows hold a train set's rows once for each set
(an integer column `by`), and the larger score is the better feature. No train set is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .information import TILE, cut, dealt, nearest_information, part_of, tasks_for
from .models import mutual_information
from .ordered import PARTS, kept

RowSelector = Callable[[DataFrame, str, str, str | None, str], DataFrame]


def finite_number(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def rank_correlation(rows: DataFrame, features: str, target: str, key: str | None, by: str) -> DataFrame:
    """(by, pos, score): the size of the rank correlation of each feature with the target, ties at their mean rank.

    Rows where either value isn't finite don't count for that feature. A feature that is constant, or has fewer than
    two rows, scores 0. Rows go to parts of about equal size by x, then by y, where their ranks are counted; ranks before a
    part come from counts of parts. So a row is shuffled twice, and no task holds more than parts of a set."""
    long = rows.select(F.col(by).alias("s"), F.col(target).cast("double").alias("y"), F.posexplode(features).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    seen = kept(long.groupBy("s", "pos").agg(F.count_if(finite_number("x") & finite_number("y")).alias("n")))
    size = seen.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count("*").alias("groups")).first()
    parts = int(min(PARTS, max(1, -(-(size["most"] or 0) // TILE))))
    tasks = tasks_for(rows, size["rows"] or 1, (size["groups"] or 1) * parts, TILE)

    def placed(df: DataFrame, v: str) -> DataFrame:
        """Adds `part`, by v, and `before`, the rows of the set in lower parts. What is sent: sets x features x parts numbers."""
        at = df.join(F.broadcast(kept(cut(df, ["s", "pos"], v, parts, "e"))), ["s", "pos"]).withColumn("part", part_of(F.col(v) + 0.0, "e", parts)).drop("e")
        earlier = Window.partitionBy("s", "pos").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = at.groupBy("s", "pos", "part").agg(F.count("*").alias("c"))
        return at.join(F.broadcast(counts.select("s", "pos", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))), ["s", "pos", "part"])

    def ranks(b: pa.RecordBatch, v: str) -> np.ndarray:
        _, of, many = np.unique(b.column(v).to_numpy(), return_inverse=True, return_counts=True)
        return b.column("before")[0].as_py() + (np.cumsum(many) - many + (many + 1) / 2)[of]

    def by_x(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column("s"), b.column("pos"), b.column("y"), pa.array(ranks(b, "x"))], ["s", "pos", "y", "rx"])

    def by_y(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rx, ry = b.column("rx").to_numpy(), ranks(b, "y")
        sums = (pa.array([float(v)]) for v in (len(rx), rx @ ry, rx @ rx, ry @ ry))
        yield pa.RecordBatch.from_arrays([b.column("s").slice(0, 1), b.column("pos").slice(0, 1), *sums], ["s", "pos", "n", "ab", "aa", "bb"])

    kind = dict(long.dtypes)["s"]
    pairs = long.where(finite_number("x") & finite_number("y"))
    first = dealt(placed(pairs, "x"), ["s", "pos", "part"], tasks, by_x, f"s {kind}, pos int, y double, rx double").persist()  # read for edges, counts and ranks
    each = dealt(placed(first, "y"), ["s", "pos", "part"], tasks, by_y, f"s {kind}, pos int, n double, ab double, aa double, bb double")
    sums = each.groupBy("s", "pos").agg(*(F.sum(c).alias(c) for c in ("n", "ab", "aa", "bb")))
    middle = F.col("n") * ((F.col("n") + 1) / 2) ** 2  # ranks have the mean (n + 1) / 2, ties or not
    size_ = (F.col("aa") - middle) * (F.col("bb") - middle)
    score = F.when(size_ > 0, F.abs(F.col("ab") - middle) / F.sqrt(size_)).otherwise(0.0)
    return seen.select("s", "pos").join(sums, ["s", "pos"], "left").select(F.col("s").alias(by), "pos", F.coalesce(score, F.lit(0.0)).alias("score"))


def nearest(rows: DataFrame, features: str, target: str, key: str | None, by: str) -> DataFrame:
    """Mutual information from distances to three nearest neighbours."""
    return nearest_information(rows, features, target, key, by).withColumnRenamed("mi", "score")


def binned(rows: DataFrame, features: str, target: str, key: str | None, by: str) -> DataFrame:
    """Mutual information over eight quantile bins."""
    return mutual_information(rows, features, target, by=[by]).withColumnRenamed("mi", "score")


#: By name; users may register their own.
ROW_SELECTORS: dict[str, RowSelector] = {"mutual_info": nearest, "mutual_info_binned": binned, "rank_correlation": rank_correlation}


def get_row_selector(name: str) -> RowSelector:
    if name not in ROW_SELECTORS:
        raise ValueError(f"unknown selector {name}")
    return ROW_SELECTORS[name]
