"""Sums over smaller values and least values of larger ones, without one window for all rows or for a hot group.

Rows are counts by distinct value. A sketch cuts each group into at most PARTS parts of about equal size; a window
holds one part, and the parts' own totals, PARTS rows a group, are summed in another. Groups of at most FEW values
need no parts: a window holds a group then.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import met
from .sums import shared_folder

PARTS, FEW = 256, 1 << 16


#: What goes at the end of each released() that is open: frames, and paths of files.
KEPT: list[list[DataFrame | str]] = []


def kept(df: DataFrame) -> DataFrame:
    """The frame, persisted until the innermost released() ends."""
    df = df.persist()
    if KEPT:
        KEPT[-1].append(df)
    return df


def written(df: DataFrame) -> DataFrame:
    """The frame as files in the shared folder, deleted when the innermost released() ends. Plans of what reads it begin
    at the files; those over a kept() frame name all that it was made of once for each reader, so that a chain of them
    fills the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foldlight-{uuid.uuid4().hex}"
    if KEPT:
        KEPT[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(df: DataFrame) -> Iterator[None]:
    """What is kept() or written() inside goes at the end, and shuffle files that nothing refers to any more."""
    KEPT.append([])
    sc = df.sparkSession.sparkContext
    try:
        yield
    finally:
        for of in KEPT.pop():
            if isinstance(of, str):
                at = sc._jvm.org.apache.hadoop.fs.Path(of)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            else:
                of.unpersist()
        gc.collect()
        sc._jvm.System.gc()  # Spark deletes the shuffle files of collected plans


def in_parts(rows: DataFrame, by: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """Adds `__part`, ascending with the value inside each combination of `by`. Kept, as it is read more than once."""
    edges = rows.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts).alias("__edges"))
    at = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return met(rows, edges, by).withColumn("__part", at).drop("__edges").transform(kept)


def sums_before(rows: DataFrame, by: list[str], value: str, sums: list[str], parts: int = PARTS) -> DataFrame:
    """Adds <c>_before for each of `sums`: the sum of c over the rows of smaller value. One row for each (by, value)."""
    rows = kept(rows)  # read more than once
    earlier = lambda c, order, *of: F.coalesce(F.sum(c).over(Window.partitionBy(*by, *of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if (rows.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0) <= FEW:
        return rows.withColumns({f"{c}_before": earlier(c, value) for c in sums})
    dealt = in_parts(rows, by, value, parts)
    totals = dealt.groupBy(*by, "__part").agg(*(F.sum(c).alias(c) for c in sums))
    offsets = totals.select(*by, "__part", *(earlier(c, "__part").alias(f"__far_{c}") for c in sums))
    near = dealt.withColumns({f"__near_{c}": earlier(c, value, "__part") for c in sums})
    done = met(near, offsets, [*by, "__part"])
    return done.withColumns({f"{c}_before": F.col(f"__far_{c}") + F.col(f"__near_{c}") for c in sums}).drop("__part", *(f"__{w}_{c}" for w in ("far", "near") for c in sums))


def least_from(rows: DataFrame, value: str, of: Column, name: str, parts: int = PARTS) -> DataFrame:
    """Adds `name`: the least `of` over the rows of this value or a larger one. One row for each value."""
    rows = rows.withColumn("__of", of).persist()  # read more than once
    if rows.count() <= FEW:
        return rows.withColumn(name, F.min("__of").over(Window.orderBy(F.desc(value)))).drop("__of")  # at most FEW rows
    dealt = in_parts(rows, [], value, parts)
    later = dealt.groupBy("__part").agg(F.min("__of").alias("__least")).select("__part", F.min("__least").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))  # at most `parts` rows
    near = F.min("__of").over(Window.partitionBy("__part").orderBy(F.desc(value)))
    return met(dealt.withColumn("__near", near), later, ["__part"]).withColumn(name, F.least("__near", "__far")).drop("__part", "__of", "__near", "__far")
