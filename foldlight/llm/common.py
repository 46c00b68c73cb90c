"""Shared pieces of the training-data operators: scratch tables, Arrow batches, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 512


@cache
def local_dir() -> str:
    """A temporary folder of this process, for sessions whose executors are threads of the driver."""
    return tempfile.mkdtemp(prefix="spark-foldlight-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session may do without; elsewhere executors
    couldn't read each other's files, so an error is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return local_dir()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/foldlight-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside drop their shuffle files as soon as they are done, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Scratch tables that this process has made and not discarded.
MADE: set[str] = set()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark)
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    MADE.add(path)
    return out


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    MADE.discard(path)


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that materialise() returned and that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        deleted(df.sparkSession, path)


def cleanup(spark: SparkSession, *keep: DataFrame, only: set[str] | None = None) -> None:
    """Delete the scratch tables that this process has made (those of `only`, if given), but for those that the given
    frames still read. For use after results are written; files that operators are asked to write, as shards, are no
    scratch tables."""
    paths = MADE if only is None else MADE & only
    read = [f for df in keep for f in df.inputFiles()] if paths else []
    for path in list(paths):
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in read):
            deleted(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Long texts: fewer rows in an Arrow batch than Spark's default, unless the user has set fewer."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def large_batches(spark: SparkSession, rows: int = 1 << 14) -> Iterator[None]:
    """Jobs inside, which send numbers to Python and no texts, do so in larger batches than small_batches() leaves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_batches(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts add up to about max_bytes; a longer text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def sorted_groups(batches: Iterator[pa.RecordBatch], handle: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], key: str) -> Iterator[pa.RecordBatch]:
    """Feed batches that are sorted by key to handle() so that no run of equal keys is cut."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        cut = pc.index(pc.equal(keys, keys[-1]), True).as_py()
        if cut == 0 and kept and kept[-1].column(key)[-1] == keys[-1]:
            kept.append(batch)
            continue
        head = batch.slice(0, cut)
        if kept or head.num_rows:
            yield from handle(pa.concat_batches([*kept, head]) if kept else head)
        kept = [batch.slice(cut)]
    if kept:
        yield from handle(pa.concat_batches(kept))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text is divisible by 5; a null doc_id is held out too, so that it never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_share(key: F.Column) -> F.Column:
    """A number in [0, 1) from a hash of the key as text: the rows with the smallest make a repeatable sample."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string")), 11).cast("double") / float(1 << 53)


def hub_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys AQE can split, also where one side has just been aggregated by the key.

    Joined by the key and a hash of it, neither side is already dealt out as the join needs it, so both get an
    exchange of the join's own, and only such exchanges are split.
    """
    hashed = F.xxhash64(key)
    return left.withColumn("_hub", hashed).join(right.withColumn("_hub", hashed), [key, "_hub"], how).drop("_hub")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (a, b) of any ordered type: rows (node, component), component the
    smallest node that can be reached. Nodes without an edge to another node don't appear; null ends are
    ignored.

    Alternating large-star and small-star rounds: in each, nodes pass the smallest neighbour on by an
    aggregation (combined before the shuffle) and a join whose hubs AQE splits, so no neighbour list is
    ever gathered. Every round is written to the shared folder. Rounds grow with the
    logarithm of the longest path.
    """
    now = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    while True:
        state = (
            now.select(F.explode(F.array(F.struct(F.col("lo").alias("node"), F.lit(0).alias("n_hi"), F.lit(1).alias("is_lo")),
                                         F.struct(F.col("hi").alias("node"), F.lit(1).alias("n_hi"), F.lit(0).alias("is_lo")))).alias("s"))
            .select("s.*").groupBy("node").agg(F.sum("n_hi").alias("n_hi"), F.max("is_lo").alias("is_lo"))
            .agg(F.count_if((F.col("n_hi") > 1) | ((F.col("n_hi") > 0) & (F.col("is_lo") > 0))).alias("open"))
        )
        if state.first()["open"] == 0:
            break
        both = now.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")),
                                            F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("s")).select("s.*")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = hub_join(both.where(F.col("v") > F.col("u")), least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            hub_join(large, least, "hi")
            .select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), "hi"))).alias("s"))
            .select("s.*").where(F.col("lo") != F.col("hi")).distinct()
        )
        after = materialise(small)
        discard(now)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
