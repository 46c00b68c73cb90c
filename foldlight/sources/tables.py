"""Measurement tables, annotations, datasets and results: reading, checking, writing, resuming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Text of bytes in utf-8 (mark dropped), else cp1252, else latin-1."""

    def one(data: bytes) -> str:
        for encoding in ("utf-8-sig", "cp1252"):
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return data.decode("latin-1")

    return contents.map(one)


def read_ground_truth(files: DataFrame, header: list[str], numbers: list[str], separator: str = ";") -> DataFrame:
    """Rows of dirty delimited files (path, content): outer quotes dropped, short rows padded, long rows cut, bad
    numbers null. header names the columns; the first line is skipped. `line` keeps the order."""
    lines = files.select(F.posexplode(F.split(decoded("content"), r"\r\n|\n|\r")).alias("line", "text")).where((F.col("line") > 0) & (F.trim("text") != ""))
    fields = F.split(F.regexp_replace(F.regexp_replace(F.trim("text"), '^"|"$', ""), '""', '"'), separator)
    out = lines.withColumn("f", fields).select("line", *(F.nullif(F.trim(F.regexp_replace(F.get("f", F.lit(i)), '^"|"$', "")), F.lit("")).alias(c) for i, c in enumerate(header)))
    return out.withColumns({c: F.expr(f"try_cast(replace(`{c}`, ',', '.') AS double)") for c in numbers})


def normalise_names(df: DataFrame) -> DataFrame:
    """`filename` from directoryName, else imageID, else the first column."""
    for c in ("directoryName", "imageID", df.columns[0]):
        if c in df.columns:
            return df.withColumnRenamed(c, "filename")
    return df


#: Measured columns and target names.
MEASUREMENTS = {"SPAD": "chlorophyll", "RWC": "rwc", "FvFm": "fvfm", "PI": "pi", "NDVI": "ndvi", "Soil_Moisture": "soil_moisture"}


def read_measurements(spark: SparkSession, path: str, samples: DataFrame, key: str = "Sample_Index") -> DataFrame:
    """Measured targets of the samples that have an image (samples: one column named key)."""
    rows = spark.read.option("header", "true").csv(path)
    typed = rows.select(F.col(key).cast("int").alias(key), *(F.expr(f"try_cast(`{c}` AS double)").alias(n) for c, n in MEASUREMENTS.items() if c in rows.columns))
    return typed.join(samples.select(F.col(key).cast("int").alias(key)).distinct(), key)


def read_annotations(files: DataFrame, types: str = "struct<type:string,FD:boolean,ESCA:boolean>") -> DataFrame:
    """(image, type, FD, ESCA as 1.0 or 0.0) of a JSON map; calibration panels and missing entries are left out."""
    rows = files.select(F.explode(F.from_json(F.decode("content", "UTF-8"), f"map<string,{types}>")).alias("image", "a"))
    return rows.where(F.col("a").isNotNull() & (F.coalesce("a.type", F.lit("")) != "calibration_panel")).select("image", "a.type", *(F.coalesce(F.col(f"a.{c}").cast("double"), F.lit(0.0)).alias(c) for c in ("FD", "ESCA")))


LOADERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def load(spark: SparkSession, name: str) -> DataFrame:
    """A dataset by the name it was registered under in LOADERS."""
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name}")
    return LOADERS[name](spark)


def dataset_checks(df: DataFrame, features: str = "features", keys: list[str] | None = None) -> DataFrame:
    """One row: rows, least and largest feature count, nulls of each key."""
    return df.agg(F.count("*").alias("n"), F.min(F.size(features)).alias("least_features"), F.max(F.size(features)).alias("most_features"), *(F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys or []))


def to_wide(df: DataFrame, features: str, names: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c != features), *(F.get(features, F.lit(i)).alias(n) for i, n in enumerate(names)))


def to_array(df: DataFrame, names: list[str], features: str = "features") -> DataFrame:
    return df.withColumn(features, F.array(*(F.col(n).cast("double") for n in names))).drop(*names)


def write_dataset(df: DataFrame, features: str, names: list[str], path: str) -> None:
    """A feature dataset: keys and targets first, then a column for each feature, as Parquet."""
    to_wide(df, features, names).write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, keys: list[str], features: str = "features") -> tuple[DataFrame, list[str]]:
    """(keys and an array of all other columns, their names); columns that are missing among the keys are an error."""
    wide = spark.read.parquet(path)
    missing = set(keys) - set(wide.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    names = [c for c in wide.columns if c not in keys]
    return to_array(wide, names, features), names


def write_results(df: DataFrame, path: str, tag: str) -> None:
    """Append under the settings' tag; the writer's commit makes a batch visible as a whole."""
    df.withColumn("cfg_tag", F.lit(tag)).write.mode("append").partitionBy("cfg_tag").parquet(path)


def read_results(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Only the tag's partitions are read."""
    return spark.read.parquet(path).where(F.col("cfg_tag") == tag)


def remaining(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_grid(grid: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, tag: str, keys: list[str], seed: str = "seed", batch: int = 16) -> DataFrame:
    """Evaluates the grid's combinations (keys, with the seed among them) in batches and returns all rows of the tag.

    Each batch is what the grid has and the results under `path` don't; evaluate() gets it and returns rows with all
    its keys. A combination's rows are a partition of their own (tag, seed, combination), and a batch replaces the
    partitions that it writes, so a run that is stopped loses the batch it was at, and one that starts again repeats
    none of those before and writes none twice.
    """
    spark = grid.sparkSession
    other = [k for k in keys if k != seed]
    combo = F.md5(F.to_json(F.struct(*other), {"ignoreNullFields": "false"}).cast("binary"))
    table, left = f"{path}/cfg_tag={tag}", None
    named = grid.select(*keys).distinct().withColumn("combo", combo)
    while True:
        todo = named
        if stored(spark, table):
            done = spark.read.parquet(table).select(F.col("combo").cast("string").alias("combo"), F.col("seed_part").cast("string").alias("seed_part")).distinct()
            todo = named.join(done, (named["combo"] == done["combo"]) & named[seed].cast("string").eqNullSafe(done["seed_part"]), "left_anti")
        many = todo.count()
        if not many:
            break
        if left is not None and many >= left:
            raise ValueError("evaluate() returned no rows for some combinations")
        left = many
        # bounded by `batch`; the order makes a batch the same whenever it is taken
        now = spark.createDataFrame(todo.orderBy(seed, "combo").limit(batch).select(*keys).collect(), grid.select(*keys).schema)
        rows = evaluate(now).withColumns({"combo": combo, "seed_part": F.col(seed).cast("string")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed_part", "combo").parquet(table)
    return spark.read.parquet(table).drop("seed_part", "combo")


def write_summary(df: DataFrame, summary: DataFrame, path: str) -> None:
    """A table and its overall row, each as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/table")
    summary.write.mode("overwrite").option("header", "true").csv(f"{path}/overall")
