"""Packed arrays of numbers, added up by key as they stream by, and what rounds need beside them."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def added_by_key(rows: DataFrame, key: str, packed: str) -> DataFrame:
    """One row for each key with the sum of its packed arrays of doubles, which have one length for a key. Rows of a key
    go to one task, where two arrays are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for batch in batches:
            for k, v in zip(batch.column(key).to_pylist(), batch.column(packed), strict=True):
                part = np.frombuffer(v.as_py())
                if total is not None and k == name:
                    total = total + part
                    continue
                if total is not None:
                    yield one(batch.schema, name, total)
                name, total = k, part
        if total is not None:
            yield one(batch.schema, name, total)

    def one(schema: pa.Schema, name: object, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], schema.field(key).type), pa.array([total.tobytes()], pa.binary())], [key, packed])

    kinds = dict(rows.dtypes)
    return rows.select(key, packed).repartition(key).sortWithinPartitions(key, packed).mapInArrow(run, f"{key} {kinds[key]}, {packed} binary")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in that of spark.checkpoint.dir. A local session without the setting takes a temporary
    one; elsewhere executors couldn't read it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-foldlight-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as files in the shared folder, so that rounds don't pile up plans."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
