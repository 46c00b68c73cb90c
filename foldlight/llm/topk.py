"""Operator 11: exact top-k search by exhaustive term-at-a-time accumulation.

Components become integers floor(scale * x), and a vector is a sparse row of (term, weight), a term for each
component. Candidates are dealt out by hash in groups of about `rows`, queries in lots of about `queries`; every
(lot, group) is a cell that one task works on with two bounded blocks in memory. In a cell each term has a
posting list of the candidates that hold it. Query rows scatter their weights times the list's into dense score
arrays, term after term, without skipping any; lists of over half of the block are columns of their own. A
partition selection keeps each query's best of the block, ties at its last score going to the smaller vec_id, and
the blocks' winners are merged by query. All pairs are scored, so the result is exact; nothing is capped.

Queries are rows whose vec_id is divisible by `every`. Scores are exact: where a block's weights could add up
beyond 62 bits, its scores are computed with integers of any size and saturate at those of 64 bits.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector or one
of zeros scores 0 with all. Vectors of different sizes meet in the terms that both have. Weights saturate at 64
bits. Rows that repeat vec_id and vector are told apart by number only: each is a candidate of the others and a
query of its own, so their results are repeated. A null vec_id is no query, and a candidate after all others at
equal score. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sorted_groups

#: Candidates of a group and queries of a lot, on average; a table that needs fewer groups than the session has
#: shuffle partitions is dealt out to more, of LEAST candidates or more.
ROWS, QUERIES, LEAST = 16_384, 4096, 1024
#: Cells of a dense score array that are filled at once.
CELLS = 1 << 20
#: The least sum of weights that 64-bit integers may not hold.
WIDE = float(1 << 62)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, weights, copies, spread): the usable vectors as integers, rows that repeat both counted once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    weights = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col("embedding").isNotNull()).where(~bad).select("vec_id", weights.alias("weights"))
    return rows.groupBy("vec_id", "weights").agg(F.count("*").alias("copies")).withColumn("spread", F.xxhash64("vec_id", "weights"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to the width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten(), np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def postings(block: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the positions of the rows that hold it and their weights; positions None: a whole column."""
    out: list[tuple[np.ndarray | None, np.ndarray]] = []
    for column in block.T:
        at = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if 2 * len(at) > len(column) else (at, column[at]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], rows: int) -> np.ndarray:
    """Dense scores (queries x rows), term after term."""
    scores = np.zeros((len(queries), rows), queries.dtype)
    for term, (at, weights) in enumerate(lists):
        for q in np.flatnonzero(queries[:, term]):
            if at is None:
                scores[q] += queries[q, term] * weights
            elif len(at):
                scores[q, at] += queries[q, term] * weights
    return scores


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; at the last of them the earliest."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > last)
    return np.concatenate((above, np.flatnonzero(scores == last)[: k - len(above)]))


def cell_winners(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell sorted by (is_query, vec_id nulls last): (query row, candidate row, score) of each query's best."""
    asks = batch.column("is_query").to_numpy(zero_copy_only=False)
    first = int((~asks).sum())
    width = max(1, int(np.max(batch.column("weights").value_lengths().to_numpy(zero_copy_only=False), initial=0)))
    block, wanted = matrix(batch.column("weights").slice(0, first), width), matrix(batch.column("weights").slice(first), width)
    spread, copies = batch.column("spread").to_numpy(), batch.column("copies").to_numpy()
    keys = batch.column("key").to_pylist()
    # the largest score that may come up in any order of terms
    top = float(np.abs(block.astype(float)).max(axis=0) @ np.abs(wanted.astype(float)).max(axis=0)) if first and len(wanted) else 0.0
    if top >= WIDE:
        block, wanted = block.astype(object), wanted.astype(object)
    lists, out = postings(block), []
    for at in range(0, len(wanted) if first else 0, stripe := max(1, CELLS // max(1, first))):
        scores = accumulate(wanted[at : at + stripe], lists, first)
        if top >= WIDE:
            scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        for i, row in enumerate(scores):
            query = first + at + i
            # a query's own class stands aside, unless other rows repeat it
            own = [c for c in np.flatnonzero(spread[:first] == spread[query]) if keys[c] == keys[query] and copies[c] == 1]
            chosen = best_of(row, k + len(own))
            chosen = chosen[~np.isin(chosen, own)] if own else chosen
            out.append((np.full(len(chosen), query), chosen, row[chosen]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_scores(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of every query, all if there are fewer."""
    # A key tells vectors of one vec_id apart.
    kept = materialise(quantised(vectors, scale).withColumn("key", F.md5(F.concat_ws(",", F.coalesce(F.col("vec_id").cast("string"), F.lit("null")), F.col("weights").cast("array<string>")).cast("binary"))))
    asking = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    size = kept.agg(F.count("*").alias("rows"), F.count_if(asking).alias("queries")).first()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, lots = max(1, -(-size["rows"] // rows), min(partitions, size["rows"] // LEAST)), max(1, -(-size["queries"] // queries))
    parts = min(groups * lots, 4 * max(groups, partitions))
    deal = lambda n: F.pmod("spread", F.lit(n))
    across = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["lot", "group", "is_query", "vec_id", "key", "spread", "copies", "weights"]
    held = kept.withColumns({"is_query": F.lit(False), "group": deal(groups)}).withColumn("lot", across(lots)).select(columns)
    asked = kept.where(asking).withColumns({"is_query": F.lit(True), "lot": deal(lots)}).withColumn("group", across(groups)).select(columns)
    dealt = held.unionByName(asked).withColumn("cell", F.col("lot") * groups + F.col("group"))

    def winners(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query, candidate, score = cell_winners(batch, k)
        if not len(query):
            return
        at, own = pa.array(candidate), pa.array(query)
        copies, same = batch.column("copies").take(at), pc.equal(batch.column("key").take(at), batch.column("key").take(own))
        others = pc.subtract(copies, pc.cast(same, pa.int64()))  # the query itself is no candidate
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(own), batch.column("vec_id").take(own), batch.column("copies").take(own), batch.column("vec_id").take(at), pc.min_element_wise(others, k), pa.array(score)],
            ["key", "query_id", "times", "vec_id", "copies", "score"])

    kind = dict(vectors.dtypes)["vec_id"]
    order = [F.col("is_query"), F.col("vec_id").asc_nulls_last(), F.col("key")]
    found = dealt.repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", *order).mapInArrow(
        lambda batches: sorted_groups(batches, winners, "cell"), f"key string, query_id {kind}, times long, vec_id {kind}, copies long, score long")
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")
