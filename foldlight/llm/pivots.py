"""Operator 5: near-duplicate vectors through a pivot-permutation index.

Rows with equal label and vector are one class, indexed once with the number of its rows, so a group of copies costs
no more than one vector; links count rows. Each vector is described by its `nearest` closest pivots, in order. Pivots are a bounded sample: the
`pivots` classes with the smallest hash of their vec_id; every class is indexed. Unless told otherwise, pivots
double with every fourfold of the vectors (PIVOTS up to PIVOT_ROWS of them, MOST_PIVOTS at most), so lists grow with
about the square root of the table, and the nearest are two more for each doubling, which keeps the recall. Pivots are ranked by
how often they are used, rarest first, and each vector enters the inverted lists of the first
nearest - shared + 1 of its own: two vectors with `shared` pivots in common meet in the list of the
rarest of them, and there alone they are compared. In a list, vectors with at least `shared` common pivots
are retrieved and their cosine is verified in double precision.

A list longer than `block` is dealt out in blocks, and every pair of its blocks is a cell of its own, so
that no cell holds more than two blocks whatever the list's length; nothing is capped. A cell gives each
vector's number of links and one edge to the smallest vec_id that it is connected to there, not all pairs.

Defined results: an empty table gives an empty result. Equally near pivots go by their place in the sample; with
fewer pivots than `nearest` all are taken. Vectors that are null, zero, or hold null or non-finite components, or
whose label is null, link with nothing, nor do vectors of different sizes. vec_id names a vector: rows that repeat
vec_id, label and vector are one; other rows of the same vec_id add up to one result row. Rows with a
null vec_id give one row without links and component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hub_join, materialise, sorted_groups

PIVOTS, NEAREST, SHARED, BLOCK = 256, 8, 3, 2048
PIVOT_ROWS, MOST_PIVOTS = 1 << 16, 4096
#: Rows of a cell that are compared with the others at once.
STRIPE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, label, embedding) that can have a cosine."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """(label, embedding, vec_id, copies): rows of usable() that are equal but for vec_id, named by the smallest."""
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))


def labels_of(of: pa.Array) -> np.ndarray:
    """Integers in the order of the values, any type."""
    values = of.to_pylist()
    place = {v: i for i, v in enumerate(sorted(set(values)))}
    return np.array([place[v] for v in values], np.int64)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def index_size(rows: int) -> tuple[int, int]:
    """(pivots, nearest) for so many vectors."""
    doublings = 0
    while PIVOT_ROWS << 2 * doublings < rows and PIVOTS << doublings < MOST_PIVOTS:
        doublings += 1
    return PIVOTS << doublings, NEAREST + 2 * doublings


def nearest_pivots(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Adds pivot_ids, the positions of the nearest pivots in order."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.empty((batch.num_rows, nearest), np.int32)
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = unit(matrix(batch.column("embedding").take(pa.array(at))))
                with_pivots = rows[:, :size] @ pivots[:, : rows.shape[1]].T
                near[at] = np.argsort(-with_pivots, axis=1, kind="stable")[:, :nearest]
            ids = pa.ListArray.from_arrays(np.arange(0, near.size + 1, nearest, dtype=np.int32), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "pivot_ids"])

    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, pivot_ids array<int>")


def cell_links(rows: np.ndarray, ranks: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, n_pivots: int, shared: int, cosine: float) -> np.ndarray:
    """Boolean matrix of verified links; left and right mark the rows of the cell's two blocks."""
    n, words = len(rows), -(-n_pivots // 64)
    bits = np.zeros((n, words), np.uint64)
    for column in ranks.T:
        bits[np.arange(n), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    rarer = np.zeros(words, np.uint64)
    for r in range(own):
        rarer[r // 64] |= np.uint64(1) << np.uint64(r % 64)
    links = np.zeros((n, n), bool)
    for at in range(0, n, STRIPE):
        part = slice(at, at + STRIPE)
        common = sum(np.bitwise_count(bits[part, w, None] & bits[None, :, w]).astype(np.uint8) for w in range(words))
        first = sum(np.bitwise_count(bits[part, w, None] & bits[None, :, w] & rarer[w]).astype(np.uint8) for w in range(words))
        found = (common >= shared) & (first == 0) & ((left[part, None] & right[None, :]) | (right[part, None] & left[None, :]))
        if found.any():
            links[part] = found & (rows[part] @ rows.T >= cosine)
    np.fill_diagonal(links, False)
    return links


def search(indexed: DataFrame, n_pivots: int, nearest: int, shared: int, cosine: float, block: int) -> DataFrame:
    """(vec_id, label, embedding, n, root) of the classes linked in some cell: rows of the classes linked there and the
    smallest vec_id of its piece."""
    used = indexed.select(F.explode("pivot_ids").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    by_use = {r["p"]: i for i, r in enumerate(sorted(used.collect(), key=lambda r: (r["n"], r["p"])))}  # at most n_pivots rows
    rank = F.array(*(F.lit(by_use.get(p, 0)) for p in range(n_pivots)))
    ranked = indexed.withColumn("ranks", F.sort_array(F.transform("pivot_ids", lambda p: F.get(rank, p)))).drop("pivot_ids")
    listed = ranked.withColumn("own", F.explode(F.slice("ranks", 1, nearest - shared + 1)))
    length = listed.groupBy("label", "own").agg(F.count("*").alias("n")).where(F.col("n") > block).select("label", "own", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = (
        listed.join(length, ["label", "own"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("cell", F.xxhash64("label", "own", "low", "high"))
        .select("cell", "label", "own", "low", "high", "block", "vec_id", "copies", "ranks", "embedding")
    )

    def links(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label = batch.column("label").dictionary_encode().indices.to_numpy()
        own, low, high, block_of = (batch.column(c).to_numpy() for c in ("own", "low", "high", "block"))
        names, copies, out = labels_of(batch.column("vec_id")), batch.column("copies").to_numpy(), []
        keys = np.stack((label, own, low, high), axis=1)
        edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for s, e in zip([0, *edges], [*edges, len(keys)], strict=True):
            if e - s < 2:
                continue
            some = batch.slice(s, e - s)
            lengths = some.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                part = some.take(pa.array(at))
                rows, ranks, which = unit(matrix(part.column("embedding"))), matrix(part.column("ranks")).astype(np.int64), block_of[s:e][at]
                found = cell_links(rows, ranks, int(own[s]), which == low[s], which == high[s], n_pivots, shared, cosine)
                n = found @ copies[s:e][at]
                inside = np.flatnonzero(n)
                if not len(inside):
                    continue
                found, root = found[np.ix_(inside, inside)], names[s:e][at][inside]
                while True:
                    least = np.minimum(root, np.where(found, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (least == root).all():
                        break
                    root = least
                out.append((s + at[inside], n[inside], root))
        if out:
            where, n, root = (np.concatenate(c) for c in zip(*out, strict=True))
            first = np.zeros(int(names.max()) + 1, np.int64)
            first[names] = np.arange(len(names))
            at = pa.array(where)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), batch.column("embedding").take(at), pa.array(n), batch.column("vec_id").take(pa.array(first[root]))], ["vec_id", "label", "embedding", "n", "root"])

    kind = dict(indexed.dtypes)["vec_id"]
    return dealt.repartition("cell").sortWithinPartitions("cell", "label", "own", "low", "high", "vec_id").mapInArrow(
        lambda batches: sorted_groups(batches, links, "cell"), f"vec_id {kind}, label string, embedding array<double>, n long, root {kind}")


def vector_components(vectors: DataFrame, cosine: float = 0.93, pivots: int | None = None, nearest: int | None = None, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id."""
    ids = vectors.select("vec_id").distinct()
    rows = materialise(usable(vectors))
    classes = classes_of(rows)
    usual = index_size(classes.count())
    pivots, nearest = pivots or usual[0], nearest or usual[1]
    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "embedding").limit(pivots).select("embedding").collect()
    if not sample:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    size = max(len(r["embedding"]) for r in sample)
    centres = unit(np.array([list(r["embedding"]) + [0.0] * (size - len(r["embedding"])) for r in sample]))
    nearest = min(nearest, len(centres))
    shared = min(shared, nearest)
    indexed = materialise(nearest_pivots(classes, centres, nearest))
    linked = materialise(search(indexed, len(centres), nearest, shared, cosine, block))
    found = linked.groupBy("label", "embedding").agg(F.sum("n").alias("n"))
    whole = indexed.select("label", "embedding", F.col("vec_id").alias("first"), "copies").join(found, ["label", "embedding"], "left").where((F.col("copies") > 1) | F.col("n").isNotNull())
    # every row of a class with copies or links, with what the class is linked to; a class of many rows can be split
    members = materialise(hub_join(rows.withColumn("class", F.xxhash64("label", "embedding")), whole.withColumn("class", F.xxhash64("label", "embedding")).select("class", F.col("label").alias("_l"), F.col("embedding").alias("_e"), "first", "copies", "n"), "class")
                          .where((F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n")))
    edges = members.select(F.col("vec_id").alias("a"), F.col("first").alias("b")).union(linked.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    components = connected_components(edges)
    counts = members.groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = ids.join(counts, "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return named.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
