"""Confidence intervals, pure-noise experiments and permutation tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permute import feistel
from ..operators.information import dealt, runs_of
from ..operators.moments import SUMS, Moments, added_up, column_means, fold_moments, task_sums, usable_rows
from ..operators.splits import ranked, shuffle_key
from .evaluate import fold_scores, spread


def bca_interval(point: float, draws: np.ndarray, squares: float, cubes: float, alpha: float = 0.05) -> tuple[float, float, str]:
    """(low, high, method): bias-corrected accelerated from the resamples and from the sums of squares and cubes of
    how far each left-out score is below the mean of all; the percentile form where the correction fails."""
    share, normal, method, at = (draws < point).mean(), NormalDist(), "percentile", [alpha / 2, 1 - alpha / 2]
    if 0 < share < 1 and squares > 0:
        z0, a = normal.inv_cdf(share), cubes / (6 * squares**1.5)
        at = [normal.cdf(z0 + (z0 + q) / (1 - a * (z0 + q))) for q in map(normal.inv_cdf, at)]
        method = "BCa"
    low, high = np.quantile(draws, at)
    return float(low), float(high), method


#: Rows of a bucket on average, draws made at once, and rows of the largest key that a task sorts.
BUCKET_ROWS, DRAWN, TASK_ROWS = 4096, 1 << 21, 1 << 19


def bucket_paths(rows: DataFrame, bits: int) -> DataFrame:
    """(by, bucket, rows, path): for each bucket of rows the nodes above it in a binary tree of buckets, from the root:
    (level, node, n, left), the node's rows and those of its left half. Counts of buckets are summed, not rows."""
    counts = rows.groupBy("by", "bucket").agg(F.count("*").alias("rows"))
    if not bits:
        return counts.withColumn("path", F.array().cast("array<struct<level:int,node:long,n:long,left:long>>"))
    each = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumns({
        "node": F.expr(f"shiftright(bucket, {bits} - level)"), "is_left": F.expr(f"(shiftright(bucket, {bits} - level - 1) & 1) = 0")})
    nodes = each.groupBy("by", "level", "node").agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("is_left"), F.col("rows")).otherwise(0)).alias("left"))
    return each.join(nodes, ["by", "level", "node"]).groupBy("by", "bucket", "rows").agg(F.array_sort(F.collect_list(F.struct("level", "node", "n", "left"))).alias("path"))  # one entry a level


def bucket_draws(by: str, path: list[dict], bucket: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of a key's draws fall on a bucket, in each replicate: binomial splits from the root down to it. Each
    split is drawn from its node's own stream, so all buckets below agree on it wherever they are."""
    many = np.full(n_boot, path[0]["n"] if path else -1)
    for step, at in enumerate(path):
        left = stream(by, seed, step, at["node"]).binomial(many, at["left"] / at["n"])
        many = many - left if bucket >> (len(path) - step - 1) & 1 else left
    return many


def stream(by: str, seed: int, level: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, level + 1, node, *np.frombuffer(hashlib.md5(by.encode()).digest(), np.uint32).tolist()])


def resampled_sums(rows: DataFrame, n_boot: int, seed: int, largest: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(by, b, n, s, ss, sse): for each key `by` (a text) and replicate b the sums over as many rows as the key has,
    drawn with replacement. rows: (by, id, y, e2).

    Rows that are equal are one class. Classes go to buckets by hash, whose path in the tree is a row ahead of theirs; how many draws a bucket gets follows from
    binomial splits down a tree of buckets, which rows get them from a stream of the bucket's own. Every replicate so
    has exactly n draws, no key's rows meet in one task, and the result doesn't depend on how the table is split.
    """
    bits = max(0, (max(1, largest) - 1) // bucket_rows).bit_length()
    at = F.shiftrightunsigned(F.xxhash64("id", "y", "e2"), 64 - bits) if bits else F.lit(0).cast("long")
    placed = rows.select("by", "id", "y", "e2").withColumn("bucket", at)
    paths = bucket_paths(placed, bits)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-largest // TASK_ROWS))
    dealt = paths.select("by", "bucket", F.lit(0).alias("kind"), "path").unionByName(placed.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def sums_of(by: str, bucket: int, path: list[dict], part: pd.DataFrame) -> np.ndarray:
        upto = np.cumsum(part["m"].to_numpy(np.int64))
        many = bucket_draws(by, path, bucket, n_boot, seed) if path else np.full(n_boot, upto[-1])
        y, e2 = part["y"].to_numpy(float), part["e2"].to_numpy(float)
        z, rng, out = np.stack((np.ones(len(y)), y, y * y, e2), axis=1), stream(by, seed, -1, bucket), np.zeros((n_boot, 4))
        step = max(1, DRAWN // max(1, int(upto[-1])))
        for low in range(0, n_boot, step):
            now = many[low : low + step]
            drawn = rng.integers(0, upto[-1], int(now.sum()))
            place = drawn if upto[-1] == len(upto) else np.searchsorted(upto, drawn, side="right")
            w = np.bincount(np.repeat(np.arange(len(now)), now) * len(y) + place, minlength=len(now) * len(y)).reshape(len(now), -1)
            out[low : low + step] = w.astype(float) @ z
        return out

    def as_classes(part: pd.DataFrame) -> pd.DataFrame:
        return part.groupby(["id", "y", "e2"], sort=True, dropna=False, as_index=False)["m"].sum()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        held: list[pd.DataFrame] = []

        def close() -> None:
            classes = as_classes(pd.concat(held))
            total[at[0]] = total.get(at[0], 0) + sums_of(at[0], at[1], path, classes)

        at, path = None, []
        for part in parts:  # sorted by key and bucket: the classes of one bucket are held at a time
            for (by, bucket), some in part.groupby(["by", "bucket"], sort=False):
                if at != (by, bucket):
                    if held:
                        close()
                    held, at = [], (by, bucket)
                if some["kind"].iloc[0] == 0:
                    path, some = list(some["path"].iloc[0]), some.iloc[1:]
                if len(some):
                    held.append(as_classes(some.assign(m=1)))
        if held:
            close()
        for by, sums in total.items():
            yield pd.DataFrame({"by": by, "b": np.arange(1, n_boot + 1)} | dict(zip(("n", "s", "ss", "sse"), sums.T, strict=True)))

    each = dealt.repartition(tasks, "by", "bucket").sortWithinPartitions("by", "bucket", "kind", "id", "y", "e2").mapInPandas(run, "by string, b int, n double, s double, ss double, sse double")
    return each.groupBy("by", "b").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss", "sse")))


def bootstrap_intervals(predictions: DataFrame, keys: list[str], row_key: list[str], n_boot: int = 1000, seed: int = 42, alpha: float = 0.05, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keys, r2, low, high, method, n_boot): R2 with BCa intervals for each key of (keys, row_key, y_true, y_pred).

    A replicate draws as many rows as the key has (see resampled_sums()); left-out scores come from each row and the
    key's sums, so no key's rows meet in one task. `degenerate` for a constant truth or fewer than two rows.
    """
    kinds = ", ".join(f"`{k}` {dict(predictions.dtypes)[k]}" for k in keys)
    by = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("by")
    rows = predictions.select(*keys, by, F.xxhash64(*row_key).alias("id"), F.col("y_true").cast("double").alias("y"), ((F.col("y_true") - F.col("y_pred")) ** 2).alias("e2"))
    facts = rows.groupBy(*keys, "by").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.sum("e2").alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"), (F.min("y") == F.max("y")).alias("flat"))
    facts = facts.withColumn("point", 1 - F.try_divide("sse", "sst"))
    largest = facts.agg(F.max("n").alias("n")).first()["n"] or 0
    met = rows.select("by", "id", F.col("y").alias("_y"), "e2").join(facts.drop(*keys), "by").withColumn("y", F.col("_y") - F.col("mean"))
    rest = F.col("sst") - F.col("y") ** 2 * F.col("n") / (F.col("n") - 1)  # squares about the mean of the others
    off = 1 - F.try_divide(F.col("sse") - F.col("e2"), rest) - F.col("point")
    d = [F.sum(F.col("off") ** k) for k in (1, 2, 3)]
    left = met.where(~F.col("flat") & (F.col("n") > 1)).withColumn("off", off).groupBy("by").agg(F.count("off").alias("m"), *(x.alias(f"d{k}") for k, x in enumerate(d, 1)))
    mean = F.col("d1") / F.col("m")
    left = left.select("by", (F.col("d2") - F.col("m") * mean * mean).alias("squares"), (-(F.col("d3") - 3 * mean * F.col("d2") + 2 * F.col("m") * mean**3)).alias("cubes"))
    sums = resampled_sums(met.select("by", "id", "y", "e2"), n_boot, seed, largest, bucket_rows)
    draw = 1 - F.try_divide(F.col("sse"), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    draws = sums.withColumn("r2", draw).where(F.col("r2").isNotNull()).groupBy("by").agg(F.sort_array(F.collect_list("r2")).alias("draws"))  # n_boot values a key

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                if r.flat or r.n < 2 or r.draws is None or pd.isna(r.point):
                    out.append((None, None, None, "degenerate", 0))
                else:
                    found = np.asarray(r.draws, float)
                    out.append((r.point, *bca_interval(r.point, found, r.squares, r.cubes, alpha), len(found)))
            yield part[keys].assign(**{c: [o[i] for o in out] for i, c in enumerate(("r2", "low", "high", "method", "n_boot"))})

    table = facts.select(*keys, "by", "n", "flat", "point").join(left, "by", "left").join(draws, "by", "left").drop("by")
    return table.mapInPandas(run, f"{kinds}, r2 double, low double, high double, method string, n_boot int")


#: Rows whose keys are hashed at once, and groups that a task adds up at a time.
HASHED_ROWS, HELD_GROUPS = 1 << 13, 1 << 10
MD5_TURN = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
MD5_ADD = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def md5_words(texts: list[bytes], room: int) -> list[np.ndarray]:
    """The 16 words of an md5 block for each text behind `room` bytes that are still 0; room + text have at most 55 bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    block = np.zeros((len(texts), 64), np.uint8)
    row, end = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    block[row, room + np.arange(len(row)) - np.repeat(end - sizes, sizes)] = np.frombuffer(b"".join(texts), np.uint8)
    block[np.arange(len(texts)), room + sizes] = 0x80
    words = block.view("<u4").T.copy()
    words[14] = 8 * (room + sizes)
    return [w if w.any() else np.uint32(0) for w in words]


def md5_first(words: list[np.ndarray]) -> np.ndarray:
    """The first four bytes of the md5 of one block, as the number that their hex digits are."""
    n = max(np.size(w) for w in words)
    a, b, c, d = (np.full(n, v, np.uint32) for v in MD5_START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn < 2:  # d ^ (b & (c ^ d)), then c ^ (d & (b ^ c))
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        f += a
        f += MD5_ADD[i]
        if np.ndim(word):
            f += word
        elif word:
            f += word
        by = MD5_TURN[turn, i % 4]
        np.right_shift(f, np.uint32(32) - by, out=t)
        f <<= by
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + MD5_START[0]).byteswap()


def key_hashes(texts: list[bytes], head: bytes) -> np.ndarray:
    """The first 8 hex digits of md5(head + text) as numbers."""
    out, short = np.empty(len(texts), np.uint32), np.fromiter((len(head) + len(t) <= 55 for t in texts), bool, len(texts))
    for i in np.flatnonzero(~short):
        out[i] = int(hashlib.md5(head + texts[i]).hexdigest()[:8], 16)
    if short.any():
        out[short] = md5_first(with_head(md5_words([t for t, s in zip(texts, short, strict=True) if s], len(head)), head))
    return out


def with_head(words: list[np.ndarray], head: bytes) -> list[np.ndarray]:
    add = np.frombuffer(head.ljust(-(-len(head) // 4) * 4, b"\0"), "<u4")
    return [words[i] | add[i] if i < len(add) else words[i] for i in range(16)]


def poisson_intervals(predictions: DataFrame, keys: list[str], row_key: str, n_boot: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals with Poisson(1) weights for each row and replicate, from md5 of seed, replicate and key. A task
    hashes the keys of a batch for all replicates at once and sends sums by group; rows are never repeated."""
    steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(9)])  # Poisson(1)
    least = np.ceil(steps * 2.0**32).astype(np.uint32)
    y, e2 = F.col("y_true").cast("double"), ((F.col("y_true") - F.col("y_pred")) ** 2).cast("double")
    text = F.coalesce(F.concat(F.lit("|"), F.col(row_key).cast("string")), F.lit("")).cast("binary")
    rows = predictions.select(*keys, text.alias("__k"), F.coalesce(y, F.lit(0.0)).alias("__y"), F.coalesce(e2, F.lit(0.0)).alias("__e"), e2.isNotNull().cast("double").alias("__known"))
    heads = [f"{seed}|{b}".encode() for b in range(1, n_boot + 1)]
    names = ["n", "s", "ss", "sse"]

    def weights(texts: list[bytes]) -> Iterator[np.ndarray]:
        """How often each row counts, replicate by replicate."""
        room: dict[int, list[np.ndarray]] = {}
        whole = max(map(len, texts)) + max(map(len, heads)) <= 55
        for head in heads:
            if whole and len(head) not in room:
                room = {len(head): md5_words(texts, len(head))}
            h = md5_first(with_head(room[len(head)], head)) if whole else key_hashes(texts, head)
            w = np.zeros(len(h), np.uint8)
            for v in least:
                w += h >= v
            yield w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, tuple[list[pa.Scalar], np.ndarray, float]] = {}

        def packed() -> pa.RecordBatch:
            held = list(total.values())
            group = [pa.array([g[0][i].as_py() for g in held], g_type) for i, g_type in enumerate(kinds)]
            lists = [pa.array([g[1][:, c].tolist() for g in held], pa.list_(pa.float64())) for c in range(4)]
            total.clear()
            return pa.RecordBatch.from_arrays([*group, pa.array([g[2] for g in held]), *lists], [*keys, "known", *names])

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            for at in range(0, batch.num_rows, HASHED_ROWS):
                part = batch.slice(at, HASHED_ROWS)
                code = np.zeros(part.num_rows, np.int64)
                for k in keys:
                    coded = part.column(k).dictionary_encode(null_encoding="encode")
                    code = np.unique(code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_inverse=True)[1]
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                part = part.take(pa.array(order))
                v, e = np.array(part.column("__y")), np.array(part.column("__e"))
                z, known = np.stack((np.ones(len(v)), v, v * v, e), axis=1), np.add.reduceat(np.array(part.column("__known")), starts)
                w = np.stack(list(weights(part.column("__k").to_pylist())))
                for i, (low, high) in enumerate(zip(starts, [*starts[1:], len(v)], strict=True)):
                    group = [part.column(k)[int(low)] for k in keys]
                    name = tuple(repr(g.as_py()) for g in group)
                    _, sums, seen = total.get(name, (None, 0, 0.0))
                    total[name] = group, sums + w[:, low:high].astype(float) @ z[low:high], seen + float(known[i])
                if len(total) > HELD_GROUPS:
                    yield packed()
        if total:
            yield packed()

    typed = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    parts = rows.mapInArrow(run, f"{typed}, known double, " + ", ".join(f"{c} array<double>" for c in names))
    each = parts.select(*keys, "known", F.posexplode(F.arrays_zip(*names)).alias("b", "v")).select(*keys, "known", "b", "v.*")
    sums = each.groupBy(*keys, "b").agg(F.sum("known").alias("known"), *(F.sum(c).alias(c) for c in names))
    score = F.when(F.col("known") > 0, 1 - F.try_divide(F.col("sse"), F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n"))))
    return sums.withColumn("r2", score).where(F.col("r2").isNotNull()).groupBy(*keys).agg(F.percentile("r2", F.lit(alpha / 2)).alias("low"), F.percentile("r2", F.lit(1 - alpha / 2)).alias("high"), F.count("*").alias("n_boot"))


#: Rows whose targets are shuffled together, values of them at most (rows x shuffles), and values that a task is sent.
SHUFFLED_ROWS, SHUFFLED_VALUES, SENT_VALUES = 4096, 1 << 21, 1 << 24


def shuffled_targets(df: DataFrame, key: str, target: str, n_perm: int, use: Callable[[Iterator[tuple[pa.RecordBatch, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str, seed: int = 42) -> DataFrame:
    """use() over blocks of the rows of df, each with a matrix: for every row the target (a double; NaN if null) that it
    gets in each of the n_perm shuffles.

    Each shuffle is a keyed permutation of the rows' ranks, which any task computes by itself, in both directions. A block
    of ranks packs its values by the block that gets them, in order of shuffle and place; the receiving block knows the same order.
    So neither places nor keys are sent, features are moved once, and a row is there for each pair of blocks, not
    for each row and shuffle.
    """
    n = df.count()
    size = min(SHUFFLED_ROWS, max(SHUFFLED_ROWS // 16, SHUFFLED_VALUES // max(1, n_perm)))
    blocks = max(1, -(-n // size))
    number = np.uint16 if blocks <= 1 << 16 else np.int64  # whose stable sort is by radix
    tasks = min(blocks, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * n_perm // SENT_VALUES)))
    placed = ranked(df, shuffle_key(F.col(key), seed), name="__rank").withColumn("__block", F.floor(F.col("__rank") / size).cast("int"))

    def places(rank: np.ndarray, back: bool) -> np.ndarray:
        out = np.empty((n_perm, len(rank)), np.int64)
        for p in range(n_perm):
            out[p] = feistel(rank, n, (seed << 20) + p + 1, back=back)
        return out

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rank, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__rank", "__value"))
        to = places(rank, True)  # who gets these rows' values
        order = np.argsort(to, axis=1)
        block = np.take_along_axis(to, order, axis=1).ravel() // size
        by = np.argsort(block.astype(number), kind="stable")
        block, values = block[by], value[order].ravel()[by]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = pa.py_buffer((np.append(cuts, len(block)) * 8).astype(np.int32))
        texts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends, pa.py_buffer(np.ascontiguousarray(values, float))])
        yield pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), pa.array(np.full(len(cuts), rank.min() // size)), texts], ["__block", "__from", "__packed"])

    def received(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        came = batch.column("__from").is_valid().to_numpy(zero_copy_only=False)
        mine, sent = np.flatnonzero(~came), np.flatnonzero(came)
        rank, packed = batch.column("__rank").take(pa.array(mine)).to_numpy(), batch.column("__packed")
        mine, rank = mine[np.argsort(rank)], np.sort(rank)
        sent = sent[np.argsort(batch.column("__from").take(pa.array(sent)).to_numpy())]
        at = places(rank, False).ravel() // size  # the blocks whose values these rows get
        out = np.empty(len(at))
        out[np.argsort(at.astype(number), kind="stable")] = np.frombuffer(b"".join(packed[int(i)].as_py() for i in sent))
        return batch.take(pa.array(mine)), out.reshape(n_perm, -1).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return use(received(part) for part in runs_of(batches, ["__block"]))

    messages = dealt(placed.select("__block", "__rank", F.col(target).cast("double").alias("__value")), ["__block"], tasks, send, "__block int, __from long, __packed binary")
    both = placed.unionByName(messages, allowMissingColumns=True)
    return both.repartition(tasks, "__block").sortWithinPartitions("__block").mapInArrow(run, schema)


def permuted_targets(df: DataFrame, key: str, target: str, n_perm: int, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Adds y_0 (observed) and y_1 .. y_n_perm (shuffled, doubles), see shuffled_targets()."""

    columns = df.columns

    def use(parts: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for rows, drawn in parts:
            lists = pa.ListArray.from_arrays(np.arange(0, drawn.size + 1, n_perm, dtype=np.int32), pa.array(drawn.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), lists], [*columns, "drawn"])

    names = [f"y_{i}" for i in range(n_perm + 1)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    wide = shuffled_targets(df, key, target, n_perm, use, f"{kinds}, drawn array<double>", seed)
    return wide.withColumns({"y_0": F.col(target)} | {f"y_{i}": F.get("drawn", F.lit(i - 1)) for i in range(1, n_perm + 1)}).drop("drawn"), names


def permuted_moments(df: DataFrame, key: str, features: str, target: str, fold: str, n_perm: int, seed: int = 42) -> Moments:
    """fold_moments() of the observed target (0) and its shuffles (1 .. n_perm). Only rows that count are shuffled, so one
    with a missing value takes no other with it."""
    usable = usable_rows(df, features, [target], fold).select(key, F.col(features).alias("__x"), F.col(target).cast("double").alias("__y"), F.col(fold).cast("long").alias("__fold"))
    mean_x, mean_y = column_means(usable, "__x", ["__y"])
    shift, p = np.concatenate((mean_x, np.repeat(mean_y, 1 + n_perm))), len(mean_x)

    def use(parts: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        return task_sums(((rows.column("__x"), np.column_stack((rows.column("__y").to_numpy(), drawn)), rows.column("__fold").to_numpy()) for rows, drawn in parts), shift, p)

    return added_up(shuffled_targets(usable, key, "__y", n_perm, use, SUMS, seed), shift, p)


def permutation_test(df: DataFrame, key: str, features: str, target: str, fold: str, selector: str = "correlation", model: str = "ridge", k: int = 20, n_perm: int = 50, seed: int = 42) -> DataFrame:
    """(perm, apparent_r2, nested_r2): perm 0 is observed. All shuffles are columns of one moment pass."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(permuted_moments(df, key, features, target, fold, n_perm, seed))  # folds x (features + shuffles)^2 values

    def run(parts):
        for part in parts:
            rows = []
            for perm in part["perm"]:
                scores = pd.DataFrame(fold_scores(sent.value.for_target(int(perm)), selector, model, k, seed))
                means = scores.groupby("arm")["r2"].mean()
                rows.append((int(perm), means["apparent"], means["nested"]))
            yield pd.DataFrame(rows, columns=["perm", "apparent_r2", "nested_r2"])

    return spark.range(n_perm + 1).select(F.col("id").cast("int").alias("perm")).mapInPandas(run, "perm int, apparent_r2 double, nested_r2 double")


def permutation_summary(tests: DataFrame) -> DataFrame:
    """Observed and mean shuffled scores; p = (1 + shuffles at or above) / (1 + shuffles), both arms."""
    seen = tests.where(F.col("perm") == 0).select(F.col("apparent_r2").alias("a"), F.col("nested_r2").alias("b"))
    rest = tests.where(F.col("perm") > 0).crossJoin(F.broadcast(seen))  # one row
    return rest.agg(
        F.count("*").alias("n_perm"), F.first("a").alias("observed_apparent_r2"), F.first("b").alias("observed_nested_r2"),
        F.avg("apparent_r2").alias("mean_perm_apparent_r2"), F.avg("nested_r2").alias("mean_perm_nested_r2"),
        ((1 + F.count_if(F.col("nested_r2") >= F.col("b"))) / (1 + F.count("*"))).alias("perm_p_value"),
        ((1 + F.count_if(F.col("apparent_r2") >= F.col("a"))) / (1 + F.count("*"))).alias("perm_p_value_apparent"))


def permutation_grid(df: DataFrame, key: str, features: str, target: str, fold: str, combos: list[tuple[str, str, int]], n_perm: int = 50, seed: int = 42, done: DataFrame | None = None) -> DataFrame:
    """permutation_summary() for each (selector, model, k), without those in `done` already: one moment pass for the
    whole grid, one task row for each combination and shuffle."""
    spark = df.sparkSession
    grid = spark.createDataFrame(combos, "selector string, model string, k int")
    if done is not None:
        grid = grid.join(done, ["selector", "model", "k"], "left_anti")
    sent = spark.sparkContext.broadcast(permuted_moments(df, key, features, target, fold, n_perm, seed))  # folds x (features + shuffles)^2 values

    def run(parts):
        for part in parts:
            rows = []
            for r in part.itertuples():
                scores = pd.DataFrame(fold_scores(sent.value.for_target(int(r.perm)), r.selector, r.model, int(r.k), seed))
                means = scores.groupby("arm")["r2"].mean()
                rows.append((r.selector, r.model, int(r.k), int(r.perm), means["apparent"], means["nested"]))
            yield pd.DataFrame(rows, columns=["selector", "model", "k", "perm", "apparent_r2", "nested_r2"])

    tasks = grid.crossJoin(spark.range(n_perm + 1).select(F.col("id").cast("int").alias("perm")))  # the caller's lists
    tests = spread(tasks, len(combos) * (n_perm + 1)).mapInPandas(run, "selector string, model string, k int, perm int, apparent_r2 double, nested_r2 double")
    keys = ["selector", "model", "k"]

    def observed(arm: str) -> Column:
        return F.max(F.when(F.col("perm") == 0, F.col(arm))).over(Window.partitionBy(*keys))

    rest = tests.withColumns({"a": observed("apparent_r2"), "b": observed("nested_r2")}).where(F.col("perm") > 0)
    return rest.groupBy(*keys).agg(
        F.count("*").alias("n_perm"), F.max("a").alias("observed_apparent_r2"), F.max("b").alias("observed_nested_r2"),
        F.avg("apparent_r2").alias("mean_perm_apparent_r2"), F.avg("nested_r2").alias("mean_perm_nested_r2"),
        ((1 + F.count_if(F.col("nested_r2") >= F.col("b"))) / (1 + F.count("*"))).alias("perm_p_value"),
        ((1 + F.count_if(F.col("apparent_r2") >= F.col("a"))) / (1 + F.count("*"))).alias("perm_p_value_apparent"))


P1, P2, P3, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hashed(number: np.ndarray, before: np.ndarray) -> np.ndarray:
    """F.xxhash64(*of, number) for an int, where `before` is F.xxhash64(*of)."""
    h = (before + P5 + np.uint64(4)) ^ (number * P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * P2 + P3
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def normal_numbers(of: np.ndarray, n: int) -> np.ndarray:
    """n independent standard normal numbers for each hash (Box and Muller)."""
    each = hashed(np.arange(n, dtype=np.uint64), of.view(np.uint64)[:, None])
    u, v = (((hashed(np.uint64(part), each) >> np.uint64(11)).astype(np.int64) + 1) / float(1 << 53) for part in (0, 1))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


#: Rows whose numbers are drawn at once.
NOISE_ROWS = 1024


def noise_rows(df: DataFrame, key: str, p: int, seeds: list[int], folds: int = 5) -> DataFrame:
    """(key, seed, features, y, fold): for every row of df and seed independent standard normal features and target
    drawn from its key; every row is its own group, folds are random."""
    tries = df.select(key).crossJoin(F.broadcast(df.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")))  # the caller's seeds
    placed = ranked(tries, F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.col(key).cast("string"))), ["seed"])
    slim = placed.select(key, "seed", (F.col("rank") % folds).cast("int").alias("fold"), F.xxhash64("seed", F.col(key).cast("string")).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, NOISE_ROWS):
                part = batch.slice(at, NOISE_ROWS)
                drawn = normal_numbers(np.array(part.column("_h")), p + 1)
                lists = pa.ListArray.from_arrays(np.arange(0, len(drawn) * p + 1, p, dtype=np.int32), pa.array(drawn[:, :p].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("seed"), lists, pa.array(drawn[:, p]), part.column("fold")], [key, "seed", "features", "y", "fold"])

    # one pass of Python: what follows reads the numbers and doesn't draw them again for each use
    return slim.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, seed int, features array<double>, y double, fold int")


def null_moments(df: DataFrame, key: str, p: int, seeds: list[int], folds: int = 5) -> dict[str, Moments]:
    """Moments of noise_rows() by seed, in one pass over the rows for all of them."""
    rows = noise_rows(df, key, p, seeds, folds).withColumn("_part", F.col("seed") * folds + F.col("fold"))
    m = fold_moments(rows, "features", ["y"], "_part")
    mine = {s: [i for i, part in enumerate(m.folds) if part // folds == s] for s in seeds}
    return {str(s): Moments(m.by_fold[at], [m.folds[i] - s * folds for i in at], m.p, m.shift) for s, at in mine.items()}
