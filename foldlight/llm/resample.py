"""Operator 12: target-distribution importance resampling with array-scored weights and a bracketed cutoff.

Features of a text are all runs of 1 to 3 words, hashed into `buckets` buckets. Bucket counts of all documents and
of all target texts give each bucket a gain, the scaled log of the ratio of its shares; a document's weight is the
sum of its features' gains, one lookup in an array a feature. A Gumbel number from a hash of seed and doc_id joins
the weight, so that the highest scores are a weighted draw without replacement.

The cutoff is found without sorting all scores: a quantile sketch gives a bracket of scores that should hold it;
exact counts of the rows above and inside tell whether it does, and where it doesn't the bracket is widened to
twice the share of rows, up to all. Only the bracket's rows are sorted. Ranks come from a range sort of the rows
above the cutoff and offsets of its partitions.

Features are hashed once and kept as 16-bit numbers in the shared folder; counts and weights read these. Only the
counts (a row a bucket), counts of partitions and one row of the cutoff pass through the driver.

Defined results: a null text has no words, weight 0 and is never drawn. A null doc_id is hashed as an empty text
and loses ties. Rows that repeat doc_id and score are drawn in the order of n_features, weight and words; a cut
between rows that repeat all of these takes as many as are due. Empty tables of documents give an empty result; an
empty target makes rare buckets the better ones. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches

BUCKETS, RUN = 10_000, 3
#: Bytes of a text whose words are held at once.
PIECE = 4 << 20
#: Half the share of rows in the first bracket, and the accuracy of the sketch.
MARGIN, ACCURACY = 0.002, 10_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of UTF-8 that belong to words once A-Z are lower-cased, and the others.
WORD, GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def features(data: bytes | None, buckets: int = BUCKETS, run: int = RUN) -> tuple[int, np.ndarray]:
    """Words of a UTF-8 text and the buckets of all its runs of words, whole texts in pieces cut between words."""
    at, words, out = 0, 0, [np.zeros(0, np.uint16)]
    before: list[bytes] = []
    data = (data or b"").translate(LOWER)
    while at < len(data):
        gap = GAP.search(data, min(len(data), at + PIECE))
        end = gap.start() if gap else len(data)
        found = WORD.findall(data, at, end)
        words, at = words + len(found), end + 1
        joined = before + found
        spaced = [b" " + w for w in joined]
        sums = list(map(crc32, joined))
        kept = [sums[len(before) :]]
        for n in range(1, run):  # the run that starts at i goes on with its n-th word after that
            sums = list(map(crc32, spaced[n:], sums))
            kept.append(sums[max(0, len(before) - n) :])
        out.append((np.fromiter(chain.from_iterable(kept), np.uint32) % buckets).astype(np.uint16))
        before = joined[len(joined) - run + 1 :] if len(joined) >= run else joined
    return words, np.concatenate(out)


def hashed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The keys with n_words and buckets, packed 16-bit numbers, for the column `data` (bytes of a text)."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x.as_py(), buckets) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array([n for n, _ in made], pa.int64()), pa.array([x.tobytes() for _, x in made], pa.binary())], [*keys, "n_words", "buckets"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "data").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_words long, buckets binary"]))


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: summed up in the tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("buckets"):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = packed.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket, in doubles."""
    n, many, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (many + n)) / ((s + 1.0) * (wanted + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def scored(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of hashed documents with a hash `h` of seed and doc_id."""
    sent = packed.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("buckets")]
            weight = [int(sent.value[x].sum()) for x in rows]
            luck = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array([len(x) for x in rows], pa.int64()), pa.array(weight, pa.int64()), pa.array([w + x for w, x in zip(weight, luck, strict=True)], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return packed.mapInArrow(run, f"doc_id {dict(packed.dtypes)['doc_id']}, n_words long, n_features long, weight long, score long")


def better() -> list[Column]:
    """The order of a draw, best first: score, then the smaller doc_id (null last), n_features, weight and words."""
    return [F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words"]


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `rank` from 1 in the order of better(): a range sort written to the shared folder, then each part's
    offset by the rows of the parts before it (a row a part)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = materialise(rows.repartitionByRange(parts, *better()).sortWithinPartitions(*better()).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = made.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    return made.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + inside + 1).drop("_part", "_id", "_before")  # before: a row a partition


def bracket(rows: DataFrame, wanted: int, total: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int]:
    """(low, high, above): scores above high are `above` < wanted rows, those in low .. high hold the wanted-th; None is open."""
    while True:
        at = 1 - wanted / total
        shares = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = rows.agg(F.percentile_approx("score", shares, accuracy).alias("q")).first()["q"] if margin < 1 else (None, None)
        over = F.lit(False) if high is None else F.col("score") > high
        inside = F.lit(True) if low is None else F.col("score").between(low, high)
        seen = rows.agg(F.count_if(over).alias("above"), F.count_if(inside).alias("inside")).first()
        if seen["above"] < wanted <= seen["above"] + seen["inside"]:
            return low, high, seen["above"]
        margin = max(2 * margin, 1e-6)


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, margin: float = MARGIN, accuracy: int = ACCURACY) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs, rank null unless drawn: of the N with at least
    least_words words the share's numerator * N // denominator best. target holds a text a row."""
    if buckets > 1 << 16:
        raise ValueError("buckets beyond 65536")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    packed = materialise(hashed(docs.select("doc_id", h.alias("h"), F.col("text").cast("binary").alias("data")), ["doc_id", "h"], buckets))
    wished = hashed(target.select(F.col("text").cast("binary").alias("data")), [], buckets)
    out = materialise(scored(packed, bucket_gains(bucket_counts(packed, buckets), bucket_counts(wished, buckets))))
    discard(packed)
    able = F.col("n_words") >= least_words
    total = out.where(able).count()
    wanted = share[0] * total // share[1]
    if not wanted:
        return out.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(out.where(able), wanted, total, margin, accuracy)
    within = out.where(able & (F.lit(True) if low is None else F.col("score").between(low, high)))
    last = numbered(within).where(F.col("rank") == wanted - above).first()
    beaten = F.lit(False) if last["doc_id"] is None else F.col("doc_id").isNull() | (F.col("doc_id") > last["doc_id"])
    drawn = able & ((F.col("score") > last["score"]) | (F.col("score") == last["score"]) & ~beaten)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranks = numbered(out.where(drawn)).select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    return ranks.unionByName(out.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
