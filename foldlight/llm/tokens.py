"""Operator 7: token ids in training order, as fixed-stride shards.

Every document's whole text becomes tokens of a public tokenizer and an end token, cut into sequences of
`length` tokens, the last padded with the end token. All sequences get an index without gaps; a keyed
Feistel permutation with cycle-walking maps the index to the sequence's slot in the training order. A
shard holds `per_shard` consecutive slots; unless told otherwise their number grows with the table, from PER_SHARD
four times as many at a time whenever there would be over SHARDS shards, up to MOST_PER_SHARD (256 MB). Shards are dealt out by slot and written with one record of
fixed size for each slot, so slot s is at a byte that a division gives: reading is sequential, and a run
resumes at any slot.

Documents are first dealt out in ranges of a key (md5 of doc_id and text) and sorted by it, so a sequence's
index, and with it its slot, depends on the table's rows alone, not on files or splits. Tokens are written to
the shared folder once, a file for each range, and numbered by their place there: rows counted before each
file (one row a file), plus the row's place in its file. So tokens are shuffled once, into ranges of shards.
An index beside the shards says which document and chunk a slot holds, with a digest of its tokens, which is kept
beside the tokens when they are made, so that the index reads small columns only.

Defined results: null and empty texts are one sequence with the end token only. Repeated rows are sequences of
their own, one after the other before the permutation. A null doc_id is a document like any other. An empty
table gives no sequence. Other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.permute import feistel
from .common import discard, large_batches, materialise, small_batches, tidy_shuffles

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern and end token that belong to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_TOKEN = 50256
LENGTH, PER_SHARD = 512, 4096
#: Shares of the shards that are written at a time: the last wave is small, as all others' shards are on disk by then.
WAVES = (0.7, 0.3)
SHARDS, MOST_PER_SHARD = 4096, 1 << 18
#: Bytes of text in a range of keys, and the most ranges (also of shards).
RANGE_BYTES, RANGES = 16 << 20, 100_000


class Encoder:
    """Tokens of a text as packed 16-bit integers."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return array("H", self.encoding.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END_TOKEN) -> DataFrame:
    """(doc_id, chunk, n_tokens, tokens, digest): tokens are length little-endian 16-bit integers, digest is their md5."""
    small_batches(docs.sparkSession)
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark = encoder(vocabulary, pattern).encode, np.uint16(end).tobytes()
        for batch in batches:
            where, chunks, sizes, packed = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                stream = encode(text.as_py() or "") + mark
                for at in range(0, len(stream), stride):
                    part = stream[at : at + stride]
                    where.append(i)
                    chunks.append(at // stride)
                    sizes.append(len(part) // 2)
                    packed.append(part if len(part) == stride else part + mark * (length - len(part) // 2))
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(chunks, pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array([md5(p).digest() for p in packed], pa.binary())], ["doc_id", "chunk", "n_tokens", "tokens", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk int, n_tokens int, tokens binary, digest binary")


def in_key_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a partition for each range of keys, sorted by key."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    ranges = max(1, min(RANGES, -(-size // RANGE_BYTES)))
    key = F.md5(F.concat(F.col("doc_id").isNull().cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))).cast("binary"))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int")
    return docs.select("doc_id", "text", key.alias("key")).repartitionById(ranges, at).sortWithinPartitions("key").select("doc_id", "text")


def shard_size(total: int) -> int:
    """Slots of a shard for so many sequences."""
    size = PER_SHARD
    while total > size * SHARDS and size < MOST_PER_SHARD:
        size *= 4
    return min(size, MOST_PER_SHARD)


def slotted(made: DataFrame, per_shard: int | None, key: int, stride: int) -> tuple[DataFrame, int, int]:
    """The sequences, which stand in the shared folder, with slot, shard and byte_offset, the number of shards, and
    of slots in one."""
    at = F.col("_metadata.file_name")
    files = made.groupBy(at.alias("file")).agg(F.count("*").alias("n"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = files.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    per_shard = per_shard or shard_size(total)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    numbered = made.select("*", at.alias("file"), F.col("_metadata.row_index").alias("inside")).join(F.broadcast(before), "file")  # at most RANGES rows
    rows = numbered.withColumn("slot", slot(F.col("before") + F.col("inside"))).withColumn("shard", F.floor(F.col("slot") / per_shard))
    offset = ((F.col("slot") % per_shard) * stride).alias("byte_offset")
    return rows.select("slot", "shard", offset, "doc_id", "chunk", "n_tokens", "tokens", "digest"), max(1, -(-total // per_shard)), per_shard


def in_ranges(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of the shards from first up to last, dealt out in ranges of shards, sorted by slot inside each."""
    parts = max(1, min(last - first, RANGES))
    at = F.floor((F.col("shard") - first) * parts / max(1, last - first)).cast("int")
    return rows.where((F.col("shard") >= first) & (F.col("shard") < last)).repartitionById(parts, at).sortWithinPartitions("shard", "slot")


def training_order(docs: DataFrame, length: int = LENGTH, per_shard: int | None = None, key: int = 2024, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END_TOKEN) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, chunk, n_tokens, tokens), in ranges of shards, sorted by slot inside each."""
    rows, shards, _ = slotted(materialise(sequences(in_key_order(docs), length, vocabulary, pattern, end)), per_shard, key, 2 * length + 1)
    return in_ranges(rows.drop("digest"), 0, shards)


def append_shards(ordered: DataFrame, path: str) -> None:
    """Adds one file in path/shards/shard=N for each shard. The text writer copies bytes as they are, so the
    files go to any store that Spark writes to."""
    values = ordered.select("shard", F.col("tokens").cast("string").alias("value"))
    values.write.mode("append").partitionBy("shard").option("compression", "none").text(f"{path}/shards")


def write_manifest(spark: SparkSession, path: str, length: int, per_shard: int) -> DataFrame:
    """Writes and returns path/manifest with a row for each shard: (shard, first_slot, records, stride, file)."""
    stride = 2 * length + 1
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(f"{path}/shards").select("path", "length")  # no content is read
    shard = F.regexp_extract("path", r"shard=(\d+)/[^/]*$", 1).cast("long")
    table = files.select(shard.alias("shard"), (shard * per_shard).alias("first_slot"), F.expr(f"length div {stride}").alias("records"), F.lit(stride).alias("stride"), F.regexp_extract("path", r"(shard=\d+/[^/]*)$", 1).alias("file"))
    table.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def write_shards(ordered: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes what training_order() with the same per_shard returned to path and returns the manifest. A shard's file holds for each
    slot its tokens' bytes and a line feed, nothing else."""
    append_shards(ordered, path)
    return write_manifest(ordered.sparkSession, path, length, per_shard)


def write_order(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int | None = None, waves: tuple[float, ...] = WAVES, key: int = 2024, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END_TOKEN) -> DataFrame:
    """Writes shards, manifest and index of docs to path, a folder that all executors share, and returns the
    index, read back: (slot, shard, byte_offset, doc_id, chunk, n_tokens, tokens_md5), one row for each sequence.

    Shards are written in waves of consecutive shards, so that only one wave's shuffled tokens are on disk at a
    time; each wave reads the tokens again.
    """
    spark, made = docs.sparkSession, materialise(sequences(in_key_order(docs), length, vocabulary, pattern, end))
    rows, shards, per_shard = slotted(made, per_shard, key, 2 * length + 1)
    index = rows.select("slot", "shard", "byte_offset", "doc_id", "chunk", "n_tokens", F.lower(F.hex("digest")).alias("tokens_md5"))
    with tidy_shuffles(spark), large_batches(spark):
        in_ranges(index, 0, shards).write.parquet(f"{path}/index")
        ends = [round(shards * sum(waves[: i + 1]) / sum(waves)) for i in range(len(waves))]
        for first, last in zip([0, *ends], ends, strict=False):
            if first < last:
                append_shards(in_ranges(rows, first, last), path)
        write_manifest(spark, path, length, per_shard)
    discard(made)
    out = spark.read.schema(index.schema).parquet(f"{path}/index")
    out._scratch_path = path
    return out


def read_slots(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(slot, tokens) of the slots from first up to last: only the shards that hold them are opened."""
    manifest = spark.read.parquet(f"{path}/manifest").where((F.col("first_slot") < last) & (F.col("first_slot") + F.col("records") > first))
    wanted = manifest.select("first_slot", "stride", "file").collect()  # one row for each shard asked for
    if not wanted:
        return spark.createDataFrame([], "slot long, tokens binary")
    stride = wanted[0]["stride"]
    starts = spark.createDataFrame([(r["file"], r["first_slot"]) for r in wanted], "file string, first_slot long")
    files = spark.read.format("binaryFile").load([f"{path}/shards/{r['file']}" for r in wanted]).select(F.regexp_extract("path", r"(shard=\d+/[^/]*)$", 1).alias("file"), "content").join(F.broadcast(starts), "file")
    rows = files.select("first_slot", "content", F.explode(F.sequence(F.lit(0), (F.length("content") / stride).cast("int") - 1)).alias("at"))
    return rows.select((F.col("first_slot") + F.col("at")).alias("slot"), F.substring("content", F.col("at") * stride + 1, F.lit(stride - 1)).alias("tokens")).where(F.col("slot").between(first, last - 1))
