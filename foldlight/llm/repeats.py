"""Operator 3: removal of byte strings that repeat anywhere, by suffix arrays with two-stage sorting.

Every byte covered by a `length`-byte string that also starts elsewhere, in any document, is removed.

1. Each text's strings are dealt out by anchor (the smallest hash of GRAM bytes inside), so that equal
   strings meet at equal anchors wherever they are; strings of neighbouring starts with one anchor are one
   window. Windows of equal content are counted together, so copies, however many, never gather.
2. Windows whose anchor occurs with more than one content are fetched once each and sorted in suffix arrays:
   suffixes smaller than their successors directly, the rest induced by bucket scans; adjacent common
   prefixes tell which strings start in another window too. Anchors with more than `crowd` different
   windows are decided string by string from digests instead, which splits them over tasks.
3. Runs of repeated starts go back to the documents, whose covered bytes are cut out.

Defined results: texts are UTF-8 bytes, null is empty. Texts shorter than `length` lose nothing. Repeated
rows are copies of each other: with `length` bytes or more, they lose every byte. Documents with a null
doc_id count like any other. Extra columns are ignored. Content hashes have 64 bits beside the anchor's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_join, materialise, small_batches, sorted_groups
from .suffixes import anchored_windows, repeated_starts

LENGTH, CROWD = 400, 2048
#: Windows in one suffix array, at least, where there are as many.
ARRAY_WINDOWS = 1024


def text_bytes(value: pa.StringScalar) -> bytes:
    buffer = value.as_buffer()
    return b"" if buffer is None else buffer.to_pybytes()


def windows_of(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, first, last, place, anchor, content), see anchored_windows()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchored_windows(text_bytes(t), length) for t in batch.column("text")]
            if not found:
                continue
            where = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            first, last, place, anchor, content = (np.concatenate(c) for c in zip(*found, strict=True))
            columns = [batch.column("doc_id").take(where), batch.column("digest").take(where), pa.array(first), pa.array(last), pa.array(place), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "first", "last", "place", "anchor", "content"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest long, first long, last long, place long, anchor long, content long")


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, content, place, bytes) of the wanted windows (doc_id, digest, first, last, place, anchor, content)."""
    lists = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "last", "place", "anchor", "content")).alias("wanted"))
    both = docs.alias("d").join(lists.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.digest") == F.col("w.digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lists in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data = text_bytes(text)
                part = pa.RecordBatch.from_struct_array(lists.values)
                ends = zip(part.column("first").to_pylist(), part.column("last").to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("anchor"), part.column("content"), part.column("place"), pa.array([data[a : b + length] for a, b in ends], pa.binary())], ["anchor", "content", "place", "bytes"])

    return both.select("d.text", "w.wanted").mapInArrow(run, "anchor long, content long, place long, bytes binary")


def runs(starts: np.ndarray) -> list[dict[str, int]]:
    """Ascending starts as closed runs."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return [{"low": int(a), "high": int(b)} for a, b in zip(starts[np.concatenate(([0], cuts + 1))], starts[np.concatenate((cuts, [len(starts) - 1]))], strict=True)]


RUNS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
SHARED = "anchor long, content long, runs array<struct<low:long,high:long>>"


def sorted_windows(contents: DataFrame, length: int) -> DataFrame:
    """(anchor, content, runs) from suffix arrays over whole groups of one anchor."""

    def decide(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchor, content = batch.column("anchor").to_numpy(), batch.column("content").to_numpy()
        new = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(content) != 0)))  # repeated rows fetch a window twice
        batch, anchor, content = batch.filter(pa.array(new)), anchor[new], content[new]
        starts = repeated_starts(batch.column("bytes").to_pylist(), batch.column("place").to_numpy(), anchor, length)
        hit = [i for i, s in enumerate(starts) if len(s)]
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array(anchor[hit]), pa.array(content[hit]), pa.array([runs(starts[i]) for i in hit], RUNS)], ["anchor", "content", "runs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= ARRAY_WINDOWS:
                yield pa.concat_batches(kept)
                kept = []
        if kept:
            yield pa.concat_batches(kept)

    return contents.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(lambda b: sorted_groups(gather(b), decide, "anchor"), SHARED)


def crowded_windows(contents: DataFrame, length: int) -> DataFrame:
    """(anchor, content, runs) of anchors with very many windows: each string by the digest of its bytes."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("bytes")[row].as_py()
                n = len(data) - length + 1
                digests = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                same = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays([batch.column("anchor").take(same), batch.column("content").take(same), pa.array(np.arange(n)), pa.array(digests, pa.binary())], ["anchor", "content", "start", "string"])

    each = contents.dropDuplicates(["anchor", "content"]).mapInArrow(strings, "anchor long, content long, start long, string binary")
    each = materialise(each)
    again = each.groupBy("string").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("string")
    return each.join(again, "string").groupBy("anchor", "content").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("low"), F.col("start").alias("high")))).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, digest, spans): runs of starts of repeated strings, for documents (doc_id, text, digest) that have any."""
    found = materialise(windows_of(docs, length))
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") < F.max("content")).alias("mixed")).where(F.col("n") > 1).drop("n")
    met = materialise(hub_join(found, shared, "anchor"))
    discard(found)
    contents = materialise(met.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("doc_id", "digest", "first", "last", "place")).alias("one")))
    mixed = contents.where("mixed")
    crowded = mixed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor", F.lit(True).alias("crowded"))
    fetched = materialise(fetch(docs, mixed.select("one.*", "anchor", "content"), length))
    by_size = hub_join(fetched, crowded, "anchor", "left")
    whole = contents.where(F.col("n") > 1).select("anchor", "content", F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("one.last") - F.col("one.first")).alias("high"))).alias("runs"))
    some = sorted_windows(by_size.where(F.col("crowded").isNull()).drop("crowded"), length).unionByName(crowded_windows(by_size.where("crowded").drop("crowded"), length))
    marked = whole.unionByName(some)
    spans = F.transform("runs", lambda r: F.struct((F.col("first") + r["low"]).alias("low"), (F.col("first") + r["high"]).alias("high")))
    return met.join(marked, ["anchor", "content"]).select("doc_id", "digest", spans.alias("spans")).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every document; kept: the bytes that remain."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    spans = repeated_spans(docs, length, crowd)
    both = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.digest") == F.col("s.digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text_bytes(text)
                sizes.append(len(data))
                if not spans.is_valid:
                    removed.append(0)
                    n_spans.append(0)
                    kept.append(data)
                    continue
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, spans.values.field("low").to_numpy(), 1)
                np.add.at(edges, spans.values.field("high").to_numpy() + length, -1)
                covered = np.cumsum(edges)[:-1] > 0
                removed.append(int(covered.sum()))
                n_spans.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.select("d.doc_id", "d.text", "s.spans").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")
