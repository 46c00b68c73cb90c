"""Operator 10: SimHash near-duplicates found with BK-trees.

A document's fingerprint has 64 bits; a bit is set if it is set in more than half of the XXH64 values of
the document's word shingles. Fingerprints within `radius` bits are linked; documents form components.

How pairs meet: fingerprints that differ in at most `radius` of 64 bits agree on at least `blocks - radius`
of `blocks` equal blocks of bits, so each is sent to one shard for every choice of that many blocks. In a
shard, a BK-tree (children keyed by the integer Hamming distance to their parent) takes them one by one,
and each is searched for along the edges within the radius only. Trees aren't broadcast: all fingerprints
together have no size bound, while a shard is a task's own rows.

Defined results: null and empty texts have no words and the fingerprint zero, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows share a fingerprint and
thus a component. A null doc_id never names a component unless all its members are null. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hub_join, materialise, small_batches, sorted_groups

SEED = 42
#: Shingles whose bits are counted at once.
SLICE = 1 << 15


def simhash(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z, and only ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    for i in range(0, n, SLICE):
        part = hashes[i : i + SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Integers under the Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the stored values within radius of value."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if distance - radius <= edge <= distance + radius]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            edges = self.children[at]
            distance = (self.values[at] ^ value).bit_count()
            if distance not in edges:
                edges[distance] = new
                return
            at = edges[distance]


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect just what is connected within the radius: at most one for each value."""
    tree, root, links = BKTree(), [], []
    for value in values:
        near = tree.within(value, radius)
        tree.add(value)
        root.append(own := len(root))
        for other in near:
            top = other
            while root[top] != top:
                root[top] = root[root[top]]
                top = root[top]
            if root[top] != own:
                root[top] = own
                links.append((tree.values[other], value))
    return links


def fingerprint_links(fps: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) between different fingerprints of the column fp, enough to connect all within radius."""
    if not 0 <= radius < blocks or 64 % blocks:
        raise ValueError("blocks must divide 64 and be more than the radius")
    width = 64 // blocks
    shards = [
        F.struct(F.xxhash64(F.lit(k), *(F.shiftrightunsigned("fp", width * b).bitwiseAND(F.lit((1 << width) - 1)) for b in chosen)).alias("shard"), "fp")
        for k, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]

    def links(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shard = batch.column("shard").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        edges = np.flatnonzero(np.diff(shard)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(shard)]))
        many = ends - starts > 1
        found = [x for s, e in zip(starts[many], ends[many], strict=True) for x in tree_links(fp[s:e].tolist(), radius)]
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return (
        fps.select("fp").distinct().select(F.explode(F.array(*shards)).alias("s")).select("s.*")
        .repartition("shard").sortWithinPartitions("shard", "fp")
        .mapInArrow(lambda batches: sorted_groups(batches, links, "shard"), "a long, b long")
    )


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document; component_id is the smallest doc_id reachable."""
    prints = materialise(fingerprints(docs, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    members = materialise(connected_components(fingerprint_links(prints, radius, blocks)))
    named = members.join(classes, members["node"] == classes["fp"])
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = hub_join(members, least, "component").select(F.col("node").alias("fp"), "component_id")
    of = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return hub_join(prints, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
