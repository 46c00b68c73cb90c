"""Near-duplicate documents: all pairs of texts with a Jaccard similarity of `similarity` on their shingles.

Nothing is sampled. Two ways bring texts together, and every pair that they bring is verified on all shingle
hashes of both texts:

1. SimHash fingerprints of the different shingles, linked by the BK-trees of operator 10.
2. What fingerprints can't promise, a prefix filter does. Texts are put in the order of shingle hashes,
   frequent ones last; two texts of the similarity share one of the first n - ceil(similarity * n) + 1 of their
   n shingles, whatever the order. So a poor guess of what is frequent, taken from a sample of texts, costs
   time but no pair. The places of the first shared shingle bound what two texts can still share.

Only what connects is kept. Of the texts that share a prefix shingle, the one whose SimHash is nearest to the
bitwise majority is compared with the others first, which joins most near copies in linear time; the texts of a
very frequent shingle do so in parts, whose chosen texts are compared with one of them. Groups that still
hold several components then compare the texts outside their largest component with all the others, in
cells of at most about two blocks. Pairs whose parities of hash buckets differ in more places than similar
texts can differ in shingles go no further. Equal texts are one text from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, hash_share, materialise, small_batches, sorted_groups
from .simhash import SEED, fingerprint_links

SHINGLE, SIMILARITY, COMMON, BLOCK = 5, 0.8, 256, 4096
#: Texts that tell frequent shingles, and the most shingles called so.
SAMPLE_TEXTS, FREQUENT = 10_000, 200_000
#: Pairs of one text that are verified in a task.
LOT = 256
#: Fewest and most buckets of a text's parities.
PARITY = (1024, 1 << 24)


def bits_to_print(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of consecutive runs of hashes that start at cuts."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    sizes = np.diff(cuts, append=len(hashes))
    return np.packbits(sums * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def text_hashes(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """(fingerprint, ascending hashes of the different shingles)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0, np.zeros(1, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    whole = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    different = np.unique(whole)
    return int(bits_to_print(different, np.array([0]))[0]), different


def prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The hashes of which similar texts share at least one; frequent is ascending."""
    often = np.zeros(len(hashes), bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    size = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return np.concatenate((hashes[~often], hashes[often]))[:size]


def parity(hashes: np.ndarray) -> bytes:
    """For each bucket of hashes, whether it holds an odd number: texts differ in at least as many shingles as
    bits. There are about as many buckets as hashes, a power of two."""
    buckets = min(max(PARITY[0], 1 << (len(hashes) - 1).bit_length()), PARITY[1])
    return np.packbits(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the buckets of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) != len(y):
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two ascending sets reaches the least asked for."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def frequent_shingles(texts: DataFrame, shingle: int, common: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes that more than about `common` of the rows (id, text) hold, and into how many parts of
    about `block` rows to deal the rows of each, judged by a sample."""
    rate = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([text_hashes(t.as_py(), shingle)[1] for t in batch.column("text")]).view(np.int64))], ["token"])

    counts = texts.where(hash_share(F.col("id")) < rate).select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("texts"))
    rows = counts.where(F.col("texts") > max(4, common * rate)).orderBy(F.desc("texts"), "token").limit(FREQUENT).collect()
    found = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    parts = np.array([max(1, -(-int(r["texts"] / rate) // block)) for r in rows], np.int32)
    order = np.argsort(found)
    return found[order], parts[order]


def overlap_bound(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts of n and m shingles can be similar if the first one they share stands at these places."""
    return np.minimum(n - place, m - other) * (1 + similarity) >= similarity * (n + m) - 1e-6


def able(pairs: DataFrame, slim: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids that sizes and parities (id, n, parity) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column("n").to_numpy().astype(np.int64), batch.column("m").to_numpy().astype(np.int64)
                differ = np.fromiter(map(apart, batch.column("parity").to_pylist(), batch.column("other").to_pylist()), np.int64, len(n))
                # a Jaccard similarity of s allows (1 - s) / (1 + s) of both sizes to differ
                fits = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differ * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits))

    both = pairs.join(slim.withColumnRenamed("id", "a"), "a").join(slim.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("parity").alias("other")), "b")
    return both.select("a", "b", "n", "m", "parity", "other").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts (id, text) are similar; a pair's sets meet in lots of about LOT pairs of a."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([text_hashes(t.as_py(), shingle)[1].tobytes() for t in batch.column("text")], pa.binary())], ["id", "hashes"])

    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = materialise(rows.select("id", "text").join(needed, "id", "left_semi").mapInArrow(hashed, "id long, hashes binary"))
    many = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).alias("lots")).where(F.col("lots") > 1))
    dealt = pairs.join(many, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("lots", F.lit(1))).alias("lot"), "b")
    theirs = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "lot", "b", "hashes")
    own = dealt.select("a", "lot").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "lot", F.lit(None).cast("long").alias("b"), "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, held in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("hashes"), strict=True):
                hashes = np.frombuffer(held.as_buffer(), np.uint64)
                if b is None:
                    mine = hashes.copy()
                elif similar(mine, hashes, similarity):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    linked = materialise(own.union(theirs).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long"))
    for done in (needed, sets, many):
        discard(done)
    return linked


def chosen_pairs(unique: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Shared prefix shingles as (token, id, n, place), and the pairs (a, b) to verify first: a is the text of a
    shingle's part, or of a fingerprint, that the others (b) are compared with."""

    def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of tokens that several texts share, with the text to compare with first."""
        token, part, ids, n, place, fp = (batch.column(c).to_numpy() for c in ("token", "part", "id", "n", "place", "fp"))
        cuts = np.concatenate(([0], np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1))
        sizes = np.diff(cuts, append=len(token))
        far = np.bitwise_count(fp.view(np.uint64) ^ np.repeat(bits_to_print(fp.view(np.uint64), cuts), sizes))
        run = np.repeat(np.arange(len(cuts)), sizes)
        best = np.repeat(np.lexsort((ids, far, run))[cuts], sizes)
        some = (np.repeat(sizes, sizes) > 1) | (part >= 0)
        if some.any():
            names = ["token", "part", "id", "n", "place", "hub", "hub_n", "hub_place"]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (token, part, ids, n, place, ids[best], n[best], place[best])], names)

    listed = unique.select(F.posexplode(F.arrays_zip("tokens", "parts")).alias("place", "t"), "id", "n", "fp").select(F.col("t.tokens").alias("token"), F.col("t.parts").alias("part"), "id", "n", "place", "fp")
    dealt = listed.repartition("token", "part").sortWithinPartitions("token", "part", "id")
    shared = materialise(dealt.mapInArrow(lambda b: sorted_groups(b, meet, "token"), "token long, part int, id long, n int, place int, hub long, hub_n int, hub_place int"))
    hubs = shared.where(F.col("part") >= 0).select("token", "part", F.struct(F.col("hub").alias("id"), F.col("hub_n").alias("n"), F.col("hub_place").alias("place")).alias("hub")).distinct()
    tops = hubs.groupBy("token").agg(F.min("hub").alias("top"))  # one row a part
    of_parts = hubs.join(tops, "token").select(F.col("hub.id").alias("id"), F.col("hub.n").alias("n"), F.col("hub.place").alias("place"), F.col("top.id").alias("hub"), F.col("top.n").alias("hub_n"), F.col("top.place").alias("hub_place"))
    close = F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place")) * (1 + similarity) >= similarity * (F.col("n") + F.col("hub_n")) - 1e-6
    by_token = shared.drop("token", "part").unionByName(of_parts).where(close).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    least = materialise(unique.groupBy("fp").agg(F.min("id").alias("one"), F.count("*").alias("texts")))
    equal = unique.select("fp", "id").join(least.where(F.col("texts") > 1), "fp").select(F.col("one").alias("a"), F.col("id").alias("b"))
    tree = fingerprint_links(least)
    near = tree.join(least.select(F.col("fp").alias("a"), F.col("one").alias("one_a")), "a").join(least.select(F.col("fp").alias("b"), F.col("one").alias("one_b")), "b")
    pairs = by_token.union(equal).union(near.select("one_a", "one_b")).where(F.col("a") != F.col("b")).distinct()
    return shared, pairs


def pairs_across(joined: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b) of texts of different components that share a prefix shingle: rows (token, id, n, place, of).

    The texts outside a shingle's largest component, in blocks, meet all its texts, in blocks.
    """
    pieces = materialise(joined.groupBy("token", "of").agg(F.count("*").alias("texts")))
    open_ = materialise(
        pieces.groupBy("token").agg(F.sum("texts").alias("texts"), F.max(F.struct("texts", "of")).alias("most"))
        .where(F.col("texts") > F.col("most.texts"))
        .select("token", F.col("most.of").alias("main"), F.ceil((F.col("texts") - F.col("most.texts")) / block).alias("across"), F.ceil(F.col("texts") / block).alias("parts"))
    )
    met = joined.join(open_, "token")
    place = F.xxhash64("id")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    right = met.withColumn("cell", F.explode(F.transform(every("across"), lambda r: F.struct(r.alias("r"), F.pmod(place, F.col("parts")).alias("c"))))).withColumn("left", F.lit(False))
    left = met.where(F.col("of") != F.col("main")).withColumn("cell", F.explode(F.transform(every("parts"), lambda c: F.struct(F.pmod(place, F.col("across")).alias("r"), c.alias("c"))))).withColumn("left", F.lit(True))
    cells = right.union(left).select(F.xxhash64("token", "cell.r", "cell.c").alias("key"), "id", "n", "place", "of", "left")

    def pair(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, ids, n, place, of, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "n", "place", "of", "left"))
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        found, held = [], 0
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = np.arange(s, e)
            ours, all_ = rows[left[s:e]], rows[~left[s:e]]
            for i in ours.tolist():
                fits = (of[all_] != of[i]) & overlap_bound(n[all_].astype(np.int64), place[all_], np.int64(n[i]), place[i], similarity)
                fits &= np.minimum(n[all_], n[i]) >= similarity * np.maximum(n[all_], n[i]) - 1e-9
                other = ids[all_[fits]]
                if len(other):
                    found.append((np.minimum(other, ids[i]), np.maximum(other, ids[i])))
                    held += len(other)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
                    found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return cells.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda b: sorted_groups(b, pair, "key"), "a long, b long").distinct()


def kept_rows(rows: DataFrame, shingle: int, similarity: float, common: int, block: int) -> DataFrame:
    """(id): of the rows (id, doc_id, digest, text), which stand in the shared folder, the one that stays of each group."""
    spark = rows.sparkSession
    frequent, parts = frequent_shingles(rows.select("id", "text"), shingle, common, block)
    sent = spark.sparkContext.broadcast((frequent, parts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, deal = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, out = batch.column("id").to_numpy(), []
            for i, t in enumerate(batch.column("text")):
                fp, hashes = text_hashes(t.as_py(), shingle)
                tokens = prefix(hashes, often, similarity)
                part = np.full(len(tokens), -1, np.int32)
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    split = (often[at] == tokens) & (deal[at] > 1)
                    part[split] = ids[i] % deal[at[split]]
                out.append((np.uint64(fp), len(hashes), tokens.view(np.int64), part, parity(hashes)))
            fps, n, tokens, part, odd = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(part, pa.list_(pa.int32())), pa.array(odd, pa.binary())],
                ["id", "fp", "n", "tokens", "parts", "parity"])

    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"), F.col("id"))
    chosen = materialise(rows.groupBy("digest").agg(F.min("id").alias("id"), F.min(rank).alias("first")).drop("digest"))
    unique = materialise(rows.select("id", "text").mapInArrow(sign, "id long, fp long, n int, tokens array<long>, parts array<int>, parity binary").join(chosen.select("id"), "id", "left_semi"))
    slim = unique.select("id", "n", "parity")

    shared, pairs = chosen_pairs(unique, similarity)
    first = materialise(pairs)
    links = verified(materialise(able(first, slim, similarity)), rows, shingle, similarity)
    joined = materialise(shared.select("token", "id", "n", "place").join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "place", F.coalesce("component", "id").alias("of")))
    discard(shared)
    across = pairs_across(joined, similarity, block)
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(able(across.join(known, ["a", "b"], "left_anti"), slim, similarity))
    groups = connected_components(links.union(verified(rest, rows, shingle, similarity))).withColumnRenamed("node", "id")
    return chosen.join(groups, "id", "left").groupBy(F.coalesce("component", "id").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"))


def standing(docs: DataFrame) -> DataFrame:
    """(id, doc_id, digest, text, row) in the shared folder, row with all columns: ids don't change from here on."""
    small_batches(docs.sparkSession)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", digest.alias("digest"), F.struct(*(docs[c] for c in docs.columns)).alias("row")))
    return rows.withColumn("text", F.col("row.text"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, kept) for every row: whether it is the one that stays of its group.

    digest is the md5 of the text. The smallest doc_id of a group stays (null last), of equal ones the
    smallest digest, of repeated rows one. Null and empty texts are one group.
    """
    rows = standing(docs)
    stays = kept_rows(rows.drop("row"), shingle, similarity, common, block).withColumn("stays", F.lit(True))
    return rows.join(stays, "id", "left").select("doc_id", "digest", F.coalesce("stays", F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates."""
    rows = standing(docs)
    return rows.join(kept_rows(rows.drop("row"), shingle, similarity, COMMON, BLOCK), "id", "left_semi").select("row.*")
