"""Operator 1: document quality by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE bytes each, all of them). Every passage is encoded: counts of
pairs of byte kinds and of hashed byte trigrams, scaled, then a learned tanh layer. Gated attention,
softmax over a document's passages of w . (tanh(V h) * sigmoid(U h)), weighs the passages; a logistic
layer scores the weighted sum. Encoder, attention and scorer are learned together from document labels.

Fitting uses a bounded sample: labelled documents in the order of a hash of doc_id, at most `max_docs`
of them and `max_passages` passages together; texts of more than `max_bag` passages don't train, so that
no text, however long, takes the place of the others. Scoring reads every whole text; weights have a fixed size.

Defined results: null and empty texts are a bag of one empty passage. Where no label or only one label
value is known, every score is the share of label 1 (0.5 without labels). Several labels of one document
count as their smallest; null labels and null doc_ids never train. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, held_out, small_batches, text_batches

PASSAGE = 512
TRIGRAMS = 256
MAX_DOCS = 3000
MAX_PASSAGES = 24_000
MAX_BAG = 400
THRESHOLD = 0.3
#: Bytes encoded at once, and passages whose deviations are summed at once.
SLICE, ROWS = 1 << 20, 1 << 10
#: Kinds of bytes: each of these by itself, then the ranges below.
SINGLE = b" \n.,!?*#%&$|-;:/@'\""
KINDS = len(SINGLE) + 7


def kinds() -> np.ndarray:
    """The kind of each byte value."""
    of = np.full(256, len(SINGLE), np.int64)
    for i, (low, high) in enumerate(((48, 57), (65, 90), (97, 122), (128, 191), (192, 223), (224, 255))):
        of[low : high + 1] = len(SINGLE) + 1 + i
    of[np.frombuffer(SINGLE, np.uint8)] = np.arange(len(SINGLE))
    return of


KIND = kinds()
WIDTH = KINDS * KINDS + TRIGRAMS


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (float32) and the number of passages of each text, at least one."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bags = np.maximum(1, -(-sizes // PASSAGE))
    out = np.zeros((int(bags.sum()), WIDTH), np.float32)
    row = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        for at in range(0, max(size, 1), SLICE):
            part = np.frombuffer(text, np.uint8, min(SLICE, size - at), at) if size else np.empty(0, np.uint8)
            n = max(1, -(-len(part) // PASSAGE))
            if len(part) > 2:
                kind, wide = KIND[part], part.astype(np.int64)
                passage = np.arange(len(part)) // PASSAGE
                pair = np.bincount(passage[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:], minlength=n * KINDS * KINDS)
                tri = ((wide[:-2] * 961 + wide[1:-1] * 31 + wide[2:]) * 40503 >> 7) % TRIGRAMS
                tri = np.bincount(passage[:-2] * TRIGRAMS + tri, minlength=n * TRIGRAMS)
                share = 100.0 / np.bincount(passage, minlength=n)[:, None]
                out[row : row + n, : KINDS * KINDS] = np.log1p(pair.reshape(n, -1) * share)
                out[row : row + n, KINDS * KINDS :] = np.log1p(tri.reshape(n, -1) * share)
            row += n
    return out, bags


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMIL:
    """Tanh encoder, gated attention pooling and a logistic scorer, fitted by Adam on the log loss."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"E": draw(width, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """x: scaled features; every array of the pass, for backward()."""
        p, start = self.p, np.concatenate(([0], np.cumsum(bags)[:-1]))
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        logit = (t * g) @ p["w"]
        a = np.exp(logit - np.repeat(np.maximum.reduceat(logit, start), bags))
        a /= np.repeat(np.add.reduceat(a, start), bags)
        z = np.add.reduceat(a[:, None] * h, start)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": sigmoid(z @ p["c"] + p["b"]), "start": start}

    def backward(self, f: dict[str, np.ndarray], bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, err = self.p, (f["score"] - y).astype(np.float32) / len(y)
        of_z = np.repeat(err, bags)[:, None] * p["c"]
        of_a = (of_z * f["h"]).sum(1)
        of_logit = f["a"] * (of_a - np.repeat(np.add.reduceat(f["a"] * of_a, f["start"]), bags))
        of_t = of_logit[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        of_g = of_logit[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        of_h = (f["a"][:, None] * of_z + of_t @ p["V"].T + of_g @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ of_h, "e": of_h.sum(0), "V": f["h"].T @ of_t, "U": f["h"].T @ of_g, "w": (f["t"] * f["g"]).T @ of_logit, "c": f["z"].T @ err, "b": err.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.004, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> AttentionMIL:
        """x is scaled in place: no second matrix of its size is made."""
        self.mean = x.mean(0)
        self.scale = (1 / (np.sqrt(sum(((x[i : i + ROWS] - self.mean) ** 2).sum(0, dtype=float) for i in range(0, len(x), ROWS)) / len(x)) + 0.05)).astype(np.float32)
        x -= self.mean
        x *= self.scale
        np.clip(x, -8, 8, out=x)
        start = np.concatenate(([0], np.cumsum(bags)))
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                rows = np.concatenate([np.arange(start[k], start[k + 1]) for k in chosen])
                grads = self.backward(self.forward(x[rows], bags[chosen]), bags[chosen], y[chosen])
                step += 1
                for k, grad in grads.items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(np.clip((x - self.mean) * self.scale, -8, 8), bags)["score"].astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES, max_bag: int = MAX_BAG) -> AttentionMIL | float:
    """Learn from documents (doc_id, text) that have a 0/1 label; the share of 1 if there is nothing to tell apart."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    place = hash_share(F.col("doc_id"))
    have = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).where(F.col("n") <= max_bag)
    share = 3.0 * max_docs / max(1, known.count())  # three times as many as needed leave the tasks that read
    labelled = have.join(known.where(place < share), "doc_id").withColumn("place", place)
    first = labelled.orderBy("place", "doc_id", "n").limit(max_docs)
    running = Window.orderBy("place", "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)  # at most max_docs rows
    chosen = first.withColumn("sum", F.sum("n").over(running)).where(F.col("sum") <= max_passages).groupBy("doc_id").agg(F.max("y").alias("y"), F.count("*").alias("copies"))
    rows = {r["doc_id"]: (r["y"], r["copies"]) for r in chosen.collect()}
    if len({y for y, _ in rows.values()}) < 2:
        return float(np.mean([y for y, _ in rows.values()])) if rows else 0.5
    ids = spark.createDataFrame([(k,) for k in rows], f"doc_id {dict(docs.dtypes)['doc_id']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text", SLICE) if batch.num_rows else ():
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                x, bags = encode(texts)
                ends = np.cumsum(bags)
                packed = [x[e - n : e].astype(np.float16).tobytes() for e, n in zip(ends, bags, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "bag"])

    kind = dict(docs.dtypes)["doc_id"]
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bag * PASSAGE)
    sample = short.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most max_docs ids
    got = sorted((r["doc_id"], bytes(r["bag"])) for r in sample.mapInArrow(run, f"doc_id {kind}, bag binary").toLocalIterator())
    y, bags = np.array([rows[k][0] for k, _ in got], np.float32), np.array([len(bag) // (2 * WIDTH) for _, bag in got])
    x = np.empty((int(bags.sum()), WIDTH), np.float32)
    for at in np.cumsum(bags)[::-1]:
        part = np.frombuffer(got.pop()[1], np.float16).reshape(-1, WIDTH)
        x[at - len(part) : at] = part
    return AttentionMIL(WIDTH).fit(x, bags, y)


def score_texts(texts: list[str | None], model: AttentionMIL | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    return model.score(*encode([(t or "").encode("utf-8", "surrogatepass") for t in texts]))


def score(docs: DataFrame, model: AttentionMIL | float) -> DataFrame:
    """(doc_id, score) for every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text", SLICE) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(part.column("text").to_pylist(), model), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: AttentionMIL | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text", SLICE) if batch.num_rows else ():
                yield part.filter(pa.array(score_texts(part.column("text").to_pylist(), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labelled documents that aren't held out."""
    model = fit(docs.where(~held_out()), labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
