"""Operator 8: language by rank-order profiles of character n-grams.

A text's letters, lower-cased and with every run of other characters as one blank, give n-grams of 1 to 3
characters. A profile is the ranked list of the most frequent ones (ties: smaller code points first). A
document takes the language whose profile has the smallest out-of-place distance: the sum, over the
document's ranked n-grams, of the difference in rank, or `size` where the profile lacks the n-gram.

Fitting reads a bounded sample: at most `per_lang` documents of each language, the first by a hash of
doc_id. Scoring reads every whole text.

Defined results: `und` and score 0 for null texts, texts without a letter, and where nothing was learned.
Equal distances go to the language that sorts first. Repeated rows get equal results; rows with a null
doc_id never train. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, held_out, small_batches

SIZE = 300
PER_LANG = 400
#: Codes in one sorted slice of a long text.
SLICE = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as integers (21 bits a character, blanks zero) and their counts; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.int64)
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    three = ((a << 42) | (b << 21) | c)[b != 0]
    two = (codes[:-1] << 21) | codes[1:]
    grams = np.concatenate((codes[codes != 0], two + (1 << 62), three))  # a blank first: shorter codes, told apart by the mark of pairs
    parts = [np.unique(grams[i : i + SLICE], return_counts=True) for i in range(0, len(grams), SLICE)]
    if len(parts) == 1:
        return parts[0]
    values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent values, most frequent first, ties by value."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))[:size]]


def fit_profiles(docs: DataFrame, size: int = SIZE, per_lang: int = PER_LANG) -> dict[str, list[int]]:
    """Ranked n-grams of each language in the columns doc_id, text, lang; size x languages values in all."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                grams.setdefault(lang, []).append(ngram_counts(text))
            for lang, parts in grams.items():
                values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(where, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(total)], ["lang", "gram", "n"])

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    place, order = hash_share(F.col("doc_id")), Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    shares = usable.groupBy("lang").agg((F.lit(3.0 * per_lang) / F.count("*")).alias("share")).collect()  # one row a language
    within = F.lit(False)
    for row in shares:  # three times as many as needed leave the tasks that read
        within = within | ((F.col("lang") == row["lang"]) & (F.col("place") < row["share"]))
    near = usable.select("doc_id", "text", "lang", place.alias("place")).where(within)
    sample = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_lang)
    counts = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("at", F.row_number().over(best)).where(F.col("at") <= size).select("lang", "gram", "at").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["at"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score): score is 1 less the distance's share of the largest possible."""
    small_batches(docs.sparkSession)
    langs = sorted(profiles)
    known = np.unique(np.array([g for lang in langs for g in profiles[lang]], np.int64))
    rank = np.full((len(langs), len(known) + 1), -1, np.int64)  # the last column: in no profile
    for i, lang in enumerate(langs):
        rank[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def guess(text: str | None) -> tuple[str, float]:
        values, counts = ngram_counts(text)
        if not len(values) or not langs:
            return "und", 0.0
        own = ranked(values, counts, size)
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        at = np.where(known[at] == own, at, len(known))
        theirs = rank[:, at]
        distance = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return langs[best], float(1 - distance[best] / (size * len(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [guess(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, size: int = SIZE, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that aren't held out, for all documents."""
    profiles = fit_profiles(docs.where(~held_out()), size, per_lang)
    return predict(docs, profiles, size).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
