"""Operator 6: benchmark decontamination by BM25 and block-max WAND.

The test items are the index, the training passages the queries. A document's whole text is cut into
windows of twice the longest unit's words, half a window apart, so that each unit of an item (items are
cut into units of at most UNIT words) lies whole in some window. A term's impact on a unit is its BM25
weight divided by the unit's score for itself, so a window that holds all of a unit scores 1. Each window
retrieves every unit that scores at least `threshold`, by WAND over posting lists in blocks that know
their largest impact; windows whose terms' largest impacts add up to the threshold in no block need no search.
Words are runs of letters and digits, so that punctuation beside a passage breaks none of its shingles; in scripts
that don't part words (see UNPARTED) each character is one, so that an item is found inside a longer run.
A retrieved unit is verified: at least `overlap` of its distinct five-word shingles, or of those of its
question, occur in the window, and as many of its answer's (a part of fewer words is one shingle). Where
nothing tells the answer from the question, the whole is enough, or the first two thirds and the rest. An
item hits a document if all its units do.

The index is built in shards of at most SHARD_WORDS words and SHARD_ITEMS items, so a shard's matrix of block
maxima has at most some 30 MB, and sent to the tasks at most SENT shards and SENT_BYTES of matrices at a time;
documents are searched against one lot of shards after another.

Defined results: an empty table of documents or items has no hits, and nothing is cleaned away; null and empty texts hit nothing; items without a word are never hit; an item without an
answer (or question) is verified by the other part. Repeated item rows give repeated hits of one item_id,
of which one is kept; documents are judged row by row. Ties don't matter: all above the threshold count.
Other columns are ignored by matches() and kept by clean_documents().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

UNIT, SHARD_WORDS, SHARD_ITEMS, SENT, SHINGLE = 256, 20_000, 1024, 20, 5
THRESHOLD, OVERLAP = 0.5, 0.8
K1, B = 1.2, 0.75
BLOCK = 4
SENT_BYTES = 100_000_000
#: Scripts that don't part words: kana and ideographs, Thai and Lao, Myanmar, Khmer.
UNPARTED = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\U00020000-\\U0003ffff\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff"
WORD = re.compile(rf"[^\W_{UNPARTED}]+|[{UNPARTED}]")
#: Terms of windows whose bounds are summed at once.
PAIRS = 1 << 14


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Posting lists of units in blocks, with the largest impact of each block and list."""

    def __init__(self, items: list[tuple[object, str, str]]) -> None:
        #: Item position, the shingles of the whole unit, of its question and of its answer, and whether the item tells them apart.
        self.units: list[tuple[int, list[set[tuple[str, ...]]], bool]] = []
        self.items: list[object] = []
        self.n_units: list[int] = []
        bags: list[Counter[str]] = []
        for item_id, question, answer in items:
            q, a = words_of(question), words_of(answer)
            told, words = bool(a), q + a
            if not told:  # both parts of the usual size count as well as the whole
                q, a = words[: -(-len(words) * 2 // 3)], words[-(-len(words) * 2 // 3) :]
            if not words:
                continue
            starts = range(0, len(words), UNIT)
            for at in starts:
                parts = [words[at : at + UNIT], q[at : at + UNIT], a[max(0, at - len(q)) : max(0, at + UNIT - len(q))]]
                self.units.append((len(self.items), [shingles(p) for p in parts], told))
                bags.append(Counter(words[at : at + UNIT]))
            self.items.append(item_id)
            self.n_units.append(len(starts))
        sizes = np.array([sum(b.values()) for b in bags], float)
        self.window = 2 * int(sizes.max(initial=SHINGLE))
        df = Counter(w for b in bags for w in b)
        mean = sizes.mean() if len(sizes) else 1.0
        weight = [{w: np.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)) for w, tf in bag.items()} for bag, size in zip(bags, sizes, strict=True)]
        self.term = {w: i for i, w in enumerate(sorted(df))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for unit, of in enumerate(weight):
            total = sum(of.values())
            for w, x in of.items():
                lists[self.term[w]].append((unit, x / total))
        self.postings = [([u for u, _ in p], [x for _, x in p]) for p in lists]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for _, x in self.postings]
        self.most = np.array([max(b) for b in self.block_max])
        #: Largest impact of each term in each block of BLOCK consecutive units, whatever its list.
        self.bounds = np.zeros((len(self.term), -(-len(self.units) // BLOCK)), np.float32)
        for term, (units, impacts) in enumerate(self.postings):
            np.maximum.at(self.bounds[term], np.array(units) // BLOCK, impacts)

    def retrieve(self, terms: list[int], threshold: float) -> list[int]:
        """Units that score at least the threshold for these different terms (block-max WAND)."""
        postings, block_max, most = self.postings, self.block_max, self.most
        cursors = [[postings[t][0][0], 0, t, float(most[t])] for t in terms]
        found, slack = [], threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                bound += cursor[3]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            # the blocks in which the lists up to the pivot would hold this unit
            bound, until = 0.0, None
            for cursor in cursors[: pivot + 1]:
                units, block = postings[cursor[2]][0], cursor[1] // BLOCK
                while (end := min(len(units), (block + 1) * BLOCK)) < len(units) and units[end - 1] < unit:
                    block += 1
                if units[end - 1] >= unit:
                    bound += block_max[cursor[2]][block]
                    until = units[end - 1] if until is None else min(until, units[end - 1])
            if bound >= slack:
                if cursors[0][0] == unit:
                    score = sum(postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= slack:
                        found.append(unit)
                    target = unit + 1
                else:
                    target = unit
            else:
                target = (until if until is not None else unit) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, max(cursors[pivot + 1][0], unit + 1))
            alive = []
            for i, cursor in enumerate(cursors):
                if i <= pivot and cursor[0] < target:
                    units, at = postings[cursor[2]][0], cursor[1]
                    while at < len(units) and units[at] < target:
                        at += 1
                    if at == len(units):
                        continue
                    cursor[0], cursor[1] = units[at], at
                alive.append(cursor)
            cursors = alive
        return found

    def hits(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float]]:
        """(item position, question overlap, answer overlap) of the items that a text holds."""
        words = words_of(text)
        if not words or not self.items:
            return []
        get = self.term.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        half = self.window // 2
        first = at // half  # the window that starts here, and the one before, hold the word
        pairs = np.concatenate((first * len(self.term) + ids[at], (first - 1) * len(self.term) + ids[at])) if len(words) > half else ids[at]
        pairs = np.unique(pairs[pairs >= 0])
        if not len(pairs):
            return []
        window, term = np.divmod(pairs, len(self.term))
        best: dict[int, tuple[float, ...]] = {}
        for w in self.promising(window, term, threshold):
            low, high = np.searchsorted(window, [w, w + 1])
            held = None
            for unit in self.retrieve(term[low:high].tolist(), threshold):
                if held is None:
                    held = shingles_of_all_sizes(words[w * half : w * half + self.window], self.short)
                _, parts, told = self.units[unit]
                whole, *shares = (len(p & held) / len(p) if p else None for p in parts)
                question, answer = shares = tuple(whole if share is None else share for share in shares)
                if min(shares) >= overlap or whole >= overlap and (answer >= overlap or not told):
                    best[unit] = max(best.get(unit, shares), shares)
        seen = Counter(self.units[u][0] for u in best)
        out = []
        for unit, shares in best.items():
            item = self.units[unit][0]
            if seen.get(item) == self.n_units[item]:
                out.append((item, min(s[0] for u, s in best.items() if self.units[u][0] == item), min(s[-1] for u, s in best.items() if self.units[u][0] == item)))
                del seen[item]
        return out

    def promising(self, window: np.ndarray, term: np.ndarray, threshold: float) -> list[int]:
        """Windows (ascending, with their terms) in which some block of units could reach the threshold."""
        out: list[int] = []
        for at in range(0, len(window), PAIRS):
            low, high = np.searchsorted(window, window[at]), np.searchsorted(window, window[min(at + PAIRS, len(window)) - 1], "right")
            starts = np.flatnonzero(np.diff(window[low:high], prepend=-1))
            able = (np.add.reduceat(self.bounds[term[low:high]], starts, axis=0) >= threshold - 1e-4).any(axis=1)
            out += window[low:high][starts[able]].tolist()
        return sorted(set(out))

    @property
    def short(self) -> list[int]:
        """Sizes below SHINGLE of parts that are one short shingle."""
        if not hasattr(self, "_short"):
            self._short = sorted({len(s) for _, parts, _ in self.units for p in parts for s in p} - {SHINGLE})
        return self._short


def shingles_of_all_sizes(words: list[str], short: list[int]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in [SHINGLE, *short] for i in range(len(words) - n + 1)}


def index_shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS, shard_items: int = SHARD_ITEMS) -> Iterator[Index]:
    """Indexes of the items (item_id, question, answer), each of at most shard_items items, and shard_words words and one item more."""
    items: list[tuple[object, str, str]] = []
    words = 0
    for row in benchmark.select("item_id", "question", "answer").orderBy("item_id", "question", "answer").toLocalIterator():
        item = (row["item_id"], row["question"] or "", row["answer"] or "")
        items.append(item)
        words += len(words_of(item[1])) + len(words_of(item[2]))
        if words >= shard_words or len(items) >= shard_items:
            yield Index(items)
            items, words = [], 0
    if items:
        yield Index(items)


def lots(shards: Iterator[Index]) -> Iterator[list[Index]]:
    """Up to SENT shards, and SENT_BYTES of matrices and one shard more, at a time."""
    lot: list[Index] = []
    for shard in shards:
        lot.append(shard)
        if len(lot) == SENT or sum(s.bounds.nbytes for s in lot) >= SENT_BYTES:
            yield lot
            lot = []
    if lot:
        yield lot


def questions(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) from items that have one text: up to its first question mark and the rest;
    without one, all of it is the question, as nothing tells where an answer would begin."""
    text = F.coalesce("text", F.lit(""))
    mark = F.instr(text, "?")
    asked = (mark > 0) & (mark < F.length(text))
    return benchmark.select(
        "item_id",
        F.when(asked, F.substring(text, F.lit(1), mark)).otherwise(text).alias("question"),
        F.when(asked, F.substring(text, mark + 1, F.length(text))).otherwise("").alias("answer"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap) for every document and every item (item_id, question, answer) that it holds."""
    small_batches(docs.sparkSession)
    doc, item = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc}, item_id {item}, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)

    def searcher(sent: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, index.items[item], q, a) for index in sent.value for i, t in enumerate(batch.column("text")) for item, q, a in index.hits(t.as_py(), threshold, overlap)]
                if rows:
                    where, items, q, a = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(where)), pa.array(items, item_type), pa.array(q), pa.array(a)],
                        ["doc_id", "item_id", "question_overlap", "answer_overlap"])
        return run

    for shards in lots(index_shards(benchmark)):
        sent = docs.sparkSession.sparkContext.broadcast(shards)
        out = out.union(docs.select("doc_id", "text").mapInArrow(searcher(sent), schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    small_batches(docs.sparkSession)

    def keeper(sent: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not any(index.hits(t.as_py(), threshold, overlap) for index in sent.value) for t in batch.column("text")], pa.bool_()))
        return run

    for shards in lots(index_shards(benchmark)):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(shards)), docs.schema)
    return docs
