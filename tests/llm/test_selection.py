"""Operators 11 to 13 against their definitions, with odd rows, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from foldlight.llm import audit, resample, topk

WORDS = "the of and Lor ipsum dolor Sit amet con séc tetur adi pis ci-ng elit 12 x3 é".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_top(rows, k=10):
    good = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (query, q) in enumerate(good):
        if query is None or query % 100:
            continue
        found = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, c, strict=False)))), i) for b, (i, c) in enumerate(good) if b != a]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(query, rank + 1, i, score) for rank, (score, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize(("rows", "queries"), [(16_384, 4096), (37, 2)])
def test_top_scores(spark, rows, queries):
    rng = np.random.default_rng(1)
    data = [(i, rng.integers(-3, 4, 12).astype(float).tolist()) for i in range(0, 900, 4)]  # whole numbers: many ties
    data += [(1000 + i, data[0][1]) for i in range(60)]  # copies of one vector
    data += [data[25], data[25], (100, data[3][1]), (None, data[2][1]), (None, data[2][1]), (2000, None), (2001, [float("nan")] * 12), (2002, [None] * 12), (2100, [float("inf")] + [1.0] * 11)]
    data += [(2200, []), (2300, [0.0] * 12), (2400, [1.5, -2.25]), (2401, [0.0005, -0.0005] * 6)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<double>, key string, rank int")
    got = [tuple(r) for r in topk.top_scores(frame, rows=rows, queries=queries).collect()]
    assert sorted(got, key=str) == sorted(brute_top(data), key=str)
    assert topk.top_scores(frame.limit(0)).count() == 0 and topk.top_scores(frame.where("vec_id % 100 <> 0")).count() == 0


def test_top_scores_beyond_64_bits(spark):
    data = [(0, [1e15, 1e15]), (1, [1e12, -1e12]), (2, [1e12, 1e12]), (3, [-1e12, -1e12]), (4, [3.0, 5.0]), (100, [2.0, 1.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_scores(frame, k=3).collect())
    assert got == sorted(brute_top(data, 3)) and max(r[3] for r in got) == (1 << 63) - 1
    few = topk.top_scores(frame.where("vec_id < 2")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]


def plain_features(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute_resample(docs, target):
    made = [(d, *plain_features(t)) for d, t in docs]
    s, t = sum((c for *_, c in made), Counter()), sum((plain_features(x)[1] for x in target), Counter())
    many, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (many + 10_000.0) / ((s[b] + 1.0) * (wanted + 10_000.0)))) for b in range(10_000)}
    rows = []
    for d, n, c in made:
        weight = sum(gain[b] * x for b, x in c.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2], r[5]))
    for rank, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("margin", "accuracy"), [(0.002, 10_000), (1e-9, 2), (2.0, 10)])
def test_resample(spark, margin, accuracy):
    """The bracket holds at once, must be widened again and again, or is open: the result is the same."""
    rng = random.Random(5)
    docs = [(i, text(rng, rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1] + " the" * 30) for i in range(150)] + [(None, None), (2000, ""), (2001, "--- !!"), (None, text(rng, 40)), (2002, "É" * 50_000 + " a" * 70_000)]
    docs += [docs[9]] * 40 + [(3000, text(rng, 25))] * 60
    target = [text(rng, 20) + " é séc" for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame([(*d, 0, "x", 7) for d in docs], "doc_id long, text string, h int, buckets string, rank int")
    wished = spark.createDataFrame([(t, 1) for t in target], "text string, n_words int")
    got = sorted((tuple(r) for r in resample.resample(frame, wished, margin=margin, accuracy=accuracy).collect()), key=str)
    assert got == brute_resample(docs, target) and sum(r[4] is not None for r in got) > 20
    if margin == 0.002:
        assert resample.resample(frame.limit(0), wished).count() == 0
        assert sorted((tuple(r) for r in resample.resample(frame, wished.limit(0)).collect()), key=str) == brute_resample(docs, [])
        assert sorted((tuple(r) for r in resample.resample(frame.limit(10), wished).collect()), key=str) == brute_resample([tuple(r)[:2] for r in frame.limit(10).collect()], target)


def test_features_of_long_texts(monkeypatch):
    """Pieces of any size yield the runs of the whole."""
    rng = random.Random(6)
    for case in ["", "a", " a ", "A B", "x-y-z w", text(rng, 60), "Ünder COVER", "AAAA" * 30 + " b"]:
        words, want = plain_features(case)
        for piece in (1, 2, 7, 1 << 20):
            monkeypatch.setattr(resample, "PIECE", piece)
            n, got = resample.features(case.encode())
            assert n == words and Counter(got.tolist()) == want


def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails.append((s or "", d, {k for k, v in f.items() if v}))
    out, removed_by = {}, Counter()
    for part in {s for s, _, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for s, d, f in fails if s == part]
            gone: list = []
            for step, x in enumerate(order):
                hit, rest = [v for v in left if x in v[1]], [v for v in left if x not in v[1]]
                redundant = sum(x in f for _, f in gone)
                out[part, order, step + 1] = [len(rest), len(hit), redundant, sum(f == {x} for _, f in left + gone), sum(d in good for d, _ in hit), sum(d in toxic for d, _ in hit)]
                removed_by[part, x] += len(hit)
                left, gone = rest, gone + hit
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(7)
    body = lambda n, loud=False, mark="": " ".join(f"w{rng.randint(0, 400)}" if not loud else f"W{rng.randint(0, 400)}" for _ in range(n)) + mark
    sources = ["a", "b", None, ""]
    docs = [(i, body(rng.choice([20, 199, 200, 250, 900]), rng.random() < 0.2, rng.choice(["", "", "$", " *"])), rng.choice(sources)) for i in range(120)]
    docs += [(1000 + i, docs[3][1], "a") for i in range(40)] + [(-5, docs[8][1], "b"), (None, docs[9][1], "a"), (None, docs[9][1], "a"), docs[11], docs[11], (11, docs[12][1], "a")]
    docs += [(2000, None, "a"), (2001, "", "b"), (2002, None, None), (None, None, "a"), (2003, " \t\n", "a"), (2004, "same " * 30_000, "b"), (2005, "A" * 300_000, "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1040, 3)] + [(None, 1, 1), (6, 1, 0), (6, 0, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n int, part string")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, bits string")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in audit.filter_audit(frame, marks).select(columns).collect())
    assert got == brute_audit(docs, labels) and len(got) == 3 * 600
    assert audit.filter_audit(frame.limit(0), marks).count() == 0
    bare = audit.filter_audit(frame, marks.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
