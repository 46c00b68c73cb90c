"""The pipeline's stages over a small folder."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
from foldlight.llm import common, decontaminate, quality, tokens
from foldlight.llm.common import held_out
from pyspark.sql import functions as F

from .test_operators import components, plain_score

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        assert docs.columns == columns, name
        seen.append(docs.count())
        if name == "benchmark decontamination":
            assert not any(i in r["text"] for r in docs.collect() for i in items)
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    slots = sorted(r["slot"] for r in last.select("slot").collect())
    assert slots == list(range(len(slots)))


def test_odd_tables(spark, tmp_path):
    """Null texts and ids, repeated rows, columns whose names the stages use themselves; then tables without rows."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = base.orderBy("doc_id").limit(60)
    clash = {c: F.lit(i) for i, c in enumerate(("key", "size", "score", "slot", "tokens", "copies", "component", "hash", "label", "data", "shard", "_row", "src", "text_md5", "finish"))}
    odd = spark.createDataFrame([(900001, None, "en", None, 0), (900002, "", "en", "src1", 0), (900003, None, None, None, 0), (None, "a short text of some words", "en", "src1", 0), (900004, "words " * 40_000, "en", "src2", 0)], base.schema)
    docs = some.union(some.limit(5)).union(odd).withColumns(clash)
    for name, rows, tables in (("odd", docs, {}), ("none", docs.limit(0), {}), ("bare", docs, {"labels", "benchmark"})):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            table = spark.read.parquet(f"{SF}/{t}.parquet")
            (table.limit(0) if t in tables else table).write.parquet(f"{folder}/{t}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:4]:
            now = corpus_pipeline.materialise(stage(spark, now, folder))
            assert now.columns == docs.columns, (name, stage_name)
            if stage_name == "simhash near-dedup":
                kept = now.collect()
                assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept) and sum(not r["text"] for r in kept) <= 1
        out = corpus_pipeline.run(spark, folder)
        slots = sorted(r["slot"] for r in out.collect())
        assert slots == list(range(len(slots))) and bool(slots) == (name != "none")
    made = len(common.MADE)
    common.cleanup(spark, now)
    assert now.count() >= 0 and len(common.MADE) == 1 < made
    assert len(out.collect()) == len(slots)  # shards and their index are no scratch


def word_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def holds_item(text, index):
    words, half, held = decontaminate.words_of(text), index.window // 2, defaultdict(set)
    for at in range(0, max(1, len(words)), half):
        window = words[at : at + index.window]
        seen = {tuple(window[i : i + n]) for n in range(1, 6) for i in range(len(window) - n + 1)}
        for u, (item, parts, told) in enumerate(index.units):
            whole, q, a = (len(p & seen) / len(p) if p else None for p in parts)
            q, a = (whole if x is None else x for x in (q, a))
            if min(q, a) >= 0.8 or whole >= 0.8 and (a >= 0.8 or not told):
                terms = set(window) & set(index.term)
                if sum(x for w in terms for v, x in zip(*index.postings[index.term[w]], strict=True) if v == u) >= 0.5 - 1e-9:
                    held[item].add(u)
    return any(len(us) == index.n_units[i] for i, us in held.items())


def mixed(rows):
    """How often the mix takes each row (doc_id, text, source)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    key = [hashlib.md5(f"13|{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest() if r['text'] is not None else ''}".encode()).hexdigest() for r in rows]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r["source"] == s) for s in sources}
    weight, target, budget, free = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, {}, 1.5 * sum(size), set(sources)
    while True:
        share = {s: (budget - sum(target[x] for x in sources if x not in free)) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    target |= share
    entries = []
    for s in sources:
        done = 0
        for i in sorted((i for i, r in enumerate(rows) if r["source"] == s), key=lambda i: key[i]):
            done += size[i]
            entries += [((done + c * total[s]) / target[s], (s is None, s or ""), key[i], i) for c in range(2)]
    taken, upto = [0] * len(rows), 0
    for *_, i in sorted(entries):
        upto += size[i]
        if upto > budget:
            break
        taken[i] += 1
    return taken


def test_whole_run_by_definition(spark):
    """run() against plain Python: every score, pair, window, finish time and slot."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs.where(~held_out()), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = [(plain_score(r["text"], model), r) for r in docs.collect()]
    assert min(abs(s - 0.3) for s, _ in scored) > 2e-3
    rows = [r for s, r in scored if s >= 0.3]
    sets = dict(zip((r["doc_id"] for r in rows), word_sets(r["text"] for r in rows), strict=True))
    of = components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    rows = [r for r in rows if of[r["doc_id"]] == r["doc_id"]]
    bench = decontaminate.questions(spark.read.parquet(f"{SF}/benchmark.parquet"))
    index = decontaminate.Index([(r["item_id"], r["question"], r["answer"]) for r in bench.orderBy("item_id").collect()])
    rows = [r for r in rows if not holds_item(r["text"], index)]
    rows = [r for r, n in zip(rows, mixed(rows), strict=True) for _ in range(n)]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    encode = tokens.Encoder(tokens.VOCABULARY, tokens.PATTERN).encoding.encode_ordinary
    listed = []
    for r in sorted(rows, key=lambda r: md5(f"false{r['doc_id']}|{md5(r['text']) if r['text'] is not None else ''}")):
        ids = [*encode(r["text"] or ""), tokens.END_TOKEN]
        listed += [(r["doc_id"], at // 512, (ids[at : at + 512] + [tokens.END_TOKEN] * 512)[:512]) for at in range(0, len(ids), 512)]
    want = dict(zip(tokens.feistel(np.arange(len(listed)), len(listed), 2024).tolist(), listed, strict=True))
    out = corpus_pipeline.run(spark, SF)
    written = {r["slot"]: bytes(r["tokens"]) for r in tokens.read_slots(spark, out._scratch_path, 0, 10**9).collect()}  # from the shards
    index = out.collect()
    assert all(r["tokens_md5"] == hashlib.md5(written[r["slot"]]).hexdigest() for r in index) and len(index) == len(written)
    got = {r["slot"]: (r["doc_id"], r["chunk"], np.frombuffer(written[r["slot"]], np.uint16).tolist()) for r in index}
    assert len(got) == len(want) > 100 and got == want
