"""Brute-force checks and odd rows for the training-data operators."""

import hashlib
import random
import zlib
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from foldlight.llm import chat, common, decontaminate, langid, mixing, neardup, pivots, quality, repeats, simhash, suffixes, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, fp string, size string, key string, digest string, score string"
WORDS = "the of and lor ipsum dolor sit amet con sec tetur adi pis cing elit sed do eius mod tem por inci".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [(i, text(rng, rng.randint(3, 220)), rng.choice(["en", "de"]), rng.choice(["a", "b", "ü", None])) for i in range(60)]
    copies = [(100 + i, base[i][1], "en", "a") for i in range(8)]
    near = [(200 + i, base[i][1].replace("the", "thee", 1), "en", "b") for i in range(20)]
    shared = text(rng, 70)
    passages = [(300 + i, f"{text(rng, 30)} {shared} {text(rng, 30)}", "de", "b") for i in range(6)]
    odd = [(400, None, "en", "a"), (401, "", None, None), (402, "  \n", "de", "b"), (403, "123 ?!", "en", "a"), (404, text(rng, 9000), "en", "b"), (None, base[3][1], "en", "a"), base[5], base[5]]
    return base + copies + near + passages + odd


def components(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == components(nodes, edges)
    assert common.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_hub_joins_are_split(spark):
    """A hot key meets its own aggregate; with small thresholds the plan that ran must have split it."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
             "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, 0, id) as u", "id as v")
        joined = common.hub_join(rows, rows.groupBy("u").agg({"v": "min"}), "u")
        assert joined.count() == 60_000 and joined.columns == ["u", "v", "min(v)"]
        joined.write.format("noop").mode("overwrite").save()
        listed = joined.collect()
        assert len(listed) == 60_000 and "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quality(spark, rows):
    rng = random.Random(2)
    good = [(i, text(rng, 80), "en", "a") for i in range(150)]
    bad = [(1000 + i, text(rng, 80).upper().replace(" ", "!! "), "en", "a") for i in range(60)]
    mixed = [(2000 + i, f"{text(rng, 150)} {text(rng, 90).upper().replace(' ', '!! ')}", "en", "a") for i in range(40)]
    df = docs(spark, good + bad + mixed + [(5000, None, "en", "a"), (5001, "", "en", "a")])
    labels = spark.createDataFrame([(r[0], int(r in good), "x") for r in good + bad + mixed] + [(None, 1, "x"), (1, None, "x")], "doc_id long, quality int, text string")
    out = {r["doc_id"]: r for r in quality.classify_quality(df, labels).collect()}
    held = [i for i, r in out.items() if r["held_out"] and i < 5000]
    assert len(out) == 252 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert np.mean([out[i]["predicted"] == int(i < 1000) for i in held]) > 0.9
    assert {r["score"] for r in quality.classify_quality(df, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.classify_quality(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(df.limit(0), labels).count() == 0


def test_quality_sample_survives_long_texts(spark, monkeypatch):
    """Very long labelled texts, first by hash or anywhere, neither train nor drive out the others."""
    rng = random.Random(4)
    data = [(i, text(rng, 40) if i % 2 else text(rng, 40).upper()) for i in range(60)]
    long = [(i, "spam " * 700_000) for i in (7, 8)]
    df = spark.createDataFrame([(i, t) for i, t in data if i not in (7, 8)] + long, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, quality int")
    for shift in (0.0, 1.0):  # in the order of the hash, then these texts first
        monkeypatch.setattr(quality, "hash_share", lambda key, s=shift: common.hash_share(key) - s * key.isin(7, 8).cast("double"))
        model = quality.fit(df, labels, max_docs=40, max_passages=200, max_bag=50)
        assert isinstance(model, quality.AttentionMIL)
        got = quality.score_texts([t for _, t in data], model)
        assert np.mean([(s > 0.5) == bool(i % 2) for (i, _), s in zip(data, got, strict=True)]) > 0.9


def plain_score(text, model):
    """A document's score by the definition, passage by passage."""
    data, rows = (text or "").encode(), []
    for at in range(0, max(1, len(data)), quality.PASSAGE):
        part, row = data[at : at + quality.PASSAGE], np.zeros(quality.WIDTH)
        after = data[at + quality.PASSAGE : at + quality.PASSAGE + 2]
        if len(data) > 2:
            n = len(part)
            whole = part + after
            for i in range(n):
                if i + 1 < len(whole):
                    row[quality.KIND[whole[i]] * quality.KINDS + quality.KIND[whole[i + 1]]] += 100 / n
                if i + 2 < len(whole):
                    row[quality.KINDS**2 + ((whole[i] * 961 + whole[i + 1] * 31 + whole[i + 2]) * 40503 >> 7) % quality.TRIGRAMS] += 100 / n
        rows.append(np.clip((np.log1p(row) - model.mean) * model.scale, -8, 8))
    p, gate = model.p, lambda x: 1 / (1 + np.exp(-x))
    h = [np.tanh(x @ p["E"] + p["e"]) for x in rows]
    weight = np.array([np.exp((np.tanh(x @ p["V"]) * gate(x @ p["U"])) @ p["w"]) for x in h])
    return float(gate(sum(w * x for w, x in zip(weight / weight.sum(), h, strict=True)) @ p["c"] + p["b"][0]))


def test_quality_scores_by_definition(spark, rows):
    model = quality.AttentionMIL(quality.WIDTH, seed=3)
    model.p["c"] = model.p["c"] * 5
    got = sorted((r["doc_id"] or -1, round(r["score"], 4)) for r in quality.score(docs(spark, rows), model).collect())
    want = sorted((r[0] or -1, plain_score(r[1], model)) for r in rows)
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in zip(got, want, strict=True))


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x, bags, y = rng.standard_normal((9, 5)).astype(np.float32), np.array([2, 3, 4]), np.array([0, 1, 1], np.float32)
    model = quality.AttentionMIL(5, hidden=4, gate=3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}

    def loss():
        s = model.forward(x, bags)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.backward(model.forward(x, bags), bags, y)
    for name, grad in grads.items():
        at = (0,) * model.p[name].ndim
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_urls(spark):
    link = "<html><link href='{}' rel=canonical></html>"
    pages = [
        (1, "http://a.NET/x", ""), (2, "https://en.example.net/en/1?q=1#t", None), (3, "http://b.com/1", link.format("http://a.net/zz")), (4, "http://c.com/1", link.format("//b.com/1")),
        (5, None, link.format("http://a.net/")), (6, "no url", ""), (7, "", ""), (8, "ftp://org/fr/", "<META http-equiv='refresh' content='0; url=http://x.net/1'>"), (9, "http://d.com/p", link.format("http://example.net/en/k")),
        (10, "http://notnet/", ""), (11, "http://q.com/1", link.format("http://org/fr/")), (1, "http://a.NET/x", ""), (12, "http://e.com/a/b", link.format("http://f.org/1")),
    ]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    df = spark.createDataFrame([(*p, "z", "z") for p in pages], "page_id long, url string, html string, host string, node string")
    out = {r["page_id"]: r for r in urls.judge_urls(df, rules, spark.createDataFrame([("http://f.org/1", "https://g.net/")], "from_url string, to_url string")).collect()}
    verdicts = {k: v["verdict"] for k, v in out.items()}
    assert verdicts == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "block"}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"]) == ("a.net", "/x", "net/") and out[2]["rule"] == "example.net/en/" and out[5]["host"] == "" and out[3]["rule"] is None
    assert urls.judge_urls(df.limit(0), rules).count() == 0


class Links(HTMLParser):
    """Canonical links and refresh redirects as the standard library's parser sees them."""

    def __init__(self, url):
        super().__init__(convert_charrefs=False)
        self.url, self.found, self.title = url, [], False

    def handle_endtag(self, tag):
        self.title = self.title and tag != "title"

    def handle_starttag(self, tag, attrs):
        if tag == "title" or self.title:  # browsers read no tags in titles
            self.title = True
            return
        held = {}
        for k, v in attrs:
            held.setdefault(k, v or "")
        target = None
        if tag == "link" and "canonical" in held.get("rel", "").lower().split():
            target = held.get("href")
        if tag == "meta" and held.get("http-equiv", "").strip().lower() == "refresh":
            head, _, rest = held.get("content", "").partition("=")
            if head.strip().lower().endswith("url"):
                target = rest.strip().strip("'\"")
        if target and target.strip():
            to = urljoin(self.url, target.strip())
            if "://" in to:
                self.found.append(to)

    handle_startendtag = handle_starttag


def test_links_of_every_form(spark):
    """Tags with any order, case, quotes, line feeds and references; tags that look like links and are none."""
    rng = random.Random(31)
    targets = ["http://x.net/1", "//x.net/2", "/en/3", "sub/4", "../up/5", "./6?q=1", "?only=7", "http://x.net/8?a=1&amp;b=2", "http://x.net/&#112;ath&#x2F;9", " http://x.net/10 ", "mailto:a@x.net", "javascript:go()", "", "#top", "https://X.NET/11#f", "a/../../12"]
    noise = ["<p>rel=canonical</p>", "<link rel='stylesheet' href='http://cdn.net/canonical/x.css'>", "<link rel=next title=\"refresh\" href=http://x.net/no1>", "<!-- <link rel=canonical href=http://x.net/no2> -->", "<script>'<link rel=canonical href=http://x.net/no3>'</script>",
             "<meta name=refresh content='0; url=http://x.net/no4'>", "<link title='a rel=canonical b' rel=icon href=http://x.net/no5>", "<linked rel=canonical href=http://x.net/no6>", "<meta http-equiv=refresh content=30>", "<title><link rel=canonical href=http://x.net/no7></title>", "<link rel=canonical>", "<link data-rel=canonical href=http://x.net/no8>", "<LINK REL=alternate\nHREF='http://x.net/no9'>"]
    quote = lambda v: rng.choice([f'"{v}"', f"'{v}'", v if v and not set(v) & set(" \"'") else f'"{v}"'])
    gap = lambda: rng.choice([" ", "\n", "\r\n\t", "  "])
    case = lambda s: rng.choice([s, s.upper(), s.title()])

    def tag():
        if rng.random() < 0.6:
            parts = [f"{case('rel')}{rng.choice(['=', ' = ', '=' + chr(10)])}{quote(rng.choice(['canonical', 'CANONICAL', 'nofollow canonical', 'canonicals', 'icon']))}", f"{case('href')}={quote(rng.choice(targets))}", "crossorigin", f"title={quote('rel canonical')}"]
            name = case("link")
        else:
            parts = [f"{case('http-equiv')}={quote(rng.choice(['refresh', 'Refresh', 'refreshing']))}", f"{case('content')}=\"{rng.choice(['0', '5', '0.5'])}{rng.choice(['; ', ';', ', '])}{rng.choice(['url', 'URL', 'Url'])}={rng.choice(targets).strip()}\""]
            name = case("meta")
        rng.shuffle(parts)
        return f"<{name}{gap()}{gap().join(parts)}{rng.choice(['', ' ', ' /', chr(10)])}>"

    pages = []
    for i in range(250):
        parts = [tag() for _ in range(rng.randint(0, 3))] + rng.choices(noise, k=rng.randint(0, 4))
        rng.shuffle(parts)
        pages.append((f"http://a{i}.com/{rng.choice(['', 'p', 'p/q/r', 'p/?x=1'])}", f"<html>{chr(10).join(parts)}</html>" + rng.choice(["", "<!-- open", "<script>x"])))
    pages += [("http://b.com/1", None), ("http://b.com/2", "<link rel=canonical href=http://x.net/long>" + "<b>x" * 300_000), ("http://b.com/3", "<link " + "a='' " * 20_000 + "rel=canonical href=http://x.net/wide>")]
    want = set()
    for url, html in pages:
        parser = Links(url)
        parser.feed(html or "")
        want |= {(url, to) for to in parser.found}
    frame = spark.createDataFrame(pages, "url string, html string")
    node = lambda c: urls.url_node(F.col(c))
    ends = lambda links: {tuple(r) for r in links.select(node("from_url").alias("a"), node("to_url").alias("b")).where("a <> b").collect()}
    got = ends(urls.html_links(frame))
    assert got == ends(spark.createDataFrame(sorted(want), "from_url string, to_url string")) and len(got) > 120
    assert not any("no" in b for _, b in got)


def test_suffix_order():
    rng = np.random.default_rng(5)
    for _ in range(40):
        data = np.concatenate((rng.integers(1, rng.integers(2, 6), rng.integers(1, 200)), [0])).astype(np.uint8)
        order = suffixes.suffix_order(data, len(data)).tolist()
        assert order == sorted(range(len(data)), key=lambda i, b=data.tobytes(): b[i:])


def removed(texts, length):
    count, out = defaultdict(int), []
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    for b in data:
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append((len(b), int(cover.sum()), int((cover[:-1] & ~np.concatenate(([False], cover[:-2]))).sum()) if b else 0, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=False) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeats(spark, rows, crowd):
    extra = [(500, "ab" * 700, "en", "a"), (501, "é" * 300, "en", "a")]
    data = rows + extra
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(docs(spark, data), 400, crowd).collect())
    assert got == sorted((r[0] or -1, *x) for r, x in zip(data, removed([r[1] for r in data], 400), strict=True))
    assert repeats.remove_repeats(docs(spark, data).limit(0)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob b", "yo"), (1, 70, "ann", None), (1, None, None, "?"), (2, 0, "system", "x"), (None, 1, "ann", "a"), (1, 2, "bob b", "yo")]
    out = chat.rotate(spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, speaker string")).collect()
    assert all(r["split_turn"] is None and r["bucket"] == r["chunk"] == -1 for r in out)
    by = {(r["conv_id"], r["speaker"], r["piece"]): r for r in out}
    assert set(by) == {(1, s, p) for s in ("ann", "bob b") for p in (-1, 0, 1)} | {(None, "ann", 0)}
    r = by[1, "ann", 0]
    assert r["rendered"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |end|><|end|>\n" + 2 * "<|user name=bob_b|>\nyo<|end|>\n"
    assert [r["rendered"][s["start"] : s["end"]] for s in r["mask"]] == ["hi < |end|><|end|>\n"]


def test_chat_of_many_turns_with_one_number(spark):
    """Turns without a number, with the same one, and copies of one turn: rows stay small and hold every turn once."""
    rng = random.Random(12)
    turns = [(None, t, rng.choice(["ann", "bob", None, "system"]), text(rng, 3)) for t in [None] * 300 + [7] * 200 + [8] * 5]
    turns += [(None, 9, "ann", "same")] * 150 + [(3, 9, "cy", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.rotate(frame, piece=8).collect()
    md5 = lambda role, said: hashlib.md5(f"{role or ''}|{int(role is None)}|{said}".encode()).hexdigest()
    for speaker in ("ann", "bob"):
        mine = sorted((r for r in out if r["conv_id"] is None and r["speaker"] == speaker), key=lambda r: (r["piece"], -1 if r["split_turn"] is None else r["split_turn"], r["bucket"], r["chunk"]))
        assert sum(r["n_turns"] for r in mine) == 655 and max(r["n_turns"] for r in mine) <= 64
        seen = [x for r in mine for x in r["rendered"].split("<|end|>\n")[:-1]]
        head = lambda role: "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role or 'unknown'}|>\n"  # noqa: B023, E731
        want = [head(r) + t for _, n, r, t in sorted(turns, key=lambda x: (-1 if x[1] is None else x[1], md5(x[2], x[3]))) if _ is None]
        assert sorted(seen) == sorted(want) and seen[:300] == want[:300]
        for r in mine:
            assert [r["rendered"][s["start"] : s["end"]] for s in r["mask"]] == [x + "<|end|>\n" for x in r["rendered"].replace("<|assistant|>\n", "\0").split("<|end|>\n") for x in [x.partition("\0")[2]] if x]
    assert chat.rotate(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_vectors(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    data = [(i, (centres[i % 12] + 0.12 * rng.standard_normal(16)).astype(float).tolist(), i % 2) for i in range(150)]
    data += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, data[0][1], None), (1005, [1e300] * 16, 1), (1006, [1.0] * 16, 1), (None, data[0][1], 0), data[7], (1007, data[0][1][:8], 0)]
    out = {r["vec_id"]: r for r in pivots.vector_components(spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<double>, label int, cell string"), pivots=40, shared=2, block=block).collect()}
    good = {d[0]: d for d in data if d[0] is not None and d[1] and d[2] is not None and all(x is not None and np.isfinite(x) for x in d[1]) and any(d[1])}
    unit = {k: pivots.unit(np.array([d[1]]))[0] for k, d in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][2] == good[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    found = sum(r["n_links"] for r in out.values()) / 2
    assert 0.9 * len(links) <= found <= len(links) and len(links) > 100
    assert len(out) == 159 and all(out[i]["n_links"] == 0 for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert pivots.vector_components(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors_at_the_usual_settings(spark, kind):
    """Many links, the pivots and shared pivots that the query uses, against brute force; ids of any type."""
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((150, 64))
    data = [(i if kind == "long" else f"v{i:04d}", (centres[i % 150] + 0.25 * rng.random() * rng.standard_normal(64)).tolist(), i % 3) for i in range(1200)]
    out = {r["vec_id"]: r for r in pivots.vector_components(spark.createDataFrame(data, f"vec_id {kind}, embedding array<double>, label int")).collect()}
    ids, unit = [d[0] for d in data], pivots.unit(np.array([d[1] for d in data]))
    near = (unit @ unit.T >= 0.93) & (np.array([d[2] for d in data])[:, None] == np.array([d[2] for d in data])) & ~np.eye(1200, dtype=bool)
    links = [(ids[a], ids[b]) for a, b in np.argwhere(np.triu(near))]
    assert len(links) > 1000 and all(out[i]["n_links"] <= n for i, n in zip(ids, near.sum(1), strict=True))
    assert sum(r["n_links"] for r in out.values()) >= 0.97 * 2 * len(links)
    want = components(ids, links)
    assert np.mean([out[i]["component_id"] == want[i] for i in ids]) > 0.97 and all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in out.values())


def test_copies_of_vectors(spark):
    """Thousands of copies beside near pairs: every copy counts, classes are linked once."""
    rng = np.random.default_rng(15)
    centres = rng.standard_normal((40, 32))
    near = [(c + 0.2 * rng.random() * rng.standard_normal(32)).tolist() for c in centres for _ in range(6)]
    data = [(i, v, i % 2) for i, v in enumerate(near)] + [(10_000 + i, near[i % 3], i % 2) for i in range(9000)] + [(20_000, near[0], None), (3, near[3], 1)]
    out = {r["vec_id"]: r for r in pivots.vector_components(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    rows = {(d[0], d[2], tuple(d[1])) for d in data if d[2] is not None}
    unit = pivots.unit(np.array([r[2] for r in sorted(rows)]))
    ids, label = np.array([r[0] for r in sorted(rows)]), np.array([r[1] for r in sorted(rows)])
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    want = links.sum(1)
    got = np.array([out[i]["n_links"] for i in ids.tolist()])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() and want.max() > 1400 and out[20_000]["n_links"] == 0
    root = ids.copy()
    while True:
        least = np.array([root[near_ | (np.arange(len(ids)) == i)].min() for i, near_ in enumerate(links)])
        if (least == root).all():
            break
        root = least
    assert np.mean([out[i]["component_id"] == r for i, r in zip(ids.tolist(), root.tolist(), strict=True)]) > 0.97
    assert len(out) == len({d[0] for d in data})


def test_index_size():
    assert [pivots.index_size(n) for n in (0, 1 << 16, (1 << 16) + 1, 1 << 18, 1 << 20, 1 << 60)] == [(256, 8), (256, 8), (512, 10), (512, 10), (1024, 12), (4096, 16)]


def test_aliases_of_random_links(spark):
    """Rules and components over random redirect and canonical graphs, judged by a plain search."""
    rng = random.Random(15)
    hosts = ["a.com", "b.org", "x.net", "example.net", "www.example.com", "c.de"]
    paths = ["/", "/en/1", "/de/2", "/fr/3", "/q"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    nodes = [f"{h}{p}?n={i % 7}" for i, (h, p) in enumerate((rng.choice(hosts), rng.choice(paths)) for _ in range(300))]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(130)]
    pages = [(i, f"{rng.choice(['http', 'https'])}://{n}#f", "".join(f"<link rel=canonical href='http://{b}'>" for a, b in links[:90] if a == n)) for i, n in enumerate(nodes)]
    redirects = spark.createDataFrame([(f"http://{a}", f"https://{b}") for a, b in links[90:]], "from_url string, to_url string")

    def ruled(node):
        host, _, rest = node.partition("/")
        path = "/" + rest.partition("?")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    of = components(sorted(set(nodes)), links)
    group = defaultdict(set)
    for n in set(nodes):
        if of[n] in {of[x] for x in [a for a, b in links if a != b]}:
            group[of[n]].add(ruled(n) and ruled(n)[1])
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, redirects).collect()}
    for i, n in enumerate(nodes):
        by = ruled(n)
        spread = "block" if "block" in group[of[n]] and "allow" not in group[of[n]] else "allow"
        assert out[i] == ((by[0], by[1]) if by else (None, spread)), n
    assert {"block", "allow"} == {v for r, v in out.values() if r is None}


def test_windows_by_definition(spark):
    """Windows, scores, overlaps and hits of whole documents recomputed unit by unit."""
    rng = random.Random(16)
    items = [(i, f"Which {text(rng, rng.randint(4, 20))}? {text(rng, rng.randint(1, 8))}" if i % 2 else text(rng, rng.randint(2, 30))) for i in range(15)] + [(90, text(rng, 400))]
    bench = decontaminate.questions(spark.createDataFrame(items, "item_id long, text string"))
    parts = [(r["item_id"], r["question"], r["answer"]) for r in bench.orderBy("item_id").collect()]
    index = decontaminate.Index(parts)

    def mangled(t, share):
        return " ".join(w if rng.random() > share else "zzz" for w in t.split())

    rows = [(i, f"{text(rng, rng.randint(0, 150))} {mangled(rng.choice(items)[1], rng.choice([0, 0, 0.02, 0.1]))} {text(rng, rng.randint(0, 300))}") for i in range(120)] + [(500, None), (501, "")]
    size = {u: sum(index.postings[t][1][k] for t in range(len(index.postings)) for k in range(len(index.postings[t][0])) if index.postings[t][0][k] == u) for u in range(len(index.units))}
    assert all(abs(x - 1) < 1e-9 for x in size.values())
    want = set()
    for doc, body in rows:
        words, half, held = decontaminate.words_of(body), index.window // 2, defaultdict(set)
        for at in range(0, max(1, len(words)), half):
            window = words[at : at + index.window]
            seen = {tuple(window[i : i + n]) for n in range(1, 6) for i in range(len(window) - n + 1)}
            for u, (item, of, told) in enumerate(index.units):
                score = sum(x for w in set(window) if w in index.term for v, x in zip(*index.postings[index.term[w]], strict=True) if v == u)
                whole, q, a = (len(p & seen) / len(p) if p else None for p in of)
                q, a = (whole if x is None else x for x in (q, a))
                if score >= 0.5 - 1e-9 and (min(q, a) >= 0.8 or whole >= 0.8 and (a >= 0.8 or not told)):
                    held[item].add(u)
        want |= {(doc, index.items[item]) for item, units in held.items() if len(units) == index.n_units[item]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want and len(want) > 40
    small = list(decontaminate.index_shards(bench, shard_items=4))
    assert len(small) == 4 and sum(len(s.items) for s in small) == 16


def test_decontamination(spark, rows):
    rng = random.Random(9)
    items = [(i, f"Which {text(rng, 20)}? {text(rng, 8)}") for i in range(12)] + [(50, text(rng, 600)), (51, None), (52, ""), (53, "one two")]
    planted = {700: 3, 701: 5, 702: 50}
    leaks = [(k, f"{text(rng, 40)} {dict(items)[i].upper() if k == 701 else dict(items)[i]} {text(rng, 200)}", "en", "a") for k, i in planted.items()]
    half = [(710, f"{text(rng, 40)} {' '.join(dict(items)[4].split()[:10])} {text(rng, 40)}", "en", "a")]
    bench = decontaminate.questions(spark.createDataFrame([(*i, "x") for i in items + items[:1]], "item_id long, text string, doc_id string"))
    df = docs(spark, rows + leaks + half)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()}
    assert got == set(planted.items())
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontaminate.matches(df, bench.limit(0)).count() == 0


def test_decontamination_without_blanks(spark):
    """Items in scripts that don't part words stand inside longer texts of theirs; half an item is no hit."""
    rng = random.Random(11)
    kana, thai = [chr(c) for c in [*range(0x3042, 0x3090), *range(0x4E00, 0x4F00)]], [chr(c) for c in range(0x0E01, 0x0E2F)] + ["\u0e34", "\u0e48"]
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    items = [(0, run(kana, 40)), (1, run(thai, 60)), (2, f"{run(kana, 30)}?{run(kana, 12)}"), (3, text(rng, 20)), (4, f"GPT4{run(kana, 20)}")]
    body = dict(items)
    rows = [(i, f"{run(kana if i != 1 else thai, 300)}{body[i]}{run(kana if i != 1 else thai, 80)}") for i in (0, 1, 2, 4)]
    rows += [(3, f"{run(thai, 50)} {body[3]} {run(kana, 50)}"), (10, run(kana, 500)), (11, run(thai, 500)), (12, run(kana, 100) + body[0][:20] + run(kana, 100)), (13, body[2].split("?")[0] + run(kana, 60))]
    bench = decontaminate.questions(spark.createDataFrame(items, "item_id long, text string"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()} == {(i, i) for i in range(5)}
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(frame, bench).collect()) == [10, 11, 12, 13]


def test_decontamination_beside_punctuation(spark):
    rng = random.Random(10)
    items = [(i, text(rng, 18)) for i in range(6)] + [(6, f"Which {text(rng, 14)}? {text(rng, 6)}"), (7, f"Which {text(rng, 12)}? {text(rng, 6)}")]
    body = dict(items)
    rows = [(i, f"{text(rng, 30)} ({body[i]}), {text(rng, 40)}") for i in range(7)]
    # one of the last words is another: 80 % of the item occurs, not of its last third
    rows += [(20, f"{text(rng, 30)} {' '.join(body[2].split()[:-2])} {text(rng, 40)}")]
    # a question without its answer is no hit, where the item tells them apart
    rows += [(21, f"{text(rng, 30)} {body[7].split('?')[0]}? {text(rng, 40)}")]
    bench = decontaminate.questions(spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i) for i in range(7)} | {(20, 2)}


def test_wand_finds_all_above():
    rng = random.Random(6)
    index = decontaminate.Index([(i, text(rng, 30), text(rng, 6)) for i in range(40)])
    for _ in range(60):
        terms = sorted({index.term[w] for w in text(rng, 60).split() if w in index.term})
        scores = np.zeros(len(index.units))
        for t in terms:
            units, impacts = index.postings[t]
            scores[units] += impacts
        for threshold in (0.05, 0.1, 0.2, 0.4):
            assert index.retrieve(list(terms), threshold) == np.flatnonzero(scores >= threshold - 1e-9).tolist()


def test_tokens(spark, rows, tmp_path):
    df = docs(spark, rows)
    out = tokens.training_order(df, length=64, per_shard=16).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    encode = tokens.Encoder(tokens.VOCABULARY, tokens.PATTERN)
    streams = defaultdict(list)
    for r in out:
        streams[r["doc_id"]].append(r)
    for doc in rows:
        if doc[0] in (5, None):
            continue
        parts = sorted(streams[doc[0]], key=lambda r: r["chunk"])
        ids = np.concatenate([np.frombuffer(r["tokens"], np.uint16)[: r["n_tokens"]] for r in parts]).tolist()
        assert ids == encode.encoding.encode_ordinary(doc[1] or "") + [tokens.END_TOKEN]
    # the same rows in other splits and another order have the same slots
    again = tokens.training_order(df.orderBy(F.rand(5)).repartition(7), length=64, per_shard=16).collect()
    place = lambda r: (r["slot"], r["shard"], r["byte_offset"], r["doc_id"], r["chunk"], bytes(r["tokens"]))
    assert sorted(map(place, again), key=lambda x: x[0]) == sorted(map(place, out), key=lambda x: x[0])
    # slots by the rule: documents by key, their sequences in order, each index through the permutation
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda d: md5(f"{str(d[0] is None).lower()}{'' if d[0] is None else d[0]}|{'' if d[1] is None else md5(d[1])}")
    listed = [(d[0], c) for d in sorted(rows, key=key) for c in range(-(-(len(encode.encoding.encode_ordinary(d[1] or "")) + 1) // 64))]
    assert {r["slot"]: (r["doc_id"], r["chunk"]) for r in out} == dict(zip(tokens.feistel(np.arange(len(listed)), len(listed), 2024).tolist(), listed, strict=True))
    assert all(r["shard"] == r["slot"] // 16 and r["byte_offset"] == r["slot"] % 16 * 129 for r in out)
    path = f"{tmp_path}/order"
    manifest = tokens.write_shards(tokens.training_order(df, length=64, per_shard=16), path, length=64, per_shard=16).collect()
    assert sorted((r["shard"], r["first_slot"]) for r in manifest) == [(s, 16 * s) for s in range(-(-len(out) // 16))] and sum(r["records"] for r in manifest) == len(out)
    again = {r["slot"]: bytes(r["tokens"]) for r in tokens.read_slots(spark, path, 10, 40).collect()}
    assert again == {r["slot"]: bytes(r["tokens"]) for r in out if 10 <= r["slot"] < 40}
    assert tokens.read_slots(spark, path, 10**6, 10**6 + 5).count() == 0
    assert tokens.training_order(df.limit(0)).count() == 0
    # written in waves, every record stands where the index says
    for name, waves in ((1, (1,)), (3, (5, 0.5, 2)), (100, (1,) * 100)):
        path = f"{tmp_path}/waves{name}"
        index = tokens.write_order(df, path, length=64, per_shard=16, waves=waves).collect()
        assert sorted((r["slot"], r["shard"], r["byte_offset"], r["doc_id"] or -1, r["chunk"], r["n_tokens"]) for r in index) == sorted((r["slot"], r["shard"], r["byte_offset"], r["doc_id"] or -1, r["chunk"], r["n_tokens"]) for r in out)
        held = {r["shard"]: (tmp_path / f"waves{name}" / "shards" / r["file"]).read_bytes() for r in spark.read.parquet(f"{path}/manifest").collect()}
        assert sum(map(len, held.values())) == 129 * len(out)
        want = {r["slot"]: bytes(r["tokens"]) for r in out}
        for r in index:
            record = held[r["shard"]][r["byte_offset"] : r["byte_offset"] + 129]
            assert record == want[r["slot"]] + b"\n" and hashlib.md5(record[:-1]).hexdigest() == r["tokens_md5"]
    assert tokens.write_order(df.limit(0), f"{tmp_path}/none").count() == 0


def test_shards_grow():
    """4 MB shards for small tables, 256 MB ones at most; no table in between has over four times SHARDS shards."""
    sizes = [(n, tokens.shard_size(n)) for n in (0, 1, 4096 * 4096, 4096 * 4096 + 1, 10**9, 2 * 10**11)]
    assert [s for _, s in sizes] == [4096, 4096, 4096, 16384, 262144, 262144]
    assert all(n / s <= tokens.SHARDS for n, s in sizes if s < tokens.MOST_PER_SHARD)


def test_tidy_shuffles(spark):
    """A finished write leaves no shuffle file; the setting is as before afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(1 for f in manager.getAllFiles().mkString(chr(10)).split(chr(10)) if "shuffle_" in f)
    had = shuffled()
    assert common.materialise(spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 700).alias("k")).count()).count() == 700
    assert shuffled() <= had + 2  # the count's own
    assert spark.conf.get(name, None) == before


def test_write_leaves_no_shuffle_file(spark):
    """Looked at before anything is read again: a count leaves three files of its own (data, index, checksum)."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in manager.getAllFiles().mkString(chr(10)).split(chr(10)) if "shuffle_" in f}
    rows = spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 700).alias("k")).count()
    had = shuffled()
    written = common.materialise(rows)
    assert shuffled() <= had and written.count() == 700


@pytest.mark.parametrize("case", ["a  b", " a", "a \nb", "\n\n a\t b", "it's  the 12 3", "é  ü x y", "", "   "])
def test_tokens_give_texts_back(case):
    encode = tokens.Encoder(tokens.VOCABULARY, tokens.PATTERN)
    assert encode.encoding.decode(np.frombuffer(encode.encode(case), np.uint16).tolist()) == case
    assert np.frombuffer(encode.encode(case), np.uint16).tolist() == encode.encoding.encode_ordinary(case)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_feistel(size):
    assert sorted(tokens.feistel(np.arange(size), size, 99)) == list(range(size))


def test_languages(spark):
    rng = random.Random(8)
    other = [w[::-1] + "ö" for w in WORDS]
    data = [(i, " ".join(rng.choice(WORDS if i % 2 else other) for _ in range(60)), "en" if i % 2 else "de", "a") for i in range(120)]
    out = {r["doc_id"]: r for r in langid.identify_languages(docs(spark, data + [(900, None, "en", "a"), (901, "12 !", "en", "a"), (902, "", None, "a")])).collect()}
    assert all(out[d[0]]["lang_pred"] == d[2] for d in data) and all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert {r["lang_pred"] for r in langid.predict(docs(spark, data), {}).collect()} == {"und"}


def test_languages_by_definition(spark, rows):
    """Profiles and distances recomputed character by character; ties, repeated rows, odd ids and an empty table."""
    from collections import Counter

    def grams(t):
        low = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        if not low.strip():
            return Counter()
        low = " " + " ".join(low.split()) + " "
        return Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1) if not (n == 1 and low[i] == " ") and not (n == 3 and low[i + 1] == " "))

    def code(g):
        c = [0 if x == " " else ord(x) for x in g]
        return c[0] if len(c) == 1 else (c[0] << 21 | c[1]) + (1 << 62) if len(c) == 2 else c[0] << 42 | c[1] << 21 | c[2]

    def ranks(counter, size=40):
        return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    odd = [(800, "Straße ÉÈ 12 straße", "de", "a"), (801, "a", "en", "a"), (None, "hallo welt", "de", "a"), (None, None, None, None)]
    data = rows + odd
    learn = [r for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 and r[1] is not None and r[2] is not None]
    profiles = {lang: ranks(sum((grams(r[1]) for r in learn if r[2] == lang), Counter())) for lang in ("de", "en")}
    want = []
    for r in data:
        own = ranks(grams(r[1]))
        far = {lang: sum(abs(p.index(g) - i) if g in p else 40 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want.append((-1 if r[0] is None else r[0], *((best, round(1 - far[best] / (40 * len(own)), 9)) if own else ("und", 0.0))))
    frame = docs(spark, data)
    got = langid.identify_languages(frame, size=40).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(want)
    assert langid.identify_languages(frame.limit(0)).count() == 0


def test_mix(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SLOTS", 3)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    df = docs(spark, rows)
    out = mixing.weighted_mix(df).collect()
    total = sum(r["size"] for r in out)
    sizes = {r["source"]: r["source_size"] for r in out}
    targets = {r["source"]: r["target"] for r in out}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and all(targets[s] <= 2 * sizes[s] for s in sizes)
    level = {s: targets[s] / w for s, w in zip(sorted(sizes, key=lambda s: (s is None, s)), (3, 1, 2, 3), strict=False)}
    free = [level[s] for s in sizes if targets[s] < 2 * sizes[s] - 1e-9]
    assert max(free) - min(free) < 1e-9 and all(level[s] <= free[0] + 1e-9 for s in sizes)
    queue, cut = [], 0
    for r in sorted(out, key=lambda r: (r["finish"] is None, r["finish"])):
        for c in range(2):
            if r["finish"] is not None:
                queue.append((r["finish"] + c * r["source_size"] / r["target"], r["size"]))
    for _, size in sorted(queue):
        cut += size
        if cut > 1.5 * total:
            cut -= size
            break
    assert abs(sum(r["size"] * r["copies"] for r in out) - cut) <= max(r["size"] for r in out if r["doc_id"] in (5, 105))
    assert mixing.mixed_documents(df).count() == sum(r["copies"] for r in {(x["doc_id"], x["text_md5"]): x for x in out}.values()) + sum(r["copies"] for r in out if r["doc_id"] == 5) * 2 // 3
    assert mixing.weighted_mix(df.limit(0)).count() == 0


def test_simhash(spark, rows):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = {r[0]: fingerprint(r[1]) for r in rows if r[0] is not None}
    want = components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    out = simhash.simhash_components(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out if r["doc_id"] is not None} == {k: (f"{v:016x}", want[k]) for k, v in prints.items()}
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {3}
    assert simhash.simhash_components(docs(spark, rows).limit(0)).count() == 0


def test_near_duplicates(spark, rows):
    df = docs(spark, rows)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.deduplicate(df.limit(0)).count() == 0


def test_near_duplicates_of_common_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    header, base = word(60), word(120)
    rows = [(i, " ".join(header + word(60))) for i in range(40)]
    for i in range(40, 80):
        near = base.copy()
        near[int(rng.integers(len(near)))] = f"edit{i}"
        rows.append((i, " ".join(header + near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    for common, block in [(256, 4096), (4, 4096), (4, 7), (4, 2)]:
        kept = neardup.near_duplicates(df, common=common, block=block).where("kept").collect()
        assert len(kept) == len(set(group)) == 41
        assert sorted(r["doc_id"] for r in kept) == list(range(41))


def near_pairs(rng, n, edits):
    """Texts of n words and copies with as many scattered edits, whose shingles are told by brute force."""
    out = []
    for many in edits:
        base = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        near = base.copy()
        for k in rng.choice(n, many, replace=False):
            near[k] = f"edit{k}"
        out += [" ".join(base), " ".join(near)]
    return out


def brute_kept(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts for w in [t.split()]]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return sorted(set(components(range(len(texts)), links).values())), len(links)


def kept_of(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in neardup.near_duplicates(df, **how).where("kept").collect())


def test_near_duplicates_of_long_texts(spark):
    texts = near_pairs(np.random.default_rng(11), 700, list(range(13, 21)) * 5)
    want, links = brute_kept(texts)
    assert 10 < links < 35 and kept_of(spark, texts) == want


def test_near_duplicates_of_contained_texts_of_a_common_passage(spark):
    rng = np.random.default_rng(12)
    header = " ".join(f"h{x}" for x in range(40))
    texts = []
    for _ in range(150):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 1210)]
        texts += [f"{header} {' '.join(base)}", f"{header} {' '.join(base[: int(rng.integers(955, 968))])}"]
    want, links = brute_kept(texts)
    assert 50 < links < 150 and kept_of(spark, texts, common=4, block=64) == want


def test_near_duplicates_of_repetitive_texts(spark):
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(40):
        body, line = ([f"w{x}" for x in rng.integers(0, 10**6, n)] for n in (200, 12))
        texts += [" ".join(body + line * 40), " ".join(body + line * 2)]
    want, links = brute_kept(texts)
    assert links == 40 and kept_of(spark, texts) == want
