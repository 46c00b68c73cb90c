"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontaminate, langid, mixing, pivots, quality, repeats, resample, simhash, tokens, topk, urls
from .common import scratch_path

#: Policy of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_suffix_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return out.withColumn("mask", mask)


def op5_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.vector_components(table(spark, sf_dir, "embeddings"))


def op6_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), decontaminate.questions(table(spark, sf_dir, "benchmark")))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_order(table(spark, sf_dir, "documents"), scratch_path(spark))


def op8_language_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.weighted_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_exhaustive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_mil, op2_url_aliases, op3_suffix_two_stage, op4_chat_rotation, op5_pivot_permutation, op6_bm25_wand, op7_training_order, op8_language_rank, op9_fair_mix, op10_simhash_bktree, op11_exhaustive_topk, op12_importance_resampling, op13_filter_audit)}

ORACLE: dict[str, str] = {}

ORACLE["op2_url_aliases"] = r"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
shown AS (SELECT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)', ' ', 'g') AS html FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[\s/][^>]*>')) AS tag FROM shown),
attrs AS (SELECT url, lower(tag[2:5]) AS kind, row_number() OVER () AS n, list_transform(regexp_extract_all(regexp_replace(tag, '^<[A-Za-z]+', ''), '[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?'), lambda a: {'k': lower(regexp_extract(a, '^[^\s=]+')), 'v': regexp_replace(regexp_extract(a, '(?s)^[^\s=]+\s*=\s*(.*)$', 1), '^["'']|["'']$', '', 'g')}) AS a FROM tags),
vals AS (SELECT url, kind, list_filter(a, lambda x: x.k = 'rel')[1].v AS rel, list_filter(a, lambda x: x.k = 'href')[1].v AS href, list_filter(a, lambda x: x.k = 'http-equiv')[1].v AS equiv, list_filter(a, lambda x: x.k = 'content')[1].v AS content FROM attrs),
links AS (SELECT * FROM (SELECT url AS a, trim(CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN replace(href, '&amp;', '&') WHEN kind = 'meta' AND lower(trim(equiv)) = 'refresh' THEN regexp_extract(replace(content, '&amp;', '&'), '(?is)^\s*[0-9.]+\s*[;,\s]\s*url\s*=\s*["'']?\s*([^"''\s]+)', 1) END) AS b FROM vals) WHERE b LIKE '%://%'),
named AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
nodes AS (SELECT DISTINCT url FROM named UNION SELECT b FROM links),
judged AS (
  SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM nodes, rules
  WHERE (translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = h
      OR ends_with(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.' || h))
    AND starts_with(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), p)
  GROUP BY url),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.b OR l.b = r.b),
spread AS (SELECT r.a AS url, count(*) FILTER (WHERE j.v = 'block') AS blocks, count(*) FILTER (WHERE j.v = 'allow') AS allows FROM reach r JOIN judged j ON j.url = r.b GROUP BY 1)
SELECT n.page_id, n.url, n.host, n.path, j.rule, coalesce(j.v, CASE WHEN s.blocks > 0 AND s.allows = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN judged j ON j.url = n.url LEFT JOIN spread s ON s.url = n.url
"""

ORACLE["op4_chat_rotation"] = r"""
WITH r AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS said, coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS piece FROM conversations),
h AS (SELECT *, md5(coalesce(role, '') || '|' || CAST(role IS NULL AS INTEGER) || '|' || said) AS h FROM r),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS rows, row_number() OVER (PARTITION BY conv_id, turn, h) - 1 AS copy FROM h),
t AS (
  SELECT *, CASE WHEN rows > 64 THEN turn END AS split_turn, CASE WHEN rows > 64 THEN CAST(floor(CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * ceil(rows / 64)) AS BIGINT) ELSE -1 END AS bucket,
         CASE WHEN rows > 64 THEN copy // 64 ELSE -1 END AS chunk FROM c),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT t.conv_id, s.speaker, t.piece, t.split_turn, t.bucket, t.chunk, t.turn, t.h, t.copy,
         CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(coalesce(t.role, 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g') || '|>' || chr(10) END AS head,
         t.said || '<|end|>' || chr(10) AS body, coalesce(t.role = s.speaker, false) AS own
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
e AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, piece, split_turn, bucket, chunk ORDER BY turn NULLS FIRST, h, copy ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT conv_id, speaker, piece, CAST(split_turn AS BIGINT) AS split_turn, bucket, chunk, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, h, copy) AS rendered,
       coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ',' ORDER BY upto) FILTER (WHERE own), '') AS mask
FROM e GROUP BY conv_id, speaker, piece, split_turn, bucket, chunk
"""

ORACLE["op5_pivot_permutation"] = r"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, d.vec_id) AS component_id, coalesce(coalesce(c.c, d.vec_id) = d.vec_id, false) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) d LEFT JOIN n ON n.a = d.vec_id LEFT JOIN c ON c.a = d.vec_id
"""

ORACLE["op9_fair_mix"] = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS missing, coalesce(source, '') AS name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('13|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS key FROM documents),
s AS (SELECT missing, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY missing, name) - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM s),
l AS (SELECT *, cap / weight AS lev FROM w),
a AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY lev, missing, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY lev, missing, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pos FROM l),
b AS (SELECT *, (SELECT arg_min(pos, lev) FROM a WHERE lev >= pos) AS line FROM a),
g AS (SELECT missing, name, source_size, least(cap::DOUBLE, coalesce(line * weight, cap)) AS target FROM b),
q AS (SELECT d.*, g.source_size, g.target, sum(d.size) OVER (PARTITION BY missing, name ORDER BY key) AS done FROM d JOIN g USING (missing, name)),
e AS (SELECT q.*, c.copy FROM q, (VALUES (0), (1)) c(copy) WHERE target > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY (done + source_size * copy) / target, missing, name, key) AS upto FROM e),
k AS (SELECT key, count(DISTINCT copy) AS n FROM f WHERE upto <= (SELECT sum(size) * 1.5 FROM d) GROUP BY key)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, round(q.target, 6) AS target, CAST(q.size * coalesce(k.n, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (key)
"""

ORACLE["op11_exhaustive_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, row_number() OVER () AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE["op12_importance_resampling"] = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT 'd' AS side, row_number() OVER () AS n, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
p AS (SELECT side, n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
byte AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM p)),
q AS (SELECT p.side, p.n, p.i, b AS b1, list_prepend(32, lead(b, 1) OVER s) AS b2, list_prepend(32, lead(b, 2) OVER s) AS b3, lead(b, 1) OVER s IS NOT NULL AS two, lead(b, 2) OVER s IS NOT NULL AS three
      FROM p JOIN byte USING (w) WINDOW s AS (PARTITION BY p.side, p.n ORDER BY p.i)),
c1 AS (SELECT q.*, list_reduce(b1, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295) AS c1 FROM q, crc),
c2 AS (SELECT c1.*, list_reduce(b2, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), c1) AS c2 FROM c1, crc WHERE two),
c3 AS (SELECT c2.*, list_reduce(b3, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), c2) AS c3 FROM c2, crc WHERE three),
f AS (SELECT side, n, xor(c, 4294967295) % 10000 AS bucket FROM (SELECT side, n, c1 AS c FROM c1 UNION ALL SELECT side, n, c2 FROM c2 UNION ALL SELECT side, n, c3 FROM c3)),
k AS (SELECT count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f),
g AS (SELECT bucket, floor(1000 * ln(((count(*) FILTER (WHERE side = 'b') + 1)::DOUBLE * (k.s + 10000)::DOUBLE) / ((count(*) FILTER (WHERE side = 'd') + 1)::DOUBLE * (k.t + 10000)::DOUBLE)))::BIGINT AS gain FROM f, k GROUP BY bucket, k.s, k.t),
e AS (SELECT n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY n),
o AS (SELECT w.n, w.doc_id, len(w.w) AS n_words, coalesce(e.n_features, 0) AS n_features, coalesce(e.weight, 0) AS weight FROM w LEFT JOIN e USING (n) WHERE w.side = 'd'),
h AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, n_words) AS rank FROM h WHERE n_words >= 20),
cut AS (SELECT 5 * count(*) // 100 AS m FROM r)
SELECT h.doc_id, h.n_features, h.weight, h.score, CASE WHEN r.rank <= cut.m THEN r.rank END AS rank FROM h CROSS JOIN cut LEFT JOIN r ON r.n = h.n
"""

ORACLE["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < w.doc_id, false)} AS x
  FROM w LEFT JOIN l USING (doc_id)),
u AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fails FROM f),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM u GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ks, i AS step, ks[i] AS k, ks[:i - 1] AS earlier FROM o, range(1, 6) r(i)),
t AS (
  SELECT c.part, array_to_string(s.ks, '') AS filter_order, CAST(s.step AS INTEGER) AS step, s.k,
         sum(CASE WHEN NOT list_has_any(c.fails, s.earlier) AND NOT list_contains(c.fails, s.k) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT list_has_any(c.fails, s.earlier) AND list_contains(c.fails, s.k) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_has_any(c.fails, s.earlier) AND list_contains(c.fails, s.k) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.fails = [s.k] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT list_has_any(c.fails, s.earlier) AND list_contains(c.fails, s.k) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT list_has_any(c.fails, s.earlier) AND list_contains(c.fails, s.k) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY c.part, s.ks, s.step, s.k)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM t
"""
