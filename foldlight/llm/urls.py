"""Operator 2 (native): URL rules with block decisions carried over redirects and canonical links.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's;
the longest rule wins (equal length: the longer host, then the text that sorts last). Where no rule fits,
urls that redirect to each other or name each other as canonical form a component (distributed connected
components); it is blocked if a member is blocked by rule and no member is allowed by rule. Everything
else is allowed.

A url's node is its host, path and query; scheme and fragment don't tell pages apart. Edges come from
`<link rel=canonical>`, `<meta http-equiv=refresh>` and a table of redirects (from_url, to_url) if given. Tags are
read outside comments, scripts, styles, text areas and titles, over line ends, up to their first `>`; their attributes
one after the other in any order, quoted or not, so that neither another rel nor a word in another attribute makes
a link. Character references in addresses are decoded, relative addresses are taken from the page's (not from a
`<base>`), addresses of other schemes than `scheme://` are none.

Defined results: a url that is null or has no `://` has an empty host and path, no node and the verdict
allow. Null html has no links; html of any length is read whole. Repeated rows each get the same verdict. Empty tables give empty results.
Other columns are ignored. Rules are the caller's policy list: more than MAX_RULES raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hub_join, materialise

MAX_RULES = 1000
#: What a browser doesn't read as tags, up to its end or that of the page.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)"
TAG = r"(?i)<(?:link|meta)[\s/][^>]*>"
ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
#: The address in the content of a refresh: seconds, a separator, url=.
REFRESH = r"""(?is)^\s*[0-9.]+\s*[;,\s]\s*url\s*=\s*["']?\s*([^"'\s]+)"""
#: Named character references.
NAMED = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """Host, path and query; null without a host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (size, host_size, rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    tried = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    none = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*tried)) if tried else none


def attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of that name (any case), without its quotes; null if there is none."""
    mine = F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(mine, F.lit(0)), r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def decoded(value: Column) -> Column:
    """Character references for the five marks of html, and decimal and hexadecimal ones up to U+FFFF, as characters."""
    names = F.create_map(*(F.lit(x) for pair in NAMED for x in pair))
    pattern = r"^(#[xX][0-9a-fA-F]{1,4}|#[0-9]{1,5}|amp|lt|gt|quot|apos);"

    def piece(part: Column, i: Column) -> Column:
        found = F.regexp_extract(part, pattern, 1)
        number = F.when(found.rlike("^#[xX]"), F.conv(F.substring(found, 3, 9), 16, 10)).when(found.startswith("#"), F.substring(found, 2, 9)).cast("int")
        char = F.when(number.between(1, 0xFFFF), F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")).otherwise(F.try_element_at(names, found))
        return F.when(i == 0, part).when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.regexp_replace(part, "^[^;]*;", "")))

    return F.array_join(F.transform(F.split(value, "&"), piece), "")


def without_dots(path: Column) -> Column:
    """A path whose `.` and `..` steps are taken."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.array_append(done, s)))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def absolute_url(target: Column, source: Column) -> Column:
    """The target as seen from the source; null where it isn't a page's address."""
    path, query = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    base = F.concat(F.lit("http://"), url_host(source))
    own = F.when(url_path(source) == "", "/").otherwise(url_path(source))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target)).when(F.startswith(path, F.lit("/")), F.concat(base, without_dots(path), query))
        .when(path == "", F.when(F.startswith(query, F.lit("?")), F.concat(base, own, query)))
        .otherwise(F.concat(base, without_dots(F.concat(F.regexp_replace(own, r"[^/]*$", ""), path)), query)))


def html_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of canonical links and refresh redirects in the html."""
    shown = F.regexp_replace("html", UNSEEN, " ")
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(F.col("url").alias("from_url"), F.explode(F.regexp_extract_all(shown, F.lit(TAG), F.lit(0))).alias("tag"))
    attributes = F.regexp_extract_all(F.regexp_replace("tag", r"^<[A-Za-z]+", ""), F.lit(ATTRIBUTE), F.lit(0))
    tags = found.select("from_url", F.lower(F.substring("tag", 2, 4)).alias("kind"), attributes.alias("a"))
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower(attribute(F.col("a"), "rel")), r"\s+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.lower(F.trim(attribute(F.col("a"), "http-equiv"))) == "refresh")
    target = F.when(canonical, decoded(attribute(F.col("a"), "href"))).when(refresh, F.regexp_extract(decoded(attribute(F.col("a"), "content")), REFRESH, 1))
    target = F.regexp_replace(target, r"^\s+|\s+$", "")
    return tags.withColumn("target", target).where(F.col("target") != "").select("from_url", absolute_url(F.col("target"), F.col("from_url")).alias("to_url")).where(F.col("to_url").isNotNull())


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every page."""
    links = html_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    edges = links.select(url_node(F.col("from_url")).alias("a"), url_node(F.col("to_url")).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    members = materialise(connected_components(edges))
    ruled = F.concat(F.lit("http://"), F.col("node"))
    decided = members.withColumn("by", fitting_rule(url_host(ruled), url_path(ruled), rules)["verdict"])
    barred = decided.groupBy("component").agg(F.count_if(F.col("by") == "block").alias("blocks"), F.count_if(F.col("by") == "allow").alias("allows")).where((F.col("blocks") > 0) & (F.col("allows") == 0))
    aliases = hub_join(members, barred.select("component"), "component", "left_semi").select("node", F.lit(True).alias("barred"))
    judged = (
        pages.select("page_id", "url").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "node": url_node(F.col("url"))})
        .withColumn("by", fitting_rule(F.col("host"), F.col("path"), rules))
    )
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("barred"), "block").otherwise("allow"))
    return judged.join(aliases, "node", "left").select("page_id", "url", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"))
