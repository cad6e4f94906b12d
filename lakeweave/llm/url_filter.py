"""Operator 3, URL filters: rules by host and path, spread over redirect equivalence, in DataFrame operations only.

A page's own rule decides. A page without a rule is an alias of every page in its component over redirects (meta
refresh), canonical links and equal normalised URLs; it is blocked if any of these is blocked by a rule, else allowed.
Precedence of allow: an explicit allow rule of the page's own URL always goes before its aliases' blocks. An allow rule
of an alias does not: a block must reach every address that leads to the blocked page, or one allowed redirector in its
component would clear it.

All canonical and refresh tags of a page count, with attributes in any order and quoting. Links are resolved as RFC 3986
says (scheme, host, path, query, dot segments), relative to the page's URL; a base tag is not looked at. Schemes without
'://' and links to a place within the page make no edge. http and https are one.

Defined results: a url that is null or has no '://' has an empty host and path, no rule and no aliases, so it is
allowed; null html has no links; repeated pages are judged alike; of rules of equal length allow goes first (ties); an
empty table gives an empty result; other columns, whatever their names, are ignored; urls and html of any length are
taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import keep

# Verdict, host and path prefix of the production rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<{}\b[^>]*>"
_VALUE = r"""(?is)[\s"'/]{}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Entities that links are written with, and what they stand for.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _plain_path(path: Column) -> Column:
    """A path without dot segments and closing slash."""

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, part))

    parts = F.split(path, "/", -1)
    first = F.slice(parts, 1, 1)
    return F.regexp_replace(F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), first, step), "/"), "/+$", "")


def alias_key(url: Column) -> Column:
    """A URL without scheme, fragment, dot segments, closing slash and tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    host = host_of(url)
    return F.when(host != "", F.concat(host, _plain_path(path_of(url)), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, without quotes and entities; empty if it isn't there."""
    value = F.regexp_replace(F.regexp_extract(tag, _VALUE.format(name), 1), r"""^["']|["']$""", "")
    for entity, plain in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(plain))
    return F.trim(value)


def _links(html: Column) -> Column:
    """The links of all canonical and refresh tags."""
    canonical = F.filter(F.regexp_extract_all(html, F.lit(_TAG.format("link")), F.lit(0)), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(_TAG.format("meta")), F.lit(0)), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    to = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*["']?([^"'\s]+)""", 1))
    return F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), to)


def _target(link: Column, host: Column, path: Column) -> Column:
    """A link's absolute URL, or null."""
    here = F.concat(F.lit("http://"), host)
    return (
        F.when((link == "") | link.startswith("#") | (host == ""), F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(here, link))
        .when(link.startswith("?"), F.concat(here, path, link))
        .otherwise(F.concat(here, F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), link))
    )


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; of equal lengths allow goes first."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return name, verdict


def url_filter(pages: DataFrame, rules=RULES, key: str = "page_id") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, via): via says whether rule, alias or default decided."""
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    d = pages.select(F.col(key).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("at"), url.alias("u"), F.when(html.rlike("(?i)canonical|refresh"), html).alias("links"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    to = F.array_distinct(F.array_compact(F.transform(_links(F.col("links")), lambda x: alias_key(_target(x, F.col("host"), F.col("path"))))))
    judged = keep(d.select("page_id", "host", "path", "at", rule.alias("rule"), verdict.alias("own"), F.when(F.col("links").isNotNull(), to).alias("to")), "url-judged")
    edges = judged.where("at is not null and size(to) > 0").select(F.col("at").alias("a"), F.explode("to").alias("b"))
    roots = components(edges, "url-aliases")

    rooted = judged.join(roots, judged["at"] == roots["node"], "left").withColumn("root", F.coalesce("root", "at"))
    blocked = rooted.where("own = 'block' and root is not null").groupBy("root").agg(F.lit(True).alias("hit"))
    free = rooted.where("own is null").join(blocked, "root", "left")
    spread = free.select("page_id", "host", "path", "rule", F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"), F.when(F.col("hit"), "alias").otherwise("default").alias("via"))
    return judged.where("own is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict"), F.lit("rule").alias("via")).unionAll(spread)
