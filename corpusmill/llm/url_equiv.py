"""URL filtering with redirect equivalence, in DataFrame functions only.

Rules (host suffix and path prefix) judge a url; the longest fitting rule wins. Pages without a rule of their own
take part in an equivalence relation: redirects (meta refresh, or a given table) and canonical links join urls,
distributed connected components find the aliases, and a block on any member blocks the members without a rule.
An explicit allow always stands.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_sized

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no tags of the page: comments, scripts and the like.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|title|xmp)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
#: The attributes of a tag; > may stand in quotes.
TAG = r"(?is)<{}\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
#: The value of an attribute, quoted or not; what stands in other quotes is passed over.
VALUE = r"(?is)^(?:[^\"']*?(?:\"[^\"]*+\"|'[^']*+'))*?[^\"']*?(?<=[\s\"'/]){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*))"
#: A refresh's content: seconds, then the url, quoted or not.
REFRESH = r"(?is)^(?:[^;,]*?[;,\s]\s*)?url\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'].*))"
#: Named character references of one character below 256, with their semicolon.
NAMED = {k: v for k, v in sorted(html5.items()) if k.endswith(";") and len(v) == 1 and ord(v) < 256}


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for a null url or one without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as written (net/) and its verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is tested first
        fits = _fits(host, path, rule)
        text, verdict = F.when(fits, F.lit(rule[0] + rule[1])).otherwise(text), F.when(fits, F.lit(rule[2])).otherwise(verdict)
    return text, verdict


def node_of(url: Column) -> Column:
    """A url's node: without fragment, host lower-cased."""
    bare = F.substring_index(url, "#", 1)
    return F.concat(F.regexp_extract(bare, r"(?s)^(.*?://)", 1), host_of(bare), F.regexp_replace(bare, r"(?s)^.*?://[^/?#]*", ""))


def groups(text: Column, pattern: str, n: int = 3) -> Column:
    """The one of the first n groups that took part, trimmed; empty without a match."""
    return F.regexp_replace(F.concat(*[F.regexp_extract(text, pattern, k + 1) for k in range(n)]), r"^\s+|\s+$", "")


def bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def attribute(tag: Column, name: str) -> Column:
    return bound(groups(tag, VALUE.format(name)), decoded)


def decoded(text: Column) -> Column:
    """text with its character references resolved: numbers, and names of NAMED."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(x):
        name, digits, hexes = (F.regexp_extract(x, p, 1) for p in ("^([A-Za-z][A-Za-z0-9]*;)", "^#([0-9]{1,7})(?![0-9])", "^#[xX]([0-9a-fA-F]{1,6})(?![0-9a-fA-F])"))
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        char = bound(code, lambda c: F.when((c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))
        known = F.concat(F.try_element_at(named, name), F.regexp_replace(x, "^[A-Za-z0-9]+;", ""))
        return F.coalesce(F.concat(char, F.regexp_replace(x, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")), known, F.concat(F.lit("&"), x))

    parts = F.split(text, "&")
    return F.when(text.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path from / on with . and .. resolved."""
    parts = F.split(path, "/")
    whole = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    ends = F.element_at(parts, -1).isin(".", "..")
    return bound(whole, lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise("")))


def resolve(base: Column, link: Column) -> Column:
    """A link on a page of the url base as an absolute url; null for a scheme other than http and https, and for a relative link where base has no host."""
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    own, root = path_of(base), F.concat(scheme, F.lit("//"), host)
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, r"(?s)^(.*/)", 1))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    absolute = F.when(link.rlike(r"(?i)^https?://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
    relative = (
        F.when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, bound(path, without_dots), rest))
        .when(link.startswith("?"), F.concat(root, own, rest))
        .when((link == "") | link.startswith("#"), F.concat(root, own, query, rest))
        .otherwise(F.concat(root, bound(F.concat(folder, path), without_dots), rest))
    )
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), absolute).when((scheme != "") & (host != ""), relative)


def link_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst) nodes of canonical links and refresh redirects of pages (url, html), outside comments and scripts, and of redirects (src_url, dst_url) if given. Relative links are resolved against the page's url, or its base element's."""
    found = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    found = found.withColumn("html", F.regexp_replace("html", UNREAD, ""))
    link, meta, bases = (F.regexp_extract_all("html", F.lit(TAG.format(name)), F.lit(1)) for name in ("link", "meta", "base"))

    def first(tags, take):
        return F.get(F.filter(F.transform(tags, take), lambda x: x != ""), F.lit(0))

    canonical = first(link, lambda t: F.when(F.lower(attribute(t, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)"), attribute(t, "href")))
    refresh = first(meta, lambda t: F.when(F.lower(attribute(t, "http-equiv")) == "refresh", bound(attribute(t, "content"), lambda c: groups(c, REFRESH))))
    base = first(bases, lambda t: attribute(t, "href"))
    links = found.select("url", bound(base, lambda b: F.coalesce(resolve(F.col("url"), b), F.col("url"))).alias("base"), F.explode(F.array_compact(F.array(canonical, refresh))).alias("link"))
    edges = links.select(node_of(F.col("url")).alias("src"), bound(resolve(F.col("base"), F.col("link")), node_of).alias("dst"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst")))
    return edges.where("src is not null and dst is not null and src != dst").distinct()


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """Nodes in a component that a rule blocks at some node."""
    members = connected_components(edges)
    verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    blocked = members.where(verdict == "block").select("component").distinct()
    return members.join(blocked, "component", "left_semi").select("node").distinct()


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    A null url or html, and a url without ://, have no rule and no alias: allowed. Repeated rows give a row each;
    an empty table an empty result. Other columns are ignored. The page table itself is only shuffled when the
    blocked aliases are too many to broadcast.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    blocked = blocked_aliases(link_edges(pages, redirects), rules)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("rule", rule).withColumn("own", verdict)
    judged = join_sized(judged, blocked.withColumn("alias_blocked", F.lit(True)), "node", "left", 400)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"))
