"""URL filters with redirect equivalence.

A rule names a host and a path prefix, fits that host and its subdomains, and the longest
that fits a url decides it. Urls that redirect to one another, or name one another as
canonical, are aliases: connected components over those edges carry block decisions from
ruled urls to aliases without a rule. An explicit allow goes first: a url's own rule is never
overridden, and a component that holds an explicitly allowed url passes no block on.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule,
has no aliases and is allowed; targets are resolved against the page's url; of rules that are
equally long the first by name decides; repeated rows each get the verdict; a very long url is
compared whole; other columns are not looked at and may have the names of the result's; an empty
table gives an empty result; null html or one without links gives no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm._common import cut
from weirflow.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the production query: fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = None
    for h, p, verdict in longest:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def node_of(url: Column) -> Column:
    """A url as an alias node: scheme and host in lower case, no fragment; null without a host."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(host_of(url) != "", F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.length(bare))))


def unescaped(value: Column) -> Column:
    """An attribute's value without the character references that a url can hold, one level of them."""
    code = lambda m: F.when(
        m.rlike(r"(?i)^&#x"), F.conv(F.regexp_extract(m, r"(?i)^&#x([0-9a-f]+)", 1), 16, 10)
    ).otherwise(F.regexp_extract(m, r"^&#([0-9]+)", 1)).cast("int")
    named = lambda m: F.regexp_replace(F.lower(m), ";", "")
    one = lambda m: (
        F.when(named(m) == "&amp", "&").when(named(m) == "&lt", "<").when(named(m) == "&gt", ">")
        .when(named(m) == "&quot", '"').when(named(m) == "&apos", "'")
        .when(code(m).between(1, 127), F.chr(code(m)))
        # chr() ends at 255, so other characters are built from their UTF-16 units
        .when(code(m).between(128, 65535) & ~code(m).between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code(m)), 4, "0")), "UTF-16BE"))
        .when(code(m).between(65536, 0x10FFFF), F.decode(F.unhex(F.concat(
            F.hex(0xD800 + F.floor((code(m) - 65536) / 1024)), F.hex(0xDC00 + F.pmod(code(m) - 65536, F.lit(1024))))), "UTF-16BE"))
        .otherwise(m)
    )
    reference = r"(?i)&(?:amp|lt|gt|quot|apos);|&(?:amp|lt|gt|quot)(?![a-z0-9=])|&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});"
    found, parts = F.regexp_extract_all(value, F.lit(reference), 0), F.split(value, reference, -1)
    decoded = F.array_join(F.zip_with(parts, F.transform(found, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(value.contains("&"), decoded).otherwise(value)


def _without_dots(path: Column) -> Column:
    """A path from '/' on without '.' and '..' segments."""
    none = F.array().cast("array<string>")
    segments = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    kept = F.aggregate(
        segments, none,
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    # a path that ends in a dot segment names a directory
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link on the page ``base`` as an absolute url, as RFC 3986 resolves it."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    rest = F.substring(link, F.length(own) + 1, F.length(link))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(own), rest))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#") | (link == ""), F.concat(origin, path, query, link))
        .otherwise(F.concat(origin, _without_dots(F.concat(F.regexp_extract(rooted, r"(?s)^(.*/)", 1), own)), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) that pages name themselves: canonical links and refresh redirects."""
    html = F.when(F.col("html").rlike(r"(?i)canonical|http-equiv"), F.col("html"))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    href = lambda tag, name: F.coalesce(
        F.nullif(F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)", 1), F.lit("")),
    )
    target = lambda tag: F.when(
        F.lower(href(tag, "rel")) == "canonical", href(tag, "href")
    ).when(
        F.lower(href(tag, "http-equiv")) == "refresh",
        F.regexp_extract(href(tag, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1),
    )
    return (
        pages.select(F.col("url").alias("u"), F.explode(F.transform(tags, target)).alias("v"))
        .withColumn("v", F.btrim(unescaped(F.col("v")), F.lit(" \t\n\x0c\r")))
        .where("v IS NOT NULL AND v <> ''")
        .select(
            node_of(F.col("u")).alias("a"),
            node_of(resolved(F.col("u"), F.col("v"))).alias("b"),
        )
    )


def alias_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node, verdict) of every url that has an alias, by its component."""
    known = components(edges)
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    by_label = cut(
        known.select("label", own.alias("own"))
        .groupBy("label")
        .agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
        .where("blocked AND NOT coalesce(allowed, false)")
        .select("label", F.lit("block").alias("verdict"))
    )
    return cut(known.join(by_label, "label").select("node", "verdict"))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    ``redirects`` (src, dst) adds edges from a crawl log to those in the pages.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    edges = cut(edges.where("a <> b").distinct())
    url = F.col("url")
    judged = pages.select(
        F.col("page_id").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        aliased = judged.withColumn("passed_on", F.lit(None).cast("string"))
    else:
        verdicts = alias_verdicts(edges, rules).select(F.col("node").alias("n"), F.col("verdict").alias("passed_on"))
        aliased = judged.withColumn("n", node_of(F.col("url"))).join(verdicts, "n", "left")
    return aliased.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", "passed_on", F.lit("allow")).alias("verdict"),
    )


def chained(pages: DataFrame, length: int = 5) -> DataFrame:
    """(src, dst): redirects that chain the distinct urls of every ``length`` neighbouring page ids."""
    node = node_of(F.col("url"))
    least = pages.where(node.isNotNull()).groupBy(node.alias("src")).agg(F.min("page_id").alias("i"))
    order = Window.partitionBy(F.floor(F.col("i") / length)).orderBy("i", "src")
    return least.select("src", F.lag("src").over(order).alias("dst")).where("dst IS NOT NULL")


#: op10 as SQL, for pages that name no alias.
ORACLE = r"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

#: The same with the redirects of ``chained``, for pages that name no alias: a chain is a component.
ORACLE_CHAINED = ORACLE.rpartition("SELECT page_id, host, path, rule")[0].rstrip() + r"""
, own AS (
  SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict,
    CASE WHEN host <> '' THEN regexp_extract(translate(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^(.*?://[^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s).*') ||
      regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1) END AS node
  FROM r
), chain AS (SELECT node, min(page_id) // 5 AS label FROM own WHERE node IS NOT NULL GROUP BY node),
passed AS (
  SELECT label, bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false) AS blocked FROM own JOIN chain USING (node) GROUP BY label
)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM own LEFT JOIN chain USING (node) LEFT JOIN passed USING (label)
"""
