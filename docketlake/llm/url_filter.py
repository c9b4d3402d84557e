"""URL block and allow lists that hold for all aliases of a page.

Redirects and canonical links are edges between normalised URLs. Distributed connected components find the URLs that
are one page; a block of any of them blocks them all, unless the URL itself is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.components import connected_components

BLOCK_NAMES = ("spam-farm", "cheap-pills", "free-bets", "casino-win")
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def normalised(urls: DataFrame, source: str, target: str) -> DataFrame:
    """``urls`` with a column of its URLs in one form: lower-case scheme and host, http as https, no ``www.`` or ``m.``, no
    default port, fragment, dot segment, tracking parameter, index page or closing slash. What isn't http is null.

    Each step is a column of its own, so that none is worked out twice.
    """
    df = urls.withColumn("__u", F.regexp_replace(F.trim(F.col(source).cast("string")), "#.*$", ""))
    df = df.withColumn("__host", F.lower(F.regexp_extract("__u", r"^(?i)https?://([^/?]*)", 1))).withColumn("__rest", F.regexp_extract("__u", r"^(?i)https?://[^/?]*(.*)$", 1))
    df = df.withColumn("__host", F.regexp_replace(F.regexp_replace("__host", r":(80|443)$", ""), r"^(www|m)\.", ""))
    df = df.withColumn("__path", F.regexp_extract("__rest", r"^([^?]*)", 1)).withColumn("__query", F.regexp_replace(F.regexp_extract("__rest", r"\?(.*)$", 1), rf"(^|&){TRACKING}=[^&]*", ""))
    df = df.withColumn("__path", F.when(F.col("__path").rlike(r"/\.{1,2}(/|$)"), _without_dots(F.col("__path"))).otherwise(F.col("__path")))
    df = df.withColumn("__path", F.regexp_replace(F.regexp_replace("__path", r"/index\.(html?|php)$", ""), r"/+$", "")).withColumn("__query", F.regexp_replace("__query", "^&+", ""))
    whole = F.concat(F.lit("https://"), F.col("__host"), F.col("__path"), F.when(F.col("__query") != "", F.concat(F.lit("?"), F.col("__query"))).otherwise(""))
    return df.withColumn(target, F.when(F.col("__host") != "", whole)).drop("__u", "__host", "__rest", "__path", "__query")


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, each of the latter taking the segment before it away."""
    step = lambda held, x: (
        F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x)))
    )
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


ENTITIES = {"&": "amp|#38|#x26", "/": "sol|#47|#x2f", "?": "quest|#63|#x3f", "=": "equals|#61|#x3d", ":": "colon|#58|#x3a", "#": "num|#35|#x23", "'": "apos|#39|#x27", '"': "quot|#34|#x22"}
UNSEEN = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>"


def _decoded(link: Column) -> Column:
    """A link with the character references that occur in URLs resolved; that of the ampersand last, once."""
    for mark, names in reversed(ENTITIES.items()):
        link = F.regexp_replace(link, f"(?i)&(?:{names});", mark)
    return link


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^https://([^/?]*)", 1)


def resolved(links: DataFrame, base: str, link: str, target: str) -> DataFrame:
    """``links`` with a column of its links as absolute URLs: absolute, //host, /path, ?query, or relative to the base's folder."""
    df = links.withColumn("__root", F.regexp_extract(base, r"^(?i)(https?://[^/?#]*)", 1)).withColumn("__folder", F.regexp_extract(base, r"^(?i)(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1))
    to = F.col(link)
    whole = (
        F.when(to.rlike(r"^(?i)https?://"), to)
        .when(to.startswith("//"), F.concat(F.lit("https:"), to))
        .when(to.startswith("/"), F.concat("__root", to))
        .when(to.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), to))
        .when(to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (to == "") | to.startswith("#"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("__folder"), F.when(F.col("__folder").endswith("/"), "").otherwise("/"), to))
    )
    return df.withColumn(target, whole).drop("__root", "__folder")


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (u, v) between normalised URLs from canonical links and refresh redirects in the pages' HTML.

    Comments, scripts and the like don't count; links are relative to the page's base, where it names one.
    """
    mine = pages.where("url is not null and html is not null").select(F.trim(F.col("url").cast("string")).alias("url"), F.col("html").cast("string").alias("html"))
    seen = mine.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.regexp_replace("html", UNSEEN, " ").alias("html"))

    def attribute(df: DataFrame, tag: str, having: str, name: str, target: str) -> DataFrame:
        df = df.withColumn("__tag", F.regexp_extract("html", rf"(?is)<{tag}\b([^>]*{having}[^>]*)>", 1))
        df = df.withColumn("__value", F.regexp_extract("__tag", rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1))
        df = df.withColumn("__value", F.trim(F.regexp_replace("__value", "^([\"'])(.*)\\1$", "$2")))
        return df.withColumn(target, F.when(F.contains("__value", F.lit("&")), _decoded(F.col("__value"))).otherwise(F.col("__value"))).drop("__tag", "__value")

    seen = attribute(seen, "link", r"\brel\s*=\s*[\"']?canonical\b", "href", "canonical")
    seen = attribute(seen, "meta", r"\bhttp-equiv\s*=\s*[\"']?refresh\b", "content", "content")
    seen = attribute(seen, "base", r"\bhref\b", "href", "own").drop("html")
    seen = resolved(seen, "url", "own", "own").withColumn("base", F.coalesce("own", "url"))
    refresh = F.trim(F.regexp_extract("content", r"(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*[\"']?([^\"']+)", 1))
    links = seen.select("url", "base", F.explode(F.array("canonical", refresh)).alias("link")).where("link <> ''")
    links = normalised(normalised(resolved(links, "base", "link", "to"), "url", "u"), "to", "v")
    return links.select("u", "v").where("u <> v")


def _matches(urls: DataFrame, hosts: tuple[str, ...], exact: tuple[str, ...], name: str, labels_of: tuple[str, ...] = (), listed: DataFrame | None = None) -> DataFrame:
    """Of ``urls`` (url), those on one of the hosts or a subdomain of it, on a host with one of the labels before its last, or equal to an exact or listed URL after normalisation."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(h.lower(),) for h in hosts], "rule string")
    links = spark.createDataFrame([(u,) for u in exact], "raw string")
    if listed is not None:
        links = links.union(listed.select(F.col("url").cast("string")))
    links = normalised(links, "raw", "rule").select("rule").where("rule is not null").distinct()
    labels = F.split(host_of(F.col("url")), r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    names = spark.createDataFrame([(x.lower(),) for x in labels_of], "rule string")
    suffixes = urls.select("url", suffix.alias("suffix"))
    by_host = suffixes.join(rules, F.col("suffix") == F.col("rule"), "left_semi").select("url")
    by_name = suffixes.where(F.contains("suffix", F.lit("."))).join(names, F.substring_index("suffix", ".", 1) == F.col("rule"), "left_semi").select("url")
    by_link = urls.join(links, F.col("url") == F.col("rule"), "left_semi").select("url")
    return by_host.union(by_name).union(by_link).distinct().select(F.col("url").alias(f"{name}_url"))


def filter_urls(
    pages: DataFrame,
    block_hosts: tuple[str, ...] = (),
    block_urls: tuple[str, ...] = (),
    allow_hosts: tuple[str, ...] = (),
    allow_urls: tuple[str, ...] = (),
    redirects: DataFrame | None = None,
    block_names: tuple[str, ...] = BLOCK_NAMES,
    block: DataFrame | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """One row per page (page_id, url, html): its normalised URL, its component's name, and whether and why it stays.

    ``reason`` is ``allowed`` (the URL itself is on an allow list, whatever else holds), ``blocked`` (it is on a block
    list), ``alias`` (a URL it is equivalent to is), ``invalid`` (null, empty or not http) or ``clean``; ``keep`` is true for
    allowed and clean. ``redirects`` may add edges (from_url, to_url); ``block`` and ``allow`` are tables of further URLs (url). A host rule holds for its subdomains;
    one of ``block_names`` for every host that has it as a label, under any suffix.

    The component of a URL without links is the URL. Null HTML has no links. Repeated rows and null keys give a row
    each. Other columns aren't read. An empty table gives no rows.
    """
    edges = page_links(pages)
    if redirects is not None:
        hops = normalised(normalised(redirects.select("from_url", "to_url"), "from_url", "u"), "to_url", "v")
        edges = edges.union(hops.select("u", "v").where("u <> v"))
    groups = connected_components(edges)
    mine = normalised(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("raw_url")), "raw_url", "url")
    urls = mine.select("url").where("url is not null").union(groups.select(F.col("node").alias("url"))).distinct()
    urls = urls.join(groups.withColumnRenamed("node", "url"), "url", "left").withColumn("component", F.coalesce("component", "url"))
    blocked = urls.join(_matches(urls.select("url"), block_hosts, block_urls, "block", block_names, block), F.col("url") == F.col("block_url"), "left")
    bad = blocked.where("block_url is not null").select(F.col("component").alias("bad")).distinct()
    allowed = _matches(urls.select("url"), allow_hosts, allow_urls, "allow", (), allow)
    decided = blocked.join(bad, F.col("component") == F.col("bad"), "left").join(allowed, F.col("url") == F.col("allow_url"), "left")
    reason = F.when(F.col("allow_url").isNotNull(), "allowed").when(F.col("block_url").isNotNull(), "blocked").when(F.col("bad").isNotNull(), "alias").otherwise("clean")
    decided = decided.select(F.col("url").alias("d_url"), "component", reason.alias("reason"))
    found = mine.join(decided, F.col("url") == F.col("d_url"), "left")
    reason = F.coalesce("reason", F.lit("invalid"))
    return found.select("page_id", F.col("raw_url").alias("url"), F.col("url").alias("normalised"), "component", reason.alias("reason"), reason.isin("allowed", "clean").alias("keep"))


def hops_and_allowed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the registered query: redirects of ``blog.`` hosts to the bare host and of addresses with a query to those without;
    and as an allow list the addresses on hosts of blocked names whose number ends in 0."""
    urls = pages.select(F.col("url").alias("from_url"))
    blogs = urls.where(F.col("from_url").rlike(BLOG)).withColumn("to_url", F.regexp_replace("from_url", BLOG, "//"))
    bare = urls.where(F.contains("from_url", F.lit("?"))).withColumn("to_url", F.regexp_replace("from_url", r"\?.*$", ""))
    allowed = pages.select("url").where(F.col("url").rlike("(" + "|".join(BLOCK_NAMES) + r").*/[a-z]+/\d*0\b"))
    return blogs.union(bare), allowed


BLOG = r"//((www|m)\.)?blog\."
_NAMES = "|".join(BLOCK_NAMES)
SQL = rf"""
WITH RECURSIVE h AS (
  SELECT url AS f, regexp_replace(url, '//((www|m)\.)?blog\.', '//') AS t FROM pages WHERE regexp_matches(url, '//((www|m)\.)?blog\.')
  UNION ALL SELECT url, regexp_replace(url, '\?.*$', '') FROM pages WHERE contains(url, '?')),
k AS (SELECT url, html, regexp_extract(html, '(?is)<link\b([^>]*\brel\s*=\s*["'']?canonical\b[^>]*)>', 1) AS c, regexp_extract(html, '(?is)<meta\b([^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*)>', 1) AS r FROM pages),
l AS (SELECT url, regexp_extract(c, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM k UNION ALL SELECT url, regexp_extract(r, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM k),
m AS (SELECT url AS f, CASE WHEN regexp_matches(link, '^(?i:https?)://') THEN link WHEN starts_with(link, '//') THEN 'https:' || link WHEN starts_with(link, '/') THEN regexp_extract(url, '^(?i:https?)://[^/?#]*', 0) || link
  WHEN starts_with(link, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || link ELSE regexp_extract(url, '^(?i:https?)://[^?#]*/', 0) || link END AS t FROM l WHERE link <> '' UNION ALL SELECT f, t FROM h),
w AS (SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT f FROM m UNION ALL SELECT t FROM m)),
a AS (SELECT u AS raw, regexp_replace(trim(u), '#.*$', '') AS u FROM w),
b AS (SELECT raw, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?i:https?)://([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
  regexp_extract(u, '^(?i:https?)://[^/?]*(.*)$', 1) AS rest FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/index\.(html?|php)$', ''), '/+$', '') AS path,
  regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&+', '') AS query FROM b),
n AS (SELECT raw, CASE WHEN host <> '' THEN 'https://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url FROM c),
e AS (SELECT DISTINCT x.url AS u, y.url AS v FROM m JOIN n x ON x.raw = m.f JOIN n y ON y.raw = m.t WHERE x.url <> y.url),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT DISTINCT url AS node, url AS seen FROM n WHERE url IS NOT NULL UNION SELECT reach.node, s.v FROM reach JOIN s ON reach.seen = s.u),
g AS (SELECT node, min(seen) AS component, bool_or(regexp_matches(seen, '^https://([^/?]*\.)?({_NAMES})\.[^/?]+')) AS bad FROM reach GROUP BY node),
o AS (SELECT DISTINCT n.url FROM pages p JOIN n ON n.raw = p.url WHERE regexp_matches(p.url, '({_NAMES}).*/[a-z]+/\d*0\b')),
d AS (SELECT p.page_id, p.url, n.url AS normalised, component, CASE WHEN n.url IS NULL THEN 'invalid' WHEN n.url IN (SELECT url FROM o) THEN 'allowed'
  WHEN regexp_matches(n.url, '^https://([^/?]*\.)?({_NAMES})\.[^/?]+') THEN 'blocked' WHEN bad THEN 'alias' ELSE 'clean' END AS reason
  FROM pages p LEFT JOIN n ON n.raw = p.url LEFT JOIN g ON g.node = n.url)
SELECT page_id, url, normalised, component, reason, reason IN ('allowed', 'clean') AS keep FROM d
"""
