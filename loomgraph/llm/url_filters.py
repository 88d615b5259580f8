"""Rules on urls, and block decisions that follow redirects and canonical links.

A rule names a host and the start of a path, and holds for the host and all its
subdomains. Addresses (distinct host and path) meet rules by equi-joins only:
an address has a key for each suffix of its host (no more than the deepest
rule has labels) and each length of path that rules of that suffix have, so a
list of millions of rules is joined by hash and never scanned, and hot hosts
are met once an address, not once a page.

Pages that redirect (``<meta http-equiv=refresh>``, or a table of redirects) or
name a canonical page (``<link rel=canonical>``) are one thing under several
urls. Urls are nodes, known by their canonical form; these edges join them; the
connected components are found by star rounds. A component that holds a url
under an allow rule is allowed, otherwise one that holds a url under a block
rule is blocked: so block decisions reach aliases, and an explicit allow has
precedence. A url's own rule always stands.

Defined results: a null url, or one without ``://``, has an empty host and
path, takes no rule and no edge, and is allowed; a null or empty html has no
edge; repeated rows come out as often as they went in; null ids stay null; of
rules for the same host and path allow counts; among rules that fit, the
longest text wins, and of equal lengths the one with the longer host; links
that aren't urls of a host do nothing; the dot segments of relative links stay
as they are; a tag whose attributes hold ``<`` or ``>`` isn't read; very long
pages and urls are read whole, in linear time; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.session import written

#: Query parameters that name whence a visitor came, not what is shown.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"

ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"
LINK = r"(?i)<(?:link|meta)\s[^<>]*>"
CANONICAL = r"(?i)^<link\s(?:[^<>]*\s)?rel\s*=\s*[\"']?canonical[\"'\s/>]"
REFRESH = r"(?i)^<meta\s(?:[^<>]*\s)?http-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s<>]+)"
GOES_TO = r"(?i)[\"'\s;]url\s*=\s*[\"']?([^\"'\s<>;]+)"


def after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.position(F.lit("://"), url) + 3))


def small_letters(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A to Z lower-cased; else empty."""
    return F.coalesce(small_letters(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """Host without a default port, path without a slash at its end, query without tracking parameters; no scheme, no fragment. Null without ``://``."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING))), "&")
    form = F.concat(F.regexp_replace(host_of(url), ":(80|443)$", ""), F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), form)


def resolved(link: Column, url: Column) -> Column:
    """A link of a page as a whole url, or null where it names none."""
    scheme = F.substring_index(url, "://", 1)
    here = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)", 1)
    return (
        F.when(F.rlike(link, F.lit(ABSOLUTE)), link)
        .when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")) | ~F.contains(url, F.lit("://")), None)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(here, link))
        .when(F.rlike(link, F.lit("^[?#]")), F.concat(here, path_of(url), link))
        .otherwise(F.concat(here, F.when(folder != "", folder).otherwise("/"), link))
    )


def declared_links(html: Column, url: Column) -> Column:
    """Urls to which a page redirects or that it names as canonical."""
    tags = F.regexp_extract_all(html, F.lit(LINK), F.lit(0))
    to = lambda of, pattern: F.transform(F.filter(tags, lambda t: F.rlike(t, F.lit(of))), lambda t: F.regexp_extract(t, pattern, 1))
    found = F.filter(F.concat(to(CANONICAL, HREF), to(REFRESH, GOES_TO)), lambda x: x != "")
    return F.filter(F.transform(found, lambda x: resolved(F.regexp_replace(x, "&amp;", "&"), url)), lambda x: x.isNotNull())


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of distinct ``addresses(host, path)`` under which a rule of ``rules(host, path, verdict)`` holds."""
    r = rules.groupBy(small_letters(F.col("host")).alias("rule_host"), F.col("path").alias("prefix")).agg(F.min("verdict").alias("verdict"))
    lengths = r.groupBy("rule_host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    deepest = r.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0))).first()[0]
    labels = F.split("host", r"\.")
    size = F.least(F.size(labels), F.lit(deepest))
    suffixes = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(labels, -i, i), "."))).otherwise(F.array().cast("array<string>"))
    keyed = addresses.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    keyed = keyed.select("host", "path", "rule_host", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("path"))
    found = keyed.withColumn("prefix", F.substr("path", F.lit(1), F.col("n"))).join(r, ["rule_host", "prefix"])
    text = F.concat("rule_host", "prefix")
    best = F.max(F.struct(F.length(text).alias("size"), F.length("rule_host").alias("host_size"), text.alias("rule"), "verdict"))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, basis`` of every page; the basis is ``rule``, ``alias`` or ``none``.

    ``rules(host, path, verdict)`` with verdicts ``allow`` and ``block``;
    ``redirects(src, dst)`` are more edges between urls.
    """
    url = F.col(f"`{url_col}`")
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.md5(canonical_form(url).cast("binary")).alias("node"))
    node = lambda c: F.md5(canonical_form(F.col(c)).cast("binary"))
    links = pages.limit(0).select(url.alias("src"), url.alias("dst"))
    if html_col:
        links = pages.select(url.alias("src"), F.explode(declared_links(F.col(f"`{html_col}`"), url)).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    edges = written(links.select("src", "dst", node("src").alias("a"), node("dst").alias("b")).filter("a <> b"), "aliases")
    ends = edges.select(F.col("src").alias("url"), F.col("a").alias("node")).unionByName(edges.select(F.col("dst").alias("url"), F.col("b").alias("node")))
    ends = ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    # a url that no page has can carry a rule too
    judged = written(matched_rules(p.select("host", "path").unionByName(ends.select("host", "path")).distinct(), rules), "judged")
    of = connected_components(edges.select("a", "b"))
    ruled = ends.unionByName(p.select("node", "host", "path")).join(judged.hint("merge"), ["host", "path"]).groupBy("node").agg(F.min("verdict").alias("verdict"))
    by_root = of.join(ruled, "node").groupBy("root").agg(F.min("verdict").alias("shared"))  # allow sorts first: it has precedence
    aliases = of.join(by_root, "root").select("node", "shared")

    # what is judged grows with the pages, and its files are far smaller than its rows in memory: never broadcast
    out = p.join(judged.hint("merge"), ["host", "path"], "left").join(aliases, "node", "left")
    basis = F.when(F.col("verdict").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("none")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "shared", F.lit("allow")).alias("verdict"), basis.alias("basis"))


# The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE_SQL = r"""
WITH RECURSIVE s AS (SELECT page_id, url, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS x FROM pages),
a AS (SELECT *, coalesce(translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
r(rule_host, prefix, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT DISTINCT host, path FROM a),
k AS (SELECT host, path, rule_host || prefix AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || prefix) DESC, length(rule_host) DESC) AS n
  FROM m JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)),
j AS (SELECT host, path, rule, v FROM k WHERE n = 1),
t AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM a),
e AS (SELECT url AS src, regexp_extract(tag, '(?i)(?:href|url)\s*=\s*["'']?([^"''\s<>;]+)', 1) AS dst FROM t WHERE regexp_matches(tag, '(?i)(rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh)')),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
c AS (SELECT src, dst FROM b UNION SELECT c.src, b.dst FROM c JOIN b ON c.dst = b.src),
g AS (SELECT c.src AS url, min(j.v) AS shared FROM c JOIN a ON a.url = c.dst JOIN j ON j.host = a.host AND j.path = a.path GROUP BY 1)
SELECT page_id, a.host, a.path, j.rule, coalesce(j.v, g.shared, 'allow') AS verdict, CASE WHEN j.v IS NOT NULL THEN 'rule' WHEN g.shared IS NOT NULL THEN 'alias' ELSE 'none' END AS basis
FROM a LEFT JOIN j ON j.host = a.host AND j.path = a.path LEFT JOIN g ON g.url = a.url
"""
