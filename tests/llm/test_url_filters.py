import time
from collections import defaultdict
from urllib.parse import urljoin

from loomgraph.llm import url_filters as U

PAGES = "page_id long, url string, html string, host string, verdict int"


def canonical(url):
    rest = url.split("://", 1)[1].split("#")[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    path = slash + path
    kept = [p for p in query.split("&") if p and not p.lower().startswith(("utm_source", "ref="))]
    return host.lower().removesuffix(":80").removesuffix(":443") + path.removesuffix("/") + ("?" + "&".join(kept) if kept else "")


def rule_of(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    host, path = host.lower(), slash + path
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def brute(pages, edges, rules):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(canonical(a))] = find(canonical(b))
    shared = defaultdict(set)
    for u in {u for _, u, _ in pages if u and "://" in u} | {u for e in edges for u in e}:
        if (v := rule_of(u, rules)[3]) and canonical(u) in root:
            shared[find(canonical(u))].add(v)
    out = []
    for i, u, _ in pages:
        host, path, rule, v = rule_of(u, rules)
        known = shared[find(canonical(u))] if u and "://" in u and canonical(u) in root else ()
        out.append((i, host, path, rule, v or ("allow" if "allow" in known or not known else "block")))
    return sorted(out, key=str)


def run(spark, pages, rules=U.RULES, redirects=None):
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], PAGES)
    r = spark.createDataFrame(redirects, "src string, dst string") if redirects else None
    got = U.url_verdicts(df, spark.createDataFrame(rules, "host string, path string, verdict string"), r)
    return sorted(map(tuple, got.drop("basis").collect()), key=str)


def test_aliases_against_brute_force(spark):
    link = lambda to: f'<html><LINK rel="canonical" href="{to}"><a href="http://x.net/">no</a>'
    pages = [
        (1, "http://a.example.net/fr/1", ""), (2, "https://b.example.com/x?utm_source=f", link("http://a.example.net/fr/1")), (3, "http://b.example.com/x/#top", None),
        (4, "http://c.example.com/2", link("/3")), (5, "http://c.example.com/3", "<meta content='0; url=http://gone.net/' http-equiv='refresh'>"), (6, "http://c.example.com/4", ""),
        (7, "http://e.example.com/5", link("http://f.example.net/en/1")), (8, "http://e.example.com/6", link("http://e.example.com/5")), (9, "http://e.example.com/7", link("http://h.net/")), (10, "http://e.example.com/8", link("http://e.example.com/7")),
        (11, "http://e.example.com/8/", link("http://e.example.com/6")), (12, None, link("http://x.net/")), (13, "no scheme", link("/a")), (14, "", ""), (15, "HTTP://UP.Example.NET/En/1", ""), (15, "HTTP://UP.Example.NET/En/1", ""),
        (None, "http://net", ""), (16, "x://net/", ""), (17, "http://xnet/en/", ""), (18, "http://a.org/fr/", link("mailto:a@b.net")), (19, "http://a.example.com/de/1", ""), (20, "http://k.example.com/de", link("sub/page")),
    ]
    redirects = [("http://k.example.com/sub/page", "http://m.example.com/9"), ("http://m.example.com/9", "http://deep.x.net/z")]
    edges = [
        (pages[1][1], pages[0][1]), (pages[3][1], pages[4][1]), (pages[4][1], "http://gone.net/"), (pages[6][1], "http://f.example.net/en/1"), (pages[7][1], pages[6][1]), (pages[8][1], "http://h.net/"), (pages[9][1], pages[8][1]),
        (pages[10][1], pages[7][1]), (pages[-1][1], urljoin(pages[-1][1], "sub/page")), *redirects,
    ]
    got = run(spark, pages, redirects=redirects)
    assert got == brute(pages, edges, U.RULES)
    verdict = {g[0]: g[4] for g in got}
    assert verdict[2] == verdict[3] == verdict[4] == verdict[20] == "block" and verdict[10] == verdict[9] == "allow" and verdict[6] == "allow"


def test_longest_rule_and_many_rules(spark):
    rules = [(f"h{i}.example.com", f"/{'p' * (i % 5)}", ("allow", "block")[i % 2]) for i in range(300)] + [("example.com", "/pp", "block"), ("com", "/pppp", "allow"), ("example.com", "/pp", "allow")]
    pages = [(i, f"http://{s}h{i}.example.com/{'p' * (i % 7)}", "") for i in range(300) for s in ("", "www.")]
    want = brute(pages, [], [r for r in rules if r != ("example.com", "/pp", "block")])
    assert run(spark, pages, rules) == want


def test_empty_tables_and_no_rules(spark):
    assert run(spark, []) == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = U.url_verdicts(spark.createDataFrame([(1, "http://a.net/", "")], "page_id long, url string, html string"), none).collect()
    assert [(r.verdict, r.rule, r.basis) for r in got] == [("allow", None, "none")]


def test_long_pages_and_hosts_take_linear_time(spark):
    pages = [(1, "http://" + "a." * 100_000 + "net/", "<link " * 200_000), (2, "http://a.net/" + "b/" * 300_000, "<meta http-equiv " * 60_000)]
    began = time.time()
    got = run(spark, pages)
    assert {g[4] for g in got} == {"block"} and time.time() - began < 60
