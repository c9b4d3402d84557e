import random

from docketlake.llm.components import connected_components
from docketlake.llm.url_filter import filter_urls, normalised, page_links


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3), (900, 1000 + 0)] + [(900, i) for i in range(901, 950)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_normalise(spark):
    cases = {
        "HTTP://www.Site.com:80/a/?utm_source=x&b=1#top": "https://site.com/a?b=1",
        "https://m.site.com/": "https://site.com",
        "https://site.com/x/index.html": "https://site.com/x",
        "https://site.com/a/./b/../c/..": "https://site.com/a",
        "https://site.com/../x": "https://site.com/x",
        "https://site.com/.well/a..b": "https://site.com/.well/a..b",
        "ftp://site.com": None,
        "": None,
        None: None,
    }
    rows = normalised(spark.createDataFrame([(u,) for u in cases], "u string"), "u", "n").collect()
    assert {r.u: r.n for r in rows} == cases


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://good.com/a", link.format("https://bad.com/x"), "k"),
        (2, "https://www.good.com/b", '<META content="0; URL=/a" http-equiv="refresh">', "k"),
        (3, "https://good.com/c#f", link.format("//other.com/c"), "k"),
        (4, "https://sub.bad.com/y", None, "k"),
        (5, "https://sub.bad.com/ok", "<p>", "k"),
        (6, None, "<p>", "k"),
        (7, "nonsense", "<p>", "k"),
        (None, "https://notbad.com/", "<p>", "k"),
        (4, "https://sub.bad.com/y", None, "k"),
        (8, "https://moved.com/q", "<p>", "k"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keep string")
    hops = spark.createDataFrame([("https://moved.com/q", "https://good.com/b"), (None, "https://good.com/b")], "from_url string, to_url string")
    got = filter_urls(pages, block_hosts=("bad.com",), allow_urls=("http://sub.bad.com/ok?ref=1", "https://moved.com/q/"), redirects=hops).collect()
    by = {r.page_id: (r.reason, r.keep) for r in got}
    assert len(got) == 10
    assert by == {1: ("alias", False), 2: ("alias", False), 3: ("clean", True), 4: ("blocked", False), 5: ("allowed", True), 6: ("invalid", False), 7: ("invalid", False), None: ("clean", True), 8: ("allowed", True)}
    assert filter_urls(spark.createDataFrame([], pages.schema)).collect() == []


def test_links_as_browsers_read_them(spark):
    rows = [
        (1, "https://a.com/x/y/p", '<link rel="canonical" href="../q">', "https://a.com/x/q"),
        (2, "https://a.com/p", "<link rel=canonical href='/q?a=1&amp;b=2'>", "https://a.com/q?a=1&b=2"),
        (3, "https://a.com/p", '<base href="https://b.com/dir/"><link href="z" rel="canonical">', "https://b.com/dir/z"),
        (4, "https://a.com/p", '<!-- <link rel="canonical" href="/no"> --><p>', None),
        (5, "https://a.com/p", '<script>var s = \'<link rel="canonical" href="/no">\'</script>', None),
        (6, "https://a.com/p", '<meta http-equiv="refresh" content="0;url=&#47;moved">', "https://a.com/moved"),
        (7, "https://a.com/p", "<meta http-equiv='Refresh' content='5; URL=\"next page\"'>", "https://a.com/next page"),
    ]
    for i, url, html, want in rows:
        pages = spark.createDataFrame([(i, url, html)], "page_id long, url string, html string")
        assert [r.v for r in page_links(pages).collect()] == ([want] if want else []), i


def test_tables_of_block_and_allow(spark):
    pages = spark.createDataFrame([(1, "https://x.com/a", None), (2, "https://y.com/b", None), (3, "https://z.com/c", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame([("https://y.com/b", "http://www.x.com/a/"), ("https://z.com/c", "https://x.com/a")], "from_url string, to_url string")
    table = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    got = filter_urls(pages, redirects=hops, block=table("https://m.x.com/a", None), allow=table("https://z.com/c#top", "nonsense"))
    assert {r.page_id: r.reason for r in got.collect()} == {1: "blocked", 2: "alias", 3: "allowed"}


def test_default_names_hold_under_any_suffix(spark):
    urls = ["https://free-bets.example.net/a", "http://m.casino-win.example.com/b?x=1", "https://www.spam-farm.example.com:8080/", "https://Cheap-Pills.co.uk", "https://not-free-bets.example.com/", "https://example.com/free-bets.html", "https://free-bets"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "cast(null as string) as html")
    by = {r.page_id: r.reason for r in filter_urls(pages).collect()}
    assert by == dict(enumerate(["blocked"] * 4 + ["clean"] * 3))
