from urllib.parse import urljoin

from weirflow.llm import urls


def judged(spark, rows, redirects=None, rules=urls.RULES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, host int")
    links = spark.createDataFrame(redirects, "src string, dst string") if redirects is not None else None
    return urls.judge(df, links, rules)


def plain(rows):
    return [(*r, None, None, None)[:5] for r in rows]


def test_hosts_paths_and_longest_rule(spark):
    cases = [
        (1, "http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (4, "https://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
        (5, "https://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        (6, "http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        (7, "http://a.net?/es/", "a.net", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, None, "", "", None, "allow"),
        (10, "http://", "", "", None, "allow"),
        (11, "http://com", "com", "", None, "allow"),
        (12, "http://com/", "com", "/", "com/", "allow"),
        (13, "x://y.net/fr/://z", "y.net", "/fr/://z", "net/fr/", "block"),
        (14, "http://b.org\n/en/", "b.org\n", "/en/", None, "allow"),
    ]
    got = {r.page_id: tuple(r)[1:] for r in judged(spark, plain([c[:2] for c in cases])).collect()}
    assert got == {c[0]: c[2:] for c in cases}


def brute(rows, links):
    """Components by union-find, decisions as the docstring has them."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    own = {"http://bad.net/es/": "block", "http://ok.com/": "allow"}
    out = {}
    for page, url in rows:
        held = {own.get(n) for n in parent if find(n) == find(url)} if url in parent else set()
        out[page] = own.get(url) or ("allow" if "allow" in held else "block" if "block" in held else "allow")
    return out


def test_blocks_pass_along_chains_unless_allowed(spark, rng):
    names = [f"http://h{i}.org/p" for i in range(60)] + ["http://bad.net/es/", "http://ok.com/"]
    for n in (10, 25, 45, 80):
        links = [(rng.choice(names), rng.choice(names)) for _ in range(n)]
        links += [(f"http://h{i}.org/p", f"http://h{i + 1}.org/p") for i in range(20)]
        rows = list(enumerate(names))
        got = {r.page_id: r.verdict for r in judged(spark, plain(rows), links).collect()}
        assert got == brute(rows, links)


def test_pages_name_their_aliases(spark):
    canonical = '<head><LINK href="https://bad.net/es/1" rel=canonical></head>'
    refresh = "<meta http-equiv='refresh' content='0; url=https://bad.net/es/2'>"
    rows = [(1, "https://a.org/", canonical), (2, "https://B.org/#top", refresh), (3, "https://b.org/", "canonical"), (4, "https://c.org/x", '<link rel="canonical" href="/y">'), (5, "https://c.org/y", '<link rel="canonical" href="//d.net/fr/">'), (6, "https://e.org/", "<link rel=stylesheet href='https://bad.net/es/1'>")]
    got = {r.page_id: r.verdict for r in judged(spark, [(*r, None, None) for r in rows]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_null_and_empty(spark):
    assert judged(spark, plain([(1, "http://a.org/"), (1, "http://a.org/")]), [(None, "http://a.org/"), ("http://a.org/", None)]).count() == 2
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(df).count() == 0


def test_targets_are_resolved_and_decoded(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/b/?x/y"]
    links = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g?y/../z", "#s", ";x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "g..", "./../g", "g/./h", "g/../h", "http://z/../x", "x:y"]
    df = spark.createDataFrame([(b, link) for b in bases for link in links], "b string, v string")
    got = {(r.b, r.v): r.u for r in df.select("b", "v", urls.resolved(df.b, df.v).alias("u")).collect()}
    want = {(b, link): link if "://" in link else urljoin(b, link) for b in bases for link in links}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}
    said = ["a&amp;b", "&#38;&#x26;", "&amp;amp;", "&#233;&#x4e2d;&#x1F642;", "a&copy=1&b", "&", "&quot;&#0;", "&amp"]
    df = spark.createDataFrame([(x,) for x in said], "v string")
    assert [r.u for r in df.select(urls.unescaped(df.v).alias("u")).collect()] == ["a&b", "&&", "&amp;", "é中🙂", "a&copy=1&b", "&", '"&#0;', "&"]


def test_relative_aliases_are_blocked(spark):
    head = '<link rel="canonical" href="%s">'
    pages = [
        (1, "https://c.net/es/x/bad", None), (2, "https://c.net/ok/page.html", head % "../es/x/bad"), (3, "https://c.net/ok/other", head % "page.html"),
        (4, "https://d.org/p?a=1&b=2", head % "https://e.net/fr/"), (5, "https://d.org/p", head % "?a=1&amp;b=2"), (6, "https://d.org/q", '<meta http-equiv=refresh content="0; url=p">'),
        (7, "https://d.org/z", head % "nowhere"),
    ]
    got = {r.page_id: r.verdict for r in judged(spark, [(*r, None, None) for r in pages]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}
