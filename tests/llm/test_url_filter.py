from pyspark.sql import functions as F

from waymark.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, rule string, verdict string"


def judged(spark, rows, **how):
    df = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)
    return {r.id: r for r in url_filter.judged(df, **how).collect()}


def test_hosts_paths_and_rules(spark):
    urls = {
        1: "https://A.Example.COM/en/1?x", 2: "http://example.com/en/7#a", 3: "http://notexample.com/en/7", 4: "ftp://x.net?/de/", 5: "http://b.example.net/de/8/x", 6: "no scheme/en/",
        7: None, 8: "", 9: "://", 10: "http://ÄB.org/es/", 11: "http://com/en/", 12: "http://x.com.au/en/", 13: "x://y://z.com/en/", 14: "http://net/de/1",
    }
    got = judged(spark, [(i, u, None) for i, u in urls.items()])
    want = {
        1: ("a.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/7", "example.com/en/7", "allow"), 3: ("notexample.com", "/en/7", "com/en/", "block"),
        4: ("x.net", "", None, None), 5: ("b.example.net", "/de/8/x", "example.net/de/8", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("Äb.org", "/es/", "org/es/", "block"), 11: ("com", "/en/", "com/en/", "block"), 12: ("x.com.au", "/en/", None, None),
        13: ("y:", "//z.com/en/", None, None), 14: ("net", "/de/1", "net/de/", "allow"),
    }
    for i, (host, path, rule, verdict) in want.items():
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), i
        assert verdict is None or r.verdict == verdict, i


def test_ranks_follow_links(spark):
    link = lambda *hosts: "".join(f"<A HREF='http://{h}/x'>" for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("near.io", "near.io")), (2, "http://near.io/a", link("far.io")), (3, "http://far.io/b", ""),
        (4, "http://bad.com/en/", ""), (5, "http://points.io/", link("bad.com", "bad.com")), (6, "http://alone.io/", None), (7, "http://alone.io/", None),
    ]
    got = judged(spark, rows)
    assert got[2].trust > got[3].trust > 0 and got[2].verdict == "allow"
    assert got[5].distrust > 0 and got[5].verdict == "block"
    assert (got[6].trust, got[6].distrust, got[6].verdict) == (0, 0, "allow")
    assert judged(spark, [(i, u, h) for i, u, h in rows], rounds=0)[3].trust == 0


def test_dense_reference(spark):
    """The same ranks by plain arithmetic over dictionaries."""
    pages = spark.createDataFrame([(1, "http://a.x.net/de/1", ""), (2, "http://b.x.net/", ""), (3, "http://deep.c.y.com/en/", ""), (4, "http://x.net/", ""), (5, "http://c.y.com/", ""), (6, "http://q.no.uk/", ""), (7, "http://r.no.uk/", "")], "page_id long, url string, html string")
    edges = {(r.src, r.dst) for r in url_filter.host_edges(pages).collect()}
    assert edges == {("a.x.net", "x.net"), ("x.net", "a.x.net"), ("b.x.net", "x.net"), ("x.net", "b.x.net"), ("c.y.com", "deep.c.y.com"), ("deep.c.y.com", "c.y.com")}
    seeds = {"a.x.net": url_filter.MASS}
    out = {h: sum(s == h for s, _ in edges) for h, _ in edges}
    now = dict(seeds)
    for _ in range(url_filter.ROUNDS):
        after = {h: v // 100 * (100 - url_filter.DAMPING) for h, v in seeds.items()}
        for s, d in edges:
            if s in now:
                after[d] = after.get(d, 0) + now[s] // 100 * url_filter.DAMPING // out[s]
        now = after
    seeded = spark.createDataFrame([("trust", "a.x.net", 1000)], "kind string, host string, weight long")
    got = url_filter.propagated(url_filter.host_edges(pages), seeded)
    assert {r.host: r["rank"] for r in got.filter(F.col("kind") == "trust").collect()} == now


def test_empty_table(spark):
    assert judged(spark, []) == {}


def test_ranks_are_near_their_limit(spark):
    """Along a chain of 12 hosts, and by ten times the rounds."""
    rows = [(0, "http://good.net/de/1", "<a href='http://h1.io/'>")] + [(k, f"http://h{k}.io/", f"<a href='http://h{k + 1}.io/'><a href='http://h{k // 2}.io/'>") for k in range(1, 12)]
    got, limit = judged(spark, rows), judged(spark, rows, rounds=200)
    assert sum(abs(got[k].trust - limit[k].trust) for k in range(12)) < url_filter.TOLERANCE * url_filter.MASS
    assert all(limit[k].trust > 0 for k in range(12)) and judged(spark, rows, rounds=8)[11].trust == 0


def test_a_very_long_page(spark):
    html = "<a href='http://far.io/'>" + "x" * 3_000_000 + "<a href='http://end.io/'>" * 50_000
    got = judged(spark, [(1, "http://good.net/de/1", html), (2, "http://far.io/", None), (3, "http://end.io/", "")])
    assert got[2].trust == got[3].trust > 0
