"""URL columns against the standard library."""

from urllib.parse import urldefrag, urljoin, urlparse
from urllib.robotparser import RobotFileParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import addresses, urls
from pagemill.operators import robots

BASES = ["http://h", "http://h/", "http://h/a/b", "http://h/a//b/c?x=1", "http://h/a/b/?q#f",
         "https://u@h:80/a;p/b;q", "HTTP://H/a/../b"]
HREFS = ["", "#f", "?", "?q", "?q#f", "p", "p/", "./p", "../p", "../../p", "../../../p", "/p", "/a/./b", "/a/../b",
         "/a//b", "//o/p", "//o", "//o?q", "http://x/y", "HTTP://X/y#", "mailto:a", "javascript:void(0)", "p;x", "..",
         ".", "/..", "/.", "../", "p?x=/../", "  p", "a//b", "http:", "http:p", "/p;", "a:b", "p/..", ".//p",
         "//o/../x", "/#", "?#", "/a/b/..//c"]


def column(spark, values, expression, name="v"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col(name))).collect()]


def normal(url):
    return urldefrag(url)[0].rstrip("/")


def test_normalize_fixed_rows(spark):
    rows = {"HTTP://A.com/x?#f": "http://A.com/x", "HTTP://A.com/x?": "HTTP://A.com/x?", "http://a.com//": "http://a.com",
            "http://a.com/p/?q=/": "http://a.com/p/?q=", "http://": "http:", "http://h/p;#x": "http://h/p"}
    assert column(spark, rows, urls.normalize_url) == list(rows.values())
    assert [normal(u) for u in rows] == list(rows.values())


def test_resolve_fixed_rows(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    frame = spark.createDataFrame(pairs, "b string, h string")
    both = frame.select(
        "b", "h", urls.resolve_href(F.col("b"), F.col("h")).alias("one"),
        F.get(urls.resolve_all(F.col("b"), F.array("h")), F.lit(0)).alias("all"),
    ).collect()
    assert [(r.one, r.all) for r in both] == [(urljoin(r.b, r.h), urljoin(r.b, r.h)) for r in both]


def test_random_urls(spark):
    """Random paths and references, checked in one Spark job."""
    segment = st.sampled_from(["a", "b", "..", ".", "", "c;p", "é", "x.y"])
    path = st.lists(segment, max_size=5).map("/".join)
    tail = st.sampled_from(["", "?q=1", "?", "#f", "?a#b"])
    pairs = []

    @settings(max_examples=150, database=None)
    @given(path, path, tail, st.sampled_from(["", "/", "//o/", "http://z/"]))
    def collect(base, ref, end, prefix):
        pairs.append(("http://h/" + base, prefix + ref + end))

    collect()
    pairs = [p for p in pairs if not p[1].startswith("///") and not p[0].startswith("http://h//")]
    frame = spark.createDataFrame(pairs, "b string, h string")
    rows = frame.select("b", "h", urls.resolve_href(F.col("b"), F.col("h")).alias("r"),
                        urls.normalize_url(F.concat("b", "h")).alias("n")).collect()
    for r in rows:
        if not urlparse(r.h).path.startswith("//"):
            assert r.r == urljoin(r.b, r.h), (r.b, r.h)
        assert r.n == normal(r.b + r.h)


def test_valid(spark):
    rows = {"http://h/a.pdf?x=1": True, "http://h/a?f=x.pdf": False, "mailto:a@b": False, "javascript:x": False,
            "http:///x": False, "HTTPS://H/x": True, "http://h/a.JPG": False, "ftp://h/x": False, "http://h/js": True,
            "http://[h/x": False}
    assert column(spark, rows, urls.is_valid_url) == list(rows.values())


def test_domains(spark):
    u = ["http://h?x", "http://User@H:80/p", "//h/p", "x"]
    assert column(spark, u, urls.netloc) == ["h", "User@H:80", "h", ""]
    assert column(spark, u, urls.stub_domain) == ["h?x", "User@H:80", "h", ""]
    assert [urlparse(x).netloc for x in u] == ["h", "User@H:80", "h", ""]


def test_private_addresses(spark):
    private = ["10.1.2.3", "172.16.0.1", "172.31.255.255", "192.168.1.1", "127.0.0.1", "169.254.1.1", "100.64.0.1",
               "::1", "0:0:0:0:0:0:0:1", "fe80::1", "febf::", "fc00::1", "fdff::1", "garbage", "", "256.1.1.1", "1:::2",
               "1:2:3:4:5:6:7", ":1"]
    public = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "2001:db8::1", "1:2:3:4:5:6:7:8", "::2", "fec0::1"]
    assert column(spark, private, addresses.is_private_address) == [True] * len(private)
    assert column(spark, public, addresses.is_private_address) == [False] * len(public)
    hosts = spark.createDataFrame([(["8.8.8.8"],), (["8.8.8.8", "10.0.0.1"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in hosts.select(addresses.is_fetchable(F.col("a"))).collect()] == [True, False, False, False]


ROBOTS = [
    "",
    "User-agent: *\nDisallow: /a\nAllow: /a/b",
    "User-agent: *\nAllow: /a/b\nDisallow: /a",
    "User-agent: *\nDisallow: /\n\nUser-agent: corpusbot\nDisallow:",
    "User-agent: CorpusBot\nUser-agent: other\nDisallow: /x?y\n# note\nDisallow: /é # more",
    "Disallow: /a\nUser-agent: *\n\nDisallow: /b\nUser-agent: *\nDisallow: /c",
    "User-agent: bot\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\r\nDisallow: *\r\n",
    "User-agent: *\nDisallow: /a+b\nDisallow: /p%20q\nDisallow: /~u",
    "user-agent : corpus\ndisallow : /a\n \nallow: /c\nsitemap: http://x\ndisallow: /b",
]
PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/b", "/c", "/x?y=1", "/é/1", "/a+b", "/p%20q", "/p q", "/~u", "/z#f"]


def test_robots_against_standard_library(spark):
    files = spark.createDataFrame([(f"http://h{i}", t) for i, t in enumerate(ROBOTS)], "base_url string, robots_txt string")
    rules = robots.parse_rules(files)
    pages = spark.createDataFrame([(f"http://h{i}{p}",) for i in range(len(ROBOTS) + 1) for p in PATHS], "url string")
    for agent in ["CorpusBot/1.0", "Mozilla/5.0 (compatible; CorpusBot/1.1)"]:
        for row in robots.allowed(pages, rules, agent).collect():
            host = int(urlparse(row.url).netloc[1:])
            parser = RobotFileParser()
            parser.parse((ROBOTS + [""])[host].splitlines())
            assert row.allowed == parser.can_fetch(agent, row.url), (agent, row.url)
