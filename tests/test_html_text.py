import random
import re
import time
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagemill.functions import config, html, scores, text

PAGE = """<html><head><title> A &amp;amp; B&#233;&#xe9;&nbsp;</title><META content='d &quot;x&quot; ' NAME=description></head>
<body><script>x<b></script>foo<!-- <p>hidden --> bar <b>baz  q</b><nav>n<a href="/nav">n</a></nav><header>h</header>
<a href='/x?a=1&amp;b=2' title='a>b'>l1</a><a name=x>no</a><a
HREF=rel>l2</a><a href="">l3</a><aside>side</aside>&copy; 5 < 6 &unknown; &lt;b&gt;<noscript>ns</noscript></body>"""


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "h string").select(*columns).first()


def test_extraction(spark):
    h = F.col("h")
    row = one(spark, PAGE, html.title(h), html.meta_description(h), html.visible_text(h), html.hrefs(h),
              html.hrefs(h, html.CODE_SKIP), html.outgoing_links(F.lit("http://h/a/b"), h))
    assert row[0] == "A &amp; Béé"
    assert row[1] == 'd "x"'
    assert row[2] == "A &amp; Béé foo bar baz  q l1 no l2 l3 © 5 < 6 &unknown; <b> ns"
    assert row[3] == ["/x?a=1&b=2", "rel", ""]
    assert row[4] == ["/nav", "/x?a=1&b=2", "rel", ""]
    assert row[5] == ["http://h/x?a=1&b=2", "http://h/a/rel", "http://h/a/b"]


def test_bad_links_drop_alone(spark):
    page = '<a href="http://[x/y">a</a><a href="b.PDF">b</a><a href="mailto:x">m</a><a href="c">c</a>'
    assert one(spark, page, html.outgoing_links(F.lit("http://h/"), F.col("h")))[0] == ["http://h/c"]


def test_needs_render_and_index_text(spark):
    h = F.col("h")
    long = "<p>" + "word " * 30 + "</p>"
    assert one(spark, "<script>" + "x" * 500 + "</script><noscript>" + "y" * 500 + "</noscript>hi", html.needs_render(h))[0]
    assert not one(spark, long, html.needs_render(h))[0]
    page = "<title>t</title><ul><li><a href=x>" + "menu " * 20 + f"</a></li></ul>{long}<aside>short</aside>"
    assert one(spark, page, html.main_text(h))[0] == ("word " * 30).strip()
    assert one(spark, "<title>t</title><p>a</p><aside>b</aside><footer>f</footer>", html.main_text(h))[0] == "t a b"


def test_entities_match_standard_library(spark):
    for value in ["&eacute;&Eacute;&hellip;", "&#x1F600; &#128512;", "&amp;lt;", "a & b &; &nope;", "&Alpha;&euro;&#39;"]:
        assert one(spark, value, html.decode_entities(F.col("h")))[0] == unescape(value)


def test_whole_text_is_read(spark):
    page = "<p>" + "x" * 300_000 + "</p><br>" * 5_000 + "<p>end</p>"
    assert one(spark, page, html.visible_text(F.col("h")))[0].endswith(" end")


def test_extraction_and_statistics_are_one_expression(spark):
    page = "<nav>a<nav>b</nav></nav><p>" + "A plain sentence here. " * 9 + "</p>"
    whole, apart = html.main_text(F.col("h")), one(spark, page, html.main_text(F.col("h")))[0]
    assert one(spark, page, text.reading_ease(whole))[0] == one(spark, apart, text.reading_ease(F.col("h")))[0] > 50


def test_reading_ease(spark):
    sample = "The cat sat on the mat. It was a sunny day, and the cat was very happy indeed! Nobody else came by that day at all."
    words = re.findall("[a-z]+", sample.lower())
    syllables = sum(max(1, len(re.findall("[aeiouy]+", w))) for w in words)
    got = one(spark, sample, text.reading_ease(F.col("h")))[0]
    assert abs(got - (206.835 - 1.015 * len(words) / 3 - 84.6 * syllables / len(words))) < 1e-9
    assert one(spark, "Short.", text.reading_ease(F.col("h")))[0] == 0.0


PORTER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control
roll roll generalizations gener oscillators oscil is is ion ion enjoy enjoi saying sai by by""".split()


def test_fold_and_stem(spark):
    words, stems = PORTER[::2], PORTER[1::2]
    frame = spark.createDataFrame([(w,) for w in words], "h string")
    assert [r[0] for r in frame.select(text.stem(F.col("h"))).collect()] == stems
    assert one(spark, "ÉÑß Ü", text.fold(F.col("h")))[0] == "enß u"


def test_scores(spark):
    rows = [
        ("http://a.gov/x", 0, "2024-06-01"), ("http://a/x.organic", None, "2022-01-01"), ("http://a.edu.gov", 1000, None),
        ("http://a.com", 10, "2025-06-01"),
    ]
    frame = spark.createDataFrame(rows, "u string, n int, t string").withColumn("t", F.col("t").cast("timestamp"))
    as_of = F.lit("2024-06-01").cast("timestamp")
    got = frame.select(
        scores.domain_authority(F.col("u")), scores.quality(F.col("n")), scores.freshness(F.col("t"), as_of)
    ).collect()
    assert [tuple(round(v, 9) for v in r) for r in got] == [
        (1.0, 0.0, 1.0), (0.5, 0.0, 0.0), (1.0, 3.0, 1.0), (0.0, 1.0, 2.0)
    ]


def test_config(spark):
    c = F.col("h")
    laid = config.overlay(c)
    row = one(spark, '{"max_depth": 1, "storage": {"enabled": true}}', config.setting(laid, "max_depth", "int"),
              config.setting(laid, "max_retries", "int"), F.element_at(laid, F.lit("storage")))
    assert tuple(row) == (1, 3, '{"enabled":true}')
    assert one(spark, "[]", config.setting(laid, "max_depth", "int"))[0] == 3


def timed(spark, value, column):
    """Result of a column on one value, and its seconds."""
    frame = spark.createDataFrame([(value,)], "h string").select(column)
    start = time.perf_counter()
    return frame.first()[0], time.perf_counter() - start


class Visible(HTMLParser):
    """Text and links outside the elements of some names, by levels per name."""

    def __init__(self, skip):
        super().__init__()
        self.levels, self.texts, self.links = dict.fromkeys(skip, 0), [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.levels:
            self.levels[tag] += 1
        elif tag == "a" and not any(self.levels.values()):
            self.links.append(dict(attrs).get("href"))

    def handle_endtag(self, tag):
        if self.levels.get(tag):
            self.levels[tag] -= 1

    def handle_data(self, data):
        if not any(self.levels.values()) and data.strip():
            self.texts.append(data.strip())


def test_nested_elements_match_a_parser(spark):
    rng = random.Random(4)
    names = ["nav", "header", "footer", "aside"]

    def element(depth):
        inside = "".join(element(depth - 1) if rng.random() < 0.6 else f"t{rng.randrange(99)}<a href=/l{rng.randrange(9)}>x</a>" for _ in range(3 if depth else 0))
        name = rng.choice(names + ["div", "NAV"])
        return f"s{rng.randrange(99)}<{name} class='n'>{inside}v<b>w</b></{name}>"

    pages = ["".join(element(4) for _ in range(4)) for _ in range(60)] + ["<p>a</p></nav>" + element(3) + "</header>z", "<nav>" * 300 + "x" + "</nav>" * 300 + "y"]
    rows = spark.createDataFrame([(n, p) for n, p in enumerate(pages)], "n int, h string")
    got = rows.select("n", html.visible_text(F.col("h")), html.hrefs(F.col("h"))).collect()
    for n, text_, links in got:
        parser = Visible(names)
        parser.feed(pages[n])
        assert (text_, links) == (" ".join(parser.texts), parser.links), pages[n]


def test_elements_that_are_never_closed_are_none(spark):
    h = F.col("h")
    assert one(spark, "<nav>a<nav>b</nav>c", html.visible_text(h))[0] == "a c"
    assert one(spark, "<header>A <header>B</header> LEAK <a href=/leak>z</a></header>q", html.visible_text(h), html.hrefs(h))[:] == ("q", [])
    assert one(spark, "a</nav><nav>b<nav></nav>c</nav>d<nav>e", html.visible_text(h))[0] == "a d e"


def test_hostile_pages_are_linear(spark):
    h = F.col("h")
    attributes = "".join(f' a{i}="x>y"' for i in range(100_000))
    pages = {
        "attributes": f"<p{attributes}>text</p><a href=x{attributes}>l</a>",
        "unclosed elements": "<nav>" * 20_000 + "text",
        "unclosed mixed": "<nav><header><footer><aside><title>" * 10_000 + "text",
        "unclosed quotes": "<a href=\"x>'" * 20_000 + "text",
        "open tags": "<p " * 50_000, "comments": "<!-- <script> " * 20_000, "titles": "<title>" * 20_000,
        "closed late": "<nav>" * 20_000 + "</nav>text", "deep": "<nav>x" * 20_000 + "</nav>" * 20_000 + "text",
        "wide": "<nav>" + "<nav>x</nav>" * 20_000 + "</nav>text",
    }
    one(spark, PAGE, html.visible_text(h), html.main_text(h), html.hrefs(h), html.title(h), html.meta_description(h))
    for name, page in pages.items():
        for column in (html.visible_text(h), html.main_text(h), html.hrefs(h), html.title(h), html.meta_description(h)):
            got, seconds = timed(spark, page, column)
            assert seconds < 2, (name, str(column)[:60], seconds)
    assert timed(spark, pages["attributes"], html.visible_text(h))[0] == "text l"
    assert timed(spark, pages["closed late"], html.visible_text(h))[0] == "text"
    assert timed(spark, pages["deep"], html.visible_text(h))[0] == timed(spark, pages["wide"], html.visible_text(h))[0] == "text"
    assert timed(spark, pages["unclosed elements"], html.visible_text(h))[0] == "text"


def test_reading_ease_of_consonants_is_linear(spark):
    got, seconds = timed(spark, "b" * 100_000 + " a", text.reading_ease(F.col("h")))
    assert seconds < 2 and abs(got - (206.835 - 1.015 * 2 - 84.6)) < 1e-9


def test_meta_tags_are_looked_for_once(spark, capsys):
    page = spark.createDataFrame([("<meta name='description' content=' a &amp; b '><meta name=description content=c>",), ("<p>",), (None,)], "html string")
    found = page.select(html.meta_description(F.col("html")).alias("meta"))
    assert [r.meta for r in found.collect()] == ["a & b", "", ""]
    found.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("regexp_extract_all") == 1
