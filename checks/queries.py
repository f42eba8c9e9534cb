"""Registered queries: each job run on the given tables, columns named as in the SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import addresses, config, html, scores, text, urls
from pagemill.operators import (
    frontier, graph, indexing, language, links, outcomes, robots, search, stats,
)
from pagemill.operators import pages as page_table
from pagemill.operators.numbering import number_urls
from pagemill.plans import corpus, ranking
from pagemill.session import cut_lineage, work_path
from pagemill.sources import page_store, raw_html, tables
from pagemill.streaming import counters, index_sync, ingest, recent_retries, retry
from pagemill.streaming.sources import read_files

AS_OF = "2024-06-01"
AGENT = "CorpusBot/1.0"
WHOLE_PAGE = html.CODE_SKIP  # keep links in navigation blocks


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return tables.read_table(spark, f"{folder}/{name}.parquet", spread_by=TEXT_KEYS.get(name))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def days_before(days: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(as_of()) - days * 86400)


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with their normalised url, duplicates kept."""
    return load(spark, folder, "pages").withColumn("norm_url", urls.normalize_url(F.col("url")))


def outlinks_of(spark: SparkSession, folder: str, skip: list[str] = WHOLE_PAGE) -> DataFrame:
    """One row per distinct page with its link targets."""
    return cut_lineage(links.page_outlinks(corpus.distinct_pages(load(spark, folder, "pages"), "page_id"), skip))


def text_or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def stamp(c: Column) -> Column:
    return text_or_dash(F.unix_micros(c))


# Addresses

def url_normalize(spark, folder):
    return pages_of(spark, folder).select("page_id", "url", "norm_url")


def url_domain(spark, folder):
    u = F.col("norm_url")
    return pages_of(spark, folder).select(
        "page_id", urls.netloc(u).alias("domain"), urls.stub_domain(u).alias("stub_domain"),
        urls.base_url(u).alias("base_url"),
    )


def url_valid(spark, folder):
    u = F.col("norm_url")
    forms = F.array(
        u, F.concat(u, F.lit(".PDF")), F.concat(u, F.lit(".zip?x=1")), F.concat(u, F.lit("?file=a.mp3")),
        F.regexp_replace(u, "^https?", "ftp"), F.concat(F.lit("mailto:x@"), urls.netloc(u)),
        F.regexp_replace(u, "^https?:", ""), F.regexp_replace(u, "//[^/]*", "//"),
    )
    return pages_of(spark, folder).select("page_id", F.posexplode(forms).alias("form", "candidate")).withColumn(
        "valid", urls.is_valid_url(F.col("candidate"))
    )


def url_key(spark, folder):
    return pages_of(spark, folder).select("page_id", urls.raw_html_key(F.col("norm_url")).alias("raw_html_path"))


def href_resolve(spark, folder):
    """Every link of every page in eight written forms."""
    found = pages_of(spark, folder).select(
        "page_id", F.col("url").alias("base"), F.posexplode(html.hrefs(F.col("html"), WHOLE_PAGE)).alias("link", "href")
    )
    h = F.col("href")
    forms = F.array(
        h, F.substr(h, F.lit(2)), F.concat(F.lit(".."), h), F.concat(F.lit("./x/.."), h), F.concat(F.lit("?q="), h),
        F.concat(F.lit("#"), h), F.concat(F.lit("//other.example"), h), F.concat(F.lit("https://abs.example"), h),
        F.lit(""),
    )
    return found.select("page_id", "link", "base", F.posexplode(forms).alias("form", "ref")).select(
        "page_id", "link", "form", urls.resolve_href(F.col("base"), F.col("ref")).alias("resolved")
    )


# Extraction

def page_title(spark, folder):
    return load(spark, folder, "pages").select("page_id", html.title(F.col("html")).alias("title"))


def page_meta(spark, folder):
    """Descriptions of the pages, of which every third gets a tag for it."""
    tag = F.concat(F.lit("<head><META name='description' content=\"Page &amp; no. "), F.col("page_id").cast("string"), F.lit(' ">'))
    tagged = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<head>"), tag)).otherwise(F.col("html"))
    return load(spark, folder, "pages").select("page_id", html.meta_description(tagged).alias("meta_description"))


def page_text(spark, folder):
    whole = html.visible_text(F.col("html"))
    return load(spark, folder, "pages").select("page_id", whole.alias("whole_text")).withColumn(
        "body_text", F.substring("whole_text", 1, schemas.BODY_CHARS)
    )


def page_insufficient(spark, folder):
    """Whether the page and its bare head need a browser."""
    head = F.regexp_extract("html", r"(?is)^.*?</head>", 0)
    return load(spark, folder, "pages").select(
        "page_id", html.needs_render(F.col("html")).alias("page_needs_render"),
        html.needs_render(head).alias("head_needs_render"),
    )


def page_main_text(spark, folder):
    return load(spark, folder, "pages").select("page_id", html.main_text(F.col("html")).alias("main_text"))


def page_nested(spark, folder):
    """Text, links and main text of the pages with blocks in blocks of the same name planted before and after them."""
    deep = (F.col("page_id") % 4).cast("int")
    plant = F.concat(
        F.repeat(F.lit('<NAV class="m">in<a href="/in">i</a>'), deep + 1), F.lit("<header>h<header id=x>hh</header>LEAK</header>"),
        F.repeat(F.lit('</nav> LEAK <a href="/leak">l</a><p>A leaked line that is long enough to be a block of its own.</p>'), deep),
        F.lit("</nav>"), F.col("html"), F.lit('<aside>a<aside>b</aside>LEAK<a href="/leak">x</a></aside> end'),
    )
    planted = load(spark, folder, "pages").select("page_id", plant.alias("html"))
    return planted.select(
        "page_id", html.visible_text(F.col("html")).alias("whole_text"), F.array_join(html.hrefs(F.col("html")), " ").alias("links"),
        html.main_text(F.col("html")).alias("main_text"),
    )


def raw_html_join(spark, folder):
    """Stored objects read back by the path of their page."""
    fetched = corpus.distinct_pages(load(spark, folder, "pages"), "page_id")
    path = work_path(spark, "raw-html")
    raw_html.write_store(fetched, path)
    paths = fetched.select("seq", urls.raw_html_key(F.col("url")).alias("raw_html_path"))
    return paths.join(raw_html.read_store(spark, path), "raw_html_path").select(
        F.col("seq").alias("page_id"), "raw_html_path", F.sha2("html", 256).alias("html_hash")
    )


# Links

def page_links_raw(spark, folder):
    return load(spark, folder, "pages").select(
        "page_id", F.posexplode(html.hrefs(F.col("html"), WHOLE_PAGE)).alias("link", "href")
    )


def page_links_valid(spark, folder):
    return links.link_pairs(outlinks_of(spark, folder))


def page_links_content(spark, folder):
    """Links outside navigation, header, footer and aside blocks, the crawl's own rule."""
    return load(spark, folder, "pages").select(
        "page_id", F.size(html.outgoing_links(F.col("url"), F.col("html"))).alias("content_links"),
        F.size(html.outgoing_links(F.col("url"), F.col("html"), WHOLE_PAGE)).alias("all_links"),
    )


def _numbered_pages(spark, folder) -> DataFrame:
    """Distinct pages with dense ids."""
    return cut_lineage(number_urls(pages_of(spark, folder).select(F.col("norm_url").alias("url")).distinct()))


def link_stubs(spark, folder):
    stubs, _ = links.load_links(_numbered_pages(spark, folder), outlinks_of(spark, folder))
    return stubs.select("id", "url", "domain", "depth")


def link_edges(spark, folder):
    """Edges of two loads: all pages, then the same pages again as pairs, which adds none."""
    known, outlinks = _numbered_pages(spark, folder), outlinks_of(spark, folder)
    stubs, edges = links.load_links(known, outlinks)
    everyone = known.select("id", "url").unionByName(stubs.select("id", "url"))
    again = links.resolve_edges(links.link_pairs(outlinks), everyone)
    return _stored(spark, links.add_edges(edges, again), "edges", schemas.LINKS)


def _stored(spark, rows, name, schema) -> DataFrame:
    """A table written as a snapshot and read with the data model's schema."""
    path = work_path(spark, name)
    tables.write_snapshot(rows, path)
    return tables.read_table(spark, path, schema)


def edge_cascade(spark, folder):
    """Edges left after all pages with an https address are removed from the table."""
    known, outlinks = _numbered_pages(spark, folder), outlinks_of(spark, folder)
    stubs, edges = links.load_links(known, outlinks)
    everyone = known.select("id", "url").unionByName(stubs.select("id", "url"))
    return links.drop_dangling_edges(edges, everyone.filter(~F.col("url").startswith("https:")))


# Graph

def _page_graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    known = _numbered_pages(spark, folder)
    stubs, edges = links.load_links(known, outlinks_of(spark, folder))
    return known.select("id", "url").unionByName(stubs.select("id", "url")), edges


def _part_graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Parts linked to the next part of the same order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    edges = load(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("source_id"), F.lead("l_partkey").over(line).alias("target_id")
    ).filter("target_id is not null").distinct()
    return load(spark, folder, "part").select(F.col("p_partkey").alias("id")), edges


def out_degree(spark, folder):
    nodes, edges = _page_graph(spark, folder)
    return graph.out_degree(nodes, edges).select("id", "links_out")


def pagerank_pages(spark, folder):
    nodes, edges = _page_graph(spark, folder)
    ranks = graph.pagerank(nodes.select("id"), edges)
    return nodes.join(ranks, "id").select("url", F.round("score", 9).alias("score"))


def pagerank_parts(spark, folder):
    nodes, edges = _part_graph(spark, folder)
    return graph.pagerank(nodes, edges).select("id", F.round("score", 9).alias("score"))


def pagerank_redistributed(spark, folder):
    """The part graph without the links of every tenth part, whose score all parts share."""
    nodes, edges = _part_graph(spark, folder)
    ranks = graph.pagerank(nodes, edges.filter("source_id % 10 <> 0"), dangling="redistribute")
    return ranks.select("id", F.round("score", 9).alias("score"))


def bfs_frontier(spark, folder):
    """Parts within three steps of the smallest part number."""
    nodes, edges = _part_graph(spark, folder)
    return graph.bfs_levels(edges, nodes.agg(F.min("id").alias("id")), 3)


def _part_frontier(spark, folder) -> DataFrame:
    """Part names as urls, queued at the depth of their size."""
    return load(spark, folder, "part").select(
        F.concat(F.lit("http://parts.example/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_size").alias("depth"),
    )


def frontier_pop(spark, folder):
    return frontier.pop(_part_frontier(spark, folder)).select("url", "depth")


def frontier_merge(spark, folder):
    """New frontier rows of the page links, laid over the links' own pages."""
    outlinks = outlinks_of(spark, folder)
    depth = F.length(F.regexp_replace("source_url", "[^/]", "")) - 2
    pairs = links.link_pairs(outlinks).select("target_url", depth.alias("depth"))
    added = frontier.enqueue(pairs, outlinks.select("url"), max_depth=3)
    return frontier.merge_frontier(added, outlinks.select("url", F.lit(0).alias("depth")))


def visited_update(spark, folder):
    """Suppliers' parts are visited, parts with a returned line are taken out again."""
    line = load(spark, folder, "lineitem")
    url = F.concat(F.lit("http://parts.example/"), F.col("l_partkey").cast("string")).alias("url")
    visited = frontier.add_visited(
        _part_frontier(spark, folder).filter("depth <= 25").select("url"), line.filter("l_quantity >= 45").select(url)
    )
    return frontier.remove_visited(visited, line.filter("l_returnflag = 'R' and l_quantity < 3").select(url))


# Ranking

def _flagship(spark, folder) -> DataFrame:
    raw = load(spark, folder, "pages")
    empty = spark.createDataFrame([], schemas.PAGES)
    crawled = F.when(F.col("seq") % 7 != 0, days_before(F.col("seq") % 500))
    pages, edges = corpus.load_corpus(empty, raw, crawled, skip=WHOLE_PAGE, readable=True)
    ranked = ranking.rank_cycle(pages, edges, as_of())
    return _stored(spark, ranked, "page-table", schemas.PAGES)


def composite_score(spark, folder):
    names = ["rank_score", "freshness_score", "quality_score", "domain_score"]
    return _flagship(spark, folder).select("url", "depth", *[F.round(n, 7).alias(n) for n in names])


def top_pages(spark, folder):
    return composite_score(spark, folder).orderBy(F.desc("rank_score"), "url").limit(search.TOP_K)


def readability(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id", F.round(text.reading_ease(F.col("text")), 6).alias("reading_ease")
    )


def _language_model(spark, folder):
    return language.train(load(spark, folder, "documents").select("text", F.col("lang").alias("language")))


def language_id(spark, folder):
    docs = load(spark, folder, "documents")
    found = language.identify(docs.select("doc_id", "text"), "doc_id", _language_model(spark, folder))
    return found.select("doc_id", "language")


def corpus_language(spark, folder):
    """The language column of a loaded page table, link stubs included."""
    empty = spark.createDataFrame([], schemas.PAGES)
    raw = load(spark, folder, "pages")
    pages, _ = corpus.load_corpus(empty, raw, as_of(), model=_language_model(spark, folder), skip=WHOLE_PAGE)
    return pages.select("url", F.coalesce("language", F.lit("-")).alias("language"))


def page_language(spark, folder):
    bodies = load(spark, folder, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))
    return language.identify(bodies, "page_id", _language_model(spark, folder)).select("page_id", "language")


# The page table

def _customer_pages(spark, folder) -> DataFrame:
    """Customers as pages: some stubs, some indexed, some deleted, by their columns."""
    c = load(spark, folder, "customer")
    key = F.concat(F.lit("http://shop.example/"), F.col("c_custkey").cast("string"))
    stub = F.col("c_mktsegment") == "BUILDING"
    day = F.col("c_nationkey")
    given = {
        "id": F.col("c_custkey"), "url": key, "title": F.when(~stub, F.col("c_name")),
        "meta_description": F.when(~stub, F.col("c_mktsegment")), "domain": F.lit("shop.example"),
        "depth": F.when(stub, F.lit(-1)).otherwise(day), "crawled_at": days_before(day),
        "body_text": F.when(~stub, F.col("c_mktsegment")), "language": F.when(~stub, F.lit("en")),
        "text_length": F.when(~stub, F.length("c_mktsegment")), "rank_score": F.when(day > 2, F.col("c_acctbal")),
        "indexed_at": F.when(F.col("c_acctbal") > 2000, days_before(F.lit(12))),
        "deleted_at": F.when(F.col("c_acctbal") > 7000, days_before(F.lit(1))),
    }
    return c.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGES
    ])


def _order_writes(spark, folder) -> DataFrame:
    """Orders as page writes in order of their key, many per customer."""
    o = load(spark, folder, "orders")
    key = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    given = {
        "url": F.concat(F.lit("http://shop.example/"), key.cast("string")),
        "title": F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
        "meta_description": F.col("o_orderpriority"), "domain": F.lit("shop.example"), "depth": F.lit(1),
        "body_text": F.col("o_orderstatus"), "raw_html_path": F.concat(F.lit("raw/"), F.col("o_orderkey")),
        "language": F.lit("de"), "text_length": F.length("o_orderstatus"),
        "crawled_at": F.col("o_orderdate").cast("timestamp"), "is_stub": F.col("o_orderstatus") == "P",
        "seq": F.col("o_orderkey"),
    }
    return o.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in schemas.PAGE_WRITES])


def _shown_pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        "id", "url", text_or_dash(F.col("title")).alias("title"),
        text_or_dash(F.col("meta_description")).alias("meta_description"), "depth",
        text_or_dash(F.col("body_text")).alias("body_text"), text_or_dash(F.col("raw_html_path")).alias("raw_html_path"),
        text_or_dash(F.col("language")).alias("language"), stamp(F.col("crawled_at")).alias("crawled_at"),
        stamp(F.col("deleted_at")).alias("deleted_at"), stamp(F.col("indexed_at")).alias("indexed_at"),
    )


def page_upsert(spark, folder):
    return _shown_pages(page_table.upsert(_customer_pages(spark, folder), _order_writes(spark, folder)))


def page_store_upsert(spark, folder):
    """The same writes to a table on disk, in two parts by url; the second must number on."""
    store = page_store.PageStore(spark, work_path(spark, "page-store"), folders=16)
    store.write(_customer_pages(spark, folder))
    writes = _order_writes(spark, folder)
    first = F.col("url") < "http://shop.example/5"
    store.upsert(writes.filter(first))
    store.upsert(writes.filter(~first))
    return _shown_pages(store.read()).drop("id")


def soft_delete(spark, folder):
    failed = _order_writes(spark, folder).filter("is_stub").select("url")
    return page_table.soft_delete(_customer_pages(spark, folder), failed, as_of()).select(
        "id", stamp(F.col("deleted_at")).alias("deleted_at")
    )


def index_pending(spark, folder):
    """The whole change feed and, marked in it, the first 1,000 pages to index."""
    pages = _customer_pages(spark, folder)
    batch = indexing.index_batch(pages, 1000).select("id", F.lit(True).alias("first_batch"))
    return indexing.pending(pages).select("id").join(batch, "id", "left").select(
        "id", F.coalesce("first_batch", F.lit(False)).alias("first_batch")
    )


def index_queue_depth(spark, folder):
    return indexing.queue_depth(_customer_pages(spark, folder))


def index_cleanup(spark, folder):
    pages = _customer_pages(spark, folder)
    index = indexing.documents(pages.filter("indexed_at is not null"))
    after, left = corpus.cleanup_cycle(pages, index)
    return after.join(left.select("id", F.lit(True).alias("in_index")), "id", "left").select(
        "id", stamp(F.col("indexed_at")).alias("indexed_at"), F.coalesce("in_index", F.lit(False)).alias("in_index")
    )


def index_documents(spark, folder):
    """Index after the whole change feed replaced its documents; all of it is then marked."""
    pages = _customer_pages(spark, folder)
    index = indexing.documents(pages.filter("indexed_at is not null")).withColumn("title", F.lit("old"))
    feed = indexing.pending(pages)
    after = indexing.replace_documents(index, indexing.documents(feed))
    marked = page_table.set_index_mark(pages, feed, as_of()).select("id", stamp(F.col("indexed_at")).alias("indexed_at"))
    return after.join(marked, "id").select(
        "id", "url", text_or_dash(F.col("title")).alias("title"), F.round("crawled_at", 3).alias("crawled_at"),
        "rank_score", "indexed_at",
    )


def index_cycle(spark, folder):
    """All pending pages indexed: stored HTML to main text, reading ease and documents."""
    raw = corpus.distinct_pages(load(spark, folder, "pages"), "page_id")
    empty = spark.createDataFrame([], schemas.PAGES)
    record = page_table.page_record(raw, F.lit(0), days_before(F.col("seq")))
    pages = cut_lineage(page_table.upsert(empty, record))
    index = spark.createDataFrame([], schemas.INDEX_DOCUMENTS)
    after, index = corpus.index_cycle(pages, raw_html.store_rows(raw), index, as_of())
    return after.select("url", F.round("readability_score", 6).alias("reading_ease"),
                        F.col("indexed_at").isNotNull().alias("indexed")).join(
        index.select("url", F.length("body_text").cast("long").alias("body_chars"), F.sha2("body_text", 256).alias("body_hash")),
        "url", "left",
    ).select("url", "reading_ease", "indexed", F.coalesce("body_chars", F.lit(0).cast("long")).alias("body_chars"),
             text_or_dash(F.col("body_hash")).alias("body_hash"))


# Search

def _search_documents(spark, folder) -> DataFrame:
    """Documents as index documents: first line is the title, the source is the domain."""
    d = load(spark, folder, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("http://docs.example/"), F.col("doc_id").cast("string")).alias("url"),
        first.alias("title"), F.concat_ws(" ", "source", "lang").alias("meta_description"),
        F.col("source").alias("domain"), F.col("lang").alias("language"),
        (F.col("n_chars") % 100 / F.lit(100.0)).alias("rank_score"),
        F.substr("text", F.length(first) + 2).alias("body_text"),
    )


def _queries(spark, folder) -> DataFrame:
    """One query per benchmark item, its whole text with the fourth word misspelt; and an empty one.

    Some items ask for a language, some for a domain, as their key says.
    """
    b = load(spark, folder, "benchmark")
    words = text.words(F.col("text"))
    misspelt = F.transform(words, lambda w, i: F.when(
        i == 3, F.concat(F.substr(w, F.lit(1), F.lit(2)), F.lit("x"), F.substr(w, F.lit(3)))
    ).otherwise(w))
    kind = F.col("item_id") % 4
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit("").alias("text"))
    return b.select("item_id", "text").unionByName(empty).select(
        F.col("item_id").alias("qid"), F.array_join(misspelt, " ").alias("q"),
        F.when(kind == 1, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("domain"),
        F.when(kind == 2, F.lit("en")).alias("language"),
    )


def term_postings(spark, folder):
    d = _search_documents(spark, folder).select(F.col("id").alias("doc_id"), "title", F.col("body_text").alias("body"))
    return indexing.term_vectors(d, "doc_id").select(
        "doc_id", "term", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions")
    )


def _begun_queries(spark, folder) -> DataFrame:
    """The first, second and sixth word of each benchmark item, the last cut to its first three letters; every fifth ends with a blank."""
    b = load(spark, folder, "benchmark")
    words = text.words(F.col("text"))
    begun = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.substr(F.get(words, F.lit(5)), F.lit(1), F.lit(3)))
    nothing = F.lit(None).cast("string")
    return b.select(
        F.col("item_id").alias("qid"), F.when(F.col("item_id") % 5 == 0, F.concat(begun, F.lit(" "))).otherwise(begun).alias("q"),
        nothing.alias("domain"), nothing.alias("language"),
    )


def _search(spark, folder, queries_of=_queries, **options):
    """Queries against a store of postings in term order."""
    documents = _search_documents(spark, folder)
    queries = cut_lineage(queries_of(spark, folder))
    path = work_path(spark, "postings")
    indexing.write_postings(indexing.postings(documents), path)
    postings = tables.read_table(spark, path)
    answers, matches = search.match_documents(queries, postings, documents, **options)
    return documents, queries, postings, answers, matches


def search_postings(spark, folder):
    return indexing.postings(_search_documents(spark, folder))


def search_typo(spark, folder):
    words = search.query_terms(_queries(spark, folder)).select("word").distinct()
    vocabulary = indexing.postings(_search_documents(spark, folder)).select("term").distinct()
    return search.match_terms(cut_lineage(words), cut_lineage(vocabulary))


def search_swaps(spark, folder):
    """Every longer word of the benchmark with its two middle letters swapped, and what answers it."""
    found = load(spark, folder, "benchmark").select(F.explode(text.words(text.fold(F.col("text")))).alias("w")).filter("length(w) >= 5")
    half = F.floor(F.length("w") / 2).cast("int")
    part = lambda start, size: F.substr("w", start, size)
    swapped = F.concat(part(F.lit(1), half - 1), part(half + 1, F.lit(1)), part(half, F.lit(1)), F.substr("w", half + 2))
    vocabulary = indexing.postings(_search_documents(spark, folder)).select("term").distinct()
    return search.match_terms(cut_lineage(found.select(swapped.alias("word")).distinct()), cut_lineage(vocabulary))


def search_ranked(spark, folder):
    _, queries, postings, answers, matches = _search(spark, folder)
    return search.rank(queries, answers, matches, postings)


def search_prefix(spark, folder):
    """Requests as they are typed: the last word may be the start of a longer one."""
    _, queries, postings, answers, matches = _search(spark, folder, _begun_queries, prefix=True)
    return search.rank(queries, answers, matches, postings)


def search_facets(spark, folder):
    return search.facets(_search(spark, folder)[-1])


def search_facet_maps(spark, folder):
    maps = search.facet_maps(search.facets(_search(spark, folder)[-1]))
    shown = lambda name: F.array_join(F.transform(
        F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    ), ",").alias(name)
    return maps.select("qid", shown("domain"), shown("language"))


def _results(spark, folder):
    documents, queries, postings, answers, matches = _search(spark, folder)
    return search.results(search.rank(queries, answers, matches, postings), answers, documents, postings)


def search_snippets(spark, folder):
    return _results(spark, folder)


def search_display(spark, folder):
    return search.display(_results(spark, folder))


# The fetch log

def _robots_files(spark, folder) -> DataFrame:
    """A robots.txt per site, made from the languages that its pages are in."""
    part = F.regexp_extract("norm_url", r"^[a-z]+://[^/]+/([^/?]*)", 1)
    site = pages_of(spark, folder).select(urls.base_url(F.col("norm_url")).alias("base_url"), part.alias("part"))
    lines = [
        F.lit("# rules of this site"), F.lit("User-agent: OtherBot"), F.lit("Disallow: /"), F.lit(""),
        F.lit("User-agent: *"), F.concat(F.lit("Disallow: /"), F.min("part"), F.lit("/1")),
        F.concat(F.lit("Allow: /"), F.min("part")), F.concat(F.lit("Disallow: /"), F.max("part"), F.lit("/2 # no")),
    ]
    named = [F.lit(""), F.lit("User-agent: corpusbot"), F.lit("Disallow: /en/3"), F.lit("Disallow:")]
    whole = F.when(F.min("part") == "de", F.concat_ws("\n", *lines, *named)).otherwise(F.concat_ws("\n", *lines))
    return site.groupBy("base_url").agg(whole.alias("robots_txt"))


def robots_filter(spark, folder):
    rules = robots.parse_rules(_robots_files(spark, folder))
    candidates = pages_of(spark, folder).select("page_id", F.col("norm_url").alias("url"))
    return robots.allowed(candidates, rules, AGENT).select("page_id", "url", "allowed")


def fetch_schedule(spark, folder):
    depth = F.length(F.regexp_replace("url", "[^/]", "")) - 2
    queue = corpus.distinct_pages(load(spark, folder, "pages"), "page_id").select("url", depth.alias("depth"))
    return frontier.fetch_schedule(queue, delay_seconds=1.5, max_per_minute=60)


def address_filter(spark, folder):
    """Addresses of each host, made from its name; the first hex digit picks the kind."""
    host = urls.netloc(F.col("norm_url"))
    hosts = pages_of(spark, folder).select(host.alias("domain")).distinct()
    digest = F.md5("domain")
    octet = lambda i: F.conv(F.substring(digest, i, 2), 16, 10)
    v4 = lambda *o: F.concat_ws(".", *o)
    kind = F.substring(digest, 1, 1)
    first = (
        F.when(kind == "0", v4(F.lit("10"), octet(2), octet(4), octet(6)))
        .when(kind == "1", v4(F.lit("172"), octet(2), octet(4), octet(6)))
        .when(kind == "2", v4(F.lit("192"), F.lit("168"), octet(4), octet(6)))
        .when(kind == "3", v4(F.lit("127"), F.lit("0"), F.lit("0"), octet(6)))
        .when(kind == "4", v4(F.lit("100"), octet(2), octet(4), octet(6)))
        .when(kind == "5", F.concat(F.lit("fe80::"), F.substring(digest, 3, 4)))
        .when(kind == "6", F.concat(F.lit("2001:db8::"), F.substring(digest, 3, 4)))
        .when(kind == "7", F.lit("not-an-address"))
        .otherwise(v4(octet(2), octet(4), octet(6), octet(8)))
    )
    listed = hosts.withColumn("addresses", F.array(first, F.lit("8.8.8.8")))
    return listed.select(
        "domain", F.element_at("addresses", 1).alias("address"),
        addresses.is_private_address(F.element_at("addresses", 1)).alias("private"),
        addresses.is_fetchable(F.col("addresses")).alias("fetchable"),
    )


def _fetch_log(spark, folder) -> DataFrame:
    """Events as fetches: an error is a failed fetch, a signup is disallowed, users are urls."""
    e = load(spark, folder, "events")
    kind = F.col("event_type")
    outcome = outcomes.fetch_outcome(
        kind != "signup",
        F.when(kind == "error", F.when(F.col("value") < 20, F.lit(503))).when(kind == "purchase", 404).otherwise(200),
        F.when(kind == "click", "text/html; charset=utf-8").when(F.col("value") < 30, "text/html").otherwise("image/png"),
    )
    return e.select(
        "event_id", F.concat(F.lit("http://site"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit(".example/"),
                             F.col("user_id").cast("string")).alias("url"), outcome.alias("outcome"),
    ).withColumn("domain", urls.netloc(F.col("url")))


def fetch_outcomes(spark, folder):
    return _fetch_log(spark, folder).select("event_id", "url", "outcome")


def domain_stats(spark, folder):
    return outcomes.domain_stats(_fetch_log(spark, folder))


def crawl_counters(spark, folder):
    """All totals in one row: the fetch log, the recorded links, the index and its queue."""
    pages = _customer_pages(spark, folder)
    others = [outcomes.link_counters(outlinks_of(spark, folder)), indexing.queue_depth(pages), indexing.indexed_total(pages)]
    totals = outcomes.crawl_counters(_fetch_log(spark, folder))
    return totals.select("*", *[p.select(c).scalar().alias(c) for p in others for c in p.columns])


def retry_state(spark, folder):
    return outcomes.retry_state(_fetch_log(spark, folder))


def score_histogram(spark, folder):
    counted = stats.histogram(load(spark, folder, "events"), "value")
    return counted.select(
        F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string")).alias("le"),
        "n", F.round("total", 2).alias("total"), "observations",
    )


def config_overlay(spark, folder):
    """Event settings over the defaults: ``k`` as the depth limit, the whole as an extra key."""
    e = load(spark, folder, "events")
    stored = F.concat(F.lit('{"max_depth": '), F.get_json_object("props", "$.k"), F.lit(', "nested": '), F.col("props"), F.lit("}"))
    laid = config.overlay(F.when(F.col("event_type") != "error", stored).otherwise(F.lit("not json")))
    return e.select("event_id", laid.alias("c")).select(
        "event_id", config.setting(F.col("c"), "max_depth", "int").alias("max_depth"),
        config.setting(F.col("c"), "delay_per_domain", "double").alias("delay_per_domain"),
        config.setting(F.col("c"), "save_to_db", "boolean").alias("save_to_db"),
        F.coalesce(F.get_json_object(F.element_at("c", F.lit("nested")), "$.k"), F.lit("-")).alias("nested_k"),
        F.size("c").alias("settings"),
    )


# Streams. Each reads the files of the folder as a stream and runs until all are read.

def stream_window_counts(spark, folder):
    source = read_files(spark, folder, load(spark, folder, "events").schema, "events.parquet")
    path = work_path(spark, "windows")
    counters.count_windows(source, path, work_path(spark, "windows-state")).awaitTermination()
    return spark.read.parquet(f"{path}/batch=*").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n"
    )


def _ingested(spark, folder) -> DataFrame:
    source = read_files(spark, folder, load(spark, folder, "pages").schema, "pages.parquet")
    path = work_path(spark, "pages")
    ingest.ingest(
        source, path, work_path(spark, "pages-state"), as_of(), skip=WHOLE_PAGE, order="page_id"
    ).awaitTermination()
    return tables.read_log(spark, path, ingest.LOG)


def stream_ingest(spark, folder):
    log = _ingested(spark, folder)
    pages = ingest.current_pages(log)
    sent = ingest.current_links(log).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("links"))
    return pages.join(sent, "url", "left").select(
        "url", "domain", "depth", "is_stub", F.coalesce("links", F.lit(0)).alias("links"),
        F.when(F.col("is_stub"), F.lit("-")).otherwise(F.sha2(F.concat("title", "body_text"), 256)).alias("content_hash"),
    )


def stream_retry(spark, folder):
    schema = load(spark, folder, "events").schema
    source = read_files(spark, folder, schema, "events.parquet")
    log = source.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.when(F.col("event_type") == "error", outcomes.ERROR).otherwise(outcomes.CRAWLED).alias("outcome"),
    )
    path = work_path(spark, "retries")
    retry.track_retries(
        log, lambda batch, number: tables.append_batch(batch, path, number), work_path(spark, "retries-state")
    ).awaitTermination()
    changes = spark.read.option("basePath", path).parquet(path)
    latest = F.max_by(F.struct("failures", "decision"), "batch").alias("state")
    return changes.groupBy("url").agg(latest).select("url", "state.failures", "state.decision")


def stream_recent_retries(spark, folder):
    """Failures of each user since the last pause of more than 30 hours."""
    schema = load(spark, folder, "events").schema
    source = read_files(spark, folder, schema, "events.parquet")
    log = source.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), "ts",
        F.when(F.col("event_type") == "error", outcomes.ERROR).otherwise(outcomes.CRAWLED).alias("outcome"),
    )
    path = work_path(spark, "recent-retries")
    recent_retries.track_recent_retries(
        log, lambda batch, number: tables.append_batch(batch, path, number), work_path(spark, "recent-state"), quiet="30 hours"
    ).awaitTermination()
    changes = spark.read.option("basePath", path).parquet(path)
    latest = F.max_by(F.struct("failures", "decision"), "batch").alias("state")
    return changes.groupBy("url").agg(latest).select("url", "state.failures", "state.decision")


def latency_histogram(spark, folder):
    """Event values as seconds of a request, over the bounds of request times."""
    counted = stats.histogram(load(spark, folder, "events").withColumn("seconds", F.col("value") / 10), "seconds", stats.LATENCY_BOUNDS)
    return counted.select(
        F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le"), "n",
        F.round("total", 2).alias("total"), "observations",
    )


def retry_effects(spark, folder):
    """What failed fetches leave in the queue, the visited set and the page table."""
    state = outcomes.retry_state(_fetch_log(spark, folder))
    known = state.select("url", F.pmod(F.length("url"), F.lit(3)).alias("depth"))
    empty = spark.createDataFrame([], schemas.FRONTIER)
    pages = known.select("url", F.lit(None).cast("timestamp").alias("deleted_at"))
    queue, visited, table = corpus.apply_retries(empty, known.select("url"), pages, state.join(known, "url"), as_of())
    return (
        table.join(queue, "url", "left").join(visited.select("url", F.lit(True).alias("is_visited")), "url", "left")
        .select("url", F.coalesce("depth", F.lit(-1)).alias("queued_at"), F.coalesce("is_visited", F.lit(False)).alias("is_visited"),
                F.col("deleted_at").isNotNull().alias("is_deleted"))
    )


def _changed_pages(spark, folder) -> DataFrame:
    """The pages as a stream of changes that were never indexed."""
    source = read_files(spark, folder, load(spark, folder, "pages").schema, "pages.parquet")
    u = urls.normalize_url(F.col("url"))
    return source.select(
        F.col("page_id").alias("id"), u.alias("url"), html.title(F.col("html")).alias("title"),
        html.meta_description(F.col("html")).alias("meta_description"), urls.netloc(u).alias("domain"),
        F.lit("unknown").alias("language"), as_of().alias("crawled_at"), F.lit(None).cast("double").alias("rank_score"),
        F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(None).cast("timestamp").alias("deleted_at"), "html",
    )


def stream_index_sync(spark, folder):
    """The index after two streams: all pages, then every eleventh one deleted; and the marks for the page table."""
    changed, path = _changed_pages(spark, folder), work_path(spark, "index")
    index_sync.sync_index(changed, path, work_path(spark, "index-state"), as_of()).awaitTermination()
    gone = changed.filter("id % 11 = 0").withColumn("deleted_at", as_of()).withColumn("indexed_at", as_of())
    index_sync.sync_index(gone, path, work_path(spark, "index-state"), as_of(), first_batch=1_000_000).awaitTermination()
    log = tables.read_log(spark, path, index_sync.LOG)
    marks = index_sync.index_marks(log).withColumnRenamed("id", "marked_id")
    index = index_sync.current_index(log)
    return index.join(marks, F.col("id") == F.col("marked_id")).select(
        "id", "url", "title", "crawled_at", "rank_score", F.sha2("body_text", 256).alias("body_hash"),
        F.round("readability_score", 6).alias("reading_ease"), stamp(F.col("indexed_at")).alias("indexed_at"),
    )


def stream_postings(spark, folder):
    """Live postings after three streams: all pages, every eleventh deleted, every seventh crawled again with more text.

    The postings of the first two are compacted before the third.
    """
    changed, path, first, second = _changed_pages(spark, folder), *(work_path(spark, n) for n in ("index", "postings", "compacted"))

    def sync(rows, batch, postings_path):
        index_sync.sync_index(
            rows, path, work_path(spark, "index-state"), as_of(), first_batch=batch, postings_path=postings_path
        ).awaitTermination()
        log = tables.read_log(spark, path, index_sync.LOG)
        return tables.read_log(spark, postings_path, indexing.POSTINGS_LOG), index_sync.live_versions(log)

    sync(changed, 0, first)
    gone = changed.filter("id % 11 = 0").withColumn("deleted_at", as_of()).withColumn("indexed_at", as_of())
    indexing.compact_postings(*sync(gone, 1_000_000, first), second, 1_000_000)
    again = changed.filter("id % 7 = 0 and id % 11 <> 0").withColumn("indexed_at", days_before(F.lit(1)))
    more = again.withColumn("html", F.concat("html", F.lit("<p>These words came with the second crawl of the page.</p>")))
    return indexing.live_postings(*sync(more, 2_000_000, second))


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    url_normalize, url_domain, url_valid, url_key, href_resolve,
    page_title, page_meta, page_text, page_insufficient, page_main_text, page_nested, raw_html_join,
    page_links_raw, page_links_valid, page_links_content, link_stubs, link_edges, edge_cascade,
    out_degree, pagerank_pages, pagerank_parts, pagerank_redistributed, bfs_frontier, frontier_pop, frontier_merge, visited_update,
    composite_score, top_pages, readability, language_id, page_language, corpus_language,
    page_upsert, page_store_upsert, soft_delete, index_pending, index_queue_depth, index_cleanup, index_documents, index_cycle,
    term_postings, search_postings, search_typo, search_swaps, search_ranked, search_prefix, search_facets, search_facet_maps,
    search_snippets, search_display,
    robots_filter, fetch_schedule, address_filter, fetch_outcomes, domain_stats, crawl_counters, retry_state, retry_effects,
    score_histogram, latency_histogram, config_overlay,
    stream_window_counts, stream_ingest, stream_retry, stream_recent_retries, stream_index_sync, stream_postings,
]
QUERIES = {q.__name__: q for q in ALL}
