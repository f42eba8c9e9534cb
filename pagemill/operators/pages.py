"""The keyed page table: upsert, soft delete, index marks.

Every operation is a function from table to table. Incoming data is a table of page
writes (``schemas.PAGE_WRITES``); a write of a link stub only inserts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import html, scores, urls
from pagemill.operators import links
from pagemill.operators.sizing import sized
from pagemill.session import cut_lineage

# Set by the first write of a url and then left alone.
INSERT_ONLY = ["meta_description", "domain", "depth", "raw_html_path"]
# Set by every page write.
UPDATABLE = ["title", "body_text", "language", "text_length", "crawled_at"]


def page_record(
    pages: DataFrame, depth: Column, crawled_at: Column, language: Column | None = None,
    title_chars: int | None = None, body_chars: int | None = None, extra: list[str] | None = None,
) -> DataFrame:
    """Page writes extracted from ``(url, html, seq)`` rows; ``url`` is already normalised.

    Extraction works on the whole page and stores the whole text; ``title_chars`` and ``body_chars``
    are for a store of fixed widths. ``text_length`` is always that of the whole text. ``extra`` columns are kept.
    """

    def fitted(column: Column, width: int | None) -> Column:
        return column if width is None else F.substring(column, 1, width)

    whole = pages.withColumn("whole_text", html.visible_text(F.col("html")))
    return whole.select(
        "url",
        fitted(html.title(F.col("html")), title_chars).alias("title"),
        html.meta_description(F.col("html")).alias("meta_description"),
        urls.netloc(F.col("url")).alias("domain"),
        depth.cast("int").alias("depth"),
        fitted(F.col("whole_text"), body_chars).alias("body_text"),
        urls.raw_html_key(F.col("url")).alias("raw_html_path"),
        (language if language is not None else F.lit("unknown")).alias("language"),
        crawled_at.alias("crawled_at"),
        F.lit(False).alias("is_stub"),
        F.col("seq").cast("long").alias("seq"),
        F.length("whole_text").alias("text_length"),
        *(extra or []),
    ).select(*schemas.PAGE_WRITES.fieldNames(), *(extra or []))


def stub_record(targets: DataFrame, crawled_at: Column, seq: Column) -> DataFrame:
    """Stub writes for ``target_url`` rows; whether a stub is needed is decided when writes are folded."""
    unique = targets.select(F.col("target_url").alias("url")).distinct()
    given = {
        "url": F.col("url"), "domain": urls.stub_domain(F.col("url")), "depth": F.lit(links.STUB_DEPTH),
        "crawled_at": crawled_at, "is_stub": F.lit(True), "seq": seq,
    }
    return unique.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAGE_WRITES
    ])


def fold_writes(writes: DataFrame, promote_stubs: bool = False) -> DataFrame:
    """One row per url: what a sequence of writes leaves behind.

    Insert-only columns come from the first write, the others from the last page write.
    Both are aggregates with a map-side part, so many writes of one url cost no more than
    one, and only the last page write carries its body. A page first seen as a stub keeps the stub's insert-only values unless
    ``promote_stubs`` is set.
    """
    columns = [c for c in schemas.PAGE_WRITES.fieldNames() if c not in ("url", "is_stub", "seq")]
    page = ~F.col("is_stub")
    row = F.struct(*columns, "seq", "is_stub")
    # What a page writes last replaces its other columns; of a first write they count for a stub only.
    first_row = F.struct(
        *[F.col(c) if c in INSERT_ONLY else F.when(~page, F.col(c)).alias(c) for c in columns], "seq", "is_stub"
    )
    folded = writes.groupBy("url").agg(
        F.min_by(first_row, F.struct("is_stub", "seq") if promote_stubs else F.struct("seq")).alias("first"),
        F.max_by(F.when(page, row), F.when(page, F.col("seq"))).alias("last"),
    )
    latest = F.coalesce("last", "first")
    return folded.select(
        "url",
        *[(F.col("first") if c in INSERT_ONLY else latest)[c].alias(c) for c in columns],
        F.col("last").isNull().alias("is_stub"),
        latest["seq"].alias("seq"),
    )


def new_page_columns() -> dict[str, Column]:
    """Defaults of the columns that a crawl does not write."""
    return {
        "rank_score": F.lit(scores.DEFAULT_RANK_SCORE), "freshness_score": F.lit(0.0), "quality_score": F.lit(0.0),
        "readability_score": F.lit(0.0), "domain_score": F.lit(0.0),
        "indexed_at": F.lit(None).cast("timestamp"), "deleted_at": F.lit(None).cast("timestamp"),
    }


def upsert(pages: DataFrame, writes: DataFrame, promote_stubs: bool = False) -> DataFrame:
    """Page table after the writes.

    On a url that exists, only the updatable columns change: its first-seen columns, its
    scores, its index mark and its delete mark stay. New urls get ids after the largest.

    The folded batch is stored once. A batch of checked size is sent to the pages, which then stay where
    they are; only urls, not rows, are compared and numbered.
    """
    return upsert_folded(pages, cut_lineage(fold_writes(writes, promote_stubs)), promote_stubs)


def upsert_folded(pages: DataFrame, batch: DataFrame, promote_stubs: bool = False, all_pages: DataFrame | None = None) -> DataFrame:
    """``pages`` after the folded writes ``batch``, a stored table. New ids follow the largest of ``all_pages``, of which ``pages`` is a part."""
    known = cut_lineage(pages.select("url").join(sized(batch.select("url")), "url", "left_semi"))
    numbers = links.with_new_ids(pages if all_pages is None else all_pages, batch.select("url").join(known, "url", "left_anti"))
    fresh = batch.join(numbers.select("url", "id"), "url")

    incoming = batch.select("url", "is_stub", *[F.col(c).alias(f"new_{c}") for c in UPDATABLE + INSERT_ONLY])
    page_write = F.coalesce(~F.col("is_stub"), F.lit(False))

    def value(name: str) -> Column:
        if name in UPDATABLE:
            return F.when(page_write, F.col(f"new_{name}")).otherwise(F.col(name))
        if promote_stubs and name in INSERT_ONLY:
            return F.when(page_write & (F.col("depth") == links.STUB_DEPTH), F.col(f"new_{name}")).otherwise(F.col(name))
        return F.col(name)

    names = schemas.PAGES.fieldNames()
    updated = pages.join(sized(incoming), "url", "left").select(*[value(n).alias(n) for n in names])
    defaults = new_page_columns()
    inserted = fresh.select(*[defaults.get(n, F.col(n)).alias(n) for n in names])
    return updated.unionByName(inserted)


def add_stubs(pages: DataFrame, stubs: DataFrame, crawled_at: Column) -> DataFrame:
    """Pages and the stub rows ``(id, url, domain, depth)`` of link targets."""
    given = {"id", "url", "domain", "depth"}
    defaults = {**new_page_columns(), "crawled_at": crawled_at}
    return pages.unionByName(stubs.select(*[
        F.col(f.name) if f.name in given else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.PAGES
    ]))


def soft_delete(pages: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Set ``deleted_at`` on pages whose url failed for good."""
    gone = cut_lineage(failed.select("url").distinct()).withColumn("gone", F.lit(True))
    return pages.join(sized(gone), "url", "left").withColumn(
        "deleted_at", F.when(F.col("gone"), now).otherwise(F.col("deleted_at"))
    ).drop("gone")


def set_index_mark(pages: DataFrame, ids: DataFrame, indexed_at: Column) -> DataFrame:
    """Set ``indexed_at`` (or clear it with a null) for the given ids."""
    marked = cut_lineage(ids.select("id").distinct()).withColumn("marked", F.lit(True))
    return pages.join(sized(marked), "id", "left").withColumn(
        "indexed_at", F.when(F.col("marked"), indexed_at).otherwise(F.col("indexed_at"))
    ).drop("marked")


def set_columns_by_id(pages: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Replace ``columns`` where ``values(id, columns)`` has new ones, in one join; a null changes nothing.

    Values of checked size are sent to the pages, which then are not shuffled.
    """
    new = cut_lineage(values.select("id", *[F.col(c).alias(f"new_{c}") for c in columns]))
    joined = pages.join(sized(new), "id", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in pages.columns])
