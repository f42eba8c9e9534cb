"""Document index: change feed, documents, postings, replacement and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas
from pagemill.functions import html, scores, text
from pagemill.operators.sizing import sized
from pagemill.session import cut_lineage

# Searchable fields, most important first.
FIELDS = ["title", "body_text", "meta_description"]

# Frequent words whose stems are made once and sent to all tasks.
FREQUENT_WORDS = 100_000


def is_stale() -> Column:
    """Never indexed, or crawled again since; deleted pages count in the queue depth."""
    return F.col("indexed_at").isNull() | (F.col("crawled_at") > F.col("indexed_at"))


def pending(pages: DataFrame, include_stubs: bool = True) -> DataFrame:
    """Pages whose document is missing or old, without deleted ones."""
    rows = pages.filter(is_stale() & F.col("deleted_at").isNull())
    return rows if include_stubs else rows.filter(F.col("depth") >= 0)


def queue_depth(pages: DataFrame) -> DataFrame:
    return pages.filter(is_stale()).agg(F.count("*").alias("queue_depth"))


def indexed_total(pages: DataFrame) -> DataFrame:
    """Pages that are in the index."""
    return pages.agg(F.count_if(F.col("indexed_at").isNotNull() & F.col("deleted_at").isNull()).alias("indexed_total"))


def index_batch(pages: DataFrame, n: int | None = None, include_stubs: bool = True) -> DataFrame:
    """All pending pages, or the oldest ``n``."""
    rows = pending(pages, include_stubs)
    return rows if n is None else rows.orderBy("crawled_at", "id").limit(n)


def to_clean(pages: DataFrame) -> DataFrame:
    """Deleted pages that are still in the index."""
    return pages.filter(F.col("deleted_at").isNotNull() & F.col("indexed_at").isNotNull())


def cleanup_batch(pages: DataFrame, n: int | None = None) -> DataFrame:
    """All pages to clean, or the ``n`` of the smallest ids."""
    rows = to_clean(pages)
    return rows if n is None else rows.orderBy("id").limit(n)


def with_body(batch: DataFrame, raw_html: DataFrame) -> DataFrame:
    """Pages with the main text of their stored HTML and its reading ease.

    A page without stored HTML gets an empty body and 0.0. The keys of a batch of checked size are
    broadcast, so that the HTML of other pages is dropped where it is read instead of being shuffled.
    """
    stored = raw_html.select("raw_html_path", "html").join(
        sized(batch.select("raw_html_path")), "raw_html_path", "left_semi"
    )
    return (
        batch.join(stored, "raw_html_path", "left")
        .withColumn("body_text", F.coalesce(html.main_text(F.col("html")), F.lit("")))
        .drop("html")
        .withColumn("readability_score", text.reading_ease(F.col("body_text")))
    )


def documents(pages: DataFrame) -> DataFrame:
    """Index documents of pages: default score for unranked ones, epoch seconds, no path."""
    given = {
        "crawled_at": scores.epoch_seconds(F.col("crawled_at")),
        "rank_score": F.coalesce("rank_score", F.lit(scores.DEFAULT_RANK_SCORE)),
    }
    return pages.select(*[given.get(n, F.col(n)).alias(n) for n in schemas.INDEX_DOCUMENTS.fieldNames()])


def replace_documents(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Index with the batch added; a document of the same url is replaced."""
    return delete_documents(index, batch).unionByName(batch)


def delete_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Index without the documents of ``gone``; if those are few, the index is not shuffled."""
    return index.join(sized(gone.select("url")), "url", "left_anti")


def term_vectors(docs: DataFrame, key: str) -> DataFrame:
    """English term vector of ``title`` and ``body``: ``(key, term, positions)``.

    Positions count every word, stop words included; stop words are then left out and the other words stemmed. Most words of
    texts are few different ones: the most frequent are stemmed once and sent to the words, a rare one is stemmed where it stands.
    Texts are spread by key before they are cut, so their words are never shuffled.
    """
    whole = docs.select(key, F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))).alias("whole"))

    def tokens(texts: DataFrame) -> DataFrame:
        found = texts.select(key, F.posexplode(text.words(F.col("whole"))).alias("place", "word"))
        return found.filter(~F.col("word").isin(text.STOP_WORDS))

    frequent = cut_lineage(
        tokens(whole).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word")
    )
    stems = cut_lineage(frequent.select("word", text.stem(F.col("word")).alias("known")))
    stemmed = tokens(whole.repartition(key)).join(sized(stems), "word", "left").select(
        key, F.coalesce("known", text.stem(F.col("word"))).alias("term"), (F.col("place") + 1).alias("pos")
    )
    return stemmed.groupBy(key, "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def postings(docs: DataFrame, key: str = "id") -> DataFrame:
    """Search postings ``(term, key, field, pos)``: one row per word of the searchable fields.

    Terms are folded words without stemming. ``field`` is the rank of the field, 0 best.
    Building them needs no shuffle: nothing is collected per term or document, so a term
    that is in every document is just many rows.
    """
    fields = F.array(*[
        F.struct(F.lit(i).alias("field"), F.coalesce(F.col(name), F.lit("")).alias("content"))
        for i, name in enumerate(FIELDS)
    ])
    tokens = docs.select(key, F.inline(fields)).select(
        key, "field", F.posexplode(text.words(text.fold_body(F.col("content")))).alias("pos", "term")
    )
    return tokens.select("term", key, "field", (F.col("pos") + 1).alias("pos"))


def write_postings(rows: DataFrame, path: str) -> None:
    """Store postings in term order, so that a search reads only the files of its terms.

    The order goes on to the document and position, which spreads a frequent term over as
    many files as it needs.
    """
    keys = [c for c in rows.columns if c != "term"]
    ordered = rows.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys)
    ordered.write.mode("overwrite").parquet(path)


#: A posting in a log of batches: ``version`` is the batch that its document was written in.
POSTINGS_LOG = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("id", T.LongType()), T.StructField("field", T.IntegerType()),
    T.StructField("pos", T.IntegerType()), T.StructField("version", T.LongType()),
])


def append_postings(docs: DataFrame, path: str, batch: int) -> None:
    """Postings of the documents of one batch, which has one row per document, in a folder of their own and in term order.

    Nothing that is already stored is read or written again; a replayed batch replaces itself.
    """
    rows = postings(docs).select("term", "id", "field", "pos", F.lit(batch).cast("long").alias("version"))
    write_postings(rows, f"{path}/batch={batch}")


def live_postings(log: DataFrame, versions: DataFrame) -> DataFrame:
    """Postings ``(term, id, field, pos)`` of a log whose document is the one that counts.

    ``versions`` is the stored table ``(id, version)`` of those documents. Postings of replaced and deleted documents stay in the
    log until it is compacted. A search's terms still reach the scan, since the filter on terms goes below this join.
    """
    return log.join(sized(versions.select("id", "version")), ["id", "version"], "left_semi").select("term", "id", "field", "pos")


def compact_postings(log: DataFrame, versions: DataFrame, path: str, last_batch: int) -> None:
    """A new log at ``path`` whose only batch, the last one folded, has the live postings, cut by ranges of terms."""
    live = log.join(sized(versions.select("id", "version")), ["id", "version"], "left_semi")
    write_postings(live.select("term", "id", "field", "pos", "version"), f"{path}/batch={last_batch}")
