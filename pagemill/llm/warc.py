"""Content-addressed WARC archive.

``write`` makes two tables below a folder: ``payloads``, with every different payload's bytes once under its
SHA-256, and ``headers``, with the exact header block of every record and the digest it points to. ``read``
joins them back to the records, and ``export`` writes them out as plain WARC files.

Of records with equal payloads of at least ``min_revisit_bytes``, the one with the largest id is a ``response``
and the others ``revisit`` it; records of smaller payloads are all responses, which still share their bytes in the store.

A digest is verified twice: when written, all records of a SHA-256 must agree in SHA-1, length and a 64-bit hash;
when read, the stored bytes must give the SHA-256 again. Anything else is an error, not a record.

Defined results: a null payload is the empty one. Records that repeat whole (id, url, payload) are archived
once, or with ``repeats`` as often as they come: the repeats are numbered in their record ids, and the first of them alone can
be the response that others revisit. Records that share an id but differ are records each. A null id counts as the smallest. A null url is
the empty one; characters that end a line are percent-encoded in it. Extra columns are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import stored

CRLF = "\r\n"
#: The part of a record's block before its payload.
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


def _record_id(*parts: Column) -> Column:
    """A name-based URN, the same on every run."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


# Characters at which some reader ends a line.
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _clean(value: Column) -> Column:
    """A header value in one line: what could end a line is percent-encoded, so different values stay different."""
    out = F.coalesce(value, F.lit(""))
    for char in LINE_ENDS:
        out = F.replace(out, F.lit(char), F.lit("".join(f"%{byte:02X}" for byte in char.encode())))
    return out


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
          date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 1000, repeats: bool = False) -> None:
    """Archive ``pages`` into ``folder``; the payload is text, stored in UTF-8. With ``repeats`` every row is a record."""
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), _clean(F.col(f"`{url}`")).alias("url"), body.alias("body"))
    records = stored(rows.select(
        "id", "url", F.sha2("body", 256).alias("digest"), F.sha1("body").alias("sha1"),
        F.octet_length("body").cast("long").alias("size"), F.xxhash64("body").alias("check"),
    ).groupBy("id", "url", "digest", "sha1", "size", "check").agg(F.count("*").alias("rows")), "records")
    # The largest id of a payload, the largest url among its rows.
    first = F.max(F.struct(F.col("id").isNotNull().alias("has"), F.col("id"), F.col("url"))).alias("first")
    stores = records.groupBy("digest").agg(
        first, F.countDistinct("sha1", "size", "check").alias("kinds")
    ).select(
        F.when(F.col("kinds") > 1, F.raise_error(F.lit("different payloads share a SHA-256"))).otherwise(F.col("digest")).alias("digest"),
        F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"),
    )
    stores = stored(stores, "stores")
    copies = F.sequence(F.lit(1).cast("long"), F.col("rows") if repeats else F.lit(1).cast("long"))
    marked = records.join(stores, "digest").withColumn("copy", F.explode(copies))
    is_first = (F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("url") == F.col("first_url"))
    kind = F.when((F.col("size") < min_revisit_bytes) | is_first, F.lit("response")).otherwise(F.lit("revisit"))
    named = [F.col("id"), F.col("url"), F.col("digest")]
    own = F.when(F.col("copy") == 1, _record_id(*named)).otherwise(_record_id(*named, F.col("copy")))
    other = _record_id(F.col("first_id"), F.col("first_url"), F.col("digest"))
    revisit = F.col("type") == "revisit"
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("type")), F.concat(F.lit("WARC-Record-ID: "), own),
        F.concat(F.lit("WARC-Date: "), F.lit(date)), F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("X-Source-Id: "), F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), other)),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Source-Id: "), F.coalesce(F.col("first_id").cast("string"), F.lit("")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
    ]
    head = F.concat(F.array_join(F.array_compact(F.array(*lines)), CRLF), F.lit(CRLF + CRLF + HTTP))
    marked.withColumn("type", kind).select("digest", head.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    # Bytes travel once, to meet the row that stands for their digest; equal rows are dropped where they meet.
    def keyed(rows: DataFrame, id: str, url: str, *more: Column) -> DataFrame:
        return rows.select(F.col(id).isNull().alias("none"), F.coalesce(id, F.lit(0)).alias("id"), F.col(url).alias("url"), *more)

    keys = ["none", "id", "url", "digest"]
    one = keyed(rows, "id", "url", F.sha2("body", 256).alias("digest"), F.col("body")).join(
        keyed(stores, "first_id", "first_url", F.col("digest")), keys, "left_semi"
    )
    one.dropDuplicates(keys).select("digest", "body").write.option("compression", "zstd").parquet(f"{folder}/payloads")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``digest`` and ``body`` of the store; bytes that do not give their digest are an error."""
    store = spark.read.schema("digest string, body binary").parquet(f"{folder}/payloads")
    right = F.sha2("body", 256) == F.col("digest")
    return store.select("digest", F.when(right, F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload is damaged: "), F.col("digest"))).cast("binary")
    ).alias("body"))


def fields(header: Column) -> dict[str, Column]:
    """What a header block says: id, url, type, sha1, refers_to and the block's length without headers."""

    def value(name: str) -> Column:
        # Only "\n" ends a line, whatever else Unicode counts as one.
        return F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)", 1)

    def number(name: str) -> Column:
        return F.nullif(value(name), F.lit("")).cast("long")

    return {
        "id": number("X-Source-Id"), "url": value("WARC-Target-URI"), "type": value("WARC-Type"),
        "sha1": F.substring_index(value("WARC-Payload-Digest"), ":", -1),
        "refers_to": number("X-Refers-To-Source-Id"), "content_length": number("Content-Length"),
    }


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``digest``, ``header`` and the header's fields of every record; no payload is read."""
    rows = spark.read.schema("digest string, header string").parquet(f"{folder}/headers")
    return rows.select("digest", "header", *[c.alias(n) for n, c in fields(F.col("header")).items()])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its fields, full ``payload`` and exact ``record`` bytes (a revisit's record has no payload).

    A record whose bytes after the WARC header are not as many as its Content-Length is an error.
    """
    joined = read_headers(spark, folder).join(payloads(spark, folder), "digest")
    block = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col("body"))
    record = F.concat(F.encode("header", "UTF-8"), block)
    length = F.octet_length("record") - F.octet_length(F.substring_index("header", CRLF * 2, 1)) - len(CRLF * 2)
    return joined.withColumn("record", record).withColumn("record", F.when(length == F.col("content_length"), F.col("record")).otherwise(
        F.raise_error(F.concat(F.lit("record of another length than its Content-Length: "), F.col("digest"))).cast("binary")
    )).withColumnRenamed("body", "payload")


def export(spark: SparkSession, folder: str, target: str) -> None:
    """WARC files below ``target``. A record of text is followed by two line ends, which the text writer puts there."""
    read(spark, folder).select(F.decode("record", "UTF-8").alias("value")).write.option("lineSep", CRLF * 2).text(target)
