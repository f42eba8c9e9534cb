
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

PAGES = _struct(
    ("id", _L, False), ("url", _S, False), ("title", _S, True), ("meta_description", _S, True),
    ("domain", _S, False), ("depth", _I, False), ("crawled_at", _TS, True), ("body_text", _S, True),
    ("raw_html_path", _S, True), ("language", _S, True), ("text_length", _I, True),
    ("rank_score", _D, True), ("freshness_score", _D, True), ("quality_score", _D, True),
    ("readability_score", _D, True), ("domain_score", _D, True), ("indexed_at", _TS, True),
    ("deleted_at", _TS, True),
)

LINKS = _struct(("source_id", _L, False), ("target_id", _L, False))

CONFIG = _struct(("id", _I, False), ("key", _S, False), ("value", _S, False), ("updated_at", _TS, True))

INDEX_DOCUMENTS = _struct(
    ("id", _L, False), ("url", _S, False), ("title", _S, True), ("meta_description", _S, True),
    ("domain", _S, True), ("language", _S, True), ("crawled_at", _D, True),
    ("rank_score", _D, True), ("body_text", _S, True),
)

VISITED = _struct(("url", _S, False))
FRONTIER = _struct(("url", _S, False), ("depth", _I, False))

# One row per write of a page: stub writes only insert, page writes insert or update.
PAGE_WRITES = _struct(
    ("url", _S, False), ("title", _S, True), ("meta_description", _S, True), ("domain", _S, True),
    ("depth", _I, True), ("body_text", _S, True), ("raw_html_path", _S, True), ("language", _S, True),
    ("text_length", _I, True), ("crawled_at", _TS, True), ("is_stub", T.BooleanType(), False),
    ("seq", _L, False),
)

# Fixed value: width of the body column in the data model. Tables hold whole texts; it is for a view that shows a part.
BODY_CHARS = 5000
