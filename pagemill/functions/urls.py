"""URL columns: normalise, validate, split and resolve. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

# Extensions a crawlable address must not end with.
EXCLUDED_EXTENSIONS = ["pdf", "jpg", "png", "gif", "css", "js", "zip", "mp4", "mp3"]

# Schemes whose references resolve against a base (http family plus the empty one).
WEB_URL = r"(?i)^[\x00-\x20]*https?://[^/?#]"
NETLOC = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
EXTENSION = r"\.(" + "|".join(EXCLUDED_EXTENSIONS) + ")$"


def _lower_scheme(url: Column) -> Column:
    scheme = F.regexp_extract(url, SCHEME, 1)
    return F.concat(F.lower(scheme), F.substr(url, F.length(scheme) + 1))


def _drop_empty_params(path: Column) -> Column:
    """``/a/b;`` names the same resource as ``/a/b``: an empty parameter list is not written."""
    return F.regexp_replace(path, r"^((?:.*/)?[^/;]*);$", "$1")


def _clean(url: Column) -> Column:
    """Leading blanks and embedded line breaks are not part of an address."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def normalize_url(url: Column) -> Column:
    """Drop the fragment and every trailing slash.

    Only an address that has a fragment is rebuilt from its parts, which also lowers the
    scheme and drops an empty query; any other address just loses its trailing slashes.
    """

    def rebuild(before: Column) -> Column:
        path = F.substring_index(before, "?", 1)
        query = F.regexp_replace(F.substr(before, F.length(path) + 1), r"^\?$", "")
        return F.concat(F.regexp_replace(_drop_empty_params(path), r"^(https?:)$", "$1//"), query)

    whole = let(_clean(F.substring_index(url, "#", 1)), lambda u: let(_lower_scheme(u), rebuild))
    return F.rtrim(F.when(F.contains(url, F.lit("#")), whole).otherwise(url), F.lit("/"))


def netloc(url: Column) -> Column:
    """Host part as written: port, user info and letter case are kept."""
    return F.regexp_extract(url, NETLOC, 1)


def stub_domain(url: Column) -> Column:
    """Domain rule of pages known only as link targets: the text between ``//`` and ``/``."""
    return F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))


def base_url(url: Column) -> Column:
    """``scheme://netloc`` of an absolute address."""
    return F.concat(F.lower(F.regexp_extract(url, SCHEME, 1)), F.lit("://"), netloc(url))


def is_valid_url(url: Column) -> Column:
    """http(s), a host, and no excluded extension at the very end of the whole address."""
    host = netloc(url)
    brackets_ok = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    return url.rlike(WEB_URL) & brackets_ok & ~F.lower(url).rlike(EXTENSION)


def raw_html_key(url: Column) -> Column:
    """Content-addressed object key of a page's raw HTML."""
    return F.concat(F.lit("raw_html/"), F.sha2(url, 256), F.lit(".html"))


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; a path that ends in one of them keeps a trailing slash."""
    closed = F.regexp_replace(path, r"(^|/)(\.{1,2})$", "$1$2/")
    kept = F.aggregate(
        F.split(closed, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return let(F.array_join(kept, "/"), lambda joined: F.when(joined == "", F.lit("/")).otherwise(joined))


# Scheme, host, path, query and fragment of a reference (RFC 3986, appendix B).
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _parts(address: Column) -> Column:
    """Parts of an address as a struct; query and fragment keep their mark unless empty."""
    part = lambda i: F.regexp_extract(address, PARTS, i)
    return F.struct(
        F.lower(part(1)).alias("scheme"), part(2).alias("host"), _drop_empty_params(part(3)).alias("path"),
        F.regexp_replace(part(4), r"^\?$", "").alias("query"), F.regexp_replace(part(5), "^#$", "").alias("fragment"),
    )


def _rooted(path: Column) -> Column:
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _merge(base_path: Column, path: Column) -> Column:
    """``path`` below the folder of ``base_path``; empty segments in between fall out."""
    merged = F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), path)
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(merged, r"^/+", ""), r"/{2,}", "/"))


def _resolve_parts(base: Column, href: Column, b: Column, r: Column) -> Column:
    target = F.when(r["path"].startswith("/"), r["path"]).otherwise(_merge(b["path"], r["path"]))
    resolved = let(target, lambda t: F.when(t.rlike(r"(^|/)\.{1,2}(/|$)"), _remove_dot_segments(t)).otherwise(t))
    start = F.concat(b["scheme"], F.lit("://"))
    inherited = F.when(r["query"] == "", b["query"]).otherwise(r["query"])
    return (
        F.when(href == "", base)
        .when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), href)
        .when(r["host"] != "", F.concat(start, r["host"], r["path"], r["query"], r["fragment"]))
        .when(r["path"] == "", F.concat(start, b["host"], _rooted(b["path"]), inherited, r["fragment"]))
        .otherwise(F.concat(start, b["host"], _rooted(resolved), r["query"], r["fragment"]))
    )


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute address that ``href`` names on the page ``base`` (an http or https address)."""
    return let(_parts(_clean(base)), lambda b: let(_parts(_clean(href)), lambda r: _resolve_parts(base, href, b, r)))


def resolve_all(base: Column, hrefs: Column) -> Column:
    """``resolve_href`` for an array of references; the base is taken apart once."""
    one = lambda b: lambda h: let(_parts(_clean(h)), lambda r: _resolve_parts(base, h, b, r))
    return let(_parts(_clean(base)), lambda b: F.transform(hrefs, one(b)))
