"""HTML extraction as native column expressions.

Markup is cut out in a few regex passes that are linear on any page; nothing leaves the JVM.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.binding import let
from pagemill.functions.scans import running

# Elements whose content is not page text, per use.
BODY_SKIP = ["script", "style", "nav", "header", "footer", "aside"]
INDEX_SKIP = ["script", "style", "nav", "footer", "header"]
CONTENT_CHECK_SKIP = ["script", "style", "noscript"]
CODE_SKIP = ["script", "style"]

# A page with less text than this needs a browser to render it.
MIN_CONTENT_CHARS = 100

# Elements that start a new block of text.
BLOCK_TAGS = [
    "address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre",
    "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
]

# White space that stripping removes, ASCII and Unicode.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

MARK = "\x01"
BLOCK_MARK = "\x02"
LINK_OPEN = "\x03"
LINK_CLOSE = "\x04"

# A tag, with quoted attribute values that may hold ">"; then the same without regard to quotes, which the end of the
# page closes as well. Loops are possessive: they run without recursion and never go back, whatever a page holds.
QUOTED = r"""(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
TAG = r"""<[/!?a-zA-Z][^<>"']*+""" + QUOTED + r"""|<[/!?a-zA-Z][^>]*+(?:>|\z)"""
TITLE = r"(?is)<title(?:[\s/][^>]*+)?+>((?:[^<]++|<(?!/title\s*+>|title[\s/>]))*+)</title\s*+>"
META_TAG = r"""(?is)<meta[\s/][^<>"']*+""" + QUOTED
ANCHOR_TAG = r"""(?is)<a[\s/][^<>"']*+""" + QUOTED
COMMENT = r"<!--.*?(?:-->|\z)"
# Elements whose content is no markup.
RAW_TAGS = ["script", "style"]


def raw_pattern(tags: list[str]) -> str:
    """Comments and raw elements to cut out, whichever starts first; one that is not closed reaches to the page's end."""
    elements = [rf"<{t}(?:[\s/][^>]*+)?+>.*?(?:</{t}\s*+>|\z)" for t in tags if t in RAW_TAGS]
    return "(?is)" + "|".join([COMMENT, *elements])


def block_pattern() -> str:
    return r"(?is)</?(?:" + "|".join(BLOCK_TAGS) + r")(?:[\s/][^>]*+)?+(?:>|\z)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


# Entities seen on most pages, tested before the long list of names.
_COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "apos": "'"}


def _named_entity(name: Column) -> Column:
    """Character of a named entity, or null. The names are those of the standard library."""
    common = F.when(name == "amp", F.lit("&"))
    for entity, char in _COMMON.items():
        if entity != "amp":
            common = common.when(name == entity, F.lit(char))
    rest = {n: chr(c) for n, c in name2codepoint.items() if n not in _COMMON}
    # A constant, folded to a map when the query is planned.
    table = F.from_json(F.lit(json.dumps(rest)), "map<string,string>")
    return common.otherwise(F.element_at(table, name))


def _numeric_entity(name: Column) -> Column:
    """``#233`` or ``#xe9`` to the character, by way of its UTF-32 bytes."""
    digits = F.when(name.rlike(r"^#[xX]"), F.substr(name, F.lit(3))).otherwise(
        F.conv(F.substr(name, F.lit(2)), 10, 16)
    )

    def character(hexadecimal: Column) -> Column:
        code = F.conv(hexadecimal, 16, 10).cast("long")
        printable = code.between(32, 0xD7FF) | code.between(0xE000, 0x10FFFF) | code.isin(9, 10, 13)
        return F.when(printable, F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")).otherwise(F.lit(""))

    return character(digits)


ENTITY_NAME = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def _replace_entity(part: Column) -> Column:
    """Text after an ampersand with the reference at its start replaced, if it is one."""

    def replaced(name: Column) -> Column:
        char = (
            F.when(name == "", F.lit(None))
            .when(name.startswith("#"), _numeric_entity(name))
            .otherwise(_named_entity(name))
        )
        return F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    return let(F.regexp_extract(part, ENTITY_NAME, 1), replaced)


def decode_entities(text: Column) -> Column:
    """Replace each character reference once, left to right."""
    parts = F.transform(F.split(text, "&"), lambda part, i: F.when(i == 0, part).otherwise(_replace_entity(part)))
    return F.array_join(parts, "")


def _opening(tag: str) -> str:
    return rf"<{tag}(?:[\s/][^>]*+)?+>"


def _cut_closed(page: Column, tag: str, mark: str) -> Column:
    """The page without the elements of one tag, of which none is inside another.

    Only the part up to the last closing tag is searched. Every opening tag in it is closed, so no
    search runs to the end of the page in vain, and the cost is linear.
    """
    closing = rf"</{tag}\s*+>"

    def cut(p: Column) -> Column:
        return F.when(p.rlike(f"(?i){closing}"), let(F.regexp_extract(p, rf"(?is)^.*{closing}", 0), lambda closed: F.concat(
            F.regexp_replace(closed, rf"(?is){_opening(tag)}.*?{closing}", mark), F.substr(p, F.length(closed) + 1)
        ))).otherwise(p)

    return let(page, cut)


def _levels(steps: Column) -> Column:
    """How many openings (1) are not closed (-1) yet, after each step; a closing without an opening counts for nothing."""

    def joined(x: Column, y: Column) -> Column:
        return F.struct((x["sum"] + y["sum"]).alias("sum"), F.least(x["least"], x["sum"] + y["least"]).alias("least"))

    pairs = F.transform(steps, lambda x: F.struct(x.alias("sum"), x.alias("least")))
    totals = running(pairs, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("least")), joined)
    return F.transform(totals, lambda t: t["sum"] - t["least"])


def _cut_nested(page: Column, tags: list[str], mark: str) -> Column:
    """The page without the elements ``tags``, whatever is nested.

    Each name has levels of its own. What follows a tag is inside an element if a level is open there that is closed
    later: counted from the left and, with closings as openings, from the right, both above zero.
    """
    names = "|".join(tags)
    found = rf"(?is){_opening(f'(?:{names})')}|</(?:{names})\s*+>"
    closed = F.regexp_extract(page, rf"(?is)^.*</(?:{names})\s*+>", 0)

    def cut(part: Column) -> Column:
        def both(tag: Column) -> Column:
            steps = F.transform(F.regexp_extract_all(part, F.lit(found), F.lit(0)), lambda t: F.when(
                F.lower(F.regexp_extract(t, r"^</?(\w+)", 1)) != tag, 0
            ).when(t.startswith("</"), -1).otherwise(1))
            return F.transform(F.array(steps, F.reverse(F.transform(steps, lambda x: -x))), _levels)

        def kept(text: Column, n: Column, n_tags: Column, levels: Column) -> Column:
            inside = F.exists(levels, lambda x: (F.get(F.get(x, F.lit(0)), n - 1) > 0) & (
                F.coalesce(F.get(F.get(x, F.lit(1)), n_tags - n - 1), F.lit(0)) > 0
            ))
            return F.when(n == 0, text).when(inside, F.lit("")).otherwise(F.concat(F.lit(mark), text))

        present = F.filter(F.array(*[F.lit(t) for t in tags]), lambda t: F.contains(F.lower(part), F.concat(F.lit("<"), t)))
        levels = F.transform(present, both)
        return let(F.struct(levels.alias("levels"), F.split(part, found).alias("texts")), lambda x: F.array_join(F.transform(
            x["texts"], lambda text, n: kept(text, n, F.size(x["texts"]) - 1, x["levels"])
        ), ""))

    return let(closed, lambda part: F.concat(cut(part), F.substr(page, F.length(part) + 1)))


def cut_elements(html: Column, tags: list[str], mark: str = MARK) -> Column:
    """``html`` without comments and without the elements ``tags``, each replaced by ``mark``.

    Nested elements of one name are cut by their levels; a page without any is cut name by name in plain passes.
    """

    page = F.regexp_replace(html, raw_pattern(tags), mark)
    names = [t for t in tags if t not in RAW_TAGS]
    if not names:
        return page
    # An opening tag, and before any other tag of its name another opening one.
    nested = rf"(?is)<({'|'.join(names)})(?:[\s/][^<>]*+)?+>(?:[^<]++|<(?!/?\1[\s/>]))*+<\1[\s/>]"

    def plain(p: Column) -> Column:
        for tag in names:
            p = _cut_closed(p, tag, mark)
        return p

    return let(page, lambda p: F.when(p.rlike(nested), _cut_nested(p, names, mark)).otherwise(plain(p)))


def _text_nodes(cut: Column) -> Column:
    """Text between the tags and marks of a page, each run stripped, joined by one space."""
    marked = F.regexp_replace(cut, TAG, MARK)
    nodes = F.transform(F.split(decode_entities(marked), f"[{MARK}{BLOCK_MARK}]"), strip)
    return F.array_join(F.filter(nodes, lambda t: t != ""), " ")


def visible_text(html: Column, skip: list[str] = BODY_SKIP) -> Column:
    """Text nodes outside the skipped elements, each stripped, joined by one space."""
    return _text_nodes(cut_elements(html, skip))


def title(html: Column) -> Column:
    return strip(decode_entities(F.regexp_extract(html, TITLE, 1)))


def _attribute_pattern(name: str) -> str:
    return rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag, entities decoded; '' if it is missing or empty."""
    pattern = _attribute_pattern(name)
    return decode_entities(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def meta_description(html: Column) -> Column:
    """Content of the first ``<meta name="description">``, stripped."""
    tags = F.regexp_extract_all(cut_elements(html, CODE_SKIP), F.lit(META_TAG), F.lit(0))
    wanted = F.filter(tags, lambda t: attribute(t, "name") == "description")
    return let(F.get(wanted, F.lit(0)), lambda t: F.coalesce(strip(attribute(t, "content")), F.lit("")))


def hrefs(html: Column, skip: list[str] = BODY_SKIP) -> Column:
    """``href`` values of all anchors outside the skipped elements, in page order."""
    tags = F.regexp_extract_all(cut_elements(html, skip), F.lit(ANCHOR_TAG), F.lit(0))
    with_href = F.filter(tags, lambda t: t.rlike(r"""(?is)[\s"'/]href\s*="""))
    return F.transform(with_href, lambda t: attribute(t, "href"))


def outgoing_links(url: Column, html: Column, skip: list[str] = BODY_SKIP) -> Column:
    """Resolved, normalised and valid link targets of one page, duplicates kept."""
    absolute = urls.resolve_all(url, hrefs(html, skip))
    return F.filter(F.transform(absolute, urls.normalize_url), urls.is_valid_url)


def needs_render(html: Column) -> Column:
    """True if the page has too little text without its scripts."""
    return F.length(visible_text(html, CONTENT_CHECK_SKIP)) < MIN_CONTENT_CHARS


def main_text(html: Column, min_chars: int = 25, max_link_share: float = 0.5) -> Column:
    """Main content: the blocks that are long enough and are not mostly links.

    Blocks are the runs of text between block-level tags. A page on which no block
    qualifies falls back to its visible text.
    """

    def measured(block: Column) -> Column:
        text = strip(F.translate(block, LINK_OPEN + LINK_CLOSE, ""))
        prose = strip(F.regexp_replace(block, f"{LINK_OPEN}[^{LINK_CLOSE}]*{LINK_CLOSE}?", ""))
        return F.struct(text.alias("text"), F.length(prose).alias("prose"))

    def of_blocks(cut: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(cut, TITLE, BLOCK_MARK), block_pattern(), BLOCK_MARK)
        body = F.regexp_replace(body, ANCHOR_TAG, LINK_OPEN)
        body = F.regexp_replace(body, r"(?i)</a\s*>", LINK_CLOSE)
        body = decode_entities(F.regexp_replace(body, TAG, ""))
        blocks = F.filter(
            F.transform(F.split(body, BLOCK_MARK), measured),
            lambda b: (F.length(b["text"]) >= min_chars)
            & (b["prose"] >= (1 - max_link_share) * F.length(b["text"])),
        )
        return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")

    # The page is cut once, for the blocks and for what takes their place.
    return let(cut_elements(html, INDEX_SKIP, BLOCK_MARK), lambda cut: let(
        of_blocks(cut), lambda joined: F.when(joined == "", _text_nodes(cut)).otherwise(joined)
    ))
