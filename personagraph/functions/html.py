"""Markup helpers: strip tags, undo escapes, read page metadata."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import all_matches, strip_space

REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: References that most markup uses; the others are looked up in the whole table.
COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'", "nbsp;": "\u00a0"}


def _old_bytes() -> dict[int, str]:
    """Numbers that stand for characters of an old Windows code page, and the one for no character."""
    shown = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    return {0: "\ufffd"} | shown


def _numbered(reference: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(reference, "([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    number = F.when(reference.rlike("^#[xX]"), F.try_to_number(F.conv(F.right(digits, F.lit(12)), 16, 10), F.lit("9" * 20))).otherwise(
        F.try_to_number(F.right(digits, F.lit(15)), F.lit("9" * 15))
    )
    n = F.when(F.length(digits) > 11, F.lit(-1)).otherwise(number.cast("long"))
    old = F.create_map(*[F.lit(x) for pair in _old_bytes().items() for x in pair])
    known = F.try_element_at(old, n.cast("int"))
    beyond = (n < 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    # Numbers of no character: controls, and the last two of each plane.
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(beyond, "\ufffd").when(known.isNotNull(), known).when(nothing, "").otherwise(char)


def _named(reference: Column) -> Column:
    """By the table; else its longest known start, as old pages leave out the semicolon; else the reference itself."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    whole = F.try_element_at(table, reference)
    starts = F.transform(F.sequence(F.length(reference) - 1, F.lit(1), F.lit(-1)), lambda n: F.substring(reference, F.lit(1), n))
    start = F.get(F.filter(starts, lambda s: F.try_element_at(table, s).isNotNull()), F.lit(0))
    rest = F.concat(F.try_element_at(table, start), F.substring(reference, F.length(start) + 1, F.length(reference)))
    return F.coalesce(whole, F.when(F.length(reference) > 1, rest), F.concat(F.lit("&"), reference))


def unescape(text: Column) -> Column:
    """Character references decoded as browsers do, each once; all in the JVM."""

    def decoded(reference: Column) -> Column:
        common = F.lit(None).cast("string")
        for name, char in COMMON.items():
            common = F.when(reference == name, char).otherwise(common)
        return F.coalesce(common, F.when(reference.startswith("#"), _numbered(reference)).otherwise(_named(reference)))

    between = F.split(text, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), decoded)
    whole = F.array_join(F.zip_with(between, found, lambda t, d: F.concat(t, F.coalesce(d, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def strip_tags(text: Column, scripts: bool = True) -> Column:
    return F.regexp_replace(text, P.TAGS_WITH_SCRIPTS if scripts else P.TAGS, " ")


def hub_markup(body: Column) -> Column:
    """Undo the slash and ampersand escapes of links inside page state."""
    for escaped, plain in (("\\/", "/"), ("\\u002F", "/"), ("\\u002f", "/"), ("&amp;", "&")):
        body = F.replace(body, F.lit(escaped), F.lit(plain))
    return body


def bio_from_html(body: Column) -> Column:
    """Description markup to plain text with the link targets kept."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), P.ANCHOR_HREF, " $1 ")
    text = F.replace(unescape(strip_tags(text)), F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, "[ \t]+", " ")
    return strip_space(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"))


def linked_urls(body: Column) -> Column:
    """Distinct absolute URLs that appear as an href or a "url" value."""
    return F.array_distinct(all_matches(body, P.LINKED_URL, 1))


def open_graph(body: Column) -> Column:
    """First title, image and description of the page's metadata; property-first tags win."""
    keys = F.concat(all_matches(body, P.OG_PROPERTY_FIRST, 1), all_matches(body, P.OG_CONTENT_FIRST, 2))
    values = F.concat(all_matches(body, P.OG_PROPERTY_FIRST, 2), all_matches(body, P.OG_CONTENT_FIRST, 1))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))

    def first(name: str) -> Column:
        hit = F.get(F.filter(pairs, lambda p: F.lower(p["key"]) == name), F.lit(0))
        return strip_space(hit["value"]).alias(name)

    return F.struct(first("title"), first("image"), first("description"))
