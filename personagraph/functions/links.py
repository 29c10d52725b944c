"""Links in text: known platforms, personal websites and short links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import all_matches, explode_rows, tokens_with, words_with

LINK = "struct<platform:string,handle:string,native_id:string,url:string>"
LINKS = f"array<{LINK}>"


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), F.ltrim(url, F.lit("/"))))


def _alternatives(domains: list[str]) -> str:
    return "|".join(re.escape(d) for d in domains)


def on_blocked_domain(domain: Column) -> Column:
    return domain.rlike(rf"(?i)(?:^|\.)(?:{_alternatives(P.NON_WEBSITE_DOMAINS)})$")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _platform_specs() -> str:
    """SQL for the platforms' patterns as one constant array, in the order of their priority."""
    rows = [
        f"named_struct('platform', '{platform}', 'field', '{field}', 'literal', {_sql_text(literal)}, 'pattern', "
        + _sql_text(f"{pattern}((?:{P.ELLIPSIS})?)") + ")"
        for platform, field, literal, pattern in P.PLATFORM_LINKS
    ]
    return f"array({', '.join(rows)})"


def _dispatched(words: str, low: str) -> str:
    """SQL for all platform links of a text's words: the hosts in them choose the patterns, and a pattern is tried on
    the words with its host alone.

    A match that runs into an ellipsis was cut off by the platform and is dropped.
    """
    return f"""flatten(transform(
      filter({_platform_specs()}, s -> contains({low}, s.literal)),
      s -> flatten(transform(
        filter({words}, w -> contains(lower(w), s.literal)),
        w -> transform(
          filter(zip_with(regexp_extract_all(w, s.pattern, 0), arrays_zip(regexp_extract_all(w, s.pattern, 1), regexp_extract_all(w, s.pattern, 2)),
            (url, g) -> named_struct('url', url, 'value', g['0'], 'cut', g['1'])), m -> m.cut = ''),
          m -> named_struct('platform', s.platform, 'handle', if(s.field = 'handle', m.value, null),
            'native_id', if(s.field = 'native_id', m.value, null),
            'url', if(startswith(m.url, 'http'), m.url, concat('https://', ltrim('/', m.url)))))))))"""


def is_account_handle(platform: Column, handle: Column) -> Column:
    """False for reserved words, content hashes, cut-off handles and known hosts used as handles."""
    low = F.lower(handle)
    return handle.isNull() | (
        (F.length(handle) >= 2)
        & ~low.isin(P.RESERVED_HANDLES)
        & ~handle.rlike(P.HEX_JUNK)
        & ~handle.endswith(".")
        & ((platform == "bluesky") | ~low.isin(P.NON_WEBSITE_DOMAINS))
    )


def _link_key(link: Column) -> Column:
    none = F.lit("\u0000")
    return F.concat_ws(
        "\u0001",
        link["platform"],
        F.lower(F.coalesce(link["handle"], F.lit(""))),
        F.coalesce(link["native_id"], none),
    )


def first_links(df: DataFrame, column: str) -> DataFrame:
    """Keep the first link of every (platform, handle, native id) inside each row's array."""
    tagged = f"_{column}_sorted"
    keyed = F.transform(
        F.col(column), lambda x, i: F.struct(_link_key(x).alias("k"), i.alias("i"), x.alias("x"))
    )
    out = df.withColumn(tagged, F.array_sort(keyed))
    firsts = F.filter(
        F.col(tagged),
        lambda t, i: (i == 0) | (t["k"] != F.element_at(F.col(tagged), F.greatest(i, F.lit(1)))["k"]),
    )
    in_order = F.array_sort(F.transform(firsts, lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x"))))
    return out.withColumn(column, F.transform(in_order, lambda t: t["x"])).drop(tagged)


def with_platform_links(df: DataFrame, text: str, out: str = "platform_links") -> DataFrame:
    """Add the platform links of a text column as an array of structs."""
    low, words = f"_{out}_low", f"_{out}_words"
    source = words_with(F.coalesce(F.col(text), F.lit("")), r"\.\p{L}")
    found = F.filter(F.expr(_dispatched(words, low)), lambda l: is_account_handle(l["platform"], l["handle"]))
    # Texts without any of the literals skip all patterns at once.
    literals = sorted({spec[2] for spec in P.PLATFORM_LINKS})
    maybe = F.col(low).rlike(_alternatives(literals))
    tagged = df.withColumn(words, source).withColumn(low, F.lower(F.array_join(words, " ")))
    tagged = tagged.withColumn(out, F.when(maybe, found).otherwise(F.array().cast(LINKS))).drop(low, words)
    return first_links(tagged, out)


def with_website_links(df: DataFrame, text: str, out: str = "website_links") -> DataFrame:
    """Add links to hosts that are no known platform; the handle is host plus path."""
    words = tokens_with(F.coalesce(F.col(text), F.lit("")), r"(?i)://|www\.")
    hits = all_matches(words, f"{P.GENERIC_URL}(?:{P.ELLIPSIS})?")

    def pieces(hit: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(hit, "[…‥]$", ""), r"(?=https?://)"), lambda p: p != "")
        whole = ~hit.rlike("[…‥]$")
        return F.when(whole, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))

    urls = F.transform(F.flatten(F.transform(hits, pieces)), lambda u: F.regexp_replace(u, "[.,;:!?)»」】]+$", ""))

    def as_site(url: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(url, r"^(?:https?://)?(?:www\.)?", ""), r"(?s)[?#].*$", "")
        bare = F.rtrim(path, F.lit("/"))
        return F.struct(
            F.lower(F.regexp_extract(url, P.DOMAIN_OF, 1)).alias("domain"),
            bare.alias("bare"),
            F.struct(
                F.lit("website").alias("platform"),
                F.lower(bare).alias("handle"),
                F.lit(None).cast("string").alias("native_id"),
                F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url)).alias("url"),
            ).alias("link"),
        )

    sites = F.filter(
        F.transform(urls, as_site),
        lambda s: F.contains(s["domain"], F.lit(".")) & ~on_blocked_domain(s["domain"]) & ~s["bare"].rlike(P.ASSET_PATH),
    )
    return first_links(df.withColumn(out, F.transform(sites, lambda s: s["link"])), out)


def with_links(df: DataFrame, text: str, out: str = "links") -> DataFrame:
    """Platform links followed by website links."""
    df = with_platform_links(df, text, "_platform")
    df = with_website_links(df, text, "_website")
    return df.withColumn(out, F.concat("_platform", "_website")).drop("_platform", "_website")


def explode_links(df: DataFrame, column: str = "links") -> DataFrame:
    """One row per link with its position, the array column replaced by the link fields."""
    rest = [c for c in df.columns if c != column]
    rows = explode_rows(df, column, "_link", "link_pos")
    return rows.select(*rest, "link_pos", "_link.platform", "_link.handle", "_link.native_id", "_link.url")


SHORT_LINK = rf"(?iU)(?<![\w.-])(?:https?://)?(?:{_alternatives(P.SHORTENER_DOMAINS)})/[A-Za-z0-9_\-]+"
SHORT_LINK_SCAN = rf"(?i)(?:{_alternatives(P.SHORTENER_DOMAINS)})/"


def short_links(text: Column) -> Column:
    """Ordered distinct short links, scheme added."""
    found = F.transform(all_matches(text, SHORT_LINK), lambda u: with_scheme(u))
    return F.array_distinct(found)


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://([^/]+)", 1), F.lit("")))


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host_of(a) == host_of(b), F.lit(False))
