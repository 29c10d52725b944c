"""Reading the directory: search, facets, sorting, paging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import policy
from ..schemas import State
from . import evidence as ev
from .directory import from_platform

SORTS = {"artist": "public_slug", "lang": "language", "followers": "followers", "updated": "hydrated_at"}


@dataclass(frozen=True)
class Filters:
    text: str = ""
    platforms: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    commissions: list[str] = field(default_factory=list)
    show_adult: bool = False


def _holds(column: str | Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def member_accounts(state: State, live_only: bool = True) -> DataFrame:
    rows = ev.live(state.memberships) if live_only else state.memberships
    return rows.select("artist_id", "account_id").join(state.accounts, "account_id")


def commission_filter(kind: str) -> Column:
    is_open = F.col("commission_status") == "open"
    if kind == "bio":
        return is_open & ~from_platform("skeb") & ~from_platform("pixiv")
    return is_open & (F.col("platform") == kind) & from_platform(kind)


def search(directory: DataFrame, accounts: DataFrame, state: State, filters: Filters) -> DataFrame:
    """Directory rows that pass every filter; ``accounts`` are the visible account rows of the directory."""
    out = directory
    if filters.text:
        by_handle = member_accounts(state, live_only=False).filter(_holds("handle", filters.text))
        marked = by_handle.select("artist_id", F.lit(True).alias("_named")).distinct()
        out = out.join(marked, "artist_id", "left")
        hit = _holds("public_slug", filters.text) | _holds("display_name", filters.text) | F.col("_named").isNotNull()
        out = out.filter(hit).drop("_named")
    if filters.platforms:
        # Every selected platform must be there.
        wanted = accounts.filter(F.col("platform").isin(filters.platforms)).select("artist_id", "platform").distinct()
        full = wanted.groupBy("artist_id").count().filter(F.col("count") == len(set(filters.platforms)))
        out = out.join(full.select("artist_id"), "artist_id", "left_semi")
    if filters.languages:
        out = out.filter(F.col("language").isin(filters.languages))
    if filters.sources:
        out = out.filter(F.arrays_overlap("sources", F.array(*map(F.lit, filters.sources))))
    for name, column in (("no_ai", "no_ai_attested"), ("nsfw", "nsfw"), ("dormant", "dormant")):
        if name in filters.flags:
            out = out.filter(F.col(column))
    if "no_pkey" in filters.flags:
        main = member_accounts(state).filter(F.col("platform").isin("twitter", "bluesky"))
        out = out.join(main.select("artist_id").distinct(), "artist_id", "left_anti")
    for kind in filters.commissions:
        able = member_accounts(state).filter(commission_filter(kind)).select("artist_id").distinct()
        out = out.join(able, "artist_id", "left_semi")
    if not filters.show_adult and "nsfw" not in filters.flags:
        out = out.filter(~F.col("nsfw"))
    return out


def _order(sort: str, ascending: bool) -> list[Column]:
    column = F.col(SORTS.get(sort, SORTS["followers"]))
    return [column.asc_nulls_last() if ascending else column.desc_nulls_last(), F.col("public_slug").asc()]


def page_count(rows: DataFrame, size: int = policy.DIRECTORY_PAGE_SIZE) -> DataFrame:
    total = F.count("*")
    return rows.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).alias("pages"))


def last_page(rows: DataFrame, number: int, size: int = policy.DIRECTORY_PAGE_SIZE) -> int:
    """The page number, or that of the last page where it lies beyond."""
    return max(1, min(number, page_count(rows, size).first()["pages"]))


def page(rows: DataFrame, sort: str = "followers", ascending: bool = False, number: int = 1,
         size: int = policy.DIRECTORY_PAGE_SIZE) -> DataFrame:
    """One page in a whitelisted order, unknown values last, ties by slug; a number beyond the last page gives that."""
    return rows.orderBy(*_order(sort, ascending)).offset((last_page(rows, number, size) - 1) * size).limit(size)


def page_after(rows: DataFrame, cursor: Row | None = None, sort: str = "followers", ascending: bool = False,
               size: int = policy.DIRECTORY_PAGE_SIZE) -> DataFrame:
    """The page behind ``cursor``, the last row of the page before (none: the first page).

    However deep, a page is a bounded selection over the rows behind the cursor; earlier rows are never gathered.
    """
    if cursor is not None:
        name = SORTS.get(sort, SORTS["followers"])
        value, slug = F.col(name), F.col("public_slug") > cursor["public_slug"]
        if cursor[name] is None:
            rows = rows.filter(value.isNull() & slug)
        else:
            held = F.lit(cursor[name])
            further = value > held if ascending else value < held
            rows = rows.filter(value.isNull() | further | ((value == held) & slug))
    return rows.orderBy(*_order(sort, ascending)).limit(size)


def platform_facets(accounts: DataFrame) -> DataFrame:
    """Accounts per platform, ordered by rank, then count, then name; websites are no facet."""
    ranks = F.broadcast(policy.platforms(accounts.sparkSession).select("platform", "display_rank"))
    counts = accounts.filter("platform <> 'website'").groupBy("platform").agg(F.count("*").alias("n"))
    return counts.join(ranks, "platform").orderBy("display_rank", F.col("n").desc(), "platform")


def language_options(directory: DataFrame) -> DataFrame:
    return directory.select("language").distinct().orderBy("language")


def headline(directory: DataFrame, state: State) -> DataFrame:
    """One row: artists, adult artists, accounts, suppressed artists."""
    listed = directory.agg(F.count("*").alias("artists"), F.count_if("nsfw").alias("nsfw"))
    accounts = state.accounts.agg(F.count("*").alias("accounts"))
    out = ev.in_force(state.suppressions).agg(F.countDistinct("artist_id").alias("suppressed"))
    return listed.join(F.broadcast(accounts)).join(F.broadcast(out))
