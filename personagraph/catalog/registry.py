"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same question for the oracle, absent where SQL cannot ask it."""

    def keep(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def stamp(moment: Column | str) -> Column:
    """Times leave as text, so results do not depend on the reader's time zone."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as text in UTC, whatever the session's zone and beyond 2038 as well."""
    since = F.make_dt_interval(secs=F.floor(seconds).cast("decimal(18,6)"))
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since).cast("string")


#: A name as similarity compares it.
NORMAL_SQL = r"regexp_replace(regexp_replace(lower(coalesce({}, '')), '\.(?:bsky\.social|carrd\.co|tumblr\.com|fanbox\.cc|booth\.pm)$', ''), '[^a-z0-9]', '', 'g')"
#: Place and size of the longest common substring of a and b, the first of several in a, as size * 1000 + 999 - place.
LONGEST_SQL = """list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2),
  lambda l: CASE WHEN contains(b, substr(a, i, l)) THEN l * 1000 + 999 - i ELSE 0 END))))"""


def similarity_sql(pairs: str) -> str:
    """CTEs for the similarity ``score`` of all pairs (a, b) of normalized names in the relation ``pairs``."""
    return f"""
open_pairs AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> ''),
walk AS (
  SELECT a AS a0, b AS b0, a, b FROM open_pairs
  UNION ALL
  SELECT a0, b0, kid.a, kid.b FROM (
    SELECT a0, b0, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, strpos(b, substr(a, i, l)) - 1)}}, {{'a': substr(a, i + l), 'b': substr(b, strpos(b, substr(a, i, l)) + l)}}]) AS kid
    FROM (SELECT a0, b0, a, b, v // 1000 AS l, 999 - v % 1000 AS i FROM (SELECT *, {LONGEST_SQL} AS v FROM walk)) WHERE l > 0)
  WHERE kid.a <> '' AND kid.b <> ''),
scored AS (
  SELECT a0 AS a, b0 AS b, CASE WHEN a0 = b0 THEN 1.0 WHEN length(a0) >= 4 AND length(b0) >= 4 AND (contains(a0, b0) OR contains(b0, a0)) THEN 0.9
    ELSE 2.0 * sum(v // 1000) / (length(a0) + length(b0)) END::DOUBLE AS score
  FROM (SELECT a0, b0, {LONGEST_SQL} AS v FROM walk) GROUP BY a0, b0)"""
