"""Connected components by alternating star contraction (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spread import HOT_ROWS, hot_keys, lookup


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Unordered account pairs (low, high) that name each other.

    Both directions fold onto one key, so one aggregation finds the reverse edge without a self join.
    """
    src, tgt = F.col("source_account_id"), F.col("target_account_id")
    return (
        edges.filter(src != tgt)
        .groupBy(F.least(src, tgt).alias("low"), F.greatest(src, tgt).alias("high"))
        .agg(F.min(src < tgt).alias("_down"), F.max(src < tgt).alias("_up"))
        .filter("_down <> _up")
        .select("low", "high")
    )


def _with_smallest(links: DataFrame, smallest: DataFrame, hot_rows: int) -> DataFrame:
    """Bring each node's smallest neighbour to its links; the links of hubs are salted."""
    hot = smallest.filter(F.col("_n") >= hot_rows).select("u")
    return lookup(links, smallest.drop("_n"), ["u"], hot=hot)


def _largest_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Every node points its larger neighbours at its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
    linked = _with_smallest(both.filter("v > u"), smallest, hot_rows)
    return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smallest_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Every node and its smaller neighbours point at the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    smallest = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    near = _with_smallest(down, smallest, hot_rows).filter("v <> m")
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = smallest.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(pairs: DataFrame, left: str = "low", right: str = "high", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) of every node in ``pairs``; a component is named by its smallest node.

    Each round is written out; the number of rounds grows with the logarithm of the graph, and the loop
    ends when a round changes nothing.
    """
    links = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct()
    links = cut_lineage(links)
    seen = _fingerprint(links)
    while seen[0]:
        links = cut_lineage(_smallest_star(_largest_star(links, hot_rows), hot_rows))
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots).distinct()


def resolve_chains(
    pointers: DataFrame, node: str = "node", target: str = "target", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Follow pointers to their end by pointer jumping: a chain of length n needs log2(n) joins.

    After that many rounds every chain has ended, so what still moves is on a cycle, whatever its length.
    """
    links = cut_lineage(pointers.select(F.col(node).alias("node"), F.col(target).alias("target")))
    rounds = links.count().bit_length() + 1
    for _ in range(rounds):
        onward = links.select(F.col("node").alias("target"), F.col("target").alias("onward"))
        # A popular keeper holds many pointers, so its rows are salted.
        popular = hot_keys(links, ["target"], hot_rows)
        jumped = lookup(links, onward, ["target"], "left", hot=popular).select(
            "node",
            F.coalesce("onward", "target").alias("target"),
            F.col("onward").isNotNull().alias("_moved"),
        )
        jumped = cut_lineage(jumped)
        if not jumped.filter(F.col("node") == F.col("target")).isEmpty():
            break
        done = jumped.filter("_moved").isEmpty()
        links = jumped.drop("_moved")
        if done:
            return links.select(F.col("node").alias(node), F.col("target").alias(target))
    raise ValueError("merge pointers form a cycle")
