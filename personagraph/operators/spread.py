"""Joins and orderings that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, is_cut

HOT_ROWS = 100_000
SALTS = 64


#: Hot keys at most, however many rows there are: their list is broadcast.
MOST_HOT = 4096


def hot_keys(facts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows, and with at least one of MOST_HOT parts of all rows."""
    return hot_of(facts.groupBy(*keys).agg(F.count("*").alias("_n")), keys, hot_rows)


def hot_of(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same of counts (``_n``) of keys."""
    total = counts.agg(F.sum("_n").alias("_all"))
    least = F.greatest(F.lit(hot_rows), F.col("_all") / MOST_HOT)
    return counts.join(F.broadcast(total)).filter(F.col("_n") >= least).select(*keys)


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of many fact rows to a dimension.

    Where the caller knows the hot keys (``hot``, a bounded list), their rows are salted and only their
    dimension rows repeated: exact, and the dimension hardly grows. Otherwise adaptive execution splits
    skewed partitions at run time, which costs no extra pass over the facts.
    """
    if hot is None:
        return facts.join(dim, keys, how)
    flagged = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*facts.columns), F.lit(salts))).otherwise(F.lit(0))
    salted = facts.join(flagged, keys, "left").withColumn("_salt", spread.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = dim.join(flagged, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows ahead of costly text patterns, dealt by key over all shuffle partitions.

    A fixed count: adaptive execution joins partitions by their bytes, and a few megabytes of text keep a task busy for long.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; the limit is applied before the shuffle as well."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows per key with their rank; also limited ahead of the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) <= n)


#: Rows that ``running`` numbers as one slice.
SLICE_ROWS = 50_000


def running(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], position: str = "position"
) -> DataFrame:
    """Exact running position and sums per key, without one task per key.

    Rows are range-partitioned on key and order, every slice is numbered on its own, and the totals of
    the slices before it are added. A key that holds most rows spans many slices. The rows are written out and
    counted first: few rows are one slice, which no range partitioning is run for.
    """
    measured = df
    if sums or not is_cut(df):
        measured = cut_lineage(df.select("*", *[c.alias(f"_m_{n}") for n, c in sums.items()]))
    few = measured.count() <= SLICE_ROWS
    ranged = measured.withColumn("_slice", F.lit(0))
    if not few:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bounds = [F.col(k) for k in keys] + order
        ranged = cut_lineage(measured.repartitionByRange(slices, *bounds).withColumn("_slice", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_t_rows"), *[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        F.coalesce(F.sum("_t_rows").over(before), F.lit(0)).alias("_o_rows"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*",
        F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)).alias("_l_rows"),
        *[F.sum(f"_m_{n}").over(inside).alias(f"_l_{n}") for n in sums],
    )
    if few:
        kinds = {f.name: f.dataType for f in offsets.schema.fields}
        return local.select(
            *df.columns,
            (F.col("_l_rows") + F.lit(0).cast(kinds["_o_rows"])).alias(position),
            *[(F.col(f"_l_{n}") + F.lit(0).cast(kinds[f"_o_{n}"])).alias(n) for n in sums],
        )
    same = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(offsets, same, "inner").select(
        *df.columns,
        (F.col("_l_rows") + F.col("_o_rows")).alias(position),
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
    )
