"""What each filter removes under every order of the filters.

A document's failures are one mask of five bits. Documents of a part with the same mask are one cell that only counts
them, so a part has 32 cells at most however many documents it holds. Folds over the array of all orders then tell, for
each cell, where in each order its documents go: `transform` walks the orders, `aggregate` the five steps of one order,
and each of the 600 results is a struct weighted with the cell's counts. The cells of a part add up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, text_of

#: The filters by their place in the mask, and all orders of them.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SIGNS = r"[#$%&*|]"

#: What is counted at a step, in the order of the result.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _failures() -> dict[str, Column]:
    """Failure of the filters that look at one text alone."""
    text, n = F.col("text"), F.size("words")
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct("words")) * 100 < n * LEAST_DISTINCT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SIGNS),
    }


def _bits(failures: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for letter, failed in failures.items():
        mask = mask + F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)
    return mask


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row, over its whole text.

    E holds where the same text stands under a smaller doc_id. Copies fold into their smallest id before the shuffle,
    and rows meet those ids by text and id, so a text with a third of all rows is spread over its ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_of().alias("text"))
    # The texts are read once; all that follows needs these small rows alone.
    alone = cut(rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), _bits(_failures()).alias("alone")
    ))
    first = alone.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return alone.join(first, ["same", "doc_id"], "left").select("doc_id", "part", (F.col("alone") + _bits({"E": copied})).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: 32 rows a part at most."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    return masks(docs).join(told, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def _steps(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of one cell, order by order and step by step: COUNTS, weighted with the cell's counts."""
    orders = F.expr("array({})".format(", ".join("array({})".format(", ".join(str(1 << FILTERS.index(x)) for x in order)) for order in ORDERS)))
    none = F.lit(0).cast("long")

    def step(walked: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        gone = walked["gone"]
        hit = fails & ~gone
        told = F.struct(
            F.when(gone | fails, none).otherwise(n).alias("kept"),
            F.when(hit, n).otherwise(none).alias("removed"),
            F.when(fails & gone, n).otherwise(none).alias("redundant"),
            F.when(mask == bit, n).otherwise(none).alias("unique_fails"),
            F.when(hit, good).otherwise(none).alias("good_lost"),
            F.when(hit, toxic).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(walked["told"], F.array(told)).alias("told"))

    shape = "array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(shape).alias("told"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda walked: walked["told"])))


def _added(a: Column, b: Column) -> Column:
    """Two arrays of counts, element by element."""
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley: 600 rows for each part of ``docs``.

    Null and empty texts are the same text, without words: they fail A, not B, C or D. A null source is the part of the
    empty string. A row without doc_id is no copy, and no row is a copy because of it; rows that repeat the smallest id
    are no copies either. A document is good or toxic if any of its label rows says so; labels without doc_id, or of
    unknown documents, count nowhere. An empty table gives no rows; columns besides doc_id, text, source, and doc_id,
    quality, toxic of the labels are not read.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    folded = F.aggregate(
        "cells",
        F.array_repeat(zero, len(ORDERS) * len(FILTERS)),
        lambda total, cell: _added(total, _steps(cell["mask"], cell["n"], cell["good"], cell["toxic"])),
    )
    size = len(FILTERS)
    rows = parts.select("part", F.posexplode(folded).alias("at", "told"))
    rows = rows.withColumn("filter_order", F.expr("array('{}')[at div {}]".format("', '".join(ORDERS), size))).withColumn("step", F.col("at") % size + 1)
    flat = rows.select("part", "filter_order", "step", F.expr("substring(filter_order, step, 1)").alias("letter"), "told.*")
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")  # over the 120 orders
    return flat.select("part", "filter_order", "step", *COUNTS, shapley)
