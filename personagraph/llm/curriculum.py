"""Mixing sources to target weights along a time-varying curriculum, DataFrame operations only.

Training time runs from 0 to 1. Each source has a weight that changes in a line from start to end; its mean weight
decides its share of all words, and the integral of the weight says how much of that share is due by each moment. The
documents of a source stand in a keyed order, epoch after epoch, and each one's place in that stream of words is put
through the inverse of the integral: that is its position. Sorting by range of positions gives the training order.

Sums per source are made first (a row each); running sums are exact over range slices, so a source with most rows
spans many tasks; texts are only read for their size and, in ``mix``, joined to their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import running
from .common import SPACE, cut, free_name, shuffle_parts, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: How often a document may be taken.
EPOCHS = 3
#: Part of a weight by which it rises (odd places) or falls (even places) from the middle to the ends.
TILT = 0.5
KEY = 20_240


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, twin (a second hash), source, size (words between ASCII white space; 0 for a null text), and the
    digests that the order within a source is made of."""
    id_, text = F.col("doc_id").cast("long"), F.col("text")
    return docs.select(
        id_.alias("doc_id"),
        F.xxhash64(id_, text).alias("text_hash"),
        F.hash(id_, text).alias("twin"),
        F.col("source").cast("string").alias("source"),
        F.size(F.array_remove(F.split(text_of("text"), SPACE), "")).cast("long").alias("size"),
        F.md5(text_of("text")).alias("digest"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, tilt: float = TILT) -> DataFrame:
    """source, source_size, weight, tilt, target: one row per source, null last.

    All targets together are the words of all sources. A target stops at ``epochs`` times its source's size and the
    excess goes to the others by weight. With sources in the order of that limit per weight, the level that the others
    share is known from sums over those before; the first source whose target is within its limit tells the level.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below see one row per source.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    ranked = sources.withColumns(
        {
            "weight": F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights)))),
            "tilt": F.when(F.pmod(place, F.lit(2)) == 0, F.lit(tilt)).otherwise(F.lit(-tilt)),
            "_limit": F.col("source_size") * epochs,
        }
    )
    by_limit = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy())
    leveled = ranked.withColumn(
        "_level", (all_words - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    )
    fits = F.col("_level") * F.col("weight") <= F.col("_limit")
    numbered = leveled.withColumn("_n", F.row_number().over(by_limit)).withColumn("_fits", fits)
    first = F.min(F.when(F.col("_fits"), F.struct("_n", "_level"))).over(Window.partitionBy())
    return numbered.withColumn("_own", first["_level"] * F.col("weight")).select(
        "source",
        "source_size",
        "weight",
        "tilt",
        F.least(F.coalesce("_own", F.lit(0.0)), F.col("_limit").cast("double")).alias("target"),
    )


def _moment(share: Column, tilt: Column) -> Column:
    """When a source has given ``share`` of its target: the inverse of t + tilt * (t * t - t)."""
    return 2 * share / (1 - tilt + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share))


def plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, tilt: float = TILT, key: int = KEY
) -> DataFrame:
    """doc_id, text_hash, twin, source, size, source_size, target, taken, positions, place for every row.

    positions lists when the document is read, at most ``epochs`` times; taken is that many times its size. A pass over
    a document belongs to the mix when its middle word is within the target, so the words taken from a source differ
    from the target by half a document at most. Documents without words are read where they stand and weigh nothing.
    Equal input gives equal results: the order within a source hangs on the key, the id and the text. Null sources are
    one source, the last; null ids and texts, repeated rows and ties are rows like others; an empty table gives none.
    place orders all rows: the first position, or a number above 1 for rows that are not read.
    """
    rows = cut(sized(docs))
    known = targets(rows, weights, epochs, tilt)
    # Rows that tie here are equal.
    turn = F.md5(F.concat_ws("/", F.lit(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))
    rows = rows.withColumn("turn", turn)
    placed = running(rows, ["source"], [F.col("turn"), F.col("doc_id"), F.col("text_hash")], {"reached": F.col("size")})
    # One row per source, so this side is small or Spark joins by sorting; hot sources are then split at run time.
    joined = placed.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    start = F.col("reached") - F.col("size")
    middle = lambda e: 2 * (start + e * F.col("source_size")) + F.col("size")
    passes = F.filter(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (middle(e) <= 2 * F.col("target")) & (F.col("target") > 0))
    positions = F.transform(passes, lambda e: _moment(middle(e) / (2 * F.col("target")), F.col("tilt")))
    own = F.pmod(F.xxhash64(F.lit(key), "text_hash"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return joined.withColumn("positions", positions).select(
        "doc_id",
        "text_hash",
        "twin",
        "source",
        "size",
        "source_size",
        "target",
        (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        "positions",
        F.coalesce(F.get("positions", F.lit(0)), 1 + own).alias("place"),
    )


def in_order(planned: DataFrame) -> DataFrame:
    """Range-sorted by place, whatever share of the rows is read."""
    return planned.repartitionByRange(shuffle_parts(planned.sparkSession), "place").sortWithinPartitions("place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training stream: rows of ``docs`` with all their columns, once per position, range-sorted by it.

    Rows that are not read are left out. Fully equal rows (id and text) share out their positions.
    """
    read = plan(docs, **options).filter(F.size("positions") > 0)
    key, twin, lists, turn, at = (free_name(docs, x) for x in ("key", "twin", "lists", "turn", "at"))
    # One row, but for fully equal ones.
    shared = read.groupBy(F.col("text_hash").alias(key), F.col("twin").alias(twin)).agg(F.array_sort(F.collect_list("positions")).alias(lists))
    id_ = F.col("doc_id").cast("long")
    keyed = docs.withColumns({key: F.xxhash64(id_, "text"), twin: F.hash(id_, "text")})
    found = keyed.join(cut(shared), [key, twin]).withColumn(turn, F.row_number().over(Window.partitionBy(key, twin).orderBy("source")) - 1)
    stream = found.select(*[F.col(c) for c in docs.columns], F.explode(F.get(lists, F.col(turn))).alias(at))
    return stream.repartitionByRange(shuffle_parts(docs.sparkSession), at).sortWithinPartitions(at).drop(at)
