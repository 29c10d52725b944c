"""Benchmark decontamination by spaced seeds, DataFrame operations only.

A seed mask looks at some of the words under it and ignores the others. Hashes under each mask are taken at every word
of every text and joined to those of the benchmark; around a hit, windows of WINDOW words are compared word by word. The
two masks below hit every window with up to two of 13 words changed, so each such window is found.

The benchmark is read in blocks of a bounded number of words, and each block's index is broadcast; texts are never
shuffled, only their verified windows are. A test set of any size works, one pass over the texts for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, ascii_lower, text_of

#: Words of a window and the most of them that may differ.
WINDOW = 13
CHANGED = 2
#: Seen words of each mask; a test tries them against all pairs of changed words.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
#: Benchmark words in one broadcast index; a word's place takes about half a kilobyte.
BLOCK_WORDS = 40_000


def _split(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), WORD_GAP), "")


def _hash(hashes: str, at: Column, mask: tuple[int, ...]) -> Column:
    """Null where the mask does not fit."""
    places = [F.get(hashes, at + k) for k in mask]
    return F.when(places[-1].isNotNull(), F.xxhash64(*places))


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """Items (item, words, block); an item is never split, blocks hold about ``block_words`` words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), _split(text_of("text")).alias("words")).filter(F.size("words") > 0)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block_words)
    return items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, n)))), n


def _index(items: DataFrame, mask: tuple[int, ...], name: str, size: int, flank: int) -> DataFrame:
    """One row per hash under the mask, with all places: item, word, words around it, bounds of the item."""
    hashed = items.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    placed = hashed.select("item", "words", "hashes", F.posexplode("words").alias("word", "_w"))
    around = F.array(*[F.when(F.col("word") + k >= 0, F.get("words", F.col("word") + k)) for k in range(-flank, size)])
    return (
        placed.withColumn(name, _hash("hashes", F.col("word"), mask))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.collect_list(F.struct("item", "word", F.size("words").alias("size"), around.alias("around"))).alias(f"{name}_at"))
    )


def _hits(texts: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...], size: int, changed: int) -> DataFrame:
    """Verified windows of ``size`` words: doc_id, text_hash, item, word (start in the text), item_word, equal."""
    flank = size - 1 - min(m[-1] for m in masks)
    rolled = texts.select("doc_id", "text_hash", "words", "hashes", F.posexplode("hashes").alias("word", "_h"))
    names = [f"mask{k}" for k in range(len(masks))]
    found = rolled.withColumns({n: _hash("hashes", F.col("word"), m) for n, m in zip(names, masks)})
    for n, m in zip(names, masks):
        found = found.join(F.broadcast(_index(items, m, n, size, flank)), n, "left")
    place = "array<struct<item:bigint,word:int,size:int,around:array<string>>>"
    none = F.array().cast(place)
    hits = (
        found.filter(F.coalesce(*[F.col(f"{n}_at") for n in names]).isNotNull())
        .select("doc_id", "text_hash", "words", "word", F.explode(F.concat(*[F.coalesce(F.col(f"{n}_at"), none) for n in names])).alias("p"))
    )
    same = {k: F.coalesce((F.get("words", F.when(F.col("word") + k >= 0, F.col("word") + k)) == F.get("p.around", F.lit(k + flank))).cast("int"), F.lit(0)) for k in range(-flank, size)}
    # Equal words in each window that holds the hit; a window must lie in the item and in the text.
    windows = F.array(
        *[
            F.when(
                (F.col("p.word") + s >= 0) & (F.col("p.word") + s + size <= F.col("p.size"))
                & (F.col("word") + s >= 0) & (F.col("word") + s + size <= F.size("words")),
                F.struct(sum((same[k] for k in range(s, s + size)), F.lit(0)).alias("equal"), F.lit(s).alias("shift")),
            )
            for s in range(-flank, 1)
        ]
    )
    best = hits.select("doc_id", "text_hash", "word", F.col("p.item").alias("item"), F.col("p.word").alias("item_word"), F.array_max(windows).alias("best"))
    return best.filter(F.col("best.equal") >= size - changed).select(
        "doc_id",
        "text_hash",
        "item",
        (F.col("word") + F.col("best.shift")).alias("word"),
        (F.col("item_word") + F.col("best.shift")).alias("item_word"),
        F.lit(size).alias("size"),
        F.col("best.equal").alias("equal"),
    )


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    changed: int = CHANGED,
    masks: tuple[tuple[int, ...], ...] = MASKS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, text_hash, item, first_word, last_word, n_equal, similarity: a row per text and item that overlap.

    They overlap where ``window`` consecutive words of both differ in at most ``changed`` places (13 and 2: similarity
    0.8 or more). An item of fewer words must occur whole and unchanged. Words are those of the license scan. Null and
    empty texts and items overlap nothing; rows with equal doc_id and text give one row per item; null ids stay null;
    empty tables give no rows; other columns are not read.
    """
    if window - 1 < max(m[-1] for m in masks):
        raise ValueError("a mask is longer than the window")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _split(text_of("text")).alias("words")
    ).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    items, n = _blocks(benchmark, block_words)
    # Lengths of the short items: window - 1 of them at most.
    short = [r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < window).distinct().collect()]
    found = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item long, word int, item_word int, size int, equal int")
    for block in range(n):
        part = items.filter(F.col("block") == block)
        found = found.unionByName(_hits(texts, part.filter(F.size("words") >= window), masks, window, changed))
        for size in sorted(short):
            whole = (tuple(range(size)),)
            found = found.unionByName(_hits(texts, part.filter(F.size("words") == size), whole, size, 0))
    return found.groupBy("doc_id", "text_hash", "item").agg(
        F.min("word").cast("long").alias("first_word"),
        F.max(F.col("word") + F.col("size") - 1).cast("long").alias("last_word"),
        F.max("equal").cast("long").alias("n_equal"),
        F.max(F.col("equal") / F.col("size")).alias("similarity"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document with an overlap: doc_id, text_hash, items (ids, comma-joined in order), n_items, first_word,
    last_word, similarity. Options and special cases are those of ``overlaps``; an item without id counts but has no
    place in the list."""
    # A text overlaps each item at most once here, so the list is as long as the test set at most.
    return overlaps(docs, benchmark, **options).groupBy("doc_id", "text_hash").agg(
        F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"),
        F.count("*").alias("n_items"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.max("similarity").alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no item, all columns as they are."""
    found = leaks(docs, benchmark, **options).select("doc_id", "text_hash")
    same_id = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"])
    return docs.join(found, same_id & F.xxhash64(docs["text"]).eqNullSafe(found["text_hash"]), "left_anti")
