"""License scans by diagonal voting.

Every rolling word k-gram hash of every text is joined to the places of equal k-grams in the templates. A hit votes for
the diagonal (word in the text minus word in the template); votes are counted per text, template and diagonal,
neighbouring diagonals (a word added or lost) are merged into spans, and a span counts when the template words under
its verified hits are enough. Phrases must be whole and consecutive: all their votes on one diagonal.

The templates are a parameter of the code, a few thousand words, so their places are the broadcast side; texts are read
once and never shuffled: only votes and one row per text are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, ascii_lower, cut, text_of

#: k of the phrase templates, which have two words at least, and of the passages.
PHRASE_GRAM = 2
PASSAGE_GRAM = 4
#: Part of a passage's words that a span must cover.
COVERED = 0.8
#: Words by which neighbouring diagonals may differ, and that may lie between two runs of a span.
SHIFT = 3
GAP = 8
#: Template words in all, so that the places fit in a broadcast.
TEMPLATE_WORDS = 50_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


#: Phrases and their labels.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Well-known sentences of public licenses.
PASSAGES = [
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template(
        "apache-notice",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit-notice", "released under the mit license"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def _places(spark, templates: list[Template], first: int, gram: int, column: str) -> DataFrame:
    """One row per k-gram hash with all places (template, word, the k words)."""
    rows = []
    for t, template in enumerate(templates, first):
        words = template.text.split()
        if len(words) < gram:
            raise ValueError(f"a template has fewer than {gram} words: {template.text!r}")
        rows += [(t, k, words[k : k + gram]) for k in range(len(words) - gram + 1)]
    if sum(len(r[2]) for r in rows) > TEMPLATE_WORDS * gram:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    frame = spark.createDataFrame(rows, "template int, at int, gram array<string>")
    key = F.xxhash64(*[F.xxhash64(F.get("gram", F.lit(k))) for k in range(gram)])
    return frame.groupBy(key.alias(column)).agg(F.collect_list(F.struct("template", "at", "gram")).alias(f"{column}_at"))


def votes(docs: DataFrame, phrases: list[Template], passages: list[Template]) -> DataFrame:
    """One row per verified hit (row, doc_id, word, template, at) and one per text, whose template is null and whose
    word is the number of words."""
    spark = docs.sparkSession
    words = F.array_remove(F.split(ascii_lower(text_of("text")), WORD_GAP), "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    hashed = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rolled = hashed.select("doc_id", "row", "words", "hashes", F.posexplode(F.concat("hashes", F.array(F.lit(0).cast("long")))).alias("word", "_h"))
    near = lambda k: F.get("hashes", F.col("word") + k)
    short = F.xxhash64(*[near(k) for k in range(PHRASE_GRAM)])
    long = F.xxhash64(*[near(k) for k in range(PASSAGE_GRAM)])
    found = (
        rolled.withColumns({"short": short, "long": long})
        .join(F.broadcast(_places(spark, phrases, 0, PHRASE_GRAM, "short")), "short", "left")
        .join(F.broadcast(_places(spark, passages, len(phrases), PASSAGE_GRAM, "long")), "long", "left")
        .filter(F.col("short_at").isNotNull() | F.col("long_at").isNotNull() | (F.col("word") == F.size("words")))
    )
    none = F.array().cast("array<struct<template:int,at:int,gram:array<string>>>")
    own = F.struct(F.lit(None).cast("int").alias("template"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("gram"))
    hits = F.concat(
        F.coalesce("short_at", none),
        F.coalesce("long_at", none),
        F.when(F.col("word") == F.size("words"), F.array(own)).otherwise(none),
    )
    here = F.slice("words", F.col("word") + 1, F.greatest(F.size("hit.gram"), F.lit(0)))
    return (
        found.select("doc_id", "row", "word", "words", F.explode(hits).alias("hit"))
        .filter(F.col("hit.template").isNull() | (here == F.col("hit.gram")))
        .select("doc_id", "row", "word", F.col("hit.template").alias("template"), F.col("hit.at").alias("at"))
    )


def _found(hits: DataFrame, phrases: list[Template], passages: list[Template]) -> DataFrame:
    """row, label, first, last, phrase, score of all spans of ``votes`` rows; a phrase's score is 1."""
    templates = [*phrases, *passages]
    known = hits.sparkSession.createDataFrame(
        [(t, x.label, x.phrase, len(x.text.split())) for t, x in enumerate(templates)],
        "template int, label string, phrase boolean, size int",
    )
    diagonals = (
        hits.filter(F.col("template").isNotNull())
        .groupBy("row", "template", (F.col("word") - F.col("at")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.min("word").alias("first"), F.max("word").alias("last"), F.collect_set("at").alias("ats"))
        .join(F.broadcast(known), "template")
    )
    whole = diagonals.filter(F.col("phrase") & (F.col("votes") == F.col("size") - PHRASE_GRAM + 1))
    base = whole.select(
        "row", "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(True).alias("phrase"), F.lit(1.0).alias("score")
    )
    by = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    breaks = (
        F.lag("diagonal").over(by).isNull()
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > SHIFT)
        | (F.col("first") > F.lag("last").over(by) + GAP)
    )
    merged = (
        diagonals.filter(~F.col("phrase"))
        .withColumn("_new", breaks.cast("int"))
        .withColumn("span", F.sum("_new").over(by))
        .groupBy("row", "template", "label", "size", "span")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    )
    # Both lists are as long as a template at most.
    under = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.lit(PASSAGE_GRAM - 1))))))
    passage = merged.select(
        "row", "label", "first", (F.col("last") + PASSAGE_GRAM - 1).alias("last"), F.lit(False).alias("phrase"), (under / F.col("size")).alias("score")
    )
    return base.unionByName(passage)


def _texts(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("template").isNull()).select("doc_id", "row", F.col("word").cast("long").alias("n_words"))


def spans(
    docs: DataFrame, phrases: list[Template] = PHRASES, passages: list[Template] = PASSAGES, covered: float = COVERED
) -> DataFrame:
    """doc_id, label, first, last (words, from 0), score: every verified span; special cases as in ``scan``."""
    hits = cut(votes(docs, phrases, passages))
    found = _found(hits, phrases, passages).filter(F.col("score") >= covered)
    return _texts(hits).join(found, "row").select("doc_id", "label", "first", "last", "score")


def scan(
    docs: DataFrame, phrases: list[Template] = PHRASES, passages: list[Template] = PASSAGES, covered: float = COVERED
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    n_base, first_word, last_word and base_labels tell of the phrases; labels adds those of the passages; score is the
    largest part of a template that one span covers. Null and empty texts have no words, no labels and score 0; each of
    several rows with one doc_id gets its own row; null ids stay null; an empty table gives no rows; other columns are
    not read.
    """
    hits = cut(votes(docs, phrases, passages))
    # A span that covers too little still counts for the score.
    found = _found(hits, phrases, passages).withColumn("sure", F.col("score") >= covered)
    told = found.groupBy("row").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sure"), F.col("label")))), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return _texts(hits).join(told, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
