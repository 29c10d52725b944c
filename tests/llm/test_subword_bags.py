import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from personagraph.llm import subword_bags as S

from . import fixtures

LABELS = "doc_id long, quality int, toxic int, text string"
BAD = "grumbol vrattek schnozzik plimfarg".split()


def abuse(rng, text, words=BAD):
    out = text.split(" ")
    for k in range(5, len(out), 15):
        out[k] = rng.choice(words)
    return " ".join(out)


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    data, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = fixtures.prose(rng, rng.randint(60, 200))
        data.append((k, abuse(rng, text) if toxic else text, "en", "src0", 0))
        labels.append((k, 1, int(toxic), "x"))
    return data, labels


def test_held_out_accuracy_and_misspelt_words(spark):
    data, labels = corpus()
    rng = random.Random(8)
    unseen = ["grumboll", "vratttek", "schnozzikk", "plimfargg"]
    data += [(10_000 + k, abuse(rng, fixtures.prose(rng, 150), unseen), "en", "src0", 0) for k in range(30)]
    got = {r["doc_id"]: r for r in S.toxicity(fixtures.docs(spark, data), spark.createDataFrame(labels, LABELS)).collect()}
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {k for k, r in got.items() if r["held_out"] and k < 10_000} and len(held) > 80
    right = [got[r[0]]["predicted"] == r[2] for r in held]
    assert sum(right) / len(right) >= 0.97
    assert sum(got[10_000 + k]["predicted"] for k in range(30)) >= 24
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_buckets_are_those_of_each_word_alone():
    some = ["idiot!!", "été", "a", "...", "x" * 300, "idiot", "😀b"]
    found, starts = S.buckets(some)
    ends = [*starts[1:], len(found)]
    alone = [S.buckets([w])[0].tolist() for w in some]
    assert [found[a:b].tolist() for a, b in zip(starts, ends)] == alone
    assert sorted(alone[0]) == sorted(alone[5])  # signs at the ends do not count
    assert len(alone[5]) == 5 + 4 + 3 + 1  # three- to five-grams of <idiot>, and the word
    assert len(set(alone[5]) & set(S.buckets(["idiiot"])[0].tolist())) >= 5


def test_score_is_the_softmax_of_the_mean(spark):
    rng = np.random.default_rng(2)
    model = S.Model(rng.normal(size=1 << S.BUCKET_BITS).astype(np.float32) * 30, -1.5)
    texts = ["one two, two", "", " \n", "One", "x" * 100_000, fixtures.prose(random.Random(1), 5000)]

    def slow(text):
        total = 0.0
        for w in text.lower().split():
            found = S.buckets([w])[0]
            total += float(np.mean(model.adds[found].astype(float)))
        z = model.bias + total / (len(text.split()) + S.BLANKS)
        return 1 / (1 + math.exp(-z))

    assert np.allclose(list(model.scores(texts)), [slow(t) for t in texts], atol=1e-12)
    data = [(k, t, "", "", 0) for k, t in enumerate(texts)]
    got = S.toxicity(fixtures.docs(spark, data), spark.createDataFrame([], LABELS), model).collect()
    assert np.allclose([r["score"] for r in sorted(got, key=lambda r: r["doc_id"])], [slow(t) for t in texts], atol=1e-12)


def test_products_of_tables():
    rng = np.random.default_rng(4)
    row, column, weight = rng.integers(7, size=40), rng.integers(9, size=40), rng.normal(size=40)
    full = np.zeros((7, 9))
    np.add.at(full, (row, column), weight)
    table = S.Table(row, column, weight, 7, 9)
    x, y = rng.normal(size=(3, 9)), rng.normal(size=(3, 7))
    assert np.allclose(table.times(x), x @ full.T, atol=1e-5) and np.allclose(table.times(y, back=True), y @ full, atol=1e-5)


def test_odd_rows_and_tables(spark):
    data, labels = fixtures.rows(), [(k, 1, k % 2, "x") for k in range(40)] + [(None, 1, 1, "x"), (3, 1, None, "x"), (4, 1, 7, "x"), (5, 0, 1, "x")]
    told = spark.createDataFrame(labels, LABELS).withColumn("score", F.lit("x"))
    got = S.toxicity(fixtures.docs(spark, data).withColumn("held_out", F.lit("x")).withColumn("toxic", F.lit(1)), told)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(data) and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)
    again = S.toxicity(fixtures.docs(spark, data), told).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert {r["score"] for r in S.toxicity(fixtures.docs(spark, data), spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert S.toxicity(fixtures.docs(spark, []), told).collect() == []
    texts, toxic = S.sample(fixtures.docs(spark, data), told, 10)
    assert len(texts) == len(set(texts)) == len(toxic) == 10
