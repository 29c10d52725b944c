import random
import re

import numpy as np

from personagraph.llm import quality_votes as Q
from personagraph.llm.catalog import ORACLES

from . import fixtures


def slow_counts(text):
    words = fixtures.SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if fixtures.SPACED.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(x in lines[:k] for k, x in enumerate(lines)),
        len(covered),
    )


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["a", "b", "é#", "c*", "\x1c", "\x85", " ", "|", "😀"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    data = [(k, t, "", "", 0) for k, t in enumerate(texts)] + [r for r in fixtures.rows() if not r[1] or len(r[1]) < 5000]
    got = [
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in Q.judge(fixtures.docs(spark, data)).collect()
    ]
    want = []
    for r in data:
        n, chars, symbols, dup, repeated = slow_counts(r[1])
        want.append((r[0], n, chars, symbols, dup, repeated, n < 50 or 100 * repeated > 50 * n))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_closing_characters_are_those_of_the_sql():
    (closing,) = re.findall(r"\[(\S+?)\]\[\\x20\\x09-\\x0D\]\*\$", ORACLES["op4_quality_votes"])
    closing = set(closing.replace("''", "'"))
    assert "'" in closing and ")" not in closing
    for c in map(chr, range(33, 127)):
        assert Q.counts(f"a word{c} \nb")[Q.COUNTS.index("n_ended")] == (c in closing), c


def junk(rng, kind):
    text = fixtures.prose(rng, 120)
    if kind == 0:
        return " ".join(w + rng.choice(["***", "###", "%%%"]) for w in text.split())
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in text.split())
    return "\n".join(" | ".join(rng.choice("bcdfg") + "xq" for _ in range(5)) for _ in range(30))


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    good = [(k, fixtures.prose(rng, rng.randint(60, 300)), "", "", 0) for k in range(150)]
    bad = [(1000 + k, junk(rng, k % 3), "", "", 0) for k in range(30)]
    kept = {r["doc_id"] for r in Q.keep_good(fixtures.docs(spark, good + bad)).collect()}
    assert {r[0] for r in good} <= kept
    assert len(kept & {r[0] for r in bad}) <= 3


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.85, 0.7, 0.9])
    votes = np.where(rng.random((20_000, 4)) < right, y[:, None], ~y[:, None]) * 2 - 1
    votes[rng.random((20_000, 4)) < 0.3] = 0
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    quality, told = Q.estimate(patterns, n.astype(float))
    assert abs(told["prior"] - 0.7) < 0.03
    votes_good = told["chances"][:, 1, 2] / (1 - told["chances"][:, 1, 1])
    assert np.abs(votes_good - right).max() < 0.05
    assert ((quality[where.ravel()] > 0.5) == y).mean() > 0.93


def test_columns_and_empty_table(spark):
    df = fixtures.docs(spark)
    assert Q.keep_good(df).columns == df.columns
    assert Q.judge(fixtures.docs(spark, [])).collect() == []
