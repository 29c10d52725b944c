import itertools
import random
import re

from personagraph.llm import spaced_seeds as S

from . import fixtures


def words(text):
    return fixtures.WORD.findall(fixtures.lowered(text))


def overlap(a, b, size=S.WINDOW, changed=S.CHANGED):
    """Whether windows of both differ in few places; short items must occur whole."""
    if not b:
        return False
    if len(b) < size:
        size, changed = len(b), 0
    for p in range(len(a) - size + 1):
        for q in range(len(b) - size + 1):
            if sum(x != y for x, y in zip(a[p : p + size], b[q : q + size])) <= changed:
                return True
    return False


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").selectExpr("*", "'x' AS words", "1 AS block")


def test_masks_meet_every_pair_of_changes():
    for changed in itertools.combinations(range(S.WINDOW), S.CHANGED):
        assert any(
            not {at + k for k in mask} & set(changed) for mask in S.MASKS for at in range(S.WINDOW - mask[-1])
        )


def test_against_brute_force(spark):
    rng = random.Random(8)
    bench = [fixtures.prose(rng, rng.randint(3, 40)) for _ in range(25)] + [None, "", "...", "solo"]
    data = [(None, bench[0], "", "", 0), (500, None, "", "", 0), (501, "", "", "", 0), (502, bench[3], "", "", 0), (502, bench[3], "", "", 0)]
    for k in range(120):
        text = fixtures.prose(rng, rng.randint(20, 120)).split()
        piece = (rng.choice(bench[:25])).split()
        start = rng.randrange(max(1, len(piece) - 12))
        piece = piece[start : start + rng.randint(4, 30)]
        for _ in range(rng.randint(0, 4)):
            piece[rng.randrange(len(piece))] = "changed"
        at = rng.randrange(len(text))
        data.append((k, " ".join(text[:at] + piece + text[at:]), "", "", 0))
    split = [words(t) for t in bench]
    want = {(r[0], i) for r in data for i, b in enumerate(split) if overlap(words(r[1]), b)}
    for block in (S.BLOCK_WORDS, 150):
        got = S.overlaps(fixtures.docs(spark, data), items(spark, bench), block_words=block).collect()
        assert {(r["doc_id"], r["item"]) for r in got} == want
    assert len(want) > 40
    df = fixtures.docs(spark, data)
    kept = S.clean(df, items(spark, bench))
    assert kept.columns == df.columns
    leaking = {d for d, _ in want}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r[0]) for r in data if r[0] not in leaking)


def test_empty_tables(spark):
    df = fixtures.docs(spark)
    assert S.leaks(df, items(spark, []).limit(0)).collect() == []
    assert S.leaks(fixtures.docs(spark, []), items(spark, ["some words of an item"])).collect() == []
    assert S.clean(df, items(spark, [None])).count() == df.count()


def test_native_plan(spark):
    plan = S.leaks(fixtures.docs(spark), items(spark, ["some words of an item"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_windows_lie_in_the_text(spark):
    item = " ".join("abcdefghijklmnop")
    texts = [item[10:], item[:22], item[4:], f"x y {item[6:]}", "q " + item[2:26] + " z", item]
    data = [(k, t, "", "", 0) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in S.leaks(fixtures.docs(spark, data), items(spark, [item])).collect()}
    assert set(got) == {k for k, t in enumerate(texts) if overlap(t.split(), item.split())} == {2, 3, 4, 5}
    assert all(0 <= a and b < len(texts[k].split()) and b - a >= 12 for k, (a, b) in got.items())
