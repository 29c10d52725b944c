import random

from personagraph.llm import license_diagonals as L

from . import fixtures


def places(words, phrase):
    p = phrase.split()
    return [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]


def base(text):
    words = fixtures.WORD.findall(fixtures.lowered(text))
    found = [(k, t.label) for t in L.PHRASES for k in places(words, t.text)]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_against_brute_force(spark):
    rng = random.Random(2)
    pieces = ["GNU General Public License", "apache-license", "CC", "by", "CC BY", "MIT", "license", "Apache", "public", "gnu", "é", "x1", ";", "\n"]
    data = [(k, rng.choice([" ", " -- "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 30))), "en", "s", 0) for k in range(120)]
    data += [r for r in fixtures.rows() if r[0] is None or r[0] > 60]
    got = [tuple(r)[:6] for r in L.scan(fixtures.docs(spark, data)).collect()]
    want = [(r[0], *base(r[1])) for r in data]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_passages_survive_small_changes(spark):
    text = L.PASSAGES[7].text
    words = text.split()
    changed = [*words[:20], "really", *words[20:33], *words[34:]]
    half = words[: len(words) // 3]
    data = [(1, "Some words. " + text.upper() + " more.", "", "", 0), (2, " ".join(changed), "", "", 0), (3, " ".join(half), "", "", 0), (4, "none of it", "", "", 0)]
    got = {r["doc_id"]: r for r in L.scan(fixtures.docs(spark, data)).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["score"] == 1.0 and got[1]["base_labels"] == ""
    assert got[2]["labels"] == "mit-text" and 0.8 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.8
    assert got[4]["score"] == 0


def test_labels_add_to_base(spark):
    got = L.scan(fixtures.docs(spark, [(1, "Licensed under the Apache License, Version 2.0.", "", "", 0)])).first()
    assert (got["base_labels"], got["labels"], got["n_base"], got["first_word"]) == ("apache", "apache,apache-2", 1, 3)


def test_spans(spark):
    text = "some words, Licensed under the Apache License, Version 2.0. The CC BY and MIT license"
    got = sorted(tuple(r) for r in L.spans(fixtures.docs(spark, [(1, text, "", "", 0)])).collect())
    assert got == [(1, "apache", 5, 6, 1.0), (1, "apache-2", 2, 9, 1.0), (1, "cc-by", 11, 12, 1.0), (1, "mit", 14, 15, 1.0)]


def test_empty_table(spark):
    assert L.scan(fixtures.docs(spark, [])).collect() == []
