import random
import re

from personagraph.llm import line_edit_join as L
from personagraph.llm.catalog import QUERIES

from . import fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0:
            out.insert(at, rng.choice("abc😀"))
        elif at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.choice("abc😀")]
    return "".join(out).strip()


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    lines = set()
    for _ in range(8):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randint(6, 14)))
        lines |= {edited(rng, base, rng.randint(0, 4)) for _ in range(12)}
    lines = sorted(lines - {""})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    for edits in (1, 2):
        want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if distance(lines[a], lines[b]) <= edits}
        assert {tuple(r) for r in L.links(df, edits).collect()} == want
        assert len(want) > 10


def test_crowded_lines_make_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(60)]
    lines = {" ".join(words)}
    for _ in range(150):  # near copies of one line, each with its own words changed
        lines.add(" ".join(f"{rng.randrange(10**6):06d}" if rng.random() < 0.03 else w for w in words))
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    crowded = L.candidates(df).count()
    assert crowded < len(lines) ** 2 / 40
    monkeypatch.setattr(L, "SENT_IDS", 0)  # the way of many ids
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if abs(len(lines[a]) - len(lines[b])) <= 2 and sum(x != y for x, y in zip(lines[a].split(), lines[b].split())) <= 2 and distance(lines[a], lines[b]) <= 2}
    assert {tuple(r) for r in L.links(df).collect()} == want


def test_short_lines_are_joined(spark):
    rng = random.Random(5)
    lines = {"Are, is anwh reenen.", "Are. Is anwh reenen.", "Thwhesnd, esator whshing and hewh.", "Thwhesnd. Esator whshing and hewh."}
    for n in range(3, 16):
        base = "".join(rng.choice("abcdefgh") for _ in range(n))
        lines |= {edited(rng, base, rng.randint(0, 3)) for _ in range(6)}
    lines = sorted(lines - {""})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    allowed = lambda a, b: min(2, max(len(a), len(b)) // 6)
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if distance(lines[a], lines[b]) <= allowed(lines[a], lines[b])}
    got = [tuple(r) for r in L.near_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {min(len(lines[k]) for k in w) for w in want} >= {7, 12, 20, 34}
    rows = L.repeated(fixtures.docs(spark, [(1, lines[lines.index("Are, is anwh reenen.")], "", "", 0), (2, "Are. Is anwh reenen.", "", "", 0)])).collect()
    assert [r["n_links"] for r in rows] == [1, 1]


LINE = "This is a line that is long enough to be compared with others."
DATA = [
    (2, f"{LINE}\nshort\n\n{LINE} ", "", "", 0),
    (1, f"short\n{LINE[:-1]}!\nown words here", "", "", 0),
    (3, "shorn\n" + LINE.replace("long", "lung"), "", "", 0),
    (4, None, "", "", 0),
    (5, "", "", "", 0),
    (None, "short", "", "", 0),
]


def test_repeated(spark):
    got = {(r["doc_id"], r["line_no"]): tuple(r)[2:] for r in L.repeated(fixtures.docs(spark, DATA)).collect()}
    assert got == {
        (1, 0): (5, 3, 0, 1, 0),
        (1, 1): (len(LINE), 1, 2, 1, 1),
        (2, 0): (len(LINE), 2, 2, 1, 1),
        (3, 1): (len(LINE), 1, 2, 1, 1),
    }


def test_members_name_every_place(spark):
    data = [*DATA, (6, f"x\n{LINE}", "", "", 0), (6, f"x\n{LINE}", "", "", 0)]
    got = sorted(map(str, (tuple(r) for r in L.members(fixtures.docs(spark, data)).collect())))
    line, short = (len(LINE),), (5, 3, 0, 1, 0)
    want = [(1, 0, *short), (2, 1, *short), (None, 0, *short), (1, 1, *line, 1, 2, 1, 1), (3, 1, *line, 1, 2, 1, 1)]
    want += [(2, k, *line, 4, 2, 1, 1) for k in (0, 3)] + [(6, 1, *line, 4, 2, 1, 1)] * 2 + [(6, 0, 1, 2, 0, 6, 0)] * 2
    assert got == sorted(map(str, want))
    assert L.members(fixtures.docs(spark, [])).collect() == []


def test_query_names_every_place(spark, tmp_path):
    fixtures.docs(spark, DATA).write.parquet(f"{tmp_path}/documents.parquet")
    places = {(r["doc_id"], r["line_no"]) for r in QUERIES["op9_line_edit_join"](spark, str(tmp_path)).collect()}
    assert places == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 3), (3, 1), (None, 0)}


def test_clean(spark):
    df = fixtures.docs(spark, DATA)
    got = L.clean(df)
    assert got.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {1: DATA[1][1], 2: "", 3: "shorn", 4: None, 5: "", None: ""}


def test_odd_rows_and_empty_table(spark):
    assert L.repeated(fixtures.docs(spark, [])).collect() == []
    n = sum(bool(x.strip(" \t\r\x0b\x0c")) for r in fixtures.rows() for x in (r[1] or "").split("\n"))
    assert L.occurrences(fixtures.docs(spark)).count() == n
    rows = L.repeated(fixtures.docs(spark)).collect()
    assert {2, 9, 11} <= {r["n_copies"] for r in rows}


def test_native_plan(spark):
    plan = L.repeated(fixtures.docs(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
