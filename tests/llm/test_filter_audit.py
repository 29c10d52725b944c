import itertools
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from personagraph.llm import filter_audit as A
from personagraph.llm.catalog import ORACLES

from . import fixtures

LABELS = "doc_id long, quality int, toxic int"


def slow_failures(data):
    """Failing filters of every row, by the words of the contract."""
    out = []
    for doc_id, text, *_ in data:
        text = text or ""
        words = fixtures.SPACED.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in data):
            fails.add("E")
        out.append(fails)
    return out


def slow_audit(data, labels):
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    failures = slow_failures(data)
    rows = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for part in {r[3] or "" for r in data}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, letter in enumerate(order):
                row = rows[part, order, k + 1]
                for r, fails in zip(data, failures):
                    if (r[3] or "") != part:
                        continue
                    before = fails & set(order[:k])
                    here = letter in fails and not before
                    row[0] += not before and letter not in fails
                    row[1] += here
                    row[2] += letter in fails and bool(before)
                    row[3] += fails == {letter}
                    row[4] += here and r[0] in good
                    row[5] += here and r[0] in toxic
                shapley[part, letter] += row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items())


def table():
    data = fixtures.rows(n=12)
    data += [
        (200, "AB CD " * 120, "en", "", 0),
        (201, "a b | c " * 90, "en", None, 0),
        (199, "AB CD " * 120, "en", "src1", 0),
        (200, "AB CD " * 120, "en", "src1", 0),
        (203, "x\x0by\x1cz　w " * 100, "en", "src1", 0),
    ]
    labels = [(r[0], k % 3, k % 2) for k, r in enumerate(data[:-2])]
    labels += [(200, 0, 0), (200, 1, None), (None, 1, 1), (99999, 1, 1), (3, None, 1)]
    return data, labels


def test_against_brute_force(spark):
    data, labels = table()
    got = A.audit(fixtures.docs(spark, data).withColumn("mask", F.lit("x")).withColumn("part", F.lit("y")), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", *A.COUNTS, "shapley"]
    assert sorted(map(tuple, got.collect())) == slow_audit(data, labels)


def test_sql_says_the_same(spark):
    data, labels = table()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [list(r) for r in data])
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", [list(r) for r in labels])
    cur = con.execute(ORACLES["op11_filter_audit"])
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in ["part", "filter_order", "step", *A.COUNTS, "shapley"]]
    assert sorted(tuple(r[k] for k in order) for r in cur.fetchall()) == slow_audit(data, labels)


def test_empty_tables(spark):
    docs, labels = fixtures.docs(spark, []), spark.createDataFrame([], LABELS)
    assert A.audit(docs, labels).collect() == []
    some = A.audit(fixtures.docs(spark, [(1, None, None, None, None)]), labels).collect()
    assert len(some) == 600 and {r["part"] for r in some} == {""}
    assert {r["shapley"] for r in some} == {0, 120}
