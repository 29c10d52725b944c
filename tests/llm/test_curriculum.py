import re
from collections import defaultdict

from pyspark.sql import functions as F

from personagraph.llm import curriculum as C

from . import fixtures


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: C.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_against_resharing(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 5, None: 2, "Z": 0}, {"x": 7}, {"é": 50, "z": 50, "A": 50}, {"a": 0, "b": 0}, {"a": 10**9, "b": 1, "c": 1, "d": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in C.targets(df).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_plan(spark):
    data = fixtures.rows()
    rows = C.plan(fixtures.docs(spark)).collect()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in data:
        sizes[r[3]] += len(fixtures.SPACED.findall(r[1] or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r[0]), len(fixtures.SPACED.findall(r[1] or ""))) for r in data)
    want = slow_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == len(r["positions"]) * r["size"] <= 3 * r["size"]
        assert all(0 < p <= 1 for p in r["positions"]) and list(r["positions"]) == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    again = C.plan(fixtures.docs(spark).repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["text_hash"], str(r["positions"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_moment_inverts_the_integral(spark):
    for tilt in (-0.5, 0.0, 0.5, 0.9):
        shares = spark.range(101).select((F.col("id") / 100).alias("u"))
        for r in shares.select("u", C._moment(F.col("u"), F.lit(tilt)).alias("t")).collect():
            assert abs(r["t"] + tilt * (r["t"] ** 2 - r["t"]) - r["u"]) < 1e-9


def test_weights_change_over_time(spark):
    data = [(k, "w " * 10, "", f"s{k % 2}", 0) for k in range(400)]
    rows = C.plan(fixtures.docs(spark, data)).collect()
    mean = {s: [p for r in rows if r["source"] == s for p in r["positions"]] for s in ("s0", "s1")}
    assert sum(mean["s0"]) / len(mean["s0"]) > 0.55 > 0.45 > sum(mean["s1"]) / len(mean["s1"])


def test_mix(spark):
    df = fixtures.docs(spark)
    stream = C.mix(df)
    assert stream.columns == df.columns
    want = defaultdict(int)
    for r in C.plan(df).collect():
        want[str(r["doc_id"]), r["size"]] += len(r["positions"])
    got = defaultdict(int)
    for r in stream.collect():
        got[str(r["doc_id"]), len(fixtures.SPACED.findall(r["text"] or ""))] += 1
    assert got == {k: n for k, n in want.items() if n}


def test_order_and_empty_table(spark):
    places = [r["place"] for r in C.in_order(C.plan(fixtures.docs(spark))).collect()]
    assert places == sorted(places)
    assert C.plan(fixtures.docs(spark, [])).collect() == []
    assert C.mix(fixtures.docs(spark, [])).collect() == []


def test_native_plan(spark):
    plan = C.in_order(C.plan(fixtures.docs(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
