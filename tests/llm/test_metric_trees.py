import hashlib
import math

import duckdb
import numpy as np
import pytest

from personagraph.llm import metric_trees as M
from personagraph.llm.catalog import ORACLES

VECTORS = "vec_id long, embedding array<float>, label int, code string, ids long"


def slow(data):
    """vec_id, code, error, label_error and digest of every kept row, in plain integers."""
    keep = [r for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = -(-max((len(r[1]) for r in keep), default=0) // 8) * 8
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (dims - len(r[1])) for r in keep]
    size = dims // 8
    parts = [[v[p * size : (p + 1) * size] for v in whole] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(6):
        for p in range(8):
            owner = [near(x, books[p])[1] for x in parts[p]]
            for k in range(len(books[p])):
                own = [x for x, o in zip(parts[p], owner) if o == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    text = ",".join(str(c) for book in books for y in book for c in y)
    found = [[near(parts[p][k], books[p]) for p in range(8)] for k in range(len(keep))]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = {}
    for r, e in zip(keep, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(text.encode()).hexdigest()
    rows = [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(keep, found, errors)]
    return sorted(rows, key=str)


def table(spark, data):
    return spark.createDataFrame([(*r, "x", 7) for r in data], VECTORS)


def result(spark, data):
    rows = M.report(table(spark, data)).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows), key=str)


def clustered(rng, n, dims, groups=12):
    centres = rng.normal(size=(groups, dims))
    points = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dims)) * 0.05
    return points.astype(np.float32).tolist()


def test_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    data = [(3 * k, v, int(k % 4) if k % 5 else None) for k, v in enumerate(clustered(rng, 400, 16))]
    data += [(1000 + k, data[7][1], 2) for k in range(150)]  # a group of copies
    data += [(3, data[1][1], 1), (3, data[1][1], 1), (None, data[9][1], None)]
    data += [(1, None, 0), (2, [0.5] * 15 + [None], 0), (4, [float("nan")] * 16, 0), (5, [float("inf")] + [0.0] * 15, 0)]
    data += [(6, [-0.0001] * 16, 9), (7, [0.3] * 5, 9), (8, [], 9), (10, [1e30, -1e30] + [0.0] * 14, None)]
    want = data[:-1]
    assert result(spark, want) == slow(want)
    assert len(result(spark, data)) == len(want) - 4 + 1  # a component beyond all sizes is held to the bound


def test_lengths_that_are_no_multiple_and_few_vectors(spark):
    rng = np.random.default_rng(4)
    data = [(k, v, 1) for k, v in enumerate(clustered(rng, 60, 11))]
    assert result(spark, data) == slow(data)
    assert result(spark, data[:5]) == slow(data[:5])
    assert result(spark, data[:1]) == slow(data[:1])


def test_empty_table(spark):
    got = M.report(table(spark, []))
    assert got.collect() == [] and got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert M.report(table(spark, [(1, None, 0), (2, [None], 1)])).collect() == []
    assert [tuple(r)[2:5] for r in M.report(table(spark, [(2, [], 1)])).collect()] == [("00" * 8, 0, 0)]


def test_sql_says_the_same(spark):
    rng = np.random.default_rng(5)
    data = [(k if k % 50 else -k, v, int(k % 3) if k % 7 else None) for k, v in enumerate(clustered(rng, 200, 16))]
    data += [(900, None, 0), (901, [0.5] * 15 + [None], 0), (902, [float("nan")] * 16, 0), (903, data[0][1], 0)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in data])
    cur = con.execute(ORACLES["op12_metric_trees"])
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")]
    assert sorted((tuple(r[k] for k in order) for r in cur.fetchall()), key=str) == slow(data) == result(spark, data)


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_balls_hold_their_points(kind):
    rng = np.random.default_rng(6)
    points = np.floor(np.array(clustered(rng, 1500, 24)) * 4096).astype(kind)
    balls, rows, vectors = M.forest(points)
    assert sorted(vectors[:1500]) == list(range(1500))
    for b in balls:
        own = rows[b["start"] : b["stop"]]
        assert (own.sum(0) == b["total"]).all()
        assert ((own - b["pivot"]) ** 2).sum(1).max() == b["radius2"]
        if b["left"] >= 0:
            left, right = balls[b["left"]], balls[b["right"]]
            assert (left["start"], left["stop"], right["stop"]) == (b["start"], right["start"], b["stop"])
        else:
            assert b["stop"] - b["start"] <= M.LEAF or b["radius2"] == 0


def test_anchors_own_their_nearest_points():
    points = np.floor(np.random.default_rng(7).normal(size=(600, 3)) * 4096)
    owner = M.anchors(points)
    assert owner.max() + 1 == 25
    pivots = [points[0]]
    for _ in range(24):  # farthest first
        pivots.append(points[np.min([((points - p) ** 2).sum(1) for p in pivots], axis=0).argmax()])
    to = np.array([((points - p) ** 2).sum(1) for p in pivots])
    assert (to[owner, np.arange(600)] == to.min(0)).all()


def test_lists_shrink_until_balls_are_owned():
    """Nearly all points of well parted groups are settled by balls, and the tally is that of all points."""
    rng = np.random.default_rng(8)
    points = np.floor(np.array(clustered(rng, 3000, 16, groups=8)) * 4096)
    balls, rows, _ = M.forest(points)
    books = np.stack([points[:16, 2 * p : 2 * p + 2] for p in range(8)])
    owned, _, leaves = M.descend(balls, books)
    settled = sum(balls["stop"][k] - balls["start"][k] for k in owned)
    assert settled + sum(balls["stop"][k] - balls["start"][k] for k in leaves) == 8 * 3000
    apart = np.stack([points[[0] * 16, 2 * p : 2 * p + 2] + 1e5 * np.arange(16)[:, None] for p in range(8)])
    assert len(M.descend(balls, apart)[0]) == 8 and len(M.descend(balls, apart)[2]) == 0
    totals, counts = M.tally(balls, rows, books)
    for p in range(8):
        own = points[:, 2 * p : 2 * p + 2]
        near = ((own[:, None] - books[p]) ** 2).sum(2).argmin(1)
        assert (np.bincount(near, minlength=16) == counts[p]).all()
        assert (np.stack([own[near == k].sum(0) for k in range(16)]) == totals[p]).all()
