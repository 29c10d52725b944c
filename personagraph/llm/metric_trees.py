"""Vector codes: every vector as the numbers of the nearest codebook entries of its eight parts.

Vectors come in blocks, and each block holds, for each part position, a metric tree of its parts. A tree is built from
the middle out: about the square root of its points become anchors, each new one the point farthest from its own anchor,
and steal the points that are nearer to them (those nearer to their anchor than half of the way between the two anchors
cannot change, so their distances are not worked out); anchors are merged upwards, smallest common ball first, and large
anchors get a hierarchy of their own below. Each ball caches the sum and the number of its points.

A round passes the codebook down the trees. A ball inherits the entries that may own points of it, drops those that
the nearest entry beats everywhere in the ball, and once a single entry is left the cached sum is all that the round
needs of it. Only points of leaves that stay in doubt are compared one by one. Trees are built once and written to the
shared folder; a round sends a task's sums, which do not grow with its rows, and the driver holds nothing but codebooks.

All of it is integer arithmetic: in floats where every value that occurs is below 2**53, else in longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_bytes, cut, scratch

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of the vectors of a block, and points of a ball that is not divided further.
BLOCK = 1 << 17
LEAF = 48
#: Bytes of a row group of the written trees, so that readers hold few blocks at once.
ROW_GROUP = 16 << 20


def _exact(most: int, size: int) -> type:
    """The fastest type that holds squared distances of points of ``size`` components up to ``most``."""
    return np.float64 if 4 * most * most * size < 1 << 53 else np.int64


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = a - b
    return (d * d).sum(-1)


def anchors(points: np.ndarray) -> np.ndarray:
    """The anchor of each point, numbered from 0: about the square root of the points own all of them."""
    owner = np.zeros(len(points), np.int64)
    far = _squares(points, points[0])
    pivots = [0]
    while len(pivots) * len(pivots) < len(points):
        new = int(far.argmax())
        if far[new] == 0:
            break
        gaps = _squares(points[pivots], points[new])
        may = np.flatnonzero(4 * far > gaps[owner])
        to_new = _squares(points[may], points[new])
        won = to_new < far[may]
        owner[may[won]] = len(pivots)
        far[may[won]] = to_new[won]
        pivots.append(new)
    return owner


def _merged(centres: np.ndarray, counts: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to merge, each the pair with the smallest common ball; merged balls get the next numbers."""
    n = len(counts)
    centre, count, radius = centres.astype(float), counts.astype(float), radii.astype(float)
    name = list(range(n))
    common = np.full((n, n), np.inf)

    def row(k: int, others: np.ndarray) -> np.ndarray:
        apart = np.sqrt(((centre[others] - centre[k]) ** 2).sum(1))
        share = count[others] / (count[others] + count[k])  # of the way from ball k to the common centre
        return np.maximum(apart * share + radius[k], apart * (1 - share) + radius[others])

    for k in range(1, n):
        common[k, :k] = row(k, np.arange(k))
    live = np.ones(n, bool)
    out = []
    for step in range(n - 1):
        a, b = divmod(int(common.argmin()), n)
        out.append((name[a], name[b]))
        radius[a] = common[a, b]
        centre[a] = (centre[a] * count[a] + centre[b] * count[b]) / (count[a] + count[b])
        count[a] += count[b]
        name[a] = n + step
        live[b] = False
        common[b, :] = common[:, b] = np.inf
        others = np.flatnonzero(live & (np.arange(n) != a))
        new = row(a, others)
        low = others < a
        common[a, others[low]] = new[low]
        common[others[~low], a] = new[~low]
    return out


def _shape(points: np.ndarray, at: np.ndarray) -> tuple:
    """The tree of ``points`` (whose places are ``at``): a leaf is (places,), an inner ball (left, right)."""
    if len(points) <= LEAF:
        return (at,)
    owner = anchors(points)
    groups = [np.flatnonzero(owner == k) for k in range(int(owner.max()) + 1)]
    if len(groups) == 1:
        return (at,)
    balls = [_shape(points[g], at[g]) for g in groups]
    centres = np.array([points[g].mean(0) for g in groups])
    radii = np.array([np.sqrt(_squares(points[g], c).max()) for g, c in zip(groups, centres)])
    for a, b in _merged(centres, np.array([len(g) for g in groups]), radii):
        balls.append((balls[a], balls[b]))
    return balls[-1]


def _node(size: int) -> np.dtype:
    """A ball: its part, its rows, its children (-1: leaf), squared radius about the pivot, and the sum of its points."""
    return np.dtype(
        [(x, "<i4") for x in ("part", "start", "stop", "left", "right")]
        + [("radius2", "<i8"), ("pivot", "<i4", (size,)), ("total", "<i8", (size,))]
    )


def _tree(points: np.ndarray, part: int, first_node: int) -> tuple[np.ndarray, np.ndarray]:
    """Balls, the root first, and the order of the points in which each ball is a range of rows."""
    order: list[np.ndarray] = []
    links: list[list[int]] = []  # start, stop, left, right
    rows = 0
    stack: list[tuple] = [(_shape(points, np.arange(len(points))), -1, 0)]
    while stack:
        ball, parent, side = stack.pop()
        if ball is None:  # both children are done
            links[parent][1] = rows
            continue
        if parent >= 0:
            links[parent][2 + side] = first_node + len(links)
        if len(ball) == 1:
            order.append(ball[0])
            links.append([rows, rows + len(ball[0]), -1, -1])
            rows += len(ball[0])
        else:
            links.append([rows, 0, -1, -1])
            me = len(links) - 1
            stack += [(None, me, 0), (ball[1], me, 1), (ball[0], me, 0)]
    placed = np.concatenate(order)
    inside = points[placed]
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(inside.astype(np.int64), axis=0)])
    nodes = np.zeros(len(links), _node(points.shape[1]))
    nodes["part"] = part
    for k, field in enumerate(("start", "stop", "left", "right")):
        nodes[field] = [x[k] for x in links]
    start, stop = nodes["start"], nodes["stop"]
    nodes["total"] = sums[stop] - sums[start]
    nodes["pivot"] = nodes["total"] // (stop - start)[:, None]
    pivots = nodes["pivot"].astype(points.dtype)
    nodes["radius2"] = [_squares(inside[a:b], p).max() for a, b, p in zip(start, stop, pivots)]
    return nodes, placed


def forest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees of one block of integer vectors: balls (roots of the parts first in theirs), their points part by part in
    tree order, and for each such row its vector."""
    n, size = len(points), points.shape[1] // PARTS
    balls, rows, vectors, first = [], [], [], 0
    for part in range(PARTS):
        own = points[:, part * size : (part + 1) * size]
        nodes, order = _tree(own, part, first)
        nodes["start"] += part * n
        nodes["stop"] += part * n
        balls.append(nodes)
        rows.append(own[order])
        vectors.append(order)
        first += len(nodes)
    return np.concatenate(balls), np.concatenate(rows), np.concatenate(vectors)


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All row numbers of the ranges, one range after the other."""
    size = stop - start
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def descend(nodes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wholly owned balls, their entries, and the leaves that no single entry owns."""
    pivot, radius2 = nodes["pivot"].astype(books.dtype), nodes["radius2"].astype(float)
    apart2 = _squares(books[:, :, None], books[:, None]).astype(float)
    # An entry equal to an earlier one never owns a point.
    same = np.tril(apart2 == 0, -1).any(2)
    front = np.flatnonzero(np.r_[True, nodes["part"][1:] != nodes["part"][:-1]])
    may = ~same[nodes["part"][front]]
    owned, owners, open_leaves = [], [], []
    while len(front):
        part = nodes["part"][front]
        to = _squares(pivot[front][:, None], books[part])
        best = np.where(may, to.astype(float), np.inf).argmin(1)
        each = np.arange(len(front))
        lead = (to - to[each, best][:, None]).astype(float)
        # No point of the ball is as near to the entry as to the best one: the ball lies on one side of their bisector.
        may &= ~(lead > 2 * np.sqrt(radius2[front][:, None] * apart2[part, best]) * (1 + 1e-9))
        alone = may.sum(1) == 1
        leaf = nodes["left"][front] < 0
        owned.append(front[alone])
        owners.append(best[alone])
        open_leaves.append(front[~alone & leaf])
        on = ~alone & ~leaf
        may = np.concatenate([may[on], may[on]])
        front = np.concatenate([nodes["left"][front[on]], nodes["right"][front[on]]])
    return np.concatenate(owned), np.concatenate(owners), np.concatenate(open_leaves)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The lowest of the nearest entries of each point."""
    return ((book * book).sum(1) - 2 * (points @ book.T)).argmin(1)


def tally(nodes: np.ndarray, points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and entry the sum and the number of its points in one block."""
    totals = np.zeros(books.shape, np.int64)
    counts = np.zeros(books.shape[:2], np.int64)
    balls, entries, leaves = descend(nodes, books)
    np.add.at(totals, (nodes["part"][balls], entries), nodes["total"][balls])
    np.add.at(counts, (nodes["part"][balls], entries), (nodes["stop"] - nodes["start"])[balls])
    for part in range(PARTS):
        own = nodes[leaves[nodes["part"][leaves] == part]]
        x = points[_spans(own["start"], own["stop"])]
        one = (_nearest(x, books[part])[:, None] == np.arange(books.shape[1])).astype(x.dtype)
        totals[part] += (one.T @ x).astype(np.int64)
        counts[part] += one.sum(0).astype(np.int64)
    return totals, counts


def assign(nodes: np.ndarray, points: np.ndarray, vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part of each vector of a block, and the vectors' squared distances summed over parts."""
    n = len(points) // PARTS
    found = np.zeros(len(points), np.int64)
    balls, entries, leaves = descend(nodes, books)
    size = (nodes["stop"] - nodes["start"])[balls]
    found[_spans(nodes["start"][balls], nodes["stop"][balls])] = np.repeat(entries, size)
    for part in range(PARTS):
        own = nodes[leaves[nodes["part"][leaves] == part]]
        rows = _spans(own["start"], own["stop"])
        found[rows] = _nearest(points[rows], books[part])
    part = np.repeat(np.arange(PARTS), n)
    codes, errors = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
    codes[vectors, part] = found
    np.add.at(errors, vectors, _squares(points, books[part, found]).astype(np.int64))
    return codes, errors


def _integers(lists: pa.Array, dims: int, most: int) -> np.ndarray:
    """floor(SCALE * x) of every component, as rows of ``dims`` components."""
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    flat = np.floor(np.asarray(lists.flatten(), np.float64) * SCALE)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), _spans(np.zeros_like(sizes), sizes)] = flat
    return np.clip(out, -most, most).astype(np.int32)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose components are all there and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(finite)


def trees(rows: DataFrame, dims: int, most: int) -> DataFrame:
    """One row for each block: ids and labels, balls, points in tree order, and the vector of each point."""
    exact, wanted = _exact(most, dims // PARTS), max(1, BLOCK // max(1, dims))
    schema = f"ids array<bigint>, labels array<{rows.schema['label'].dataType.simpleString()}>, balls binary, points binary, vectors binary"
    bounded_bytes(rows.sparkSession)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, labels, lists = (c.combine_chunks() for c in table.columns)
        points = _integers(lists, dims, most)
        balls, inside, vectors = forest(points.astype(exact))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        data = [inside.astype("<i4").tobytes(), vectors.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays(
            [whole(ids), whole(labels), pa.array([balls.tobytes()], pa.binary()), *[pa.array([x], pa.binary()) for x in data]],
            names=["ids", "labels", "balls", "points", "vectors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, wanted - n)
                batch = batch.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == wanted:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    path = scratch(rows.sparkSession)
    rows.select("vec_id", "label", "embedding").mapInArrow(run, schema).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return rows.sparkSession.read.parquet(path)


def _block(batch: pa.RecordBatch, k: int, size: int, exact: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    balls, points, vectors = (batch.column(c)[k].as_buffer() for c in ("balls", "points", "vectors"))
    places = np.frombuffer(vectors, "<i4")
    return np.frombuffer(balls, _node(size)), np.frombuffer(points, "<i4").astype(exact).reshape(len(places), size), places


def improve(stored: DataFrame, books: np.ndarray, most: int) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its points; an unused one stays."""
    size = books.shape[2]
    exact = _exact(most, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((*books.shape[:2], size + 1), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                balls, points, _ = _block(batch, k, size, exact)
                totals, counts = tally(balls, points, books.astype(exact))
                sums[:, :, :size] += totals
                sums[:, :, size] += counts
        where = np.argwhere(sums)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(where[:, k], pa.int32()) for k in range(3)], pa.array(sums[tuple(where.T)], pa.int64())], names=["part", "entry", "place", "total"]
        )

    found = stored.select("balls", "points", "vectors").mapInArrow(run, "part int, entry int, place int, total bigint")
    sums = np.zeros((*books.shape[:2], size + 1), np.int64)
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():  # a codebook and its counts
        sums[r["part"], r["entry"], r["place"]] = r["total"]
    counts = sums[:, :, size:]
    return np.where(counts > 0, sums[:, :, :size] // np.maximum(counts, 1), books)


def coded(stored: DataFrame, books: np.ndarray, most: int) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    size = books.shape[2]
    exact = _exact(most, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, errors = assign(*_block(batch, k, size, exact), books.astype(exact))
                text, width = codes.tobytes().hex(), 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[k].values,
                        batch.column("labels")[k].values,
                        pa.array([text[j : j + width] for j in range(0, len(text), width)], pa.string()),
                        pa.array(errors, pa.int64()),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    label = stored.schema["labels"].dataType.elementType.simpleString()
    return stored.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every kept row of ``vectors`` (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors of other lengths than the
    longest, or of a length that is no multiple of eight, count as filled up with zeros. Repeated rows each give a row,
    and each may be a first entry; null ids are coded and are first entries only where there are too few others; fewer
    vectors than entries make a smaller codebook; an empty table gives no rows and an empty codebook. Components are
    held to a size at which the longest vector's error fits a long (2**27 for 64 components, that is values up to
    32,768; 2**25 for 1,024). Other columns are not read.
    """
    rows = kept(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = -(-longest // PARTS) * PARTS
    most = min(1 << 27, isqrt((1 << 60) // max(1, dims)))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    seeds = _integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), dims, most)
    books = seeds.reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).astype(np.int64)
    stored = trees(rows, dims, most)
    for _ in range(rounds if len(first) else 0):
        books = improve(stored, books, most)
    return cut(coded(stored, books, most)), books


def digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with label_error: error summed over equal labels, nulls together (null beyond a long).

    Labels fold before the shuffle; on the way back rows of a common label are split by adaptive execution.
    """
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row."""
    codes, books = compress(vectors)
    return with_label_errors(codes).withColumn("codebooks_sha256", F.lit(digest(books)))
