"""SimHash near-duplicates by a binary trie self-join.

Equal fingerprints fold into one leaf first, so groups of copies cost one row. The trie of the leaves is joined with
itself level by level: a pair of nodes goes on to the pairs of their children, differing bits add up, and a pair ends
when they exceed the budget. Nodes and pairs are rows, a level is two equi-joins, and no node is ever held in a task.

A trie whose budget may be spent in the first levels keeps many pairs near the root. With a budget of b bits, one of
b + 1 segments of the fingerprint is equal in both; so the fingerprints are rotated b + 1 times, each segment once on
top, and pairs must agree in the top segment. Below it a node has at most as many partners as there are words of that
length within the budget, whatever the rows are, and each leaf has at most that many links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import bounded_batches, cut, free_name

BITS = 64
#: Differing bits of linked fingerprints, words of a shingle, seed of its hash.
BUDGET = 2
SHINGLE = 3
SEED = 42
#: Bits that a level of the trie reads below the top segment.
STEP = 9
#: Shingles hashed at once.
RUN = 65_536

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash: a bit is 1 if more than half of all shingle hashes have it."""
    words = text.encode().lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, RUN):
        some = words[k : k + RUN + shingle - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        starts = [0, *ends[:-1].tolist()]
        stops = (ends - 1).tolist()[min(shingle, len(some)) - 1 :]
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], "<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            bits[8 * byte : 8 * byte + 8] += np.bincount(hashes[:, byte], minlength=256) @ _BYTE_BITS
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash and fp (signed long) of every row, over its whole text; null, empty and wordless texts have fp 0."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            known: dict[str, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = fingerprint(text or "", shingle, seed)
                out.append(known[text])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out, pa.int64())], names=["doc_id", "text_hash", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _prefix(word: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(word), BITS - depth) if depth < BITS else F.col(word)


def trie_links(leaves: DataFrame, budget: int = BUDGET, step: int = STEP) -> DataFrame:
    """Pairs (low, high) of different fingerprints of ``leaves`` (fp) that differ in at most ``budget`` bits."""
    top = BITS // (budget + 1)
    turns = F.explode(F.array(*[F.lit(k * top) for k in range(budget + 1)]))
    turned = leaves.select("fp", turns.alias("turn")).withColumn(
        "word",
        F.when(F.col("turn") == 0, F.col("fp")).otherwise(
            F.expr("shiftleft(fp, turn)").bitwiseOR(F.expr("shiftrightunsigned(fp, 64 - turn)"))
        ),
    )
    nodes = turned.select("turn", "word", _prefix("word", top).alias("node"))
    # Nodes of the top level with one leaf have no pair below them.
    pairs = nodes.groupBy("turn", "node").agg(F.count("*").alias("n")).filter("n > 1").select(
        "turn", F.col("node").alias("left"), F.col("node").alias("right"), F.lit(0).alias("err")
    )
    # The trie below those nodes is small for most inputs; its rows are read once per level.
    pairs = cut(pairs)
    live = cut(nodes.join(pairs.select("turn", F.col("left").alias("node")), ["turn", "node"], "left_semi").select("turn", "word"))
    depth = top
    while depth < BITS:
        below = min(BITS, depth + step)
        children = live.select("turn", _prefix("word", depth).alias("parent"), _prefix("word", below).alias("child")).distinct()
        left = children.select("turn", F.col("parent").alias("left"), F.col("child").alias("left_child"))
        right = children.select("turn", F.col("parent").alias("right"), F.col("child").alias("right_child"))
        err = F.col("err") + F.bit_count(F.col("left_child").bitwiseXOR(F.col("right_child"))) - F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
        grown = pairs.join(left, ["turn", "left"]).join(right, ["turn", "right"])
        kept = grown.filter((F.col("left") != F.col("right")) | (F.col("left_child") <= F.col("right_child"))).filter(err <= budget)
        pairs = kept.select("turn", F.col("left_child").alias("left"), F.col("right_child").alias("right"), err.cast("int").alias("err"))
        depth = below
    back = lambda c: F.when(F.col("turn") == 0, F.col(c)).otherwise(
        F.expr(f"shiftrightunsigned({c}, turn)").bitwiseOR(F.expr(f"shiftleft({c}, 64 - turn)"))
    )
    ends = pairs.filter(F.col("left") != F.col("right")).select(back("left").alias("a"), back("right").alias("b"))
    return ends.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def _components(prints: DataFrame, budget: int) -> DataFrame:
    """fp and component (any fp of it) of every fingerprint."""
    classes = cut(prints.select("fp").distinct())
    linked = components(trie_links(classes, budget)).withColumnRenamed("node", "fp")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, fp, component_id for every row of ``docs``: the smallest doc_id that links reach.

    Rows with equal fingerprints (exact copies, all wordless texts) are linked. Null ids never name a component, so a
    component of rows without ids has a null one; repeated rows each give a row; an empty table gives none; columns
    other than doc_id and text are not read.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(_components(prints, budget), "fp")
    classes = cut(classes)
    reached = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(classes.join(reached, "component").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of ``docs`` for each group, all columns as they are: the one with the smallest doc_id, rows without id
    last, then the smallest hash of the text; of fully equal rows any."""
    prints = cut(fingerprints(docs, shingle, seed))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first")).join(_components(prints, budget), "fp")
    kept = cut(firsts.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash"))
    same_id = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"])
    stays = docs.join(kept, same_id & F.xxhash64(docs["text"]).eqNullSafe(kept["text_hash"]), "left_semi")
    own = free_name(docs, "own")
    return stays.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own)
