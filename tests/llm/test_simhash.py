import random

import xxhash

from personagraph.llm import simhash_trie as S

from . import fixtures


def slow_print(text):
    words = fixtures.SPACED.findall(fixtures.lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """The smallest index that links reach, for each."""
    parent = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root = [a, b]
                for k in (0, 1):
                    while parent[root[k]] != root[k]:
                        root[k] = parent[root[k]]
                parent[max(root)] = min(root)
    for k in range(len(parent)):
        while parent[k] != parent[parent[k]]:
            parent[k] = parent[parent[k]]
    return parent


def test_groups_against_brute_force(spark):
    data = fixtures.rows()
    prints = [slow_print(r[1]) for r in data]
    roots = classes(prints)
    want = []
    for k, r in enumerate(data):
        ids = [x[0] for x, root in zip(data, roots) if root == roots[k] and x[0] is not None]
        want.append((r[0], prints[k], min(ids, default=None)))
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in S.groups(fixtures.docs(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_trie_against_all_pairs(spark):
    rng = random.Random(3)
    prints = {0, 2**64 - 1, 1, 3, 7, 2**63}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(5):
            prints.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    got = {tuple(r) for r in S.trie_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_keep_one(spark):
    data = fixtures.rows()
    df = fixtures.docs(spark)
    roots = classes([slow_print(r[1]) for r in data])
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len(set(roots))
    want = []
    for root in set(roots):
        ids = [r[0] for r, x in zip(data, roots) if x == root and r[0] is not None]
        want.append(min(ids, default=None))
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, want))


def test_empty_table(spark):
    assert S.groups(fixtures.docs(spark, [])).collect() == []
    assert S.keep_one(fixtures.docs(spark, [])).collect() == []
