import random
import struct
import zlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from personagraph.llm import quality_votes
from personagraph.llm.catalog import vocabulary

from . import fixtures
from .test_curriculum import slow_targets
from .test_simhash import classes, slow_print
from .test_spaced_seeds import overlap, words


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    bench = [fixtures.prose(rng, 30) for _ in range(6)]
    data = fixtures.rows()
    data += [(200 + k, fixtures.prose(rng, 90) + " " + bench[k % 6], "en", f"src{k % 3}", 0) for k in range(6)]
    data += [(300 + k, " ".join(w + "***" for w in fixtures.prose(rng, 100).split()), "en", "src1", 0) for k in range(6)]
    folder = str(tmp_path)
    fixtures.docs(spark, data, extra=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    judged = quality_votes.judge(fixtures.docs(spark, data, extra=False)).filter("kept").collect()
    good = Counter((r["doc_id"], r["n_words"]) for r in judged)
    left = [r for r in data if (r[0], len(fixtures.SPACED.findall(r[1] or ""))) in good]
    roots = classes([slow_print(r[1]) for r in left])
    firsts = {root: min((r for r, x in zip(left, roots) if x == root), key=lambda r: (r[0] is None, r[0] or 0)) for root in set(roots)}
    left = [r for r in firsts.values() if not any(overlap(words(r[1]), words(b)) for b in bench)]
    sizes = Counter()
    for r in left:
        sizes[r[3]] += len(fixtures.SPACED.findall(r[1]))
    targets = slow_targets(dict(sizes))

    rows = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(vocabulary())
    crc = {}
    for r in left:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 0]
        crc[zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] = r
    times = Counter(r["ids_crc32"] for r in rows)
    assert times.keys() <= crc.keys() and max(times.values()) <= 3
    for r in rows:
        assert r["doc_id"] == crc[r["ids_crc32"]][0]
    for source in sizes:
        taken = sum(n * len(fixtures.SPACED.findall(crc[c][1])) for c, n in times.items() if crc[c][3] == source)
        most = max(len(fixtures.SPACED.findall(r[1])) for r in left if r[3] == source)
        assert abs(taken - targets[source]) <= most / 2 + 1e-6
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:k]) for k in range(len(order))]
    # Clean documents stay up to the mix.
    clean = {r[0] for r in data if r[0] is not None and r[0] < 40 and len(fixtures.SPACED.findall(r[1])) >= 60}
    assert clean <= {r[0] for r in left}


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "source_mix", "token_output"]
