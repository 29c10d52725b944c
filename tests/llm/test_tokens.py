import random
import struct
import zlib

import pyarrow.parquet as pq
import pytest

from personagraph.llm import token_columns as T
from personagraph.llm.catalog import vocabulary
from personagraph.llm.common import scratch

from . import fixtures


@pytest.fixture(scope="module")
def own():
    return T.Encoder(vocabulary(), known_words=300)


def test_encoder_equals_library(own):
    rng = random.Random(1)
    plain = ["a", "b", "é", " ", "\n", "1", "!", "'s", "it's", "word", "😀"]
    odd = [*plain, "\t", "\r", " ", "  ", "\x85", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 12))) for p in (plain, odd) for _ in range(1500)]
    texts += [fixtures.prose(rng, 300), "", "x" * 20_000, "a " * 9_000]
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want


def test_new_words_go_to_the_library_in_blocks(monkeypatch):
    fresh = T.Encoder(vocabulary())
    asked = []
    monkeypatch.setattr(fresh, "_whole", lambda texts, whole=fresh._whole: asked.extend(texts) or whole(texts))
    rng = random.Random(4)
    words = ["".join(rng.choice("aé1!'中") for _ in range(rng.randint(1, 6))) + str(k) for k in range(2500)]
    texts = [" ".join(words[:1200]), "\n".join(words[1200:]), " " + words[0], "\n\n" + words[1] + "\n"]
    want = [e.ids for e in fresh.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in fresh.encode(texts)] == want
    # Every word was asked for once, a thousand in a text.
    assert len(asked) < 10 and sum(len(x.split("\n")) for x in asked) >= 2500


def test_added_tokens_as_the_library_has_them(own):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = ["a <|endoftext|> b", "a b", "<|endoftext|>", "x<|endoftext|>\ny <|endoftext|", "a <|endoftext|> b\tc"]
    assert [x.tolist() for x in own.encode(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert own.encode(texts)[0].tolist() == [64, 220, 50256, 275]


def test_round_trip(spark, own):
    data = fixtures.rows()
    path = scratch(spark)
    T.write(T.encoded(fixtures.docs(spark, data), vocabulary()), path, page_rows=7)
    back = T.read(spark, path).collect()
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], list(r["tokens"])) for r in back), key=lambda r: r[1])
    want = [[*own.library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in data]
    assert sorted(map(str, (g[3] for g in got))) == sorted(map(str, want))
    ids = [g[0] for g in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [g[1] for g in got] == [sum(len(g[3]) for g in got[:k]) for k in range(len(got))]
    by_id = {r[0]: own.library.encode(r[1] or "", add_special_tokens=False).ids for r in data if r[0] is not None}
    for doc_id, _, n, tokens in got:
        if doc_id is not None:
            assert tokens == [*by_id[doc_id], 0] and n == len(tokens)
    for r in T.digests(T.read(spark, path)).collect():
        if r["doc_id"] is not None:
            tokens = [*by_id[r["doc_id"]], 0]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(tokens)}I", *tokens))


def test_layout(spark):
    path = scratch(spark)
    T.write(T.encoded(fixtures.docs(spark), vocabulary(), parts=2), path, page_rows=7)
    import glob

    files = glob.glob(f"{path.removeprefix('file://')}/docs/*.parquet")
    assert len(files) == 2
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    some = T.read(spark, path).filter("doc_id between 5 and 7")
    assert sorted(r["doc_id"] for r in some.collect()) == [5, 6, 7]
    assert "GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    assert "tokens:array" not in T.read(spark, path, ())._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    path = scratch(spark)
    T.write(T.encoded(fixtures.docs(spark, []), vocabulary()), path)
    assert T.digests(T.read(spark, path)).collect() == []
