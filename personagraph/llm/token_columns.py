"""Token ids in Parquet list columns.

One file per range of document ids, rows in ascending order of document id, so row groups and pages hold narrow ranges
of ids: a reader that wants some documents prunes files, row groups and, by the page index, pages. Ids are one
dictionary-encoded list column (vocabulary ids need about 16 bits, and a page that outgrows its dictionary falls back
to plain pages); the numbers beside it are delta-encoded, so scans of metadata alone read a few bytes a document.
Row groups, pages and rows per page are parameters.

Layout of a set: ``docs/`` as above with the offset of each document in its file, ``files/`` with one row per file and
the offset of the file in the whole stream. A document's start is the sum of both, so writing needs one pass.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts

ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_BYTES = 256 * 1024
PAGE_ROWS = 2_000
DICTIONARY_BYTES = 512 * 1024
#: Words that a worker remembers the ids of.
KNOWN_WORDS = 400_000
#: New words that are encoded as one text.
BLOCK_WORDS = 1_000
END_ID = 0

ENCODED = "doc_id long, file int, at long, n_tokens long, tokens array<int>"


class Encoder:
    """Ids of whole texts by the tokenizers library; words seen before are not encoded again.

    A byte-level vocabulary cuts text before a space or line feed that follows a character other than white space, and
    after line feeds that precede one, whatever stands further away; so pieces cut there can be encoded alone. Texts
    with other runs of white space, or with the string of an added token, go to the library whole.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        # Spark gives each core a task; threads of the library's own would only contend with those of other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        #: Strings that the library takes for tokens of their own wherever they stand.
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.known_words = known_words
        # The cuts above hold for byte-level pieces without normalisation; other vocabularies get whole texts.
        self.cuts = self.library.normalizer is None and repr(self.library.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
        line_feed = self._whole(["\n"])[0]
        self.cuts = self.cuts and len(line_feed) == 1 and not any("\n" in token for token in self.added)
        self.break_id = int(line_feed[0]) if self.cuts else None
        self.known: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        # The fast form leaves out the places of tokens in the text, which nobody reads.
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in some order, their numbers of ids, and all ids.

        The library encodes a thousand words at a time with line feeds between, whose id stands for nothing else, as words
        hold none; words with line feeds of their own are encoded one by one.
        """
        plain = [w for w in words if w[-1] != "\n"]
        odd = [w for w in words if w[-1] == "\n"]
        blocks = [plain[k : k + BLOCK_WORDS] for k in range(0, len(plain), BLOCK_WORDS)]
        texts = ["\n".join([w[1:] if w[0] == " " else f" {w}" for w in block]) for block in blocks]
        done, counts, ids = [], [], []
        for block, got in zip(blocks, self._whole(texts)):
            breaks = np.flatnonzero(got == self.break_id)
            if len(breaks) != len(block) - 1:
                odd += block
                continue
            done += block
            counts.append(np.diff(breaks, prepend=-1, append=len(got)) - 1)
            ids.append(np.delete(got, breaks))
        for w, got in zip(odd, self._whole([w[1:] if w[0] == " " else f" {w}" for w in odd])):
            done.append(w)
            counts.append(np.array([len(got)]))
            ids.append(got)
        return done, np.concatenate(counts).astype(np.int64), np.concatenate(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [k for k, text in enumerate(texts) if self.cuts and _cuttable(text) and not any(x in text for x in self.added)]
        words: list[str] = []
        ends = [0]
        for k in cut:
            _pieces(texts[k], words)
            ends.append(len(words))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        counts, ids = self.counts, self.ids
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new, n, got = self._alone(list({words[k] for k in missing}))
            here = dict(zip(new, range(len(counts), len(counts) + len(new))))
            at[missing] = [here[words[k]] for k in missing]
            counts, ids = np.concatenate([counts, n]), np.concatenate([ids, got])
            # Words that come later than the memory holds are rare ones; they are encoded where they occur.
            if len(counts) <= self.known_words:
                self.known |= here
                self.counts, self.ids = counts, ids
        starts = np.cumsum(counts) - counts
        sizes = counts[at]
        stops = np.cumsum(sizes)
        flat = ids[np.repeat(starts[at] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.concatenate([[0], stops])[ends]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for n, k in enumerate(cut):
            out[k] = flat[bounds[n] : bounds[n + 1]]
        rest = sorted(set(range(len(texts))) - set(cut))
        for k, got in zip(rest, self._whole([texts[k] for k in rest])):
            out[k] = got
        return out


_ODD_SPACE = re.compile(r"[^\S \n]")


def _cuttable(text: str) -> bool:
    """No white space but line feeds and single spaces between words."""
    return not ("  " in text or " \n" in text or "\n " in text or text[-1:] == " " or _ODD_SPACE.search(text))


def _pieces(text: str, out: list[str]) -> None:
    """Append the pieces of a cuttable text. A word stands for itself after a space; what follows no space (the first
    word of a line, line feeds) is marked by a space before it, which no word holds."""
    blank = 0
    for k, line in enumerate(text.split("\n")):
        blank += k > 0
        if line:
            if blank:
                # All but the last of several line feeds are one piece, the last one is another.
                if blank > 1:
                    out.append(" " + "\n" * (blank - 1))
                out.append(" \n")
                blank = 0
            at = len(out)
            out += line.split(" ")
            out[at] = " " + out[at]
    if blank:
        out.append(" " + "\n" * blank)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary; it outlives the task, which brings its own copy of this module."""
    kept = sys.modules.setdefault("token_columns_encoders", ModuleType("token_columns_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """doc_id, file, at, n_tokens, tokens: whole texts as ids with the end id, in ranges of ascending doc_id.

    Null texts are empty (the end id alone); null doc_ids come first; rows with equal doc_ids are ordered by text. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("_h", F.xxhash64("text"))
    # Two bounds per partition: the rows of equal ids are split by their text.
    ordered = ordered.repartitionByRange(parts or 2 * shuffle_parts(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")

    def run(batches):
        from pyspark import TaskContext

        own = encoder(tokenizer)
        file, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            counts = np.array([len(x) + 1 for x in ids], np.int64)
            ends = np.cumsum(counts)
            flat = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
            keep = np.ones(len(flat), bool)
            keep[ends - 1] = False
            flat[keep] = np.concatenate(ids) if ids else []
            starts = at + ends - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(ids), file, np.int32)),
                    pa.array(starts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                ],
                names=["doc_id", "file", "at", "n_tokens", "tokens"],
            )

    return ordered.select("doc_id", "text").mapInArrow(run, ENCODED)


def write(
    rows: DataFrame,
    path: str,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write ``encoded`` rows below ``path``; files and the two folders carry all that ``read`` needs."""
    spark = rows.sparkSession
    (
        rows.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("compression", "zstd")
        .parquet(f"{path}/docs")
    )
    stored = spark.read.schema(ENCODED).parquet(f"{path}/docs")
    # One row per file: the window below sees no more than that.
    totals = stored.groupBy("file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files.coalesce(1).write.parquet(f"{path}/files")


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """doc_id, start, n_tokens and the asked columns. Filters on doc_id reach row groups and pages of the files;
    without "tokens" the list column is not read."""
    stored = spark.read.schema(ENCODED).parquet(f"{path}/docs")
    files = spark.read.schema("file int, n_docs long, n_ids long, base long").parquet(f"{path}/files")
    # One row per written file.
    return stored.join(F.broadcast(files.select("file", "base")), "file").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *columns
    )


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows with tokens: crc32 over little-endian unsigned 32-bit ids."""

    def run(batches):
        for batch in batches:
            tokens = batch.column(3)
            flat = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = tokens.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    bounded_batches(stored.sparkSession)
    return stored.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
