"""What several operators of the subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

#: ASCII white space; everything between is a word of the counting operators.
SPACE = r"[\x20\x09-\x0D]+"
#: Words of the phrase operators: ASCII letters (lower case) and digits, and everything beyond ASCII.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    return cut_lineage(df)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let at most so many rows go to a Python worker at once, as single texts can be very long.

    Batches are sized when a plan runs, so this stays set in the session; a smaller setting is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def bounded_bytes(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let at most so many bytes, and always one row, go to a Python worker at once; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not held.isdigit() or int(held) > limit:
        spark.conf.set(key, str(limit))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, also not in other case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
