"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "personagraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh folder only where none is named, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="personagraph-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Lost executors cost nothing that was cut, and the next joins are planned on true sizes: a frame is
    broadcast only when its files are small enough. (Row estimates of a checkpointed frame multiply with
    every join before it, which loops cannot afford.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.is_cut = True
    return stored


def cut_added(df: DataFrame) -> DataFrame:
    """Cut a frame that ``extended`` made: only the rows added to the written ones are written."""
    base, added = getattr(df, "_parts", (None, df))
    if base is None:
        return cut_lineage(df)
    return extended(base, cut_lineage(added), cut=True)


def extended(stored: DataFrame, rows: DataFrame, cut: bool = False) -> DataFrame:
    """Rows put to a frame; if that stands on files, it is remembered which rows do not."""
    base, added = getattr(stored, "_parts", (stored if is_cut(stored) else None, None))
    out = stored.unionByName(rows)
    if base is not None:
        out._parts = base, rows if added is None else added.unionByName(rows)
    out.is_cut = cut
    return out


def each_apart(work: Callable[[DataFrame], DataFrame], frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Do independent small jobs side by side: their waits overlap, and the cluster is not left idle between them."""
    if len(frames) < 2:
        return {name: work(df) for name, df in frames.items()}
    spark = next(iter(frames.values())).sparkSession
    with ThreadPoolExecutor(len(frames)) as pool:
        runs = {name: pool.submit(inheritable_thread_target(spark)(work), df) for name, df in frames.items()}
        return {name: run.result() for name, run in runs.items()}


def is_cut(df: DataFrame) -> bool:
    return getattr(df, "is_cut", False) is True
