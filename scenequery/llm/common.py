"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: The setting that says how many rows an Arrow batch has, its default, and what the operators take instead.
BATCH_SIZE, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"

#: The characters of Unicode's White_Space, to stand inside a character class.
WHITE_SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def lean(f: Callable) -> Callable:
    """A function for mapInArrow whose worker gives its memory back when the task ends: Spark keeps workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    """Memory that this process no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of ``BATCH_ROWS`` rows from now on in this session, unless it has a size of its own."""
    if spark.conf.get(BATCH_SIZE) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SIZE, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a new temporary one where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scenequery-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def staged_at(df: DataFrame, name: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, by these options; the table, which cuts the lineage, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (paths := _STAGED.get()) is not None:
        paths.append(path)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    return staged_at(df, name, options)[0]


@contextmanager
def noted() -> Iterator[list[str]]:
    """Gathers the paths that are staged inside, by this thread alone."""
    paths: list[str] = []
    before = _STAGED.set(paths)
    try:
        yield paths
    finally:
        _STAGED.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables; nothing that reads them may run after that. Those that are gone already stay gone."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle makes here; it follows the size of the cluster and the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
