"""Shared plumbing of the training-data operators: table paths, worker imports, shared scratch space."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: One word, everywhere in this package: a run of anything but space and \t \n \v \f \r.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

REPO_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once, unless the session says so itself: several workers share an
#: executor's memory with its buffers of these on either side.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by its working directory alone, and bound what
    they get at once."""
    if spark.conf.get(BATCH_KEY, "1") == "1":  # 1 stands for: unset
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a new one is set for
    a session in one process, as in tests; on a cluster, whose machines don't share their folders, that is an error."""
    return shared.folder(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again, which cuts the lineage and survives lost executors."""
    path = shared.path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; what was not written here stays."""
    for t in tables:
        if getattr(t, "written_to", None):
            shared.remove(t.sparkSession, t.written_to)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with a function that is made once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield out

    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes, a row at least."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, giving memory back when a task ends: workers are used again, side by side."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Give memory that is no longer used back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(columns: list[str], wanted: str) -> str:
    """A column name that clashes with none of the given ones, in any case."""
    taken = {c.lower() for c in columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
