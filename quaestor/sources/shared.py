"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting that keeps the folder of a local session without spark.checkpoint.dir.
_LOCAL = "spark.quaestor.sharedDir"
#: Bytes of a table (as JSON) up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir; it goes when the driver ends.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster that is an
    error, since executors can't read a folder of the driver's machine.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL, None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="quaestor-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = f"file://{made}"
        spark.conf.set(_LOCAL, top)
    folder = f"{top.rstrip('/')}/quaestor-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        _marked.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


_marked: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of 4 MB at most in the jobs that run meanwhile, so that long texts don't add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(4 << 20))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def trimmed(run):
    """Wraps an Arrow function: when a task ends, its worker, which outlives it, gives freed memory back to the system."""

    @functools.wraps(run)
    def wrapper(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapper


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage is cut."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if it is small, and leaves it for a shuffled join if it isn't."""
    size = table.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table
