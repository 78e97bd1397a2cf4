"""Intermediate tables in the shared folder, and path checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without any checkpoint folder gets one of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="churnloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for this application below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/churnloom/{app}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()
_generation = 0


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes inside go when the block ends, but kept ones."""
    outer, paths = getattr(_scopes, "paths", None), []
    _scopes.paths = paths
    try:
        yield
    finally:
        _scopes.paths = outer
        for uri in paths:
            fs, path = _filesystem(spark, uri)
            fs.delete(path, True)


def generation() -> int:
    """A number that changes when scratch is dropped; what refers to scratch is then void."""
    return _generation


def materialize(
    df: DataFrame, name: str, partition_by: str | list[str] | None = None, keep: bool = False
) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    This cuts the lineage with a copy that outlives any executor, and lets the
    readers after it prune columns and plan with real sizes. A reader that filters on
    ``partition_by`` opens only the folders it needs. ``keep`` tables outlive
    ``passing_scratch``.
    """
    path = scratch_path(df.sparkSession, name)
    if not keep and getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written.select(*df.columns) if partition_by else written


def _filesystem(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """A small file, complete under its name or not there at all."""
    fs, path = _filesystem(spark, uri)
    partial = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{path.getName()}")
    out = fs.create(partial, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(partial, path):
        raise OSError(f"cannot write {uri}")


def list_names(spark: SparkSession, uri: str) -> list[str]:
    """Names of the files in a folder, without hidden ones; none if there is no folder."""
    fs, path = _filesystem(spark, uri)
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return [n for n in names if not n.startswith(("_", "."))]


def path_exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _filesystem(spark, uri)
    return bool(fs.exists(path))


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call when it is done."""
    global _generation
    _generation += 1
    app = spark.sparkContext.applicationId
    fs, path = _filesystem(spark, f"{shared_dir(spark)}/churnloom/{app}")
    fs.delete(path, True)
