"""The folder that the whole cluster shares, and relations that live for one job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a new local one where that is unset, else an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tidemark_scratch", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = context._tidemark_scratch = tempfile.mkdtemp(prefix="tidemark-scratch-")
        atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@contextmanager
def relation(spark: SparkSession, name: str, rows: DataFrame) -> Iterator[int]:
    """``rows`` written once and readable by SQL as ``name`` inside of the block, with their number; dropped after it.

    A table of that name is replaced.  The rows are those at the start of the
    block, whatever happens to their sources, and outlive a lost executor.
    """
    path = new_folder(spark, name)
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    stored.createOrReplaceTempView(name)
    try:
        yield stored.count()
    finally:
        spark.catalog.dropTempView(name)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
