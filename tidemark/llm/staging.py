"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a new local one where that is unset, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_tidemark_dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = spark.sparkContext._tidemark_dir = tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(found)
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


#: The folders of the scratch blocks that the caller is in, outermost first.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside of the block go at its end, but for those written with ``outer``."""
    scopes = (*_scopes.get(), f"scratch-{uuid.uuid4().hex[:12]}")
    token = _scopes.set(scopes)
    try:
        yield
    finally:
        _scopes.reset(token)
        delete_path(spark, "/".join([_root(spark), *scopes]))


def new_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A path in this application's folder, which goes when the application ends."""
    scopes = _scopes.get()
    return "/".join([_root(spark), *(scopes[:-1] if outer else scopes), f"{name}-{uuid.uuid4().hex[:12]}"])


def _root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_tidemark_staging", None) != root:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        spark.sparkContext._tidemark_staging = root
    return root


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; with ``outer`` it outlives the scratch block.

    The result has no lineage to what made it, so a lost executor costs a
    re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that still read them must be written before."""
    delete_path(spark, _root(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Keep Arrow batches to Python workers at ``most`` bytes or less, so long texts don't add up."""
    if int(spark.conf.get(_ARROW_BYTES, str((1 << 31) - 1)).rstrip("b") or 0) > most:
        spark.conf.set(_ARROW_BYTES, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
