"""CSV, zip, Parquet and report files, and versioned snapshots with one active generation."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header that must have exactly the schema's columns, in its order."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.names:
        raise ValueError(f"unexpected header: {header}")
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """One member of zip archives as text columns; a byte-order mark is dropped, missing columns are an error.

    Each archive is read by one task, a row at a time after the archive itself.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z, z.open(member) as f:
                    reader = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                    missing = set(columns) - set(reader.fieldnames or ())
                    if missing:
                        raise ValueError(f"{member} lacks {sorted(missing)}")
                    held: list[list[str | None]] = []
                    for row in reader:
                        held.append([row[c] for c in columns])
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], list(columns))
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], list(columns))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def load_once(spark: SparkSession, rows: DataFrame, path: str, replace: bool = False) -> bool:
    """Write ``rows`` unless there is a table already; with ``replace`` over it.  True if written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    if there and not replace:
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small report table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join(lines) + "\n"


def write_reports(rows: DataFrame, path: str) -> None:
    """The rows as CSV and JSON folders under ``path``."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


class Generations:
    """Snapshots of a table, each in a folder of its own, of which one is active.

    A generation is written whole, checked against the expected count, and made
    active by replacing one small pointer file; readers see the old or the new
    one.  There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, generation: str, rows: DataFrame) -> int:
        path = f"{self.root}/generation={generation}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def resume(self, generation: str, rows: DataFrame, key: Sequence[str]) -> int:
        """Adds the rows whose key the generation lacks, after a write that was broken off; an active one can't be changed."""
        if generation == self.active():
            raise ValueError(f"generation {generation} is active")
        fs, path = self._fs(f"{self.root}/generation={generation}")
        if not fs.exists(path):
            return self.write(generation, rows)
        rows.join(self.read(generation).select(*key), list(key), "left_anti").select(*rows.columns).write.mode("append").parquet(path.toString())
        return self.read(generation).count()

    def activate(self, generation: str, expected: int) -> None:
        found = self.read(generation).count()
        if found != expected:
            raise ValueError(f"generation {generation} has {found} rows, not {expected}")
        fs, new = self._fs(f"{self.root}/ACTIVE.new")
        out = fs.create(new, True)
        out.write(json.dumps({"generation": generation, "rows": expected}).encode())
        out.close()
        _, old = self._fs(f"{self.root}/ACTIVE")
        fs.delete(old, False)
        fs.rename(new, old)

    def active(self) -> str | None:
        fs, path = self._fs(f"{self.root}/ACTIVE")
        if not fs.exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/ACTIVE", wholetext=True).first()[0])["generation"]

    def read(self, generation: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generation={generation or self.active()}")


def projected(spark: SparkSession, path: str, columns: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Some columns of the rows in a time range; both reach the Parquet reader."""
    return spark.read.parquet(path).where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz"))).select(*columns)
