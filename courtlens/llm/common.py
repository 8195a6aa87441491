"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once an application, unless their PYTHONPATH has it already.

    Batches that go to Python are kept small, whatever the length of the texts: a worker holds a few of them at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    top, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    out = tempfile.mkdtemp(prefix="package-")
    copied = shutil.copytree(Path(__file__).resolve().parents[1], f"{out}/tree/courtlens", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/courtlens", "zip", Path(copied).parent))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(sizes, limit: int):
    """(start, end) runs of consecutive rows whose sizes add up to about ``limit``; a larger row stands alone."""
    start = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are written and whose plans are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library, which needs no such call
        return lambda _: 0


def tidy() -> None:
    """Give memory that is free back to the system: Python workers live on from task to task beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def map_column(df: DataFrame, column: str, fields: str, make, limit: int = 1_500_000, size=lambda x: len(x or "")) -> DataFrame:
    """Replace ``column`` by the columns ``fields`` that ``make`` computes from its values in each task.

    All other columns pass through as Arrow arrays, so nulls and large integers stay as they are. ``make`` gets lists of
    values whose sizes add up to about ``limit`` (a longer value comes alone) and returns a list of columns.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in rest] + list(T._parse_datatype_string(fields).fields))
    kinds = [_arrow(f.dataType) for f in schema.fields[len(rest) :]]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(rest)).to_pylist()
            for a, b in slices([size(x) for x in values], limit):
                made = [pa.array(x, kind) for x, kind in zip(make(values[a:b]), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(rest))] + made, names)
                del made
            del values
            tidy()

    return df.select(*rest, column).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind.simpleString()]
