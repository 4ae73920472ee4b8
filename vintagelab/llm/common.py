"""What the operators of this subpackage share: the shared folder, staged tables and batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; where it is unset, a local one if all runs on one machine,
    and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/vintagelab/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so lost executors cost
    no recomputation, and what was computed once is read by all later jobs."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that no later step reads."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named _k0, _k1, ... so that no name of theirs, whatever it is, meets one of an operator's own."""
    return df.toDF(*[f"_k{i}" for i in range(len(df.columns))])


def no_clash(keep: list[str], own: list[str]) -> None:
    """An error if a kept column has the name of a result's column."""
    if twice := {c.lower() for c in keep} & {c.lower() for c in own}:
        raise ValueError(f"rename the kept columns {sorted(twice)}: the result has columns of these names")


def text_or_empty(col: str | Column) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a folder of the shared store, for tasks that write binary files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def out_batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20, count: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `count` rows and about `limit` bytes of strings."""
    cols: list[list] = [[] for _ in schema]
    size = 0
    for row in rows:
        for c, v in zip(cols, row, strict=True):
            c.append(v)
            if isinstance(v, (bytes, str)):
                size += len(v)
        if size >= limit or len(cols[0]) >= count:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            cols, size = [[] for _ in schema], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system at a task's end: a worker lives on, and idle ones count too."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of record batches as tuples, a slice at a time, so that few Python objects live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)
