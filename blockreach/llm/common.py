"""Helpers shared by the text operators: tables, shared folders, files, and functions for the executors."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockreach.session import ensure_checkpoint_dir

# Functions of this package travel to the executors by value, so workers need not be able to import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

# Characters of text that a Python step holds at once, next to their batch.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete shared folders that are no longer read."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path behind a folder name, as seen by this process (local, HDFS or object store)."""
    if "://" not in uri and not uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` holding about ``limit`` characters each (one text at least)."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or "") > limit:
            yield start, i
            start, held = i, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def array_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """Consecutive parts of a string column of about ``limit`` bytes each (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | Iterator[pa.RecordBatch]]]) -> DataFrame:
    """Run the function that ``make`` builds once per task over every Arrow batch of ``df``; it may yield its result in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                out = step(batch)
                if isinstance(out, pa.Table):
                    out = out.to_batches()
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def pass_through_schema(df: DataFrame) -> str:
    """Schema text for a map that keeps all columns."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
