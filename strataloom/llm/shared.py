"""Helpers that several operators share: written intermediate tables and bounded Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step works on; a single longer document is still taken whole.
SLICE_BYTES = 1 << 18


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine a folder in the warehouse where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(?:\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/strataloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: Spark keeps a Python worker for later tasks, whatever they need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, which gives its memory back when its task ends."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each holds about ``limit`` bytes at most."""
    for batch in batches:
        start = used = 0
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        for row, size in enumerate(sizes):
            if row > start and used + size > limit:
                yield batch.slice(start, row - start)
                start, used = row, 0
            used += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)
