"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``.

    On one machine the folder lies in the warehouse where that isn't set; on a cluster it must be.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(?:\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{folder.rstrip('/')}/strataloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a new path that all executors share and read it back; it survives the loss of any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, if its files give fewer partitions than there are cores.

    A small table may be one file of one row group, which one task reads; work on its texts is worth a
    shuffle of them then.  Tables of more files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of some ``size`` bytes, by their mean row and without a copy.

    Spark's batches have 64 MB; what a task makes of one is many times as large.
    """
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows that come sorted by a column without nulls, in tables of some megabytes that split no group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in parts(batches):
        column = batch.column(by)
        end = column[-1]
        first = batch.num_rows - pc.sum(pc.equal(column, end)).as_py()  # where the last group begins
        if held and (first or end != last):
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        elif first:
            yield pa.Table.from_batches([batch.slice(0, first)])
        held.append(batch.slice(first))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def paired_counts(rows: DataFrame, t: Column, o: Column) -> DataFrame:
    """(key, word, t, o): how often either of two arrays of words holds each word.

    Whole rows are dealt out by key before they are taken apart, so neither counts by word nor sums by
    key shuffle words.
    """
    marked = lambda side, here, there: F.transform(side, lambda w: F.struct(w.alias("word"), F.lit(here).alias("t"), F.lit(there).alias("o")))
    none = F.array().cast("array<struct<word:string,t:int,o:int>>")
    both = F.concat(F.coalesce(marked(t, 1, 0), none), F.coalesce(marked(o, 0, 1), none))
    each = rows.repartition("key").select("key", F.explode(both).alias("w")).select("key", "w.word", "w.t", "w.o")
    return each.groupBy("key", "word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
