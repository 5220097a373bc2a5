"""Incremental ingestion: a stream of documents becomes a table of searchable chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean, lexical_terms
from ..operators.chunking import text_chunks
from ..operators.fingerprints import content_hash
from ..operators.relational import latest

def indexed(docs: DataFrame) -> DataFrame:
    """Chunks of (key, version, text) rows with content hash and search terms.

    Texts that are null or blank fail: they give one row with status ``failed`` and no chunk.
    """
    plain = docs.withColumn("text", clean(F.col("text")))
    good = plain.where("length(text) > 0")
    cut = text_chunks(good.select("key", "text"))
    versions = good.select("key", "version")
    ready = cut.join(versions, "key").select("key", "version", "ordinal", "text", "heading_path", "tokens", content_hash(F.col("text")).alias("content_hash"), lexical_terms(F.col("text")).alias("terms"), F.lit("ready").alias("status"))
    failed = plain.where("text is null or length(text) = 0").select("key", "version", F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("heading_path"), F.lit(0).alias("tokens"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("array<string>").alias("terms"), F.lit("failed").alias("status"))
    return ready.unionByName(failed)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "key long, version int, text string") -> StreamingQuery:
    """Index the Parquet files that appear under ``source``, each batch once, and stop when there are no more.

    A batch that is run again overwrites its own folder, so a lost driver or executor repeats no row.
    """

    def batch(rows: DataFrame, number: int) -> None:
        newest = latest(rows, "key", F.desc("version"))
        indexed(newest).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searchable(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's newest version that is ready."""
    rows = spark.read.parquet(target).where("status = 'ready'")
    newest = rows.groupBy("key").agg(F.max(F.struct("version", "batch")).alias("v"))
    return rows.join(newest.select("key", F.col("v.version").alias("version"), F.col("v.batch").alias("batch")), ["key", "version", "batch"]).drop("batch")
