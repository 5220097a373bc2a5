"""The corpus pipeline: toxic documents, near copies and benchmark leaks go, personal data are replaced, the rest is encoded.

Each row is judged by its own text, whatever other rows share its doc_id, but for benchmark leaks:
there rows with the same doc_id go together, and rows with a null doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, dartminhash, decontam, pii, toxicity
from strataloom.llm.queries import vocabulary
from strataloom.llm.shared import written

#: Documents of this probability or more are toxic.
TOXIC = 0.7
ROW = "_pipeline_row"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold of a model of all labels."""
    params = toxicity.ToxicParams()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_sample(labels, docs, "toxic", params.max_labels), params, docs)
    return toxicity.scored(docs, model, "_toxicity").where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class.

    Rows are told apart by a number of their own, not by doc_id, so each row's text is judged by
    itself; the rows are written with their numbers, which no later run can deal anew.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    classes = dartminhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    others = written(classes.where("not representative").select(F.col("doc_id").alias(ROW)), "other-copies")
    return rows.join(others, ROW, "left_anti").select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts."""
    return pii.replaced(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and digests of the ids and of what they decode to."""
    out = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), vocabulary())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_copies),
    ("decontamination", remove_leaks),
    ("personal_data", replace_personal_data),
    ("bpe", encode),
]

#: Model scores, signatures and tokens are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
