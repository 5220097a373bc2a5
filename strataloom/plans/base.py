"""Tables of the synthetic data in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text) of the documents."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) of the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, vector): the embedding of vec_id stands for the document of that id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, id, name): regions hold nations, nations hold customers."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    top = r.select(F.lit(None).cast("string").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    middle = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    low = c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    return top.union(middle).union(low)


TREE_SQL = """
SELECT NULL::VARCHAR AS parent, 'r' || r_regionkey AS id, r_name AS name FROM region
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text): a sentence about each order, with its number, date and price."""
    o = table(spark, sf_dir, "orders")
    price = F.format_string("%.2f", "o_totalprice")
    amount = F.translate(price, ".", ",")
    return o.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("order no "), F.col("o_orderkey"), F.lit(" was placed on "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" for "), amount, F.lit(" eur")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit events: one chain a user."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("tenant"), seq.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("actor"),
        F.concat(F.lit("event."), "event_type").alias("action"), F.col("event_id").cast("string").alias("target"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), F.col("props").alias("details"),
    )
