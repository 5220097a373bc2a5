"""The queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, dartminhash, decontam, fim, licenses, pii, pivots, quality, secrets, toxicity, urls, warc
from .shared import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id and the least word edits."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned outside the held-out fifth."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    params = quality.QualityParams()
    model = quality.fit(toxicity.labelled_sample(labels.where(_fold(5) != 0), docs, "quality", params.max_labels), "quality", params)
    out = quality.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document."""
    return dartminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of each document, and digests of its ids and of what they decode to."""
    out = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates for their personal data, and how many there are."""
    return pii.replaced(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_name="n_entities")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of each document, joined by commas."""
    out = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: a document is a repository, its source the owner."""
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *map(count, secrets.BASE), F.sha2(secrets.written_out(F.col("base")), 256).alias("base_sha256"),
        secrets.written_out(F.array_sort(F.concat("base", "live_bare"))).alias("spans"), "n_live", "n_copied",
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of each vector."""
    return pivots.links(_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back, with their place in the capture index."""
    archives = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), archives)
    index = warc.merged_index(warc.read_runs(spark, archives))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned outside the held-out third."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    params = toxicity.ToxicParams()
    model = toxicity.fit(toxicity.labelled_sample(labels.where(_fold(3) != 1), docs, "toxic", params.max_labels), params, docs)
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cut at two of its lines, and digests of the output and of the text rebuilt from it."""
    out = fim.transformed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return collocations.ranked(_table(spark, sf_dir, "documents"))


#: Rules of the query: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's URL."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, action)")
    return urls.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_near_duplicates, op4_bpe, op5_pii, op6_licenses, op7_secrets, op8_embeddings, op9_warc, op10_toxicity, op11_fill_in_middle, op12_collocations, op13_url_filter)}
SQL: dict[str, str] = {
    "op6_licenses": licenses.duckdb_sql(), "op11_fill_in_middle": fim.duckdb_sql(), "op12_collocations": collocations.duckdb_sql(),
    "op13_url_filter": urls.duckdb_sql(URL_RULES),
}
