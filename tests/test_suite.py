"""Evaluation queries over more questions than one block holds."""

from strataloom.plans import suite


def test_evidence_of_more_questions_than_a_block(spark, tmp_path):
    items = [(i, f"{i:06d} is the number of this question") for i in range(5_300)] + [(9_998, ""), (9_999, None)]
    docs = [(k, " ".join(t for i, t in items if t and i % 10 == k)) for k in range(10)] + [(10, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.query_id, r.document) for r in suite._evidence(spark, str(tmp_path)).collect())
    assert got == [(i, i % 10) for i in range(5_300)]
