"""The pipeline's stages over odd tables, and their decisions against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import quality, toxicity
from tests.llm.test_text_operators import plain_classes, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, base = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    item = prose(rng, 30)
    near = prose(rng, 60).split()
    rows = [(k, prose(rng, 40), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, prose(rng, 20) + " worthless trash idiot " + prose(rng, 10), "en", "s0") for k in range(40)]
    rows += [(200, " ".join(near), "en", "s0"), (201, " ".join([*near[:30], "changed", *near[31:]]), "de", "s1"), (202, " ".join(near).upper(), None, None)]
    rows += [(300, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s0"), (301, item.replace(" ", "  "), "fr", "s1")]
    rows += [(400, "write to ann.b@mail.example.com now", "en", "s0"), (401, None, None, None), (402, "", "en", "s0"), (402, "", "en", "s0"), (None, "nobody knows this row here", "en", "s0"), (None, None, None, None)]
    rows += [(500, "long " + prose(rng, 60_000), "en", "s2"), (501, "x" * 400_000, "en", "s2"), (502, '" « „ “ ” …', "en", "s2")]
    docs = [(i, t, lang, source, len(t or ""), "extra") for i, t, lang, source in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i, *_ in docs if i is not None and i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, docs


def test_pipeline_over_odd_rows(spark, tables):
    base, docs = tables
    columns = spark.read.parquet(f"{base}/documents.parquet").columns
    frame = spark.read.parquet(f"{base}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, base)
        frame.write.parquet(f"{base}/out-{name}")
        frame = spark.read.parquet(f"{base}/out-{name}")
        kept.append({r.doc_id for r in frame.collect()})
        assert frame.columns == columns or name == "bpe"
    all_ids = {d[0] for d in docs}
    assert kept[0] == all_ids - set(range(100, 140))
    classes = plain_classes([(i, t) for i, t, *_ in docs if i in kept[0] and i is not None and i < 500])
    assert {i for i in kept[1] if i is not None and i < 500} == {i for i in kept[0] if i is not None and i < 500 and classes[i] == i}
    assert kept[1] - kept[2] == {300} | ({301} & kept[1])
    assert kept[3] == kept[4] == kept[2]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/out-personal_data").collect()}
    assert re.fullmatch(r"write to [a-z]{3}\.[a-z]@[a-z]{4}\.[a-z]{7}\.com now", texts[400]) and "ann.b" not in texts[400] and texts[500] == next(t for i, t, *_ in docs if i == 500)
    assert corpus_pipeline.run(spark, base).count() == frame.count()


def test_pipeline_over_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_weights_equal_a_direct_solution(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 30) if k % 2 else "###!!! " * rng.randint(3, 20), k % 2) for k in range(300)]
    params = quality.QualityParams(features=32)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5), "quality", params)
    import pyarrow as pa

    x = quality.statistics(pa.array([t for _, t, _ in rows]))
    fold = [r.f for r in spark.createDataFrame(rows, "doc_id long, text string, quality int").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).alias("f")).orderBy("doc_id").collect()]
    use = np.array(fold) > 0
    mean, scale = x[use].mean(0), np.sqrt(np.maximum((x[use] ** 2).mean(0) - x[use].mean(0) ** 2, 1e-8))
    z = quality._fourier((x[use] - mean) / scale, model.directions, model.phases)
    y = np.array([float(q) for _, _, q in rows])[use]
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 0
    direct = np.linalg.lstsq(np.concatenate([z, np.sqrt(penalty)]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.mean, mean) and np.allclose(z @ model.weights, z @ direct, atol=1e-6)


def test_columns_of_the_scores_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "text", "x")], "doc_id long, text string, score string")
    model = toxicity.fit(df.select("doc_id", "text", F.lit(0).alias("toxic")))
    assert toxicity.scored(df, model).columns == ["doc_id", "text", "score"]
