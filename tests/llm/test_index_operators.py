"""Embedding links, components, WARC archives and the pipeline."""

import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import components, pivots, warc
from strataloom.llm.shared import scratch_path


def labels(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(250, 290)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = labels(300, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((20, 32))
    v = np.concatenate([np.repeat(centre, 10, axis=0) + 0.1 * rng.standard_normal((200, 32)), np.repeat(centre[:1], 150, axis=0) * rng.uniform(0.5, 2, (150, 1)), rng.standard_normal((100, 32))])
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, []), (905, [float("inf")] + [1.0] * 31), (906, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>").withColumn("label", F.lit(None).cast("int"))
    out = {r.vec_id: r for r in pivots.links(df, params=pivots.PivotParams(block=40)).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    true, got = linked.sum() - len(v), sum(r.n_links for r in out.values())
    assert 0.97 * true <= got <= true
    want = labels(len(v), [(a, b) for a, b in zip(*np.nonzero(linked), strict=True) if a < b])
    assert sum(out[i].component_id == want[i] for i in range(len(v))) >= 0.98 * len(v)
    repeated = {r.vec_id: (r.n_links, r.component_id) for r in pivots.links(spark.createDataFrame([(k, [float(k % 3), 1.0, 2.0 - k % 3]) for k in range(3000)], "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))).collect()}
    assert repeated == {k: (999, k % 3) for k in range(3000)}
    for i in range(900, 907):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert pivots.links(df.limit(0)).count() == 0


def test_every_dimension_is_compared(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(3000)]
    rows += [(4000, [1.0, 2.0, 3.0]), (4001, [1.0, 2.0, 3.01]), (4002, [1.0, 2.0]), (4003, [3.0]), (4004, [5.0]), (4005, [-5.0]), (4006, [1.0, 2.0, 3.0, 4.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in pivots.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id >= 4000").collect()}
    assert out == {4000: (1, 4000), 4001: (1, 4000), 4002: (0, 4002), 4003: (1, 4003), 4004: (1, 4003), 4005: (0, 4005), 4006: (0, 4006)}


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    rows = [(k, f"https://www.Example.org/p{k % 3}", f"<p>é {k % 4}\r\n\r\nWARC/1.1\r\n</p>") for k in range(40)]
    rows += [(100, None, None), (101, "http://x/", ""), (102, "http://y/\r\nEvil: 1", "long " * 50_000), (103, "http://y/", "more " * 5_000), (None, "http://z/", "gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path, files=((1000, 7), (100_000, 2)))
    index = warc.merged_index(warc.read_runs(spark, path), captures_per_range=9)
    out = {r.page_id: r for r in index.collect()}
    assert set(out) == {r[0] for r in rows if r[0] is not None}
    for k, _, html in rows[:-1]:
        last = max(i for i, _, h in rows[:-1] if (h or "") == (html or ""))
        r = out[k]
        assert (r.payload_bytes, r.payload_digest, r.header_digest) == (len((html or "").encode()), digest(html), digest(html))
        assert (r.record_type, r.refers_to) == (("response", None) if k == last else ("revisit", last))
    order = sorted(out.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(out)))
    keys = [(r.url_key, r.captured, r.page_id) for r in order]
    assert keys == sorted(keys)
    empty = scratch_path(spark, "test-warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.merged_index(warc.read_runs(spark, empty)).count() == 0


def test_least_bytes_keeps_small_payloads_apart(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    texts = [r.value for r in warc.records(pages, least_bytes=5).collect()]
    assert all("WARC-Type: response" in t for t in texts)


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randint(0, 50), j) for _ in range(rng.randint(0, 9))) for j in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_pipeline_stages_do_their_work(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in docs.collect() if any(i in r.text for i in items)}
    assert not leaking & {r.doc_id for r in rows}
    copies = [r.ids for r in docs.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).where(F.size("ids") > 1).collect()]
    kept = {r.doc_id for r in rows}
    assert all(len(kept & set(ids)) <= 1 for ids in copies)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
