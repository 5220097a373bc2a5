"""The kept index, readers' tokens, trees of any depth, passages and chains against plain versions."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strataloom.operators import audit, index, passages, relational
from strataloom.operators.tables import scratch, written

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda no.12/3 x-4 2019".split()


def plain_bm25(docs, queries, k, may=lambda q, d: True):
    cut = lambda t: [w if re.search(r"\d", w) else w[:5] for w in re.findall(r"\w+", t)] + [x for x in t.split() if len(x) >= 4 and re.search(r"\d", x) and re.search("[./-]", x)]
    terms = {d: Counter(cut(t or "")) for d, t in docs.items()}
    n, mean = len(terms), sum(sum(c.values()) for c in terms.values()) / max(len(terms), 1) or 1.0
    df = Counter(t for c in terms.values() for t in c)
    out = []
    for q, text in queries:
        scores = {}
        for d, c in terms.items():
            hit = [t for t in set(cut(text)) if c[t]]
            if hit and may(q, d):
                scores[d] = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in hit), 6)
        out += [(q, d, r) for r, (d, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.key, r["rank"]) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "key long, text string")


def test_index_equals_a_rebuild_after_every_change(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30)))
    queries = [(q, " ".join(rng.sample(WORDS, 3))) for q in range(12)] + [(50, ""), (51, "unheard")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    own, docs = index.SearchIndex(spark, scratch(spark, "test-index"), buckets=3, segment_documents=20), {}
    assert own.search(asked, 5).count() == 0
    for step in range(4):
        if step == 2:
            gone = rng.sample(sorted(docs), 12)
            own.delete(spark.createDataFrame([(k,) for k in [*gone, 999]], "key long"))
            docs = {k: t for k, t in docs.items() if k not in gone}
        else:
            new = {rng.randrange(70): text() for _ in range(35)} | ({3: "", 4: None} if step == 1 else {})
            own.put(frame(spark, new))
            docs |= new
        if step == 3:
            own.compact()
        want = plain_bm25(docs, queries, 5)
        assert rows(own.search(asked, 5)) == want == rows(index.search(frame(spark, docs), asked, 5))
        assert rows(own.search(asked, 5, block=4)) == want == rows(index.search(frame(spark, docs), asked, 5, block=4))


def test_a_change_that_is_broken_off_counts_for_nothing(spark):
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    own = index.SearchIndex(spark, scratch(spark, "test-index"))
    own.put(frame(spark, {1: "alpha"}))
    own._commit, kept = (lambda *a: None), own._commit
    own.put(frame(spark, {1: "beta", 2: "alpha"}))
    own._commit = kept
    assert rows(own.search(asked)) == [(1, 1, 1)]
    a, b = index.SearchIndex(spark, own.path), index.SearchIndex(spark, own.path)
    seen = a._manifest()
    a._manifest = b._manifest = lambda: seen  # two writers that don't see each other
    a.put(frame(spark, {7: "alpha"}))
    b.put(frame(spark, {7: "alpha alpha", 8: "beta"}))
    assert rows(own.search(asked)) == rows(own.search(asked)) and len([r for r in rows(own.search(asked)) if r[1] == 7]) == 1


def test_askers_see_what_they_may_read(spark):
    rng = random.Random(5)
    docs = {d: " ".join(rng.choice(WORDS[:6]) for _ in range(8)) for d in range(60)}
    users = spark.createDataFrame([(1, "member", "active"), (2, "editor", "active"), (3, "member", "disabled"), (4, "guest", "active")], "user_id long, role string, status string")
    members = spark.createDataFrame([(1, 7), (4, 8), (3, 7)], "user_id long, group_id long")
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, id string")
    grants = spark.createDataFrame([("b", "role", "editor", "read"), ("a", "group", "8", "manage"), ("d", "user", "1", "read"), ("c", "user", "2", "none")], "target string, kind string, principal string, permission string")
    documents = spark.createDataFrame([(d, "abcd"[d % 4], d % 10 == 9) for d in docs], "document long, collection string, deleted boolean")
    single = spark.createDataFrame([(4, "group", "7", "read"), (9, "group", "7", "read")], "target long, kind string, principal string, permission string")
    readers, askers = relational.document_tokens(grants, tree, documents, document_grants=single), relational.reader_tokens(users, members)
    pairs = {(r.user_id, r.document) for r in relational.accessible(grants, users, members, tree, documents, document_grants=single).collect()}
    met = {(u.user_id, d.document) for u in askers.collect() for d in readers.collect() if set(u.tokens) & set(d.tokens)}
    assert met == pairs and {u for u, _ in met} == {1, 2, 4}
    counts = {(r.user_id, r.documents, r.first_document, r.last_document) for r in relational.readable_counts(readers, askers).collect()}
    assert counts == {(u, len(own), min(own), max(own)) for u in {u for u, _ in met} for own in [[d for v, d in met if v == u]]}
    queries = [(q, " ".join(rng.sample(WORDS[:6], 2))) for q in range(1, 5)]
    asked = spark.createDataFrame(queries, "query_id long, text string").join(askers.withColumnRenamed("user_id", "query_id"), "query_id", "left")
    got = rows(index.search(frame(spark, docs), asked, 4, readers=readers.withColumnRenamed("document", "key")))
    assert got == plain_bm25(docs, queries, 4, lambda q, d: (q, d) in pairs) and got


@pytest.mark.parametrize("n", [1, 2, 3, 160, 10_000])
def test_trees_of_any_depth(spark, n):
    chain = spark.range(n).select(F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.col("id").cast("string").alias("id"), F.lit("x").alias("name"))
    below = relational.closure(chain.select("parent", "id"), spark.createDataFrame([("0",), (str(n // 2),)], "id string"))
    assert {(r.root, r["count"]) for r in below.groupBy("root").count().collect()} == {("0", n), (str(n // 2), n - n // 2)}
    assert relational.paths(chain).where("length(path) = 4 * depth - 3 and depth = id + 1").count() == n


def test_trees_with_cycles_and_strays(spark):
    rng = random.Random(2)
    edges = [(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(14)] + [(None, "k"), ("k", "l")]
    got = {(r.id, r.root) for r in relational.closure(spark.createDataFrame(edges, "parent string, id string"), spark.createDataFrame([("a",), ("b",), ("k",), ("zz",)], "id string")).collect()}
    want = {(r, r) for r in ("a", "b", "k", "zz")}
    while more := {(i, r) for p, i in edges for q, r in want if p == q} - want:
        want |= more
    assert got == want
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", None), ("x", "y", "X"), ("y", "x", "Y"), ("z", "x", "Z"), ("s", "gone", "S"), ("o", "o", "O")], "id string, parent string, name string")
    assert {(r.id, r.path) for r in relational.paths(nodes).collect()} == {("a", "A"), ("b", "A / B"), ("c", "A / B / "), ("x", None), ("y", None), ("z", None), ("s", "S"), ("o", None)}


def test_passages_equal_plain_search(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(k, make(rng.randrange(400))) for k in range(40)] + [(50, None), (51, ""), (52, "aaaa" * 300), (53, "é" * 10)]
    whole = [t for _, t in texts if t]
    wanted = [(k, (t := rng.choice(whole))[(a := rng.randrange(len(t))) : a + rng.choice([1, 2, 3, 5, 16, 31, 100, 300])]) for k in range(60)]
    wanted += [(100, None), (101, ""), (102, "not there"), (103, "aaaa"), (104, "é"), (105, "a" * 1200), (106, "a" * 1201)]
    got = {(r.passage, r.key, r.times, r.first) for r in passages.located(spark.createDataFrame(wanted, "passage long, text string"), spark.createDataFrame(texts, "key long, text string")).collect()}
    places = lambda p, t: [i for i in range(len(t)) if t.startswith(p, i)]
    assert got == {(k, i, len(at), at[0]) for k, p in wanted if p for i, t in texts if t for at in [places(p, t)] if at}
    none = spark.createDataFrame([], "passage long, text string")
    assert passages.located(none, spark.createDataFrame(texts, "key long, text string")).count() == 0


def test_one_long_log_is_checked_by_all_tasks(spark):
    events = spark.range(1, 5001).select(
        F.when(F.col("id") < 4900, "big").otherwise("small").alias("tenant"), F.when(F.col("id") < 4900, F.col("id")).otherwise(F.col("id") - 4899).alias("seq"), F.timestamp_seconds("id").alias("ts"),
        *(F.lit("x").alias(c) for c in ("actor", "action", "target", "outcome", "details")),
    )
    chain = written(audit.build_chain(events), "test-chain")
    changes = {
        None: lambda c: c,
        (3000, "gap"): lambda c: c.where("tenant = 'small' or seq <> 2999"), (1, "broken_link"): lambda c: c.withColumn("prev_hash", F.when(F.col("seq") == 1, "zz").otherwise(F.col("prev_hash"))),
        (777, "modified_event"): lambda c: c.withColumn("actor", F.when(F.col("seq").isin(777, 4000), "y").otherwise(F.col("actor"))),
        (778, "broken_link"): lambda c: c.withColumn("hash", F.when(F.col("seq") == 777, "0").otherwise(F.col("hash"))),
        (2, "gap"): lambda c: c.where("tenant = 'small' or seq > 1"), (41, "modified_event"): lambda c: c.withColumn("hash", F.when(F.col("seq") == 41, F.lit(None)).otherwise(F.col("hash"))),
    }
    for want, change in changes.items():
        got = {r.tenant: (r.checked, r.problem_seq, r.problem) for r in audit.verify_chain(change(chain)).collect()}
        if want is None:
            assert got == {"big": (4899, None, None), "small": (101, None, None)}
        elif want == (778, "broken_link"):  # its own hash is no longer its own, which comes first
            assert got["big"][1:] == (777, "modified_event")
        else:
            assert got["big"][1:] == want
    tasks = audit.verify_chain(chain)
    assert "rangepartitioning(tenant" in tasks._jdf.queryExecution().toString()


def test_a_task_holds_few_weights_at_a_time(monkeypatch):
    rows, docs = [Row(query_id=i, terms=["the", f"w{i}"]) for i in range(500)], 4000
    block = index.Block.of(rows)
    common = block.terms.index("the")
    batch = pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.array([5] * docs, pa.int32()), pa.array([[common, k % 500] for k in range(docs)], pa.list_(pa.int32())), pa.array([[1 + k % 3, 1] for k in range(docs)], pa.list_(pa.int32()))], ["key", "length", "terms", "tfs"])
    sizes, expanded = [], index._expanded
    monkeypatch.setattr(index, "_expanded", lambda *a: sizes.append(len((x := expanded(*a))[0])) or x)
    run = index._scored(SimpleNamespace(value=block), np.ones(len(block.terms)), 5.0, 3, 1.2, 0.75)
    [out] = run(iter([batch.slice(7)]))
    assert max(sizes) <= 1 << 20 and sum(sizes) >= 500 * (docs - 7) and out.num_rows == 3 * 500
    monkeypatch.setattr(index, "SCORES", 1 << 30)
    [whole] = index._scored(SimpleNamespace(value=block), np.ones(len(block.terms)), 5.0, 3, 1.2, 0.75)(iter([batch.slice(7)]))
    assert whole.equals(out)
