"""Work that grows no faster than the input: rows between the operators, counted, and results against plain versions."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.operators import alignment, chunking, comparison, evaluation, kernels, maintenance, quality, relational, tables

from strataloom.plans import content, permissions, readings

from .compare import difference
from .rows import _nodes, most_rows


def test_administrators_are_not_paired_with_collections(spark):
    n = 600
    users = spark.range(n).select((F.col("id") % 2).cast("int").alias("tenant_id"), F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, "member").otherwise("admin").alias("role"), F.lit("active").alias("status"))
    collections = users.select("tenant_id", F.concat(F.lit("c"), "user_id").alias("id"))
    grants = users.select("user_id", F.concat(F.lit("c"), "user_id").alias("id"), F.lit("manage").alias("permission"))
    rows, most = most_rows(maintenance.managed_counts(users, grants, collections))
    assert len(rows) == n and most <= 4 * n and {r.collections for r in rows} == {1, n // 2}


def test_counts_of_managed_collections_equal_the_pairs(spark):
    rng = random.Random(5)
    # users of several tenants, who are administrators in some of them; ids that lie in two tenants
    users = spark.createDataFrame([(rng.randrange(4), rng.randrange(12), rng.choice(["admin", "member"]), rng.choice(["active", "active", "disabled"])) for _ in range(40)], "tenant_id int, user_id long, role string, status string")
    collections = spark.createDataFrame([(rng.randrange(4), f"c{rng.randrange(15)}") for _ in range(30)], "tenant_id int, id string")
    grants = spark.createDataFrame([(rng.randrange(12), f"c{rng.randrange(18)}", rng.choice(["manage", "read"])) for _ in range(60)], "user_id long, id string, permission string")
    pairs = maintenance.managed(users, grants, collections).groupBy("user_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    assert {tuple(r) for r in pairs} == {tuple(r) for r in maintenance.managed_counts(users, grants, collections).collect()}


def _shared_library(spark, rng, tree):
    """Users, members, grants, documents and grants of single documents at random."""
    users = spark.createDataFrame([(u, rng.choice(["member", "editor", None]), rng.choice(["active", "active", "disabled"])) for u in range(12)], "user_id long, role string, status string")
    members = spark.createDataFrame([(rng.randrange(12), rng.randrange(3)) for _ in range(14)], "user_id long, group_id long")
    principal = lambda: rng.choice([("user", str(rng.randrange(12))), ("role", rng.choice(["member", "editor"])), ("group", str(rng.randrange(3)))])
    grants = spark.createDataFrame([(f"f{rng.randrange(12)}", *principal(), rng.choice(["read", "write", "none"])) for _ in range(10)], "target string, kind string, principal string, permission string")
    documents = spark.createDataFrame([(d, rng.choice([None, *(f"f{k}" for k in range(12))]), d % 10 == 9) for d in range(80)], "document long, collection string, deleted boolean")
    single = spark.createDataFrame([(rng.randrange(90), *principal(), "read") for _ in range(40)], "target long, kind string, principal string, permission string")
    return users, members, grants, spark.createDataFrame(tree, "parent string, id string"), documents, single


@pytest.mark.parametrize("kind", ["forest", "cycle", "two parents"])
def test_counts_of_readable_documents_equal_the_pairs(spark, kind):
    rng = random.Random(kind)
    tree = [(f"f{rng.randrange(k)}", f"f{k}") for k in range(1, 12)]
    tree += {"forest": [], "cycle": [("f7", "f0")], "two parents": [("f2", "f9"), ("f3", "f9")]}[kind]
    users, members, grants, edges, documents, single = _shared_library(spark, rng, tree)
    for own in ((None, single) if kind == "cycle" else (single,)):
        pairs = relational.accessible(grants, users, members, edges, documents, document_grants=own).groupBy("user_id").agg(F.count("*"), F.min("document"), F.max("document")).collect()
        assert pairs and {tuple(r) for r in pairs} == {tuple(r) for r in relational.accessible_counts(grants, users, members, edges, documents, document_grants=own).collect()}
    readers, askers = relational.place_tokens(grants, edges, documents, document_grants=single).collect(), relational.place_readers(grants, users, members).collect()
    met = {(u.user_id, d.document) for u in askers for d in readers if set(u.tokens) & set(d.tokens)}
    assert met == {tuple(r) for r in relational.accessible(grants, users, members, edges, documents, document_grants=single).collect()}


def test_documents_do_not_carry_the_users_of_their_folders(spark):
    tree = spark.createDataFrame([("a", "b")], "parent string, id string")
    grants = spark.range(500).select(F.lit("a").alias("target"), F.lit("user").alias("kind"), F.col("id").cast("string").alias("principal"), F.lit("read").alias("permission"))
    documents = spark.range(20).select(F.col("id").alias("document"), F.lit("b").alias("collection"), F.lit(False).alias("deleted"))
    assert {tuple(r.tokens) for r in relational.place_tokens(grants, tree, documents).collect()} == {("in:a",)}


def test_users_are_not_paired_with_documents(spark):
    n = 300
    users = spark.range(n).select(F.col("id").alias("user_id"), F.lit("member").alias("role"), F.lit("active").alias("status"))
    members = spark.createDataFrame([], "user_id long, group_id long")
    tree = spark.createDataFrame([("a", "b")], "parent string, id string")
    grants = users.select(F.lit("a").alias("target"), F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("principal"), F.lit("read").alias("permission"))
    documents = spark.range(n).select(F.col("id").alias("document"), F.when(F.col("id") < 100, "b").alias("collection"), F.lit(False).alias("deleted"))
    single = documents.where("document >= 50").select(F.col("document").alias("target"), F.lit("role").alias("kind"), F.lit("member").alias("principal"), F.lit("read").alias("permission"))
    rows, most = most_rows(relational.accessible_counts(grants, users, members, tree, documents, document_grants=single))
    assert len(rows) == n and {(r.documents, r.first_document, r.last_document) for r in rows} == {(n, 0, n - 1)} and most <= 4 * n


def test_grams_are_cut_once_in_stretches():
    rng = random.Random(3)
    texts = ["abcab", "", None, "😀é😀é😀z", "^^a\na", "".join(rng.choice("abc 😀") for _ in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for order, letters in ((1, 7), (2, 1), (3, 1000), (3, 1 << 20), (5, 2)):
        got, want = Counter(), Counter()
        for part in kernels._grams(order, letters)([batch]):
            got.update(dict(zip(part.column("g").to_pylist(), part.column("n").to_pylist(), strict=True)))
        for t in texts:
            padded = "^" * (order - 1) + (t or "")
            want.update(padded[i : i + order] for i in range(len(t or "")))
        assert got == want


def test_running_lines_of_many_words(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    pages = spark.createDataFrame([("d", 1, f"{long}\nw1 alpha\nbeta w2", long, True)], "doc string, page int, text string, furniture string, usable boolean")
    blocks = spark.createDataFrame([("d", 1, "beta"), ("d", 1, "x" * 50_000)], "doc string, page int, text string")
    assert [(r.line, r.text) for r in comparison.missed_lines(pages, blocks).collect()] == [(1, "w1 alpha")]
    found = spark.createDataFrame([("a-1/23 no x12 " + "y" * 200_000 + " 4.5.6",)], "t string").select(comparison.identifiers(F.col("t"))).first()[0]
    assert found == ["a-1/23", "4.5.6"]


def odd_documents(spark, path):
    """Documents whose ids repeat or are null, with empty and missing texts."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(9)] + ["1234", "55/678", "a-1.2/33", "x_y"]
    page = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 8]))) for _ in range(rng.choice([1, 2, 5, 23, 60])))
    rows = [(rng.choice([k, k, k, 7, 8, None]), rng.choice([page(), page(), page(), None, "", "\n\n\n\n\n"])) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con, sum((t or "").count("\n") + 1 for _, t in rows)


def moved_records(df):
    return sum(node.metrics().apply("shuffleRecordsWritten").value() for node in _nodes(df._jdf.queryExecution().executedPlan()) if node.metrics().contains("shuffleRecordsWritten"))


def test_parsers_are_compared_where_documents_lie(spark, tmp_path):
    con, lines = odd_documents(spark, tmp_path)
    df = readings.parser_comparison(spark, str(tmp_path))
    assert difference(df, con, readings.SQL["parser_comparison"]) == ""
    assert moved_records(df) <= 2 * lines and len(df.inputFiles()) == 1


def test_missed_lines_are_found_where_documents_lie(spark, tmp_path):
    con, lines = odd_documents(spark, tmp_path)
    df = readings.parser_missed_lines(spark, str(tmp_path))
    assert difference(df, con, readings.SQL["parser_missed_lines"]) == ""
    assert moved_records(df) <= 3 * lines and len(df.inputFiles()) == 1


def test_users_and_their_folders_are_not_shuffled_as_pairs(spark, tmp_path):
    n = 400
    tables = {
        "region": "id as r_regionkey, 'R' as r_name from range(5)", "nation": "id as n_nationkey, id % 5 as n_regionkey, 'N' as n_name from range(25)",
        "customer": f"id as c_custkey, 9 as c_nationkey, 'C' as c_name from range({n})", "events": f"id as user_id from range({n})",
    }
    for name, query in tables.items():
        spark.sql(f"select {query}").write.parquet(f"{tmp_path}/{name}.parquet")
    df = permissions.readable_tree(spark, str(tmp_path))
    rows = df.collect()
    moved = [node.metrics().apply("shuffleRecordsWritten").value() for node in _nodes(df._jdf.queryExecution().executedPlan()) if node.metrics().contains("shuffleRecordsWritten")]
    assert len(rows) == len(set(rows)) > n * n / 2 and max(moved) < n * n / 4


def test_users_meet_folders_in_lists(spark):
    n = 2000
    users = spark.range(n).select(F.col("id").alias("user_id"), F.lit("member").alias("role"), F.lit("active").alias("status"))
    members = users.select("user_id", F.lit(1).alias("group_id")).where("false")
    grants = spark.createDataFrame([("r", "role", "member", "read")], "target string, kind string, principal string, permission string")
    nodes = spark.createDataFrame([(None, "r", "R")] + [("r", f"c{k}", f"C{k}") for k in range(50)], "parent string, id string, name string")
    df = relational.readable_folders(grants, users, members, nodes)
    assert len(set(df.collect())) == 51 * n and moved_records(df) < 10 * n


def test_readable_folders_equal_a_walk(spark):
    rng = random.Random(8)
    # folders of two parents, a cycle, a parent that isn't there and folders named twice
    nodes = [(None, "a", "A"), ("q", "z", "Z"), ("x2", "x1", "X"), ("x1", "x2", "X")] + [(rng.choice(["a", "z", "x1", *(f"c{j}" for j in range(k))]), f"c{k}", f"C{k}") for k in range(30)]
    nodes += [(rng.choice(["a", "x2", "c3"]), f"c{rng.randrange(4, 30)}", "again") for _ in range(5)]
    ids = sorted({x for _, x, _ in nodes}) + ["nowhere"]
    users = [(u, rng.choice(["editor", "member"]), "disabled" if u % 7 == 3 else "active") for u in range(25)]
    members = [(u, rng.randrange(3)) for u in range(25) if rng.random() < 0.6]
    grants = [(rng.choice(ids), kind, str(p), rng.choice(["read", "write", "manage", "none"])) for kind, ps in (("user", range(25)), ("role", ["editor"]), ("group", range(3))) for p in ps for _ in range(rng.choice([0, 1, 2]))]
    df = relational.readable_folders(
        spark.createDataFrame(grants, "target string, kind string, principal string, permission string"), spark.createDataFrame(users, "user_id long, role string, status string"),
        spark.createDataFrame(members, "user_id long, group_id int"), spark.createDataFrame(nodes, "parent string, id string, name string"),
    )
    want = []
    for u, role, status in users:
        own = [(t, p) for t, kind, principal, p in grants if (kind, principal) in {("user", str(u)), ("role", role)} | {("group", str(g)) for v, g in members if v == u}]
        can = {}
        for least in ("read", "write"):
            seen = {t for t, p in own if status == "active" and p in ("read", "write", "manage")[least == "write" :]}
            while more := {x for up, x, _ in nodes if up in seen} - seen:
                seen |= more
            can[least] = seen
        want += [(u, x, name, up if up in can["read"] else None, sum(p == x for p, _, _ in nodes), x in can["write"]) for up, x, name in nodes if x in can["read"]]
    assert Counter(tuple(r) for r in df.collect()) == Counter(want) and len(want) > 100


def test_words_are_scored_once_not_gram_by_gram(spark):
    n = 300
    pages = spark.range(n).select(F.col("id").alias("key"), F.lit("abcdefghijklmnopqrst abcdefghij " * 3).alias("text"))
    rows, most = most_rows(quality.char_scores(pages, quality.char_model(pages)))
    assert len(rows) == n and {r.positions for r in rows} == {3 * 30} and most <= 3 * n


def test_two_readings_are_taken_apart_once_each(spark):
    plan = content.identifier_two_readings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_distance_of_words_equals_the_table():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(90))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert alignment.distance(a, b) == row[-1]


def test_words_are_aligned_only_where_their_order_is_asked_for(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "a b c d e f", "f b c d a") for k in range(40)], "key long, truth string, output string")
    assert "ordered" not in alignment.pooled(alignment.reading_measures(pages, ordered=False).withColumn("g", F.lit(1)), "g").columns
    assert {tuple(r) for r in alignment.word_distances(pages.withColumn("g", F.lit("x"))).select("g", "truth_words", "ordered_errors").collect()} == {("x", 6, 3)}


def test_measures_of_words_shuffle_pages_not_words(spark):
    n = 50
    pages = spark.range(n).select(F.col("id").alias("key"), F.lit(" ".join(f"w{k}" for k in range(200))).alias("truth"), F.lit(" ".join(f"w{k}" for k in range(100, 300))).alias("output"))
    df = evaluation.word_measures(pages)
    rows = df.collect()
    moved = [node.metrics().apply("shuffleRecordsWritten").value() for node in _nodes(df._jdf.queryExecution().executedPlan()) if node.metrics().contains("shuffleRecordsWritten")]
    assert len(rows) == n and {(r.shared, r.word_error) for r in rows} == {(100, 100)} and sum(moved) <= 4 * n


def test_a_task_takes_parts_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x" * 10_000] * 5000)], ["key", "text"])
    sizes = [p.nbytes for p in tables.parts(iter([batch]))]
    assert max(sizes) <= 1 << 23 and len(sizes) > 10


def test_blocks_of_many_documents_are_chunked_in_parts():
    class Documents:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    block = {"kind": "paragraph", "text": "Some words. " * 100, "page": 1, "level": None, "label": None, "rows": None, "header_rows": 0}
    batch = pa.RecordBatch.from_pylist([{"key": k, "blocks": [block]} for k in range(3000)] + [{"key": 3000, "blocks": None}])
    out = list(chunking.chunks(Documents())(iter([batch])))
    assert len(out) > 3 and {k for b in out for k in b.column("key").to_pylist()} == set(range(3000))
