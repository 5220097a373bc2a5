"""Long words, long keys and folds that hold little, against plain versions."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions.text import lexical_terms
from strataloom.operators import audit, evaluation, fingerprints, quality, relational
from strataloom.streaming import limits


def test_words_of_many_letters(spark):
    df = spark.createDataFrame([("x" * 100_000,), ("aB" * 50_000,), ("1" * 50_000 + "." * 50_000 + "a",), ("a-b" * 30_000,), (None,)], "text string")
    rows = df.select(F.round(quality.artefact_share(F.col("text")), 3).alias("a"), F.size(lexical_terms(F.col("text"))).alias("n")).collect()
    assert [r.a for r in rows[:2]] == [0.0, 1.0] and rows[0].n == rows[1].n == 1


def test_limits_are_a_fold_in_time_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randrange(4000)) for k in range(900)]
    df = spark.createDataFrame(rows, "user long, id long, s long").select("user", "id", F.timestamp_seconds("s").alias("ts"))
    got = {r.id: r.allowed for r in limits.limited(df, most=3, seconds=60).collect()}
    want = {}
    for user in (1, 2, 3):
        own = sorted((s, k) for u, k, s in rows if u == user)
        for (_, k), ok in zip(own, limits.admit([float(s) for s, _ in own], [], 3, 60.0)[0], strict=True):
            want[k] = ok
    assert got == want


def test_chains_of_many_events_verify(spark):
    rows = [(str(k % 3), k // 3 + 1, "a", f"act {k}", None, "ok", None) for k in range(3000)]
    e = spark.createDataFrame(rows, "tenant string, seq long, actor string, action string, target string, outcome string, details string").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    chain = audit.build_chain(e)
    assert sorted((r.tenant, r.checked, r.problem) for r in audit.verify_chain(chain).collect()) == [(str(k), 1000, None) for k in range(3)]
    last = audit.GENESIS
    for r in chain.where("tenant = '2'").orderBy("seq").limit(50).collect():
        plain = {"action": r.action, "actor": "a", "details": None, "outcome": "ok", "prev_hash": last, "seq": r.seq, "target": None, "tenant": "2", "ts": f"1970-01-01T00:{r.seq // 60:02}:{r.seq % 60:02}.000000Z"}
        assert r.prev_hash == last
        last = hashlib.sha256(json.dumps(plain, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
        assert r.hash == last
    bad = chain.withColumn("action", F.when((F.col("tenant") == "1") & (F.col("seq") == 500), "forged").otherwise(F.col("action")))
    assert [(r.problem_seq, r.problem) for r in audit.verify_chain(bad).where("tenant = '1'").collect()] == [(500, "modified_event")]


def test_ranks_of_counted_values(spark):
    rng = random.Random(4)
    values = {g: sorted(rng.randrange(30) for _ in range(n)) for g, n in (("a", 1), ("b", 57), ("c", 400))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v long")
    got = {(r.g, r.share): r.value for r in evaluation.nearest_rank(df, "g", "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    assert got == {(g, s): vs[min(int(s * len(vs)), len(vs) - 1)] for g, vs in values.items() for s in (0.0, 0.5, 0.9, 1.0)}
    means = {r.g: r.worst_decile for r in evaluation.worst_decile_mean(df, "g", "v").collect()}
    assert means == {g: round(sum(vs[: max(1, len(vs) // 10)]) / max(1, len(vs) // 10), 6) for g, vs in values.items()}


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)]
    df = spark.createDataFrame([(k, v >> 32, v & 0xFFFFFFFF) for k, v in enumerate(values)], "key long, high long, low long")
    first = {}
    for k, v in enumerate(values):
        first.setdefault(v, k)
    want = {(a, b, (x ^ y).bit_count()) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 3}
    assert {tuple(r) for r in fingerprints.simhash_pairs(df).collect()} == want


def test_exports_and_pruned_chains(spark, tmp_path):
    rows = [("t", k + 1, "a;b" if k == 1 else "=sum", 'say "x"', None, "ok", "line\nend") for k in range(200)]
    e = spark.createDataFrame(rows, "tenant string, seq long, actor string, action string, target string, outcome string, details string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 86400))
    chain = audit.build_chain(e)
    audit.write_csv(chain, f"{tmp_path}/csv")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode("utf-8-sig")
    lines = list(csv.reader(io.StringIO(data, newline=""), delimiter=";"))
    assert data.count("\r\n") == 201 and lines[0][:4] == ["tenant", "seq", "ts", "actor"] and len(lines) == 201
    assert [int(x[1]) for x in lines[1:]] == list(range(1, 201)) and lines[1][3] == "'=sum" and lines[2][3] == "a;b" and lines[1][7] == "line\nend"
    with pytest.raises(ValueError):
        audit.write_csv(chain, f"{tmp_path}/more", most=10)
    out, manifest = audit.signed_export(chain, b"key")
    assert (manifest["count"], manifest["first"], manifest["last"]) == (200, 1, 200) and audit.check_export(out, manifest, b"key") is None
    assert audit.check_export(out.where("seq <> 3"), manifest, b"key") == "count" and audit.check_export(out, manifest, b"other") == "signature"
    assert audit.check_export(out.withColumn("body", F.when(F.col("seq") == 3, "x").otherwise(F.col("body"))), manifest, b"key") == "digest"
    kept, removed, anchors = audit.pruned(chain, F.timestamp_seconds(F.lit(200 * 86400)), 90)
    assert kept.count() == 91 and audit.verify_chain(kept).first().problem == "gap" and audit.verify_chain(kept, anchors).first().problem is None


def test_tenants_see_their_own_rows(spark):
    tables = {"d": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, tenant_id string")}
    assert [r.id for r in relational.TenantView(tables, "a").read("d").collect()] == [1]
    assert relational.TenantView(tables, None).read("d").count() == 0
    plan = relational.TenantView(tables, "a").read("d").where("id > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "tenant_id" in plan


def test_the_better_of_two_readings(spark):
    cases = [
        (("no_text", 0.0, 1.0), (None, 0.5, 0.0), "b"), ((None, 0.5, 1.0), ("bad", 0.0, 9.0), "a"), (("bad", 0.0, 9.0), (None, 0.5, 1.0), "b"), ((None, 0.1, 1.0), (None, 0.2, 9.0), "a"),
        ((None, 0.2, 1.0), (None, 0.1, 0.0), "b"), ((None, 0.1, 1.0), (None, 0.1, 2.0), "b"), ((None, 0.1, 1.0), (None, 0.1, 1.0), "a"), (("bad", 0.3, 1.0), ("bad", 0.1, 1.0), "b"),
    ]
    reading = "struct<verdict:string,artefacts:double,score:double>"
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, a {reading}, b {reading}")
    assert [r.x for r in df.select("k", quality.better_reading(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()] == [c for _, _, c in cases]
