"""Documents on their way, over a stream that breaks off and goes on."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException

from strataloom.streaming import states

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "document long, version int, status string, ts timestamp, reason string"
at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    yield spark
    spark.conf.set(name, old) if old else spark.conf.unset(name)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(path)


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def test_states_with_stuck_documents_dead_letters_and_a_restart(rocks, tmp_path):
    spark, source, target, check = rocks, *(str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, source, [(1, 1, "queued", at(0), None), (1, 1, "parsing", at(1), None), (2, 1, "queued", at(0), None), (3, 1, "parsing", at(0), None), (None, 1, "queued", at(0), None), (4, 1, "queued", at(0), None), (5, 1, "queued", at(0), None)])

    def fail(number):
        raise RuntimeError("killed")

    states.start(stream(spark, source), target, check, patience_seconds=1800, late_seconds=60).awaitTermination()
    put(spark, source, [(1, 1, "ocr", at(5), None), (1, 1, "parsed", at(6), None), (1, 1, "ready", at(7), None), (1, 1, "parsed", at(8), None), (4, 2, "queued", at(9), None), (4, 2, "dreaming", at(10), None)])
    with pytest.raises(StreamingQueryException, match="killed"):
        states.start(stream(spark, source), target, check, before=fail, patience_seconds=1800, late_seconds=60).awaitTermination()
    put(spark, source, [(1, 1, "embedding", at(20), None), (1, 1, "ready", at(21), None), (5, 1, "parsing", at(20), None), (5, 1, "failed", at(21), "no_text"), (5, 1, "queued", at(22), None), (4, 1, "parsing", at(10), None)])
    put(spark, source, [(6, 1, "queued", at(45), None)])
    for _ in range(2):
        states.start(stream(spark, source), target, check, patience_seconds=1800, late_seconds=60).awaitTermination()
    put(spark, source, [(7, 1, "queued", at(46), None)])
    states.start(stream(spark, source), target, check, patience_seconds=1800, late_seconds=60).awaitTermination()
    history = spark.read.parquet(target)
    now = {r.document: (r.version, r.status, r.reason) for r in states.current(history).collect()}
    assert now == {1: (1, "ready", None), 2: (1, "failed", "stuck_queued"), 4: (2, "failed", "stuck_queued"), 5: (1, "queued", None), 6: (1, "queued", None), 7: (1, "queued", None)}
    letters = sorted((r.document, r.status, r.reason) for r in states.dead_letters(history).collect())
    assert letters == [(1, "ready", "bad_transition"), (3, "parsing", "not_queued"), (4, "dreaming", "unknown_status"), (4, "parsing", "superseded")]
    accepted = history.where("accepted and document = 1").collect()
    assert sorted(r.status for r in accepted) == sorted(["queued", "parsing", "ocr", "parsed", "embedding", "ready"])


def test_steps_allow_only_the_order_of_stages():
    rng = random.Random(3)
    now = None
    for _ in range(2000):
        version, status = rng.randrange(1, 4), rng.choice([*states.NEXT, "other"])
        why = states.step(now, version, status)
        if status == "other":
            assert why == "unknown_status"
        elif now is None or version > now[0]:
            assert (why is None) == (status == "queued")
        elif version < now[0]:
            assert why == "superseded"
        elif status == now[1]:
            assert why == "repeated"
        else:
            assert (why is None) == (status in states.NEXT[now[1]])
        now = (version, status) if why is None else now
        if now and rng.random() < 0.05:
            now = None
