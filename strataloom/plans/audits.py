"""Audit, retention, limits and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..streaming import limits
from .base import events, table

_CHAIN = "SELECT user_id::VARCHAR AS tenant, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id, ts, event_type FROM events"


def hash_chain_verify(spark, sf_dir):
    """Chains built from the events of each user, then verified."""
    return audit.verify_chain(audit.build_chain(events(spark, sf_dir)))


def chain_tamper(spark, sf_dir):
    """Verification after damage: tenant 1 lost its third event, of tenant 2 the fourth was changed, of tenant 3 the second forged."""
    chain = audit.build_chain(events(spark, sf_dir))
    chain = chain.where("not (tenant = '1' and seq = 3)")
    chain = chain.withColumn("outcome", F.when((F.col("tenant") == "2") & (F.col("seq") == 4), "forged").otherwise(F.col("outcome")))
    chain = chain.withColumn("prev_hash", F.when((F.col("tenant") == "3") & (F.col("seq") == 2), audit.GENESIS).otherwise(F.col("prev_hash")))
    return audit.verify_chain(chain)


def checkpoint_verify(spark, sf_dir):
    """Checkpoints at every tenant's fifth event; one is beyond the chain."""
    chain = audit.build_chain(events(spark, sf_dir))
    points = chain.where("seq = 5").select("tenant", F.when(F.col("tenant") == "4", 10**6).otherwise(F.col("seq")).alias("seq"), "hash", (F.col("tenant") != "6").alias("signature_ok"))
    return audit.verify_checkpoints(chain, points).select("tenant", "seq", "problem")


def event_hashes(spark, sf_dir):
    """Hash of each event's plain fields."""
    e = table(spark, sf_dir, "events")
    plain = F.concat_ws("|", "event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select("event_id", F.sha2(plain, 256).alias("hash"))


def retention_prune(spark, sf_dir):
    """What a period of 90 days before the last event removes: the prefix of each chain."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    kept, removed = audit.retention(e.withColumn("ts", F.col("ts") - F.make_dt_interval(F.pmod(F.col("seq") * -37, F.lit(211)).cast("int"))), F.lit(now), 90)
    left = kept.groupBy("tenant").agg(F.count("*").alias("kept"))
    return removed.join(left, "tenant", "full").select("tenant", "through_seq", F.coalesce("removed", F.lit(0)).cast("long").alias("removed"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


_RETENTION_SQL = f"""WITH c AS (SELECT tenant, seq, ts - to_days((((seq * -37) % 211 + 211) % 211)::INT) AS ts FROM ({_CHAIN})), n AS (SELECT max(ts) AS now FROM events),
b AS (SELECT tenant, coalesce(min(seq) FILTER (WHERE ts >= now - INTERVAL 90 DAY) - 1, max(seq)) AS through_seq FROM c, n GROUP BY tenant)
SELECT c.tenant, CASE WHEN count(*) FILTER (WHERE seq <= through_seq) > 0 THEN through_seq END AS through_seq, count(*) FILTER (WHERE seq <= through_seq) AS removed, count(*) FILTER (WHERE seq > through_seq) AS kept FROM c JOIN b USING (tenant) GROUP BY c.tenant, through_seq"""


def login_backoff(spark, sf_dir):
    """Errors in a row are failures, anything else is a success."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), "ts", F.col("event_type").isin("error", "view", "click").alias("failed"))
    return audit.backoff(e).where("failures > 0").select("user", "id", "failures", "wait")


_BACKOFF_SQL = """WITH e AS (SELECT user_id AS user, event_id AS id, ts, event_type IN ('error', 'view', 'click') AS failed FROM events),
i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user ORDER BY ts, id) AS island FROM e),
c AS (SELECT user, id, sum(failed::INT) OVER (PARTITION BY user, island ORDER BY ts, id)::BIGINT AS failures FROM i)
SELECT user, id, failures, (CASE WHEN failures > 4 THEN least(pow(2, least(failures - 5, 20)), 900) ELSE 0 END)::BIGINT AS wait FROM c WHERE failures > 0"""


def rate_limit(spark, sf_dir):
    """At most 3 requests an hour and user; refused ones don't count."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), "ts")
    return limits.limited(e, most=3, seconds=3600.0).groupBy("user").agg(F.count("*").alias("requests"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


def audit_export_csv(spark, sf_dir):
    """Cells of the audit export, safe from formulas."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type")).alias("cell"))
    return e.select("event_id", audit.csv_safe(F.col("cell")).alias("cell"))


def backup_reconcile(spark, sf_dir):
    """Lines an order against a backup that lost and gained some."""
    li = table(spark, sf_dir, "lineitem")
    live = li.groupBy(F.col("l_orderkey").cast("string").alias("name")).agg(F.count("*").alias("n"))
    saved = live.where("name not like '%7'").withColumn("n", F.when(F.col("name").endswith("3"), F.col("n") + 1).otherwise(F.col("n")))
    return audit.reconcile(live, saved)


def operations_overview(spark, sf_dir):
    """Figures of all tables as (metric, value)."""
    from functools import reduce

    names = ("documents", "pages", "events", "orders", "lineitem")
    counts = [table(spark, sf_dir, n).agg(F.count("*").alias("value")).select(F.lit(n).alias("metric"), "value") for n in names]
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("value")).select(F.lit("document_bytes").alias("metric"), "value")
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").agg(F.count("*").alias("value")).select(F.lit("failed_events").alias("metric"), "value")
    return reduce(lambda a, b: a.union(b), [*counts, size, failed])


QUERIES = {f.__name__: f for f in (hash_chain_verify, chain_tamper, checkpoint_verify, event_hashes, retention_prune, login_backoff, rate_limit, audit_export_csv, backup_reconcile, operations_overview)}

SQL = {
    "hash_chain_verify": "SELECT user_id::VARCHAR AS tenant, count(*) AS checked, NULL::BIGINT AS problem_seq, NULL::VARCHAR AS problem FROM events GROUP BY user_id",
    "chain_tamper": f"""WITH c AS (SELECT tenant, count(*) AS n FROM ({_CHAIN}) GROUP BY tenant)
SELECT tenant, n - (CASE WHEN tenant = '1' AND n >= 3 THEN 1 ELSE 0 END) AS checked,
  CASE WHEN tenant = '1' AND n > 3 THEN 4 WHEN tenant = '2' AND n >= 4 THEN 4 WHEN tenant = '3' AND n >= 2 THEN 2 END::BIGINT AS problem_seq,
  CASE WHEN tenant = '1' AND n > 3 THEN 'gap' WHEN tenant = '2' AND n >= 4 THEN 'modified_event' WHEN tenant = '3' AND n >= 2 THEN 'broken_link' END AS problem FROM c""",
    "checkpoint_verify": f"SELECT tenant, CASE WHEN tenant = '4' THEN 1000000 ELSE 5 END::BIGINT AS seq, CASE WHEN tenant = '6' THEN 'unsigned' WHEN tenant = '4' THEN 'missing' END AS problem FROM ({_CHAIN}) WHERE seq = 5",
    "event_hashes": "SELECT event_id, sha256(concat_ws('|', event_id, user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'))) AS hash FROM events",
    "retention_prune": _RETENTION_SQL,
    "login_backoff": _BACKOFF_SQL,
    "audit_export_csv": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '''=' || event_type ELSE event_type END AS cell FROM events",
    "backup_reconcile": "SELECT l_orderkey::VARCHAR AS name, count(*) AS a, CASE WHEN l_orderkey % 10 = 3 THEN count(*) + 1 END AS b, CASE WHEN l_orderkey % 10 = 7 THEN 'missing' ELSE 'count' END AS problem FROM lineitem WHERE l_orderkey % 10 IN (3, 7) GROUP BY l_orderkey",
    "operations_overview": "SELECT 'documents' AS metric, count(*)::BIGINT AS value FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'document_bytes', sum(strlen(text))::BIGINT FROM documents UNION ALL SELECT 'failed_events', count(*) FROM events WHERE event_type = 'error'",
}
