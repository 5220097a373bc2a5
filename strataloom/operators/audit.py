"""Hash-chained audit logs: building, verifying, checkpoints, retention and export; operations figures."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .maintenance import at_most
from .tables import written

GENESIS = "0" * 64
FIELDS = ("seq", "ts", "actor", "action", "target", "outcome", "details")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical(prev_hash: Column) -> Column:
    """Canonical JSON of an event: keys sorted, nulls kept, no spaces."""
    named = {**{f: (stamp(F.col(f)) if f == "ts" else F.col(f)) for f in FIELDS}, "prev_hash": prev_hash, "tenant": F.col("tenant")}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]), {"ignoreNullFields": "false"})


def event_hash(prev_hash: Column) -> Column:
    return F.sha2(canonical(prev_hash), 256)


def build_chain(events: DataFrame) -> DataFrame:
    """Events (tenant, FIELDS) with prev_hash and hash.

    A chain is sequential by nature.  Events are dealt out by tenant and sorted by Spark, and the
    fold holds the last hash only, however long a tenant's log is; a log in parts starts each from
    the last hash of the part before (``head``).
    """
    head = F.coalesce("head", F.lit(GENESIS)) if "head" in events.columns else F.lit(GENESIS)
    bodies = events.select("tenant", "seq", canonical(F.lit("@")).alias("body"), head.alias("head"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            for own, body, head in zip(batch["tenant"], batch["body"], batch["head"], strict=True):
                if own != tenant:
                    tenant, last = own, head
                before.append(last)
                last = hashlib.sha256(body.replace('"prev_hash":"@"', f'"prev_hash":"{last}"', 1).encode()).hexdigest()
                after.append(last)
            yield pd.DataFrame({"tenant": batch["tenant"], "seq": batch["seq"], "prev_hash": before, "hash": after})

    hashes = bodies.repartition("tenant").sortWithinPartitions("tenant", "seq").mapInPandas(chain, "tenant string, seq long, prev_hash string, hash string")
    return events.drop("head").join(hashes, ["tenant", "seq"])


_SEGMENT = "tenant string, n long, first_seq long, first_prev string, last_seq long, last_hash string, problem_seq long, problem string"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tenant of a task's sorted rows: where they start and end, and the first problem between them."""
    found: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tenant, prev, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tenant", "prev_hash", "hash"))
        seq, good = batch.column("seq").to_numpy(), batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        starts = np.flatnonzero(np.append(True, tenant[1:] != tenant[:-1]))
        gap, broken = np.zeros(len(seq), bool), np.zeros(len(seq), bool)
        gap[1:], broken[1:] = seq[1:] != seq[:-1] + 1, prev[1:] != own[:-1]
        gap[starts] = broken[starts] = False
        last = found[-1] if found and found[-1][0] == tenant[0] else None
        if last is not None:  # the tenant goes on from the batch before
            gap[0], broken[0] = seq[0] != last[4] + 1, prev[0] != last[5]
        bad = np.flatnonzero(gap | broken | ~good)
        for first, end in zip(starts, np.append(starts[1:], len(seq)), strict=True):
            k = np.searchsorted(bad, first)
            place = bad[k] if k < len(bad) and bad[k] < end else None
            problem = (None, None) if place is None else (int(seq[place]), "gap" if gap[place] else "broken_link" if broken[place] else "modified_event")
            if first == 0 and last is not None:
                last[1], last[4], last[5] = last[1] + end, int(seq[end - 1]), own[end - 1]
                if last[6] is None:
                    last[6:] = problem
            else:
                found.append([tenant[first], int(end - first), int(seq[first]), prev[first], int(seq[end - 1]), own[end - 1], *problem])
        if len(found) > 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(_SEGMENTS.names, row, strict=True)) for row in found[:-1]], _SEGMENTS)
            found = found[-1:]
    yield pa.RecordBatch.from_pylist([dict(zip(_SEGMENTS.names, row, strict=True)) for row in found], _SEGMENTS)


_SEGMENTS = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SEGMENT.split(", ")])


def verify_chain(chain: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(tenant, checked, problem_seq, problem): gap, broken_link or modified_event at the first bad seq, else null.

    Each event's hash is recomputed from its stored predecessor hash where the event lies.  Then only
    hashes are dealt out, by ranges of tenant and seq, so one tenant's log is spread over all tasks; a
    task reports for each of its segments how it begins and ends and its first problem, and
    neighbouring segments are stitched.  ``anchors`` (tenant, removed, head) tell where a pruned
    chain starts.
    """
    rows = chain.select("tenant", "seq", "prev_hash", "hash", (F.col("hash").eqNullSafe(event_hash(F.col("prev_hash")))).alias("good"))
    dealt = written(rows, "chain").repartitionByRange("tenant", "seq", "hash").sortWithinPartitions("tenant", "seq", "hash")
    segments = dealt.mapInArrow(_segments, _SEGMENT)
    segments = segments.join(anchors, "tenant", "left") if anchors is not None else segments.withColumn("removed", F.lit(0)).withColumn("head", F.lit(None).cast("string"))
    w = Window.partitionBy("tenant").orderBy("first_seq", "last_seq")
    before_hash = F.coalesce(F.lag("last_hash").over(w), F.col("head"), F.lit(GENESIS))
    before_seq = F.coalesce(F.lag("last_seq").over(w), F.col("removed"), F.lit(0))
    seam = F.when(F.col("first_seq") != before_seq + 1, "gap").when(~F.col("first_prev").eqNullSafe(before_hash), "broken_link")
    at = lambda seq, order, problem: F.when(problem.isNotNull(), F.struct(seq.alias("seq"), F.lit(order).alias("order"), problem.alias("problem")))
    checked = segments.select("tenant", "n", F.least(at(F.col("first_seq"), 0, seam), at(F.col("problem_seq"), 1, F.col("problem"))).alias("p"))
    return checked.groupBy("tenant").agg(F.sum("n").alias("checked"), F.min("p").alias("p")).select("tenant", "checked", F.col("p.seq").alias("problem_seq"), F.col("p.problem").alias("problem"))


def verify_checkpoints(chain: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (tenant, seq, hash, signature_ok) against the chain: unsigned, missing, differs or null."""
    own = checkpoints.join(chain.select("tenant", "seq", F.col("hash").alias("found")), ["tenant", "seq"], "left")
    return own.withColumn("problem", F.when(~F.col("signature_ok"), "unsigned").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("hash"), "differs"))


def retention(events: DataFrame, now: Column, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """The events that stay, and (tenant, through_seq, removed) of the removed prefix of each tenant.

    The prefix ends before the first event within the period, or at the head if there is none.
    """
    if keep_days < 90:
        raise ValueError("events are kept for 90 days at least")
    inside = F.col("ts") >= now - F.make_dt_interval(F.lit(keep_days))
    bounds = events.groupBy("tenant").agg(F.coalesce(F.min(F.when(inside, F.col("seq"))) - 1, F.max("seq")).alias("through_seq"))
    joined = events.join(bounds, "tenant")
    removed = joined.where("seq <= through_seq").groupBy("tenant", "through_seq").agg(F.count("*").alias("removed"))
    return joined.where("seq > through_seq").drop("through_seq"), removed


def csv_safe(text: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_line(cells: list[Column]) -> Column:
    """Cells joined by semicolons, safe from formulas; those that hold a semicolon, quote or line end are quoted, nulls are empty."""

    def written(cell: Column) -> Column:
        safe = csv_safe(F.coalesce(cell.cast("string"), F.lit("")))
        return F.when(safe.rlike(r"[;\"\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return F.array_join(F.array(*map(written, cells)), ";")


#: Events that one export may hold.
MOST_EXPORTED = 50_000


def write_csv(events: DataFrame, path: str, most: int = MOST_EXPORTED) -> None:
    """One file with a byte order mark, a header and CRLF line ends, in the order of tenant and seq; more than ``most`` events are an error."""
    columns = [c for c in ("tenant", *FIELDS, "prev_hash", "hash") if c in events.columns]
    cells = [stamp(F.col(c)) if c == "ts" else F.col(c) for c in columns]
    lines = at_most(events, most).select(F.lit(1).alias("part"), "tenant", "seq", csv_line(cells).alias("line"))
    header = events.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("tenant"), F.lit(None).cast("long").alias("seq"), F.lit("\ufeff" + ";".join(columns)).alias("line"))
    # an export is bounded, so one task may hold it
    header.unionByName(lines).repartition(1).sortWithinPartitions("part", "tenant", "seq").select("line").write.option("lineSep", "\r\n").text(path)


def _signature(digest: str, key: bytes) -> str:
    return hmac.new(key, digest.encode(), hashlib.sha256).hexdigest()


def signed_export(chain: DataFrame, key: bytes, most: int = MOST_EXPORTED) -> tuple[DataFrame, dict]:
    """Canonical rows of a chain (tenant, seq, body) and their manifest: count, first and last seq, digest and signature.

    The digest is that of the rows' hashes in order; more than ``most`` events are an error.
    """
    rows = at_most(chain, most).select("tenant", "seq", canonical(F.col("prev_hash")).alias("body"))
    return rows, _manifest(rows, key)


def _manifest(rows: DataFrame, key: bytes) -> dict:
    hashes = F.array_sort(F.collect_list(F.struct("tenant", "seq", F.sha2("body", 256).alias("h"))))
    digest = F.sha2(F.array_join(F.transform(hashes, lambda x: x["h"]), ""), 256)
    m = rows.agg(F.count("*").alias("count"), F.min("seq").alias("first"), F.max("seq").alias("last"), digest.alias("digest")).first().asDict()
    return m | {"signature": _signature(m["digest"], key)}


def check_export(rows: DataFrame, manifest: dict, key: bytes) -> str | None:
    """What is wrong with an export: signature, count or digest; null if nothing."""
    if not hmac.compare_digest(_signature(manifest["digest"], key), manifest["signature"]):
        return "signature"
    found = _manifest(rows, key)
    return next((f for f in ("count", "digest") if found[f] != manifest[f]), None)


def pruned(chain: DataFrame, now: Column, keep_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events that stay, what was removed, and an anchor (tenant, removed, head) a tenant from which its chain goes on."""
    kept, removed = retention(chain, now, keep_days)
    head = chain.join(removed.select("tenant", F.col("through_seq").alias("seq")), ["tenant", "seq"]).select("tenant", F.col("seq").alias("removed"), F.col("hash").alias("head"))
    return kept, removed, head


def backoff(attempts: DataFrame, free: int = 4, most: int = 900) -> DataFrame:
    """(user, id, ts, failures, wait): consecutive failures so far and the seconds to wait after them.

    ``attempts``: user, id, ts, failed.  A success starts a new island of failures.
    """
    w = Window.partitionBy("user").orderBy("ts", "id")
    island = attempts.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w))
    n = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("user", "island").orderBy("ts", "id"))
    counted = island.withColumn("failures", n)
    wait = F.when(F.col("failures") > free, F.least(F.pow(F.lit(2.0), F.least(F.col("failures") - free - 1, F.lit(20))), F.lit(float(most)))).otherwise(0.0)
    return counted.select("user", "id", "ts", F.col("failures").cast("long").alias("failures"), wait.cast("long").alias("wait"))


def reconcile(live: DataFrame, saved: DataFrame) -> DataFrame:
    """(name, problem) of tables whose counts differ or that stand on one side only."""
    both = live.select("name", F.col("n").alias("a")).join(saved.select("name", F.col("n").alias("b")), "name", "full")
    return both.withColumn("problem", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "count")).where("problem is not null")
