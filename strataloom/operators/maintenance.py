"""Library upkeep: retries, sweeps, purges, releases, invariants and repairs, as joins and conditional counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import ENGLISH, Language, lexical_terms
from .relational import latest, readable_counts


def retryable(versions: DataFrame, documents: DataFrame, *order: Column | str) -> DataFrame:
    """The newest version of each live document, if it failed by an internal error or is parsed without its vectors.

    ``versions``: document, status, failure, embedding_failure; ``documents``: document, deleted.
    """
    newest = latest(versions.join(documents.where("not deleted"), "document", "left_semi"), "document", *order)
    internal = (F.col("status") == "failed") & (F.col("failure") == "internal_error")
    return newest.where(internal | (F.col("status") == "parsed") & F.col("embedding_failure").isNotNull())


def sweep(files: DataFrame, rows: DataFrame, now: Column, least_age: str = "INTERVAL '1' DAY") -> DataFrame:
    """(sha256, problem): files older than a day that no row names, and rows whose file is missing.

    ``files``: sha256, modified; ``rows``: sha256.
    """
    names = rows.select("sha256").distinct()
    orphans = files.where(F.col("modified") <= now - F.expr(least_age)).join(names, "sha256", "left_anti").select("sha256", F.lit("orphan_file").alias("problem"))
    return orphans.union(names.join(files, "sha256", "left_anti").select("sha256", F.lit("missing_file").alias("problem")))


def late_purge(documents: DataFrame, jobs: DataFrame, now: Column, wait: str = "INTERVAL '1' HOUR") -> DataFrame:
    """Documents deleted longer ago than ``wait`` for which no job (document) waits."""
    return documents.where(F.col("deleted_at") < now - F.expr(wait)).join(jobs, "document", "left_anti")


def released_blobs(versions: DataFrame, gone: DataFrame) -> DataFrame:
    """(sha256): blobs of the versions (document, version) that go, which no other version names."""
    going = versions.join(gone, ["document", "version"], "left_semi").select("sha256").distinct()
    staying = versions.join(gone, ["document", "version"], "left_anti").select("sha256")
    return going.join(staying, "sha256", "left_anti")


def without_administrator(users: DataFrame, changed: DataFrame) -> DataFrame:
    """(tenant_id): tenants that have an active administrator and would have none once ``changed`` (user_id) lose the role."""
    admins = users.where("role = 'admin' and status = 'active'")
    kept = admins.join(changed.select("user_id").distinct().withColumn("goes", F.lit(1)), "user_id", "left")
    return kept.groupBy("tenant_id").agg(F.count(F.when(F.col("goes").isNull(), 1)).alias("left")).where(F.col("left") == 0).select("tenant_id")


def incomplete(chunks: DataFrame, by: list[str], *fields: str) -> DataFrame:
    """Versions of which some chunk lacks a field: one flag a field, ``no_<field>``."""
    flags = chunks.groupBy(*by).agg(*[F.bool_or(F.col(f).isNull()).alias(f"no_{f}") for f in fields])
    anything = F.lit(False)
    for f in fields:
        anything = anything | F.col(f"no_{f}")
    return flags.where(anything)


def reindexed(chunks: DataFrame, versions: DataFrame, language: Language = ENGLISH) -> tuple[DataFrame, DataFrame]:
    """``chunks`` with the search terms that they lack, and (document, version) that lack vectors and are to be embedded.

    ``chunks``: document, version, ordinal, text, terms, vector; ``versions``: document, version, status,
    deleted, context.  Only live versions that are parsed or ready are touched.  Where some chunk of a
    version lacks its terms, all of them are written anew from text and context; chunks and vectors stay.
    """
    open_ = versions.where("not deleted and status in ('parsed', 'ready')").select("document", "version", F.coalesce("context", F.lit("")).alias("context"))
    flags = incomplete(chunks.join(open_, ["document", "version"], "left_semi"), ["document", "version"], "terms", "vector")
    anew = flags.where("no_terms").join(open_, ["document", "version"]).select("document", "version", "context")
    terms = lexical_terms(F.concat_ws("\n", F.nullif("context", F.lit("")), "text"), language)
    repaired = chunks.join(anew.withColumn("_anew", F.lit(True)), ["document", "version"], "left").withColumn("terms", F.when(F.col("_anew"), terms).otherwise(F.col("terms")))
    return repaired.select(*chunks.columns), flags.where("no_vector").select("document", "version")


def resumed(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a result yet; rows that only hold a null result count as not done."""
    return items.join(done.where(F.col("result").isNotNull()).select(*keys).distinct(), keys, "left_anti")


def guarded(target: DataFrame, written: DataFrame, keys: list[str], field: str) -> DataFrame:
    """``target`` with the field of ``written`` where key and content_hash agree; stale results are left out."""
    new = written.select(*keys, F.col("content_hash").alias("_hash"), F.col(field).alias("_new"))
    out = target.join(new, keys, "left")
    return out.withColumn(field, F.when(F.col("_hash") == F.col("content_hash"), F.col("_new")).otherwise(F.col(field))).drop("_hash", "_new")


def leased(requests: DataFrame, most: int = 2, seconds: float = 600.0) -> DataFrame:
    """Requests (user, id, start, end in seconds) with ``granted``: at most ``most`` run at once, each for ``seconds`` at most.

    Dealt out and sorted by Spark; the fold holds the ends of the running leases only.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, running = None, []
        for batch in batches:
            granted = []
            for own, start, end in zip(batch["user"], batch["start"], batch["end"], strict=True):
                if own != user:
                    user, running = own, []
                running = [t for t in running if t > start]
                granted.append(len(running) < most)
                if granted[-1]:
                    running.append(min(end, start + seconds))
            yield batch.assign(granted=granted)

    rows = requests.where("user is not null").select(F.col("user").cast("long").alias("user"), F.col("id").cast("long").alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return rows.repartition("user").sortWithinPartitions("user", "start", "id").mapInPandas(fold, "user long, id long, start double, end double, granted boolean")


def upload_duplicates(uploads: DataFrame, versions: DataFrame, documents: DataFrame, *order: Column | str) -> DataFrame:
    """(upload, document): the least other live document of the upload's collection whose latest version has the same bytes.

    ``uploads``: upload, collection, sha256; ``versions``: document, sha256; ``documents``: document,
    collection, deleted.  Of equal documents the two least are kept before the join, so copies are
    never paired with each other.
    """
    newest = latest(versions, "document", *order).select("document", "sha256").join(documents.where("not deleted").select("document", "collection"), "document")
    first = newest.groupBy("collection", "sha256").agg(F.min("document").alias("first"), F.count("*").alias("n"))
    second = newest.join(first.where("n > 1"), ["collection", "sha256"]).where(F.col("document") > F.col("first")).groupBy("collection", "sha256").agg(F.min("document").alias("second"))
    least = first.join(second, ["collection", "sha256"], "left")
    both = uploads.join(least, ["collection", "sha256"])
    document = F.when(F.col("first") != F.col("upload"), F.col("first")).otherwise(F.col("second"))
    return both.select("upload", document.alias("document")).where("document is not null")


def principal(user: Column, group: Column, role: Column) -> tuple[Column, Column]:
    """Kind and value of a grant's principal, of which one is set."""
    kind = F.when(user.isNotNull(), "user").when(group.isNotNull(), "group").when(role.isNotNull(), "role")
    return kind, F.coalesce(user.cast("string"), group.cast("string"), role.cast("string"))


def allowed(users: DataFrame, catalogue: DataFrame, permission: str) -> DataFrame:
    """(user_id) of active users whose role has the permission; a name that no role has is an error."""
    known = catalogue.where(F.col("permission") == permission)
    if known.isEmpty():
        raise ValueError(f"unknown permission: {permission}")
    return users.where("status = 'active'").join(known, "role", "left_semi").select("user_id")


def managed(users: DataFrame, grants: DataFrame, collections: DataFrame) -> DataFrame:
    """(user_id, id): all collections for administrators, for others those that they manage.

    ``grants``: user_id, id, permission, closed downward.
    """
    active = users.where("status = 'active'")
    admins = active.where("role = 'admin'").select("tenant_id", "user_id").join(collections.select("tenant_id", "id"), "tenant_id").select("user_id", "id")
    own = grants.where("permission = 'manage'").join(active.where("role <> 'admin'"), "user_id", "left_semi").select("user_id", "id")
    return admins.union(own).distinct()


def managed_counts(users: DataFrame, grants: DataFrame, collections: DataFrame) -> DataFrame:
    """(user_id, collections, first_id): how many rows of ``managed`` each user has, and the least id of them.

    Collections are counted once for each set of tenants that hold them, so that administrators meet
    tenants and never collections; what others manage is as many rows as they have grants.
    """
    active = users.where("status = 'active'")
    tenant = F.col("tenant_id").cast("string")
    held = collections.groupBy(F.col("id").alias("document")).agg(F.array_sort(F.collect_set(tenant)).alias("tokens"))
    admins = active.where("role = 'admin'").select("user_id", tenant.alias("tenant_id")).distinct()
    whole = readable_counts(held, admins.groupBy("user_id").agg(F.collect_set("tenant_id").alias("tokens")))
    own = grants.where("permission = 'manage'").join(active.where("role <> 'admin'"), "user_id", "left_semi").select("user_id", "id").distinct()
    # who is an administrator elsewhere has these ids already
    there = own.join(admins, "user_id").join(collections.select(tenant.alias("tenant_id"), "id"), ["tenant_id", "id"], "left_semi").select("user_id", "id")
    single = own.join(there, ["user_id", "id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("collections"), F.min("id").alias("first_id"))
    both = whole.select("user_id", F.col("documents").alias("collections"), F.col("first_document").alias("first_id")).unionByName(single)
    return both.groupBy("user_id").agg(F.sum("collections").alias("collections"), F.min("first_id").alias("first_id"))


def cited(turns: DataFrame, permitted: DataFrame) -> DataFrame:
    """(turn, n, document, ordinal, readable) of turns with the parallel arrays documents and ordinals.

    Sources that the reader may not see any more stay, without their key.
    """
    each = turns.select("turn", F.posexplode(F.arrays_zip("documents", "ordinals")).alias("n", "s")).select("turn", (F.col("n") + 1).alias("n"), F.col("s.documents").alias("document"), F.col("s.ordinals").alias("ordinal"))
    seen = each.join(permitted.select("document").distinct().withColumn("readable", F.lit(True)), "document", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    return seen.select("turn", "n", F.when(F.col("readable"), F.col("document")).alias("document"), F.when(F.col("readable"), F.col("ordinal")).alias("ordinal"), "readable")


def at_most(df: DataFrame, limit: int) -> DataFrame:
    """The rows, or an error if there are more than ``limit``."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return df


def file_name(path: Column) -> Column:
    """Last part of a path or address without its query; control characters and quotes away, 200 letters at most; null without any."""
    last = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^.*[/\\]", "")
    return F.nullif(F.substring(F.trim(F.regexp_replace(last, r"[\x00-\x1f\x7f\"<>:|*]+", "")), 1, 200), F.lit(""))


def title_of(name: Column) -> Column:
    """A title from a file name: the stem with underscores, dots and hyphens as single spaces."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", "")
    return F.trim(F.regexp_replace(stem, r"[_.\s-]+", " "))
