"""Relational, permission and library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from .base import TREE_SQL, events, table, tree


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("version"), "l_partkey", "l_suppkey", "l_linestatus", "l_quantity", "l_shipdate")


_NEWEST_SQL = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_shipdate) = 1"


def _newest():
    return F.desc("version"), "l_partkey", "l_suppkey", "l_shipdate"


def latest_version(spark, sf_dir):
    return rel.latest(_versions(spark, sf_dir), "document", *_newest()).select("document", "version", "l_partkey", "l_linestatus")


def searchable_set(spark, sf_dir):
    """The newest searchable version of each document."""
    return rel.latest(_versions(spark, sf_dir).where(F.col("l_linestatus").isin("O")), "document", *_newest()).select("document", "version", "l_partkey")


def folder_closure(spark, sf_dir):
    """Everything below each region and nation, by levels."""
    t = tree(spark, sf_dir)
    roots = t.where("id like 'r%' or id like 'n%'").select("id")
    return rel.closure(t.where("parent is not null").select("parent", "id"), roots).groupBy("root").agg(F.count("*").alias("nodes"))


def _grants(spark, sf_dir):
    """Users are the event users: role by id, two groups, grants on nations and regions."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    users = users.withColumn("role", F.when(F.col("user_id") % 7 == 0, "editor").otherwise("member")).withColumn("status", F.when(F.col("user_id") % 11 == 0, "disabled").otherwise("active"))
    members = users.select("user_id", (F.col("user_id") % 5).alias("group_id")).where("group_id < 3")
    by_user = users.where("user_id % 4 = 0").select(F.concat(F.lit("n"), F.col("user_id") % 25).alias("target"), F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("principal"), F.lit("read").alias("permission"))
    fixed = spark.createDataFrame([("r1", "role", "editor", "manage"), ("n3", "group", "1", "write"), ("r4", "group", "2", "read"), ("n9", "role", "member", "read")], "target string, kind string, principal string, permission string")
    return users, members, by_user.union(fixed)


_GRANTS_CTE = f"""
users AS (SELECT DISTINCT user_id, CASE WHEN user_id % 7 = 0 THEN 'editor' ELSE 'member' END AS role, CASE WHEN user_id % 11 = 0 THEN 'disabled' ELSE 'active' END AS status FROM events),
members AS (SELECT user_id, user_id % 5 AS group_id FROM users WHERE user_id % 5 < 3),
grants AS (SELECT 'n' || (user_id % 25) AS target, 'user' AS kind, user_id::VARCHAR AS principal, 'read' AS permission FROM users WHERE user_id % 4 = 0
  UNION ALL VALUES ('r1', 'role', 'editor', 'manage'), ('n3', 'group', '1', 'write'), ('r4', 'group', '2', 'read'), ('n9', 'role', 'member', 'read')),
tree AS ({TREE_SQL}),
direct AS (SELECT DISTINCT u.user_id, g.target FROM users u JOIN grants g ON (g.kind = 'user' AND g.principal = u.user_id::VARCHAR) OR (g.kind = 'role' AND g.principal = u.role)
    OR (g.kind = 'group' AND g.principal IN (SELECT m.group_id::VARCHAR FROM members m WHERE m.user_id = u.user_id)) WHERE u.status = 'active'),
collections AS (
  SELECT user_id, target AS id FROM direct
  UNION SELECT d.user_id, t.id FROM direct d JOIN tree t ON t.parent = d.target
  UNION SELECT d.user_id, t2.id FROM direct d JOIN tree t ON t.parent = d.target JOIN tree t2 ON t2.parent = t.id)"""


_WRITABLE_CTE = """
may AS (SELECT DISTINCT u.user_id, g.target FROM users u JOIN grants g ON (g.kind = 'role' AND g.principal = u.role) OR (g.kind = 'group' AND g.principal IN (SELECT m.group_id::VARCHAR FROM members m WHERE m.user_id = u.user_id))
  WHERE u.status = 'active' AND g.permission IN ('write', 'manage')),
writable AS (SELECT user_id, target AS id FROM may UNION SELECT d.user_id, t.id FROM may d JOIN tree t ON t.parent = d.target UNION SELECT d.user_id, t2.id FROM may d JOIN tree t ON t.parent = d.target JOIN tree t2 ON t2.parent = t.id)"""


def _documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("document"), F.concat(F.lit("c"), "o_custkey").alias("collection"), (F.col("o_orderstatus") == "P").alias("deleted"), "o_orderstatus", "o_orderdate")


def accessible_docs(spark, sf_dir):
    """How many live documents each user may read, and the first and last of them."""
    users, members, grants = _grants(spark, sf_dir)
    t = tree(spark, sf_dir).where("parent is not null").select("parent", "id")
    return rel.accessible_counts(grants, users, members, t, _documents(spark, sf_dir))


def readable_tree(spark, sf_dir):
    """Folders that a user can read and whether one can write there; the parent only if that is readable too; what lies in them."""
    users, members, grants = _grants(spark, sf_dir)
    return rel.readable_folders(grants, users, members, tree(spark, sf_dir).withColumn("name", F.lower("name")))


def shared_documents(spark, sf_dir):
    """How many live documents each user may read where dear orders are granted to all members one by one, too."""
    users, members, grants = _grants(spark, sf_dir)
    t = tree(spark, sf_dir).where("parent is not null").select("parent", "id")
    d = _documents(spark, sf_dir)
    single = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("target"), F.lit("role").alias("kind"), F.lit("member").alias("principal"), F.lit("read").alias("permission"))
    return rel.accessible_counts(grants, users, members, t, d, document_grants=single).select("user_id", "documents")


def library_overview(spark, sf_dir):
    """Folders with their paths and documents by status."""
    o = _documents(spark, sf_dir).where("not deleted").groupBy("collection").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("ready"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("working"))
    paths = rel.paths(tree(spark, sf_dir)).where("depth = 3").select(F.col("id").alias("collection"), "path")
    return paths.join(o, "collection", "left").select("collection", "path", F.coalesce("ready", F.lit(0)).cast("long").alias("ready"), F.coalesce("working", F.lit(0)).cast("long").alias("working"))


def library_totals(spark, sf_dir):
    """For every folder with its path: documents below it by state, and those of the whole library in the row without a folder."""
    t = tree(spark, sf_dir)
    below = rel.closure(t.where("parent is not null").select("parent", "id"), t.select("id")).select(F.col("id").alias("collection"), F.col("root").alias("folder"))
    state = lambda sign, name: F.sum(F.when(F.col("o_orderstatus") == sign, F.col("n")).otherwise(0)).alias(name)
    own = _documents(spark, sf_dir).groupBy("collection", "o_orderstatus").agg(F.count("*").alias("n"))
    sums = own.join(below, "collection").groupBy("folder").agg(state("F", "ready"), state("O", "working"), state("P", "failed"))
    named = rel.paths(t).join(sums, F.col("id") == F.col("folder"), "left").select(F.col("id").alias("folder"), "path", "depth", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ready", "working", "failed")))
    whole = own.agg(state("F", "ready"), state("O", "working"), state("P", "failed")).select(F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("depth"), "ready", "working", "failed")
    return named.unionByName(whole)


def scope_filter(spark, sf_dir):
    """Documents of a chosen scope: two documents and everything below two folders."""
    t = tree(spark, sf_dir).where("parent is not null").select("parent", "id")
    inside = rel.closure(t, spark.createDataFrame([("n5",), ("r0",)], "id string")).select(F.col("id").alias("collection")).distinct()
    d = _documents(spark, sf_dir)
    by_folder = d.join(inside, "collection", "left_semi").select("document")
    return by_folder.union(d.where(F.col("document").isin(1, 2)).select("document")).distinct()


def anti_orphans(spark, sf_dir):
    """Customers without an order, and orders without a line."""
    c, o, li = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    a = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"))
    b = o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"))
    return a.union(b)


def consistency_checks(spark, sf_dir):
    """Counts that should be zero: lines without order, without part, without supplier, and closed orders with open lines."""
    o, li, p, s = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part", "supplier"))
    checks = {
        "line_without_order": li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"), "line_without_part": li.join(p, li.l_partkey == p.p_partkey, "left_anti"),
        "line_without_supplier": li.join(s, li.l_suppkey == s.s_suppkey, "left_anti"), "open_line_of_closed_order": li.where("l_linestatus = 'O'").join(o.where("o_orderstatus = 'F'"), li.l_orderkey == o.o_orderkey, "left_semi"),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def filtered_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return e.groupBy("user_id").agg(F.count("*").alias("events"), n(F.col("event_type") == "error", "errors"), n(F.col("value") > 50, "large"), n((F.col("event_type") == "purchase") & (F.col("value") > 50), "large_purchases"), F.bool_or(F.col("event_type") == "signup").alias("signed_up"))


def status_pivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).cast("long").alias("finished"), F.coalesce("O", F.lit(0)).cast("long").alias("open"))


def latest_run_per_kind(spark, sf_dir):
    """The last event of each kind, and the last with a value over 90."""
    e = table(spark, sf_dir, "events")
    a = rel.latest(e, "event_type", F.desc("ts"), F.desc("event_id")).select("event_type", F.col("event_id").alias("last_id"))
    b = rel.latest(e.where("value > 90"), "event_type", F.desc("ts"), F.desc("event_id")).select("event_type", F.col("event_id").alias("last_large_id"))
    return a.join(b, "event_type", "left")


def ordered_arrays(spark, sf_dir):
    """Distinct and repeated parts of each order, in order."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]), ",").alias("suppliers"))


def correlated_counts(spark, sf_dir):
    """Each supplier with its number of lines and its largest quantity."""
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    counts = li.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.max("l_quantity").alias("largest"))
    return s.join(counts, s.s_suppkey == counts.l_suppkey, "left").select("s_suppkey", F.lower("s_name").alias("name"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), "largest")


def upsert_latest(spark, sf_dir):
    """Balances of two states of the customers: the second changes every third and wins."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("version"), "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("version", F.lit(2)).withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))
    return rel.upsert(c, new, "c_custkey", "version")


def constraint_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rules = {"small_quantity": F.col("l_quantity") >= 2, "known_flag": F.col("l_returnflag").isin("A", "N"), "discounted_only_if_taxed": (F.col("l_discount") == 0) | (F.col("l_tax") > 0)}
    return rel.violations(li, rules, "k").groupBy("rule").agg(F.count("*").alias("n"))


def audit_list_page(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = rel.where_all(e.withColumn("id", F.col("target").cast("long")), rel.filters(action="event.*", outcome="failure", tenant=None))
    return rel.page(rows, "id", 9000, 50).select("id", "tenant", "action", "outcome")


QUERIES = {f.__name__: f for f in (latest_version, searchable_set, folder_closure, accessible_docs, shared_documents, readable_tree, library_overview, library_totals, scope_filter, anti_orphans, consistency_checks, filtered_counts, status_pivot, latest_run_per_kind, ordered_arrays, correlated_counts, upsert_latest, constraint_violations, audit_list_page)}

SQL = {
    "latest_version": f"SELECT l_orderkey AS document, l_linenumber AS version, l_partkey, l_linestatus FROM lineitem QUALIFY {_NEWEST_SQL}",
    "searchable_set": f"SELECT l_orderkey AS document, l_linenumber AS version, l_partkey FROM lineitem WHERE l_linestatus = 'O' QUALIFY {_NEWEST_SQL}",
    "folder_closure": f"WITH RECURSIVE tree AS ({TREE_SQL}), below AS (SELECT id AS root, id FROM tree WHERE id LIKE 'r%' OR id LIKE 'n%' UNION SELECT b.root, t.id FROM below b JOIN tree t ON t.parent = b.id) SELECT root, count(*) AS nodes FROM below GROUP BY root",
    "accessible_docs": f"WITH {_GRANTS_CTE} SELECT user_id, count(*) AS documents, min(document) AS first_document, max(document) AS last_document FROM (SELECT DISTINCT c.user_id, o.o_orderkey AS document FROM collections c JOIN orders o ON c.id = 'c' || o.o_custkey WHERE o.o_orderstatus <> 'P') GROUP BY user_id",
    "shared_documents": f"WITH {_GRANTS_CTE}, a AS (SELECT c.user_id, o.o_orderkey FROM collections c JOIN orders o ON c.id = 'c' || o.o_custkey WHERE o.o_orderstatus <> 'P' UNION SELECT u.user_id, o.o_orderkey FROM users u JOIN orders o ON o.o_totalprice > 150000 AND o.o_orderstatus <> 'P' WHERE u.role = 'member' AND u.status = 'active') SELECT user_id, count(*) AS documents FROM a GROUP BY user_id",
    "readable_tree": f"WITH {_GRANTS_CTE}, {_WRITABLE_CTE} SELECT c.user_id, c.id, lower(t.name) AS name, CASE WHEN EXISTS (SELECT 1 FROM collections p WHERE p.user_id = c.user_id AND p.id = t.parent) THEN t.parent END AS parent, (SELECT count(*) FROM tree x WHERE x.parent = c.id) AS children, EXISTS (SELECT 1 FROM writable w WHERE w.user_id = c.user_id AND w.id = c.id) AS can_write FROM collections c JOIN tree t ON t.id = c.id",
    "library_overview": "SELECT 'c' || c_custkey AS collection, r_name || ' / ' || n_name || ' / ' || c_name AS path, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) FILTER (WHERE o_orderstatus = 'O') AS working FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "library_totals": f"""WITH RECURSIVE tree AS ({TREE_SQL}), below AS (SELECT id AS folder, id FROM tree UNION SELECT b.folder, t.id FROM below b JOIN tree t ON t.parent = b.id),
named AS (SELECT id, name AS path, 1 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, n.path || ' / ' || t.name, n.depth + 1 FROM named n JOIN tree t ON t.parent = n.id),
o AS (SELECT 'c' || o_custkey AS collection, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
sums AS (SELECT folder, sum(n) FILTER (WHERE s = 'F') AS ready, sum(n) FILTER (WHERE s = 'O') AS working, sum(n) FILTER (WHERE s = 'P') AS failed FROM o JOIN below ON collection = below.id GROUP BY folder
  UNION ALL SELECT NULL, sum(n) FILTER (WHERE s = 'F'), sum(n) FILTER (WHERE s = 'O'), sum(n) FILTER (WHERE s = 'P') FROM o)
SELECT n.id AS folder, n.path, n.depth::BIGINT AS depth, coalesce(ready, 0)::BIGINT AS ready, coalesce(working, 0)::BIGINT AS working, coalesce(failed, 0)::BIGINT AS failed FROM named n LEFT JOIN sums ON folder = n.id
UNION ALL SELECT NULL, NULL, 0, coalesce(ready, 0)::BIGINT, coalesce(working, 0)::BIGINT, coalesce(failed, 0)::BIGINT FROM sums WHERE folder IS NULL""",
    "scope_filter": f"WITH RECURSIVE tree AS ({TREE_SQL}), below AS (SELECT unnest(['n5', 'r0']) AS id UNION SELECT t.id FROM below b JOIN tree t ON t.parent = b.id) SELECT o_orderkey AS document FROM orders WHERE o_orderkey IN (1, 2) OR 'c' || o_custkey IN (SELECT id FROM below)",
    "anti_orphans": "SELECT 'customer' AS kind, c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'order', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "consistency_checks": "SELECT 'line_without_order' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'line_without_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'open_line_of_closed_order', count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "filtered_counts": "SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS large, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS large_purchases, bool_or(event_type = 'signup') AS signed_up FROM events GROUP BY user_id",
    "status_pivot": "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS finished, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY l_returnflag",
    "latest_run_per_kind": "SELECT a.event_type, a.last_id, b.last_large_id FROM (SELECT DISTINCT ON (event_type) event_type, event_id AS last_id FROM events ORDER BY event_type, ts DESC, event_id DESC) a LEFT JOIN (SELECT DISTINCT ON (event_type) event_type, event_id AS last_large_id FROM events WHERE value > 90 ORDER BY event_type, ts DESC, event_id DESC) b USING (event_type)",
    "ordered_arrays": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts, array_to_string(list(l_suppkey ORDER BY l_linenumber, l_suppkey), ',') AS suppliers FROM lineitem GROUP BY l_orderkey",
    "correlated_counts": "SELECT s_suppkey, lower(s_name) AS name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT max(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey) AS largest FROM supplier",
    "upsert_latest": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer",
    "constraint_violations": "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN l_quantity < 2 THEN 'small_quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'known_flag' END, CASE WHEN NOT (l_discount = 0 OR l_tax > 0) THEN 'discounted_only_if_taxed' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL GROUP BY rule",
    "audit_list_page": "SELECT event_id AS id, user_id::VARCHAR AS tenant, 'event.' || event_type AS action, 'failure' AS outcome FROM events WHERE event_type = 'error' AND event_id < 9000 ORDER BY event_id DESC LIMIT 50",
}
