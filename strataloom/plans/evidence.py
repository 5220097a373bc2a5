"""Queries over what answers rest on: layouts, samples, judged sources, identifiers and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lexical_terms
from ..operators import evaluation, maintenance, passages, retrieval, verification
from ..sources import layout
from .base import documents, questions, table
from .search import BM25_CTE, bm25_search, terms_sql

NUMBERS = "[0-9]{12,}"


def _held(spark, sf_dir):
    """(query_id, document) of the documents that hold a question's text."""
    found = passages.located(questions(spark, sf_dir).withColumnRenamed("query_id", "passage"), documents(spark, sf_dir))
    return found.select(F.col("passage").alias("query_id"), F.col("key").alias("document"))


_HELD = "held AS (SELECT item_id AS query_id, doc_id AS document FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)"


def layout_reading_order(spark, sf_dir):
    """Blocks of layouts made from all documents: groups of five lines, each seventh line furniture, a page number at each tenth line."""
    d = documents(spark, sf_dir).select("key", F.split("text", "\n").alias("lines"))
    layer = lambda n: F.when(n % 7 == 6, "furniture").otherwise("body")
    prov = lambda n: F.when(n % 10 == 0, F.array(F.struct((F.floor(n / 10) + 1).cast("int").alias("page_no"))))
    texts = F.transform("lines", lambda x, n: F.struct(F.lit("text").alias("label"), x.alias("text"), layer(n).alias("content_layer"), prov(n).alias("prov")))
    ref = lambda name, n: F.struct(F.concat(F.lit(f"#/{name}/"), n).alias("$ref"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 5).cast("int")), lambda g: F.struct(F.transform(F.sequence(g * 5, F.least(g * 5 + 4, F.size("lines") - 1)), lambda n: ref("texts", n)).alias("children")))
    body = F.struct(F.transform(groups, lambda x, g: ref("groups", g)).alias("children"))
    docs = d.select("key", F.to_json(F.struct(body.alias("body"), texts.alias("texts"), groups.alias("groups"))).alias("json"))
    return layout.layout_blocks(docs).select("key", F.col("idx").cast("int").alias("idx"), "page", F.sha2("text", 256).alias("text_sha256"))


def context_samples(spark, sf_dir):
    """Contexts of perfect searches: two documents that hold the question, even ids first, filled up from BM25 and shuffled by a seed."""
    holding = _held(spark, sf_dir).select("query_id", F.lit(0).alias("piece"), F.col("document").alias("key"), (F.col("document") % 2 == 0).alias("answers"))
    return evaluation.context_samples(holding, bm25_search(spark, sf_dir)).select("query_id", "key", F.col("place").cast("int").alias("place"))


def answers_by_sources(spark, sf_dir):
    """Judged answers: the best hit is cited and five are found; the evidence is any document that holds the question."""
    hits = bm25_search(spark, sf_dir).where("rank <= 5").select("query_id", "rank", F.col("key").alias("document"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    status = F.when(F.col("query_id") % 5 == 0, "refused").otherwise("answered")
    a = questions(spark, sf_dir).select("query_id", F.concat(F.lit("t"), F.col("query_id") % 3).alias("type"), status.alias("status"), (F.col("query_id") % 4 != 0).alias("correct"))
    evidence = _held(spark, sf_dir).select("query_id", F.lit(0).alias("piece"), "document", F.lit(1).alias("page"))
    return evaluation.judged_answers(a, hits.where("rank = 1"), hits, evidence, ["answered", "refused"])


def _numbers(spark, sf_dir):
    """(key, kind, value): long numbers of each document."""
    return documents(spark, sf_dir).select("key", F.lit("number").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0)))).alias("value"))


def identifier_lookup(spark, sf_dir):
    """Documents with the numbers of document i first for question i, then the BM25 list: the first ten."""
    held = _numbers(spark, sf_dir)
    asked = questions(spark, sf_dir).select("query_id").join(held.withColumnRenamed("key", "query_id"), "query_id")
    return retrieval.by_identifiers(asked, held, bm25_search(spark, sf_dir)).where("rank <= 10").select("query_id", "key", F.col("held").cast("long").alias("held"), "rank")


def identifier_ties(spark, sf_dir):
    """The BM25 list where hits within five points of the best that hold a long number go first."""
    hits = bm25_search(spark, sf_dir)
    holds = hits.select("query_id", "key").join(_numbers(spark, sf_dir).select("key").distinct(), "key", "left_semi")
    return retrieval.identifier_tie_break(hits, holds, 5.0).select("query_id", "key", F.col("final_rank").cast("int").alias("final_rank"))


def hit_details(spark, sf_dir):
    """The best three hits of each question with the long numbers on the first two pages of four lines."""
    lines = documents(spark, sf_dir).select("key", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    found = lines.select("key", F.floor(F.col("n") / 4).cast("int").alias("page"), F.explode(F.regexp_extract_all("line", F.lit(NUMBERS), F.lit(0))).alias("number"))
    pages = found.groupBy(F.col("key").alias("document"), "page").agg(F.collect_list("number").alias("uncertain"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("document"), F.lit(0).alias("page_start"), F.lit(1).alias("page_end"), F.array("source", "lang").alias("heading_path"))
    out = retrieval.rank_details(bm25_search(spark, sf_dir).where("rank <= 3"), d, pages)
    return out.select("query_id", "rank", "key", F.array_join("heading_path", " > ").alias("path"), F.array_join("uncertain", ",").alias("uncertain"))


def speaker_check(spark, sf_dir):
    """Statements about the amounts of orders: the clerk of each order names it, a second person names another; every third statement mixes them up."""
    o = table(spark, sf_dir, "orders")
    amount = (F.col("o_orderkey") * 7 + 1000).cast("string")
    other = (F.col("o_orderkey") * 11 + 900_000_000).cast("string")
    text = F.concat(F.lit("Anna Berg said the order came to "), amount, F.lit(" in all. Later Carl Dahl replied that it came to "), other, F.lit(" or less."))
    said = F.when(F.col("o_orderkey") % 3 == 0, other).otherwise(amount)
    sources = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("k"), text.alias("text"))
    sentences = o.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("n"), F.concat(F.lit("Anna Berg stated that "), said, F.lit(" was due.")).alias("text"))
    return verification.spoken(sentences, sources).select("id", "n", "person", F.array_join("given", ",").alias("given"))


def index_rewrite(spark, sf_dir):
    """Search terms of all lines once those that lack some are written anew, and whether their version is to be embedded.

    Every third line of even documents lacks its terms, every fifth document its vectors; each seventh document failed.
    """
    lines = documents(spark, sf_dir).select(F.col("key").alias("document"), F.lit(1).alias("version"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    gone = (F.col("document") % 2 == 0) & (F.col("ordinal") % 3 == 0)
    chunks = lines.withColumn("terms", F.when(~gone, lexical_terms(F.col("text")))).withColumn("vector", F.when(F.col("document") % 5 != 0, F.array(F.lit(1.0))))
    d = table(spark, sf_dir, "documents")
    versions = d.select(F.col("doc_id").alias("document"), F.lit(1).alias("version"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ready").alias("status"), F.lit(False).alias("deleted"), F.col("source").alias("context"))
    repaired, queued = maintenance.reindexed(chunks, versions)
    out = repaired.join(queued.withColumn("queued", F.lit(True)), ["document", "version"], "left")
    return out.select("document", F.col("ordinal").cast("int").alias("ordinal"), F.array_join("terms", " ").alias("terms"), F.coalesce("queued", F.lit(False)).alias("queued"))


def stated_answers(spark, sf_dir):
    """Whether answers about orders state the golden answer: a number with a thousands separator, every third one another number."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey") + 1000
    golden = F.when(F.col("o_orderkey") % 3 == 0, number + 1).otherwise(number)
    both = o.select("o_orderkey", F.concat(F.lit("In all  it came to "), F.format_number(number, 0), F.lit(" units.")).alias("answer"), golden.cast("string").alias("golden"))
    plain = both.select("o_orderkey", verification.comparable(F.col("answer")).alias("a"), verification.comparable(F.col("golden")).alias("g"))
    return plain.select("o_orderkey", verification.states(F.col("a"), F.col("g")).alias("states"))


def uncertain_answers(spark, sf_dir):
    """Answers (the first line of each document) that state long numbers of their document, which are uncertain."""
    first = documents(spark, sf_dir).select(F.col("key").alias("answer_id"), F.col("key").alias("document"), F.element_at(F.split("text", "\n"), 1).alias("text"))
    uncertain = _numbers(spark, sf_dir).select(F.col("key").alias("document"), F.col("value").alias("identifier"))
    return verification.uncertain_in(first, uncertain).select("answer_id", F.array_join("identifiers", ",").alias("identifiers"))


QUERIES = {f.__name__: f for f in (layout_reading_order, context_samples, answers_by_sources, identifier_lookup, identifier_ties, hit_details, speaker_check, index_rewrite, stated_answers, uncertain_answers)}

_NUMBERS_CTE = f"numbers AS (SELECT DISTINCT doc_id AS key, unnest(regexp_extract_all(text, '{NUMBERS}')) AS value FROM documents)"
SQL = {
    "layout_reading_order": r"""WITH l AS (SELECT doc_id AS key, n - 1 AS n, trim(regexp_replace(lines[n], '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(lines) + 1)) AS n FROM documents)),
k AS (SELECT *, CASE WHEN n % 10 = 0 THEN n // 10 + 1 END AS own FROM l WHERE n % 7 <> 6 AND text <> '')
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY n) - 1)::INT AS idx, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY key ORDER BY n), 1)::INT AS page, sha256(text) AS text_sha256 FROM k""",
    "context_samples": f"""WITH {BM25_CTE}, {_HELD}, first AS (SELECT query_id, document AS key, 0 AS list, row_number() OVER (PARTITION BY query_id ORDER BY document % 2, document) AS n FROM held QUALIFY n <= 2),
each AS (SELECT query_id, key, min({{'list': list, 'n': n}}) AS o FROM (SELECT query_id, key, list, n FROM first UNION ALL SELECT query_id, key, 1, rank FROM bm25 WHERE rank <= 18) GROUP BY query_id, key),
kept AS (SELECT query_id, key FROM each QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o, key) <= 6)
SELECT query_id, key, (row_number() OVER (PARTITION BY query_id ORDER BY sha256('7:' || query_id || ':' || key), key))::INT AS place FROM kept""",
    "answers_by_sources": f"""WITH {BM25_CTE}, {_HELD}, ok AS (SELECT query_id, min(rank) AS first FROM bm25 JOIN held ON held.query_id = bm25.query_id AND held.document = bm25.key WHERE rank <= 5 GROUP BY query_id),
a AS (SELECT item_id AS query_id, 't' || (item_id % 3) AS type, item_id % 5 = 0 AS refused, item_id % 4 <> 0 AS correct, coalesce(first = 1, false) AS cited, first IS NOT NULL AS found FROM benchmark LEFT JOIN ok ON ok.query_id = item_id)
SELECT type, count(*) AS questions, round(avg(correct::INT), 6) AS correct, round(avg(cited::INT), 6) AS cited, round(avg(found::INT), 6) AS found, count(*) FILTER (WHERE NOT refused) AS answered, count(*) FILTER (WHERE refused) AS refused FROM a GROUP BY type""".replace("SELECT query_id, min(rank)", "SELECT bm25.query_id, min(rank)").replace("GROUP BY query_id),\na AS", "GROUP BY bm25.query_id),\na AS"),
    "identifier_lookup": f"""WITH {BM25_CTE}, {_NUMBERS_CTE}, hits AS (SELECT item_id AS query_id, h.key, count(*) AS held FROM benchmark JOIN numbers a ON a.key = item_id JOIN numbers h ON h.value = a.value GROUP BY ALL),
pairs AS (SELECT coalesce(h.query_id, b.query_id) AS query_id, coalesce(h.key, b.key) AS key, coalesce(h.held, 0) AS held, b.rank AS r FROM hits h FULL JOIN bm25 b ON h.query_id = b.query_id AND h.key = b.key)
SELECT query_id, key, held, (row_number() OVER (PARTITION BY query_id ORDER BY held DESC, r NULLS LAST, key))::INT AS rank FROM pairs QUALIFY rank <= 10""",
    "identifier_ties": f"""WITH {BM25_CTE}, {_NUMBERS_CTE}, n AS (SELECT b.*, score >= max(score) OVER (PARTITION BY query_id) - 5.0 AND key IN (SELECT key FROM numbers) AS near FROM bm25 b)
SELECT query_id, key, (row_number() OVER (PARTITION BY query_id ORDER BY NOT near, rank))::INT AS final_rank FROM n""",
    "hit_details": rf"""WITH {BM25_CTE}, l AS (SELECT doc_id AS key, (n - 1) // 4 AS page, lines[n] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(lines) + 1)) AS n FROM documents)),
u AS (SELECT key, string_agg(number, ',' ORDER BY number) AS uncertain FROM (SELECT DISTINCT key, unnest(regexp_extract_all(line, '{NUMBERS}')) AS number FROM l WHERE page <= 1) GROUP BY key)
SELECT b.query_id, b.rank, b.key, d.source || ' > ' || d.lang AS path, coalesce(u.uncertain, '') AS uncertain FROM bm25 b JOIN documents d ON d.doc_id = b.key LEFT JOIN u ON u.key = b.key WHERE b.rank <= 3""",
    "index_rewrite": rf"""WITH l AS (SELECT doc_id AS document, source, n - 1 AS ordinal, lines[n] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(lines) + 1)) AS n FROM documents)),
k AS (SELECT *, document % 2 = 0 AND document % 7 <> 0 AS anew FROM l)
SELECT document, ordinal::INT AS ordinal, CASE WHEN anew THEN array_to_string({terms_sql("(source || chr(10) || text)")}, ' ') WHEN document % 2 = 0 AND ordinal % 3 = 0 THEN NULL ELSE array_to_string({terms_sql("text")}, ' ') END AS terms, document % 5 = 0 AND document % 7 <> 0 AS queued FROM k""",
    "stated_answers": "SELECT o_orderkey, contains('in all it came to ' || (o_orderkey + 1000) || ' units.', (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1001 ELSE o_orderkey + 1000 END)::VARCHAR) AS states FROM orders",
    "uncertain_answers": rf"""WITH {_NUMBERS_CTE}, f AS (SELECT doc_id AS key, list_transform(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{{L}}\p{{N}}./,_-]+'), lambda t: regexp_replace(regexp_replace(t, '^[.,/_-]+', ''), '[.,/_-]+$', '')) AS tokens FROM documents)
SELECT key AS answer_id, string_agg(value, ',' ORDER BY value) AS identifiers FROM numbers JOIN f USING (key) WHERE list_contains(tokens, value) GROUP BY key""",
    "speaker_check": "SELECT o_orderkey AS id, 0 AS n, 'anna berg' AS person, (o_orderkey * 11 + 900000000)::VARCHAR AS given FROM orders WHERE o_orderkey % 3 = 0",
}
