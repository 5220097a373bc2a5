"""Queries that compare readings, parsers and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, comparison
from ..operators.tables import spread
from .base import documents, table

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _readings(spark, sf_dir):
    """Documents and a reading in which words that begin with 'th' are garbled, every fifth line is missing and a line was made up."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    lines = F.split(F.regexp_replace("text", r"(?:^|(?<=\s))t(h[a-z]{4,})", "qz$1"), "\n")
    kept = F.filter(lines, lambda x, k: k % 5 != 4)
    return d.select(F.col("doc_id").alias("key"), "lang", F.col("text").alias("truth"), F.concat(F.array_join(kept, "\n"), F.lit("\nqxa qxb qxc qxd")).alias("output"))


def word_edit_distance(spark, sf_dir):
    """Least word edits between each document and the reading in which only words are garbled: as many as there are garbled words."""
    d = documents(spark, sf_dir).select("key", F.col("text").alias("truth"), F.regexp_replace("text", r"(?:^|(?<=\s))t(h[a-z]{4,})", "qz$1").alias("output"))
    return alignment.word_edits(d)


def reading_summary(spark, sf_dir):
    """Pooled measures of the readings by language, but for the order of words."""
    r = _readings(spark, sf_dir)
    m = alignment.reading_measures(r, ordered=False).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang"), "key")
    return alignment.pooled(m, "lang")


def reading_order(spark, sf_dir):
    """Share of words in order, by language; word for word alignment is beyond SQL."""
    return alignment.word_distances(_readings(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("pages"), alignment.order())


def _parsed(spark, sf_dir):
    """Pages of four lines; the parser leaves out each third line and gives the first line of a page to the page before.

    The first line of a document is its running line; each fifth page has no usable text layer.
    """
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("all"))
    texts = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(4)), lambda first: F.array_join(F.slice("all", first, 4), "\n"))
    pages = d.select("doc", F.element_at("all", 1).alias("furniture"), F.posexplode(texts).alias("page", "text")).withColumn("page", F.col("page") + 1)
    n, page = F.col("n"), F.floor(F.col("n") / 4).cast("int") + 1
    blocks = d.select("doc", F.posexplode("all").alias("n", "line")).where("n % 3 <> 2")
    blocks = blocks.select("doc", F.when((n % 4 == 0) & (page > 1), page - 1).otherwise(page).alias("page"), F.col("line").alias("text"))
    return pages.withColumn("usable", F.col("page") % 5 != 0), blocks


def parser_comparison(spark, sf_dir):
    """What the parser keeps and adds of each document, where pages under 60 % fall back to the text layer."""
    return comparison.tally(*_parsed(spark, sf_dir), 0.6)


def parser_missed_lines(spark, sf_dir):
    """Lines that the parser missed, by document and page."""
    return comparison.missed_lines(*_parsed(spark, sf_dir)).groupBy("doc", "page").agg(F.count("*").alias("missed"), F.min("line").alias("first"))


QUERIES = {f.__name__: f for f in (word_edit_distance, reading_summary, reading_order, parser_comparison, parser_missed_lines)}

_PARSED_CTE = rf"""
lined AS (SELECT doc, furniture, n - 1 AS n, lines[n] AS line, (n - 1) // 4 + 1 AS page FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS lines, lines[1] AS furniture, unnest(range(1, len(lines) + 1)) AS n FROM documents)),
usable AS (SELECT * FROM lined WHERE page % 5 <> 0),
blocks AS (SELECT doc, CASE WHEN n % 4 = 0 AND page > 1 THEN page - 1 ELSE page END AS page, line AS text FROM lined WHERE n % 3 <> 2),
marks AS (SELECT DISTINCT doc, page, furniture FROM usable)"""


def _counts_sql(name: str, kind: str) -> str:
    """CTEs of the multisets of one kind of word: wanted by page, near a page, and both by document with the fallback applied."""
    w = {"w": _WORDS, "i": r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}./-]*\p{{Nd}}[\p{{L}}\p{{N}}./-]*'), lambda x: len(regexp_replace(x, '[^\p{{Nd}}]', '', 'g')) >= 3)"}[kind]
    return rf"""
own_{name} AS (SELECT doc, page, word, count(*) AS n FROM (SELECT doc, page, unnest({w.format("line")}) AS word FROM usable) GROUP BY ALL),
marked_{name} AS (SELECT doc, page, word, count(*) AS n FROM (SELECT doc, page, unnest({w.format("furniture")}) AS word FROM marks) GROUP BY ALL),
want_{name} AS (SELECT o.doc, o.page, o.word, o.n - coalesce(m.n, 0) AS n FROM own_{name} o LEFT JOIN marked_{name} m USING (doc, page, word) WHERE o.n > coalesce(m.n, 0)),
have_{name} AS (SELECT doc, page, word, count(*) AS n FROM (SELECT doc, page, unnest({w.format("text")}) AS word FROM blocks) GROUP BY ALL)"""


def _tally_sql(name: str) -> str:
    return f"""
got_{name} AS (SELECT doc, word, sum(n) AS n FROM (
  SELECT doc, page, word, n FROM have_{name} SEMI JOIN marks USING (doc, page) ANTI JOIN back USING (doc, page) UNION ALL SELECT doc, page, word, n FROM own_{name} SEMI JOIN back USING (doc, page)) GROUP BY ALL),
doc_{name} AS (SELECT doc, word, sum(n) AS n FROM want_{name} GROUP BY ALL),
both_{name} AS (SELECT coalesce(d.doc, g.doc) AS doc, sum(coalesce(d.n, 0)) AS want, sum(least(coalesce(d.n, 0), coalesce(g.n, 0))) AS kept, sum(greatest(coalesce(g.n, 0) - coalesce(d.n, 0), 0)) AS extra FROM doc_{name} d FULL JOIN got_{name} g ON d.doc = g.doc AND d.word = g.word GROUP BY 1)"""


_GARBLED = r"regexp_replace(text, '(^|\s)t(h[a-z]{4,})', '\1qz\2', 'g')"
SQL = {
    "word_edit_distance": rf"""WITH d AS (SELECT doc_id AS key, len(list_filter({_WORDS.format(_GARBLED)}, lambda w: starts_with(w, 'qzh'))) - len(list_filter({_WORDS.format("text")}, lambda w: starts_with(w, 'qzh'))) AS n FROM documents)
SELECT key, n AS edits, n AS replaced, 0::BIGINT AS deleted, 0::BIGINT AS inserted FROM d""",
    "reading_summary": rf"""WITH r AS (SELECT doc_id AS key, lang, text AS truth, array_to_string(list_filter(string_split({_GARBLED}, chr(10)), lambda x, k: k % 5 <> 0), chr(10)) || chr(10) || 'qxa qxb qxc qxd' AS output FROM documents),
a AS (SELECT key, lang, {_WORDS.format("truth")} AS t, {_WORDS.format("output")} AS o, list_filter(list_transform(regexp_split_to_array(truth, '\r\n|[\r\n]'), lambda x: {_WORDS.format("x")}), lambda w: len(w) > 0) AS lines FROM r),
placed AS (SELECT key, unnest(o) AS word, unnest(range(len(o))) AS pos FROM a),
marks AS (SELECT p.key, p.pos, t.key IS NOT NULL AS known FROM placed p LEFT JOIN (SELECT DISTINCT key, unnest(t) AS word FROM a) t USING (key, word)),
made_up AS (SELECT key, sum(n) AS invented FROM (SELECT key, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS island FROM marks WHERE NOT known) GROUP BY key, island HAVING count(*) >= 3) GROUP BY key),
line_words AS (SELECT key, line, unnest(w) AS word FROM (SELECT key, unnest(lines) AS w, unnest(range(len(lines))) AS line FROM a)),
met AS (SELECT key, count(*) AS found FROM (SELECT l.key, l.line FROM line_words l LEFT JOIN (SELECT DISTINCT key, word FROM placed) o USING (key, word) GROUP BY ALL HAVING count(o.word) >= 0.5 * count(*)) GROUP BY key),
grams AS (SELECT key, max(n) AS most FROM (SELECT key, g, count(*) AS n FROM (SELECT key, unnest(list_transform(range(1, len(o) - 2), lambda i: array_to_string(o[i:i + 3], ' '))) AS g FROM a) GROUP BY ALL) GROUP BY key),
true_grams AS (SELECT key, max(n) AS most FROM (SELECT key, g, count(*) AS n FROM (SELECT key, unnest(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) AS g FROM a) GROUP BY ALL) GROUP BY key),
s AS (SELECT a.key, lang, len(t) AS truth_words, len(o) AS output_words, coalesce(m.invented, 0) AS invented, len(lines) AS lines, coalesce(f.found, 0) AS lines_found, coalesce(g.most, 0) >= 3 AND coalesce(h.most, 0) < 3 AS loop
  FROM a LEFT JOIN made_up m USING (key) LEFT JOIN met f USING (key) LEFT JOIN grams g USING (key) LEFT JOIN true_grams h USING (key)),
tc AS (SELECT key, word, count(*) AS n FROM (SELECT key, unnest(t) AS word FROM a) GROUP BY ALL), oc AS (SELECT key, word, count(*) AS n FROM placed GROUP BY ALL),
b AS (SELECT coalesce(tc.key, oc.key) AS key, coalesce(tc.word, oc.word) AS word, coalesce(tc.n, 0) AS t, coalesce(oc.n, 0) AS o FROM tc FULL JOIN oc ON tc.key = oc.key AND tc.word = oc.word),
e AS (SELECT key, greatest(sum(t) - sum(least(t, o)), sum(o) - sum(least(t, o))) AS bag, coalesce(sum(t) FILTER (WHERE id), 0) AS ids, coalesce(sum(least(t, o)) FILTER (WHERE id), 0) AS found
  FROM (SELECT *, length(word) >= 4 AND regexp_matches(word, '\p{{Nd}}') AND 2 * length(regexp_replace(word, '[^\p{{Nd}}]', '', 'g')) >= length(regexp_replace(word, '[^\p{{L}}\p{{N}}]', '', 'g')) AS id FROM b) GROUP BY key)
SELECT lang, count(*) AS pages, sum(truth_words)::BIGINT AS truth_words, 1 - round(sum(coalesce(bag, 0)) / greatest(sum(truth_words), 1), 6) AS words, round(sum(coalesce(found, 0)) / greatest(sum(coalesce(ids, 0)), 1), 6) AS ids,
  round(sum(coalesce(invented, 0)) / greatest(sum(output_words), 1), 6) AS invented, count(*) FILTER (WHERE loop) AS loops, round(sum(lines_found) / greatest(sum(lines), 1), 6) AS lines FROM s LEFT JOIN e USING (key) GROUP BY lang""",
    "parser_comparison": f"""WITH {_PARSED_CTE}, {_counts_sql("w", "w")}, {_counts_sql("i", "i")},
near AS (SELECT doc, page, word, sum(n) AS n FROM (SELECT doc, page, word, n FROM have_w UNION ALL SELECT doc, page + 1, word, n FROM have_w) GROUP BY ALL),
back AS (SELECT w.doc, w.page FROM want_w w LEFT JOIN near USING (doc, page, word) GROUP BY ALL HAVING sum(least(w.n, coalesce(near.n, 0))) / sum(w.n) < 0.6), {_tally_sql("w")}, {_tally_sql("i")}
SELECT d.doc, coalesce(w.want, 0)::BIGINT AS words, coalesce(w.kept, 0)::BIGINT AS kept, coalesce(w.extra, 0)::BIGINT AS extra, coalesce(i.want, 0)::BIGINT AS ids, coalesce(i.kept, 0)::BIGINT AS ids_kept, (SELECT count(*) FROM back b WHERE b.doc = d.doc) AS replaced
FROM (SELECT DISTINCT doc FROM lined) d LEFT JOIN both_w w USING (doc) LEFT JOIN both_i i USING (doc)""",
    "parser_missed_lines": rf"""WITH {_PARSED_CTE}, {_counts_sql("w", "w")},
near AS (SELECT doc, page, word, sum(n) AS n FROM (SELECT doc, page, word, n FROM have_w UNION ALL SELECT doc, page + 1, word, n FROM have_w) GROUP BY ALL),
each AS (SELECT doc, page, n % 4 AS line, word, count(*) AS n FROM (SELECT doc, page, n, unnest({_WORDS.format("line")}) AS word FROM usable) e ANTI JOIN marked_w m USING (doc, page, word) GROUP BY ALL),
taken AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc, page, word ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM each),
bad AS (SELECT t.doc, t.page, t.line FROM taken t LEFT JOIN near USING (doc, page, word) GROUP BY ALL HAVING sum(CASE WHEN coalesce(near.n, 0) <= earlier THEN t.n ELSE 0 END) >= 0.5 * sum(t.n))
SELECT doc, page::INT AS page, count(*) AS missed, min(line)::INT AS first FROM bad GROUP BY doc, page""",
}
