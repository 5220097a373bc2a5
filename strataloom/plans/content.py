"""Queries over the contents of documents: fingerprints, quality, entities, chunks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import claims, clean, token_estimate, words
from ..operators import chunking, entities, fingerprints, kernels, quality
from ..sources import files
from .base import documents, sentences, table

_W = r"[\p{L}\p{N}_]+"
_WORDS_SQL = rf"regexp_extract_all(lower(text), '{_W}')"
_SENTENCES_CTE = "s AS (SELECT o_orderkey AS key, 'order no ' || o_orderkey || ' was placed on ' || strftime(o_orderdate, '%d.%m.%Y') || ' for ' || replace(printf('%.2f', o_totalprice), '.', ',') || ' eur' AS text, o_orderdate, o_totalprice FROM orders)"


def content_hash_dups(spark, sf_dir):
    """Groups of documents with equal words."""
    d = documents(spark, sf_dir).select("key", fingerprints.content_hash(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("copies"), F.min("key").alias("first_key")).where("copies > 1")


def simhash(spark, sf_dir):
    h = fingerprints.simhash(documents(spark, sf_dir))
    return h.select("key", F.concat(F.lpad(F.hex("high"), 8, "0"), F.lpad(F.hex("low"), 8, "0")).alias("simhash"))


_SIMHASH_CTE = f"""
w AS (SELECT doc_id AS key, {_WORDS_SQL} AS w FROM documents),
sh AS (SELECT key, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w),
hashed AS (SELECT key, ('0x' || substr(sha256(s), 1, 16))::UBIGINT AS h FROM sh),
bits AS (SELECT key, i, sum(2 * ((h >> i) & 1)::INT - 1) AS b FROM hashed, range(64) t(i) GROUP BY key, i),
halves AS (SELECT key, sum(CASE WHEN b > 0 AND i >= 32 THEN 1::BIGINT << (i - 32)::BIGINT ELSE 0 END)::UBIGINT AS high, sum(CASE WHEN b > 0 AND i < 32 THEN 1::BIGINT << i::BIGINT ELSE 0 END)::UBIGINT AS low FROM bits GROUP BY key),
sim AS (SELECT key, high * 4294967296::UBIGINT + low AS h FROM halves)"""


def near_dup_pairs(spark, sf_dir):
    """Pairs of different SimHashes within three bits; documents of one hash count as their first."""
    return fingerprints.simhash_pairs(fingerprints.simhash(documents(spark, sf_dir)))


def _paged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def running_lines(spark, sf_dir):
    """Pages of each source without their running lines: how much is left of each."""
    return quality.without_running_lines(_paged(spark, sf_dir)).select("doc", "page", F.length("text").cast("long").alias("letters"), F.sha2("text", 256).alias("hash"))


_RUNNING_SQL = r"""WITH sizes AS (SELECT source AS doc, count(*) AS pages FROM documents GROUP BY source),
l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
n AS (SELECT *, sum((trim(line) <> '')::INT) OVER (PARTITION BY doc, page ORDER BY pos) AS up, sum((trim(line) <> '')::INT) OVER (PARTITION BY doc, page) AS total FROM l),
k AS (SELECT *, CASE WHEN trim(line) <> '' AND (up <= 2 OR up > total - 2) THEN trim(lower(line)) END AS key FROM n),
c AS (SELECT doc, key, count(DISTINCT page) AS on_pages, min({'page': page, 'pos': pos}) AS first FROM k WHERE key IS NOT NULL GROUP BY doc, key),
j AS (SELECT k.*, c.on_pages, c.first, s.pages FROM k LEFT JOIN c ON c.doc = k.doc AND c.key = k.key JOIN sizes s ON s.doc = k.doc),
m AS (SELECT *, pages >= 3 AND key IS NOT NULL AND (regexp_matches(key, '^(page\s*)?[-–]?\s*[0-9]{1,3}\s*(/\s*[0-9]{1,3})?\s*[-–]?$')
  OR (on_pages >= greatest(3, pages // 2) AND NOT (first.page = page AND first.pos = pos))) AS gone FROM j)
SELECT doc, page, length(t)::BIGINT AS letters, sha256(t) AS hash FROM (SELECT doc, page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '') AS t FROM m GROUP BY doc, page)"""


_GRAMS = r"list_filter(flatten(list_transform(list_transform({runs}, lambda r: ' ' || r || ' '), lambda p: list_transform(range(1, greatest(length(p) - 1, 2)), lambda i: substr(p, i, 3)))), lambda g: length(g) = 3)"
_RUNS = "regexp_extract_all(lower(text), '\\p{L}+')"
_MODEL_CTE = rf"""
fold AS (SELECT doc_id % 2 AS half, unnest({_GRAMS.format(runs=_RUNS)}) AS tri FROM documents),
tri AS (SELECT half, tri, count(*) AS n_tri FROM fold GROUP BY half, tri),
bi AS (SELECT half, substr(tri, 1, 2) AS bi, sum(n_tri) AS n_bi FROM tri GROUP BY 1, 2)"""


def char_model(spark, sf_dir):
    """Trigram counts of all documents."""
    return quality.char_model(documents(spark, sf_dir))[0]


def char_score(spark, sf_dir):
    """Score of every document by the model of the other half."""
    d = documents(spark, sf_dir)
    halves = [d.where(F.pmod("key", F.lit(2)) == k) for k in (0, 1)]
    return quality.char_scores(halves[0], quality.char_model(halves[1])).unionAll(quality.char_scores(halves[1], quality.char_model(halves[0])))


_SCORE_SQL = rf"""WITH {_MODEL_CTE},
low AS (SELECT doc_id AS key, 1 - doc_id % 2 AS half, list_filter(regexp_extract_all(text, '\p{{L}}+'), lambda w: length(w) >= 3 AND w = lower(w)) AS runs FROM documents),
used AS (SELECT key, half, tri, count(*) AS n FROM (SELECT key, half, unnest({_GRAMS.format(runs="runs")}) AS tri FROM low) GROUP BY ALL)
SELECT key, sum(n)::BIGINT AS positions, round(sum(n * log2((coalesce(CASE WHEN n_tri >= 2 THEN n_tri END, 0) + 1) / (coalesce(n_bi, 0) + 36))) / sum(n), 6) AS score
FROM used LEFT JOIN tri ON tri.half = used.half AND tri.tri = used.tri LEFT JOIN bi ON bi.half = used.half AND bi.bi = substr(used.tri, 1, 2) GROUP BY key"""


def artefact_share(spark, sf_dir):
    return documents(spark, sf_dir).select("key", F.round(quality.artefact_share(F.col("text")), 6).alias("artefacts"))


def quality_verdict(spark, sf_dir):
    """Verdict of each document: by its characters, then by its artefacts."""
    d = documents(spark, sf_dir)
    scores = quality.char_scores(d, quality.char_model(d))
    own = d.select("key", F.size(words(F.col("text"))).alias("n_words"), quality.artefact_share(F.col("text")).alias("artefacts"), F.length(F.regexp_replace("text", r"\s", "")).alias("visible"))
    both = own.join(scores, "key", "left")
    v = quality.verdict(F.col("positions"), F.col("score"), F.col("n_words"), F.col("artefacts"))
    return both.select("key", quality.usability(F.col("visible"), F.lit(0.0), F.col("n_words"), v).alias("verdict"))


def identifier_two_readings(spark, sf_dir):
    """Identifiers that only one of two readings holds: the second reads every 7 as a 1."""
    d = documents(spark, sf_dir)
    reading = lambda text: d.select("key", F.explode(fingerprints.identifiers(text)).alias("identifier"))
    n = fingerprints.multiset_differences(reading(F.col("text")), reading(F.translate("text", "7", "1")), ["key"], "identifier")
    return n.select("key", "identifier", F.abs("n").alias("n"), F.when(F.col("n") > 0, "uncertain").otherwise("extra").alias("side"))


def _identifiers_sql(text: str) -> str:
    bare = rf"list_transform(string_split_regex({text}, '\s+'), lambda t: regexp_replace(regexp_replace(t, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''))"
    return rf"list_filter({bare}, lambda t: length(t) >= 4 AND regexp_matches(t, '[0-9]') AND 2 * length(regexp_replace(t, '[^0-9]', '', 'g')) >= length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')))"


_READINGS_SQL = f"""WITH a AS (SELECT key, identifier, count(*) AS n FROM (SELECT doc_id AS key, unnest({_identifiers_sql("text")}) AS identifier FROM documents) GROUP BY ALL),
b AS (SELECT key, identifier, count(*) AS n FROM (SELECT doc_id AS key, unnest({_identifiers_sql("replace(text, '7', '1')")}) AS identifier FROM documents) GROUP BY ALL)
SELECT a.key, a.identifier, a.n - coalesce(b.n, 0) AS n, 'uncertain' AS side FROM a LEFT JOIN b USING (key, identifier) WHERE a.n > coalesce(b.n, 0)
UNION ALL SELECT b.key, b.identifier, b.n - coalesce(a.n, 0), 'extra' FROM b LEFT JOIN a USING (key, identifier) WHERE b.n > coalesce(a.n, 0)"""


def entity_extract(spark, sf_dir):
    """Entities of a sentence about each order."""
    return entities.extract(sentences(spark, sf_dir)).select("key", F.col("start").cast("long").alias("start"), "kind", "value")


def entity_counts(spark, sf_dir):
    return entity_extract(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


_ENTITY_CTE = f"""{_SENTENCES_CTE},
e AS (SELECT key, 0::BIGINT AS start, 'number' AS kind, key::VARCHAR AS value FROM s WHERE length(key::VARCHAR) BETWEEN 2 AND 10
UNION ALL SELECT key, (length('order no ' || key || ' was placed on '))::BIGINT, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM s
UNION ALL SELECT key, (length('order no ' || key || ' was placed on ') + 15)::BIGINT, 'amount', printf('%.2f', o_totalprice) || ' EUR' FROM s)"""


def metadata_suggest(spark, sf_dir):
    """Suggestions for each order's document; every fourth has its date set by hand."""
    s = sentences(spark, sf_dir)
    d = s.select("key", F.concat(F.lit("Report on contract "), "key").alias("title"), "text", F.lit(None).cast("string").alias("kind"), F.when(F.col("key") % 4 == 0, F.lit("2000-01-01").cast("date")).alias("document_date"), F.lit(None).cast("string").alias("reference"), F.when(F.col("key") % 4 == 0, F.array(F.lit("document_date"))).otherwise(F.array().cast("array<string>")).alias("by_hand"))
    return entities.suggest(d, entities.extract(s))


def claim_tokens(spark, sf_dir):
    """Claims of each order's sentence."""
    return sentences(spark, sf_dir).select("key", F.array_join(claims(F.col("text")), " ").alias("claims"))


def line_blocks(spark, sf_dir):
    """Blocks of each document's lines."""
    pages = documents(spark, sf_dir).withColumn("page", F.lit(1))
    return chunking.line_blocks(pages).select("key", "idx", "kind", "level", F.sha2("text", 256).alias("text_sha256"))


_LINE_BLOCKS_SQL = r"""WITH raw AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
l AS (SELECT key, n, trim(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM raw),
s AS (SELECT *, length(line) <= 120 AND NOT regexp_matches(line, '[.,;:]$') AS t FROM l),
v AS (SELECT *, CASE WHEN t AND regexp_matches(line, '(?i)^part\s+([0-9]+|[ivxlc]+)\b') THEN 1 WHEN t AND regexp_matches(line, '(?i)^chapter\s+([0-9]+|[ivxlc]+)\b') THEN 2 WHEN regexp_matches(line, '(?i)^article\s+([0-9]+|[ivxlc]+)\b') THEN 3
  WHEN t AND regexp_matches(line, '^[0-9]+(\.[0-9]+)*\.?\s+\p{Lu}') THEN length(regexp_replace(regexp_extract(line, '^([0-9]+(?:\.[0-9]+)*)', 1), '[^.]', '', 'g')) + 2 WHEN t AND regexp_matches(line, '^[A-Z]\.\s+\p{Lu}') THEN 2 END AS level FROM s),
b AS (SELECT *, level IS NOT NULL AND t AND NOT regexp_matches(line, '(?i)^article\s+([0-9]+|[ivxlc]+)\b') AS title, lag(line) OVER w AS before, lag(level IS NOT NULL AND t AND NOT regexp_matches(line, '(?i)^article\s+([0-9]+|[ivxlc]+)\b')) OVER w AS title_before FROM v WINDOW w AS (PARTITION BY key ORDER BY n)),
m AS (SELECT *, regexp_matches(line, '^(?:[-•*]|[0-9]{1,3}\)|[a-z]\))\s') AS listed,
  title_before AND level IS NULL AND len(string_split(before, ' ')) <= 3 AND length(line) <= 60 AND NOT regexp_matches(line, '[.,;:]$') AND len(list_filter(string_split(line, ' '), lambda x: regexp_matches(x, '^\p{Lu}'))) >= 0.6 * len(string_split(line, ' ')) AS named FROM b),
f AS (SELECT *, lag(named) OVER (PARTITION BY key ORDER BY n) AS named_before FROM m),
g AS (SELECT *, before IS NULL OR before = '' OR (NOT (regexp_matches(before, '[0-9]-$') AND regexp_matches(line, '^[0-9]')) AND (title OR (title_before AND NOT named) OR named_before OR level IS NOT NULL OR listed
  OR (regexp_matches(before, '[.:!?]$') AND regexp_matches(line, '^["''(\[“‘•*-]*[\p{Lu}\p{Nd}]')))) AS begins FROM f),
i AS (SELECT *, sum(begins::INT) OVER (PARTITION BY key ORDER BY n) - 1 AS idx FROM g WHERE line <> ''),
j AS (SELECT key, idx::INT AS idx, arg_min(title, n) AS title, arg_min(listed, n) AS listed, first(level ORDER BY n) AS level, string_agg(line, chr(10) ORDER BY n) AS text FROM i GROUP BY key, idx)
SELECT key, idx, CASE WHEN title THEN 'heading' WHEN listed THEN 'list_item' ELSE 'paragraph' END AS kind, level::INT AS level,
  sha256(replace(regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '([0-9]-)\n([0-9])', '\1\2', 'g'), chr(10), ' ')) AS text_sha256 FROM j"""


def chunk_documents(spark, sf_dir):
    """Structure-aware chunks of all documents."""
    return chunking.text_chunks(documents(spark, sf_dir).select("key", clean(F.col("text")).alias("text")))


def chunk_tokens(spark, sf_dir):
    """Estimated tokens of each document and line counts."""
    return documents(spark, sf_dir).select("key", token_estimate(F.col("text")).cast("long").alias("tokens"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


def document_context(spark, sf_dir):
    """Source and first words of each document's first lines."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return chunking.document_context(lines, d.select(F.col("doc_id").alias("key"), F.concat(F.col("source"), F.lit("_file.txt")).alias("title")))


def html_to_text(spark, sf_dir):
    return files.html_to_text(table(spark, sf_dir, "pages").select("page_id", "html"))


def witten_bell_lm(spark, sf_dir):
    """Probabilities of characters after up to two others, over the short documents."""
    lm = kernels.witten_bell(documents(spark, sf_dir))
    return lm.select("context", "char", F.round("p", 9).alias("p"))


_WB_SQL = """WITH c AS (SELECT '^^' || text AS s, length(text) AS n FROM documents WHERE length(text) > 0),
g AS (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, n + 1), lambda i: substr(s, i, 3))) AS g FROM c) GROUP BY g),
a1 AS (SELECT '' AS context, substr(g, 3, 1) AS char, sum(n) AS n FROM g GROUP BY 2),
p1 AS (SELECT context, char, n / sum(n) OVER () AS p FROM a1),
a2 AS (SELECT substr(g, 2, 1) AS context, substr(g, 3, 1) AS char, sum(n) AS n FROM g GROUP BY 1, 2),
t2 AS (SELECT context, sum(n) AS total, count(*) AS types FROM a2 GROUP BY 1),
p2 AS (SELECT context, a2.char, (a2.n + types * p1.p) / (total + types) AS p FROM a2 JOIN t2 USING (context) JOIN p1 ON p1.char = a2.char),
a3 AS (SELECT substr(g, 1, 2) AS context, substr(g, 3, 1) AS char, sum(n) AS n FROM g GROUP BY 1, 2),
t3 AS (SELECT context, sum(n) AS total, count(*) AS types FROM a3 GROUP BY 1),
p3 AS (SELECT a3.context, a3.char, (a3.n + types * p2.p) / (total + types) AS p FROM a3 JOIN t3 USING (context) JOIN p2 ON p2.context = substr(a3.context, 2, 1) AND p2.char = a3.char)
SELECT context, char, round(p, 9) AS p FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


def rover_vote(spark, sf_dir):
    """Three readings of each benchmark item, of which two are damaged at different words."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.split("text", r"\s+").alias("w"))
    damaged = lambda k: F.array_join(F.transform("w", lambda x, i: F.when(i % 5 == k, F.concat(x, F.lit("x"))).otherwise(x)), " ")
    readings = F.array(F.struct(F.lit(0).alias("voice"), F.array_join("w", " ").alias("text")), F.struct(F.lit(1).alias("voice"), damaged(1).alias("text")), F.struct(F.lit(2).alias("voice"), damaged(3).alias("text")))
    return kernels.vote(b.select("key", F.explode(readings).alias("r")).select("key", "r.voice", "r.text"))


def ctc_decode(spark, sf_dir):
    """Greedy decoding of frames made from the benchmark's first words."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.regexp_extract_all(F.lower("text"), F.lit("[abcdefgh]"), F.lit(0)).alias("c"))
    one = lambda i: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.when(j == i, 0.9).otherwise(0.0125))
    frames = F.flatten(F.transform("c", lambda c: F.array(one(F.instr(F.lit("abcdefgh"), c)), one(F.lit(0)))))
    return kernels.decode(b.select("key", frames.alias("frames")), ["", *"abcdefgh"])


QUERIES = {f.__name__: f for f in (content_hash_dups, simhash, near_dup_pairs, running_lines, char_model, char_score, artefact_share, quality_verdict, identifier_two_readings, entity_extract, entity_counts, metadata_suggest, claim_tokens, line_blocks, chunk_documents, chunk_tokens, document_context, html_to_text, witten_bell_lm, rover_vote, ctc_decode)}

SQL = {
    "content_hash_dups": f"SELECT hash, count(*) AS copies, min(key) AS first_key FROM (SELECT doc_id AS key, sha256(array_to_string({_WORDS_SQL}, ' ')) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1",
    "simhash": f"WITH {_SIMHASH_CTE} SELECT key, lpad(printf('%X', h), 16, '0') AS simhash FROM sim",
    "near_dup_pairs": f"WITH {_SIMHASH_CTE}, one AS (SELECT h, min(key) AS key FROM sim GROUP BY h) SELECT a.key AS a, b.key AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM one a JOIN one b ON a.key < b.key WHERE bit_count(xor(a.h, b.h)) <= 3",
    "running_lines": _RUNNING_SQL,
    "line_blocks": _LINE_BLOCKS_SQL,
    "char_model": f"WITH {_MODEL_CTE} SELECT tri, sum(n_tri)::BIGINT AS n_tri FROM tri GROUP BY tri HAVING sum(n_tri) >= 2",
    "char_score": _SCORE_SQL,
    "artefact_share": r"""SELECT key, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}[,;|\\]\p{L}') OR len(list_filter(string_split_regex(x, '[''’-]'), lambda p: length(regexp_replace(p, '[^\p{L}]', '', 'g')) >= 6 AND regexp_matches(p, '\p{Ll}\p{Lu}'))) > 0)) / len(w), 6) ELSE 0.0 END AS artefacts
FROM (SELECT doc_id AS key, list_transform(list_filter(string_split_regex(text, '\s+'), lambda t: regexp_matches(t, '\p{L}')), lambda t: regexp_replace(regexp_replace(t, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')) AS w FROM documents)""",
    "identifier_two_readings": _READINGS_SQL,
    "entity_extract": f"WITH {_ENTITY_CTE} SELECT key, start, kind, value FROM e",
    "entity_counts": f"WITH {_ENTITY_CTE} SELECT kind, count(*) AS n, count(DISTINCT value) AS values FROM e GROUP BY kind",
    "metadata_suggest": f"WITH {_SENTENCES_CTE} SELECT key, 'report' AS kind, CASE WHEN key % 4 = 0 THEN DATE '2000-01-01' ELSE o_orderdate::DATE END AS document_date, CASE WHEN length(key::VARCHAR) BETWEEN 2 AND 10 THEN key::VARCHAR END AS reference FROM s",
    "claim_tokens": f"WITH {_SENTENCES_CTE} SELECT key, array_to_string(list_transform(list_sort(list_transform(list_distinct(c), lambda x: {{'at': list_position(c, x), 'x': x}})), lambda y: y.x), ' ') AS claims FROM (SELECT key, [key::VARCHAR, strftime(o_orderdate, '%d.%m.%Y'), replace(printf('%.2f', o_totalprice), '.', ',')] AS c FROM s)",
    "chunk_tokens": "SELECT doc_id AS key, ceil(length(text) / 3.6)::BIGINT AS tokens, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents",
    "document_context": r"""WITH l AS (SELECT doc_id AS key, string_split(text, chr(10))[1:5] AS l FROM documents)
SELECT d.doc_id AS key, substr(d.source || ' file ' || array_to_string(list_transform(l.l, lambda x: array_to_string(string_split_regex(x, '\s+')[1:30], ' ')), ' '), 1, 2000) AS context FROM documents d JOIN l ON l.key = d.doc_id""",
    "witten_bell_lm": _WB_SQL,
}
