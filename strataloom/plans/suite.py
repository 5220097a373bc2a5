"""Evaluation queries: metrics of retrieval, answers and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lexical_terms
from ..operators import answers, evaluation, passages
from .base import documents, questions, table
from .search import BM25_CTE, DENSE_CTE, bm25_search, hybrid_search, rrf_sql


def _evidence(spark, sf_dir):
    """Documents that hold a question's whole text: any of them covers its one piece."""
    found = passages.located(questions(spark, sf_dir).withColumnRenamed("query_id", "passage"), documents(spark, sf_dir))
    return found.select(F.col("passage").alias("query_id"), F.lit(0).alias("piece"), F.col("key").alias("document"), F.lit(1).alias("page"))


def _golden(spark, sf_dir):
    hits = bm25_search(spark, sf_dir).select("query_id", "rank", F.col("key").alias("document"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return evaluation.golden_rank(hits, _evidence(spark, sf_dir))


def golden_rank(spark, sf_dir):
    """First rank at which BM25 finds a document that holds the question."""
    return _golden(spark, sf_dir)


def retrieval_metrics(spark, sf_dir):
    g = _golden(spark, sf_dir).withColumn("type", F.concat(F.lit("t"), F.col("query_id") % 3))
    return evaluation.retrieval_metrics(g)


_GOLDEN_CTE = f"{BM25_CTE}, golden AS (SELECT q.item_id AS query_id, min(b.rank) FILTER (WHERE b.rank <= 10) AS golden FROM benchmark q JOIN documents d ON contains(d.text, q.text) LEFT JOIN bm25 b ON b.query_id = q.item_id AND b.key = d.doc_id GROUP BY q.item_id)"


def quotes_on_pages(spark, sf_dir):
    """How many documents hold each question's text, how often it stands in them, and where first in the first of them."""
    found = passages.located(questions(spark, sf_dir).withColumnRenamed("query_id", "passage"), documents(spark, sf_dir))
    return found.groupBy("passage").agg(F.count("*").alias("documents"), F.sum("times").alias("times"), F.min(F.struct("key", "first")).alias("f")).select("passage", "documents", "times", F.col("f.key").alias("key"), F.col("f.first").alias("first"))


def golden_set_check(spark, sf_dir):
    """What is wrong with the questions, once every seventh says it stands in the document before the one that holds it, and ten ids repeat."""
    q = questions(spark, sf_dir)
    held = passages.located(q.withColumnRenamed("query_id", "passage"), documents(spark, sf_dir)).groupBy("passage").agg(F.min("key").alias("key"))
    own = q.join(held, F.col("query_id") == F.col("passage"), "left")
    kind = F.when(F.col("query_id") % 20 == 0, "riddle").otherwise("single")
    golden = own.select(
        F.when(F.col("query_id") < 20, F.col("query_id") % 10).otherwise(F.col("query_id")).alias("id"), kind.alias("type"), F.col("text").alias("quote"),
        F.when(F.col("query_id") % 7 == 0, F.col("key") - 1).otherwise(F.col("key")).alias("page"),
    )
    return evaluation.set_problems(golden, ("single", "several"), documents(spark, sf_dir).withColumnRenamed("key", "page"))


def page_number_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of document sizes by language."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("n"))
    return evaluation.nearest_rank(d, "lang", "n", (0.5, 0.9, 0.99))


def worst_decile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("n"))
    return evaluation.worst_decile_mean(d, "lang", "n")


def calibration_sweep(spark, sf_dir):
    """Share of good and bad documents under thresholds of their share of small letters."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length(F.regexp_replace("text", r"[^\p{Ll}]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("score"))
    return evaluation.threshold_sweep(lab.join(d, "doc_id"), [0.2, 0.5, 0.7, 0.75, 0.8])


def ocr_measures(spark, sf_dir):
    """Words of each document against a reading in which every long word with 'th' lost its first letter."""
    d = documents(spark, sf_dir).select("key", F.col("text").alias("truth"), F.regexp_replace("text", r"(?:^|(?<=\s))t(h[a-z]{4,})", "$1").alias("output"))
    return evaluation.word_measures(d)


def character_errors(spark, sf_dir):
    """Character error of the benchmark items read without spaces."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.round(evaluation.character_error(F.col("text"), F.replace(F.col("text"), F.lit(" "), F.lit(""))), 6).alias("cer"))


def loops(spark, sf_dir):
    """Documents in which some run of four words stands three times or more."""
    return documents(spark, sf_dir).where(evaluation.has_loop(F.col("text"))).select("key")


def metric_gates(spark, sf_dir):
    """Metrics of this run against a fixed baseline."""
    m = retrieval_metrics(spark, sf_dir).where("type is null").select(F.expr("stack(2, 'hit_10', hit_10, 'mrr', mrr) as (metric, value)"))
    base = spark.createDataFrame([("hit_10", 0.958), ("mrr", 0.839)], "metric string, value double")
    return evaluation.gates(m, base)


def _answers(spark, sf_dir):
    """Answers about orders citing [1]; every third one states another price, every fifth cites the wrong source."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_custkey").cast("string")
    stated = F.when(F.col("o_orderkey") % 3 == 0, F.concat(price, F.lit("99"))).otherwise(price)
    cited = F.when(F.col("o_orderkey") % 5 == 0, "[2]").otherwise("[1]")
    a = o.select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("It was made in time. Customer "), stated, F.lit(" placed it "), cited, F.lit(".")).alias("text"))
    s = o.select(F.col("o_orderkey").alias("answer_id"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.concat(F.lit("customer "), price, F.lit(" of the shop")).alias("text")), F.struct(F.lit(2).alias("n"), F.lit("nothing of note").alias("text")))).alias("s")).select("answer_id", "s.n", "s.text")
    return a, s


_ANSWERS_CTE = "o AS (SELECT o_orderkey AS answer_id, o_custkey AS c FROM orders)"


def claim_check(spark, sf_dir):
    return answers.check(*_answers(spark, sf_dir))


def strip_unsupported(spark, sf_dir):
    a, s = _answers(spark, sf_dir)
    return answers.strip_unsupported(a, answers.check(a, s))


def refusal_gate(spark, sf_dir):
    """Questions whose best hit scores under 60 are refused."""
    scores = bm25_search(spark, sf_dir).select("query_id", "score")
    none = spark.createDataFrame([], "query_id long")
    return answers.refusal(scores, none, 60.0)


def assemble_context(spark, sf_dir):
    """Context of each question from its hybrid hits."""
    hits = hybrid_search(spark, sf_dir).select("query_id", "rank", "key")
    d = documents(spark, sf_dir).select("key", F.array_distinct(lexical_terms(F.col("text"))).alias("terms"), F.ceil(F.length("text") / 2.0).cast("int").alias("tokens"))
    return answers.assemble(hits.join(d, "key").withColumn("document", F.col("key")))


def small_talk(spark, sf_dir):
    """Kinds of turns that need no search."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(answers.talk_kind(F.col("text")).alias("kind"), "role").agg(F.count("*").alias("turns"))


def ranking_agreement(spark, sf_dir):
    """How many of the ten best hits of BM25 alone the hybrid list keeps."""
    b = bm25_search(spark, sf_dir).where("rank <= 10").select("query_id", "key")
    h = hybrid_search(spark, sf_dir).select("query_id", "key")
    return b.join(h.withColumn("kept", F.lit(1)), ["query_id", "key"], "left").groupBy("query_id").agg(F.sum(F.coalesce("kept", F.lit(0))).cast("long").alias("kept"))


QUERIES = {f.__name__: f for f in (quotes_on_pages, golden_set_check, golden_rank, retrieval_metrics, page_number_percentiles, worst_decile, calibration_sweep, ocr_measures, character_errors, loops, metric_gates, claim_check, strip_unsupported, refusal_gate, assemble_context, small_talk, ranking_agreement)}

_METRICS = "count(*) AS questions, round(avg((coalesce(golden, 1000000) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(golden, 1000000) <= 5)::INT), 6) AS hit_5, round(avg((coalesce(golden, 1000000) <= 10)::INT), 6) AS hit_10, round(avg(coalesce(1 / golden, 0)), 6) AS mrr"
_HELD = "held AS (SELECT item_id, b.text, d.doc_id AS key, d.text AS body FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)"
SQL = {
    "quotes_on_pages": f"WITH {_HELD} SELECT item_id AS passage, count(*) AS documents, sum(len(string_split(body, text)) - 1)::BIGINT AS times, min(key) AS key, arg_min(instr(body, text) - 1, key)::INT AS first FROM held GROUP BY item_id",
    "golden_set_check": rf"""WITH {_HELD}, golden AS (SELECT b.item_id, CASE WHEN b.item_id < 20 THEN b.item_id % 10 ELSE b.item_id END AS id, CASE WHEN b.item_id % 20 = 0 THEN 'riddle' ELSE 'single' END AS type, b.text AS quote,
  CASE WHEN b.item_id % 7 = 0 THEN h.key - 1 ELSE h.key END AS page, len(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')) AS n FROM benchmark b LEFT JOIN (SELECT item_id, min(key) AS key FROM held GROUP BY item_id) h USING (item_id))
SELECT id, 'repeated_id' AS problem FROM golden GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'quote_length' FROM golden WHERE n < 5 OR n > 40 UNION ALL SELECT id, 'unknown_type' FROM golden WHERE type NOT IN ('single', 'several')
UNION ALL SELECT id, 'quote_not_on_page' FROM golden g WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = g.page AND contains(d.text, g.quote))""",
    "golden_rank": f"WITH {_GOLDEN_CTE} SELECT query_id, golden FROM golden",
    "retrieval_metrics": f"WITH {_GOLDEN_CTE} SELECT 't' || (query_id % 3) AS type, {_METRICS} FROM golden GROUP BY ROLLUP (1)",
    "page_number_percentiles": "WITH r AS (SELECT lang, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM documents) SELECT lang, share::DOUBLE AS share, n AS value FROM r, (SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS share) WHERE pos = least(floor(share * total), total - 1)",
    "worst_decile": "WITH r AS (SELECT lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS pos, count(*) OVER (PARTITION BY lang) AS total FROM documents) SELECT lang, round(avg(n), 6) AS worst_decile FROM r WHERE pos <= greatest(1, total // 10) GROUP BY lang",
    "calibration_sweep": r"WITH s AS (SELECT quality AS label, length(regexp_replace(text, '[^\p{Ll}]', '', 'g')) / greatest(length(text), 1) AS score FROM labels JOIN documents USING (doc_id)) SELECT threshold, round(avg((score < threshold)::INT) FILTER (WHERE label = 0), 6) AS refused_bad, round(avg((score < threshold)::INT) FILTER (WHERE label = 1), 6) AS refused_good FROM s, (SELECT unnest([0.2, 0.5, 0.7, 0.75, 0.8]::DOUBLE[]) AS threshold) GROUP BY threshold",
    "ocr_measures": r"""WITH d AS (SELECT doc_id AS key, text AS truth, regexp_replace(text, '(^|\s)t(h[a-z]{4,})', '\1\2', 'g') AS output FROM documents),
t AS (SELECT key, w, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(lower(truth), '[\p{L}\p{N}_]+')) AS w FROM d) GROUP BY ALL),
o AS (SELECT key, w, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(lower(output), '[\p{L}\p{N}_]+')) AS w FROM d) GROUP BY ALL),
b AS (SELECT coalesce(t.key, o.key) AS key, sum(coalesce(t.n, 0)) AS t, sum(coalesce(o.n, 0)) AS o, sum(least(coalesce(t.n, 0), coalesce(o.n, 0))) AS s FROM t FULL JOIN o ON t.key = o.key AND t.w = o.w GROUP BY 1)
SELECT d.key, coalesce(t, 0)::BIGINT AS truth_words, coalesce(s, 0)::BIGINT AS shared, round(s / nullif(o, 0), 6) AS precision, round(s / nullif(t, 0), 6) AS recall, round(2 * s / nullif(t + o, 0), 6) AS f1, greatest(coalesce(t, 0) - coalesce(s, 0), coalesce(o, 0) - coalesce(s, 0))::BIGINT AS word_error FROM d LEFT JOIN b USING (key)""",
    "character_errors": "SELECT item_id, round(least(1.0, levenshtein(text, replace(text, ' ', '')) / length(text)), 6) AS cer FROM benchmark",
    "loops": r"WITH w AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), g AS (SELECT key, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) >= 6) SELECT DISTINCT key FROM (SELECT key, g FROM g GROUP BY key, g HAVING count(*) >= 3)",
    "metric_gates": f"WITH {_GOLDEN_CTE}, m AS (SELECT {_METRICS} FROM golden) SELECT metric, was::DOUBLE AS was, value::DOUBLE AS value, coalesce(value >= was - 0.01, false) AS ok FROM (SELECT 'hit_10' AS metric, 0.958::DOUBLE AS was, (SELECT hit_10 FROM m) AS value UNION ALL SELECT 'mrr', 0.839, (SELECT mrr FROM m))",
    "claim_check": f"WITH {_ANSWERS_CTE} SELECT answer_id, c::VARCHAR || CASE WHEN answer_id % 3 = 0 THEN '99' ELSE '' END AS claim, CASE WHEN answer_id % 3 = 0 THEN 'unsupported' WHEN answer_id % 5 = 0 THEN 'uncited' ELSE 'supported' END AS status, CASE WHEN answer_id % 3 <> 0 AND answer_id % 5 = 0 THEN 1 END AS lacking FROM o",
    "strip_unsupported": f"WITH {_ANSWERS_CTE} SELECT answer_id, 'It was made in time.' || CASE WHEN answer_id % 3 = 0 THEN '' ELSE ' Customer ' || c || ' placed it ' || CASE WHEN answer_id % 5 = 0 THEN '[2]' ELSE '[1]' END || '.' END AS text FROM o",
    "small_talk": r"""WITH t AS (SELECT role, trim(regexp_replace(lower(text), '[^\p{L}\p{N} ]+', '', 'g')) AS p FROM conversations)
SELECT CASE WHEN len(string_split_regex(p, ' +')) > 8 THEN NULL """ + " ".join(f"WHEN regexp_matches(p, '^{pattern}$') THEN '{kind}'" for kind, pattern in answers.SMALL_TALK.items()) + """ END AS kind, role, count(*) AS turns FROM t GROUP BY 1, 2""",
    "ranking_agreement": f"""WITH {BM25_CTE}, {DENSE_CTE}, {rrf_sql((1.0, 1.0))}
SELECT b.query_id, count(f.key) AS kept FROM bm25 b LEFT JOIN (SELECT query_id, key FROM fused WHERE rank <= 10) f ON f.query_id = b.query_id AND f.key = b.key WHERE b.rank <= 10 GROUP BY b.query_id""",
    "refusal_gate": f"WITH {BM25_CTE} SELECT query_id, max(score) AS best, max(score) < 60.0 AS refused FROM bm25 GROUP BY query_id",
}
