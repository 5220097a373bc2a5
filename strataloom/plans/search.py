"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lexical_terms, words
from ..operators import index, retrieval
from ..operators import relational as rel
from ..operators.tables import scratch, written
from .base import documents, questions, table, tree, vectors
from .permissions import _GRANTS_CTE, _grants

SYNONYMS = [["that than", "than that"], ["the thenand", "with anonre", "erand"], ["and er", "er and"]]


def terms_sql(text: str) -> str:
    return rf"""list_concat(
  list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN regexp_matches(w, '\p{{Nd}}') THEN w ELSE substr(w, 1, 5) END),
  list_filter(list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_./-]*\p{{Nd}}[\p{{L}}\p{{N}}_./-]*'), lambda x: regexp_replace(regexp_replace(x, '^[./-]+', ''), '[./-]+$', '')),
    lambda x: length(x) >= 4 AND regexp_matches(x, '\P{{Nd}}') AND regexp_matches(x, '[./-]')))"""


BM25_CTE = f"""
terms AS (SELECT doc_id AS key, {terms_sql("text")} AS terms FROM documents),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM terms),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({terms_sql("text")}) AS term FROM benchmark),
tf AS (SELECT key, len(terms) AS length, term, count(*) AS tf FROM (SELECT key, terms, unnest(terms) AS term FROM terms) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighted AS (SELECT tf.key, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS w FROM tf JOIN df USING (term), stats),
bm25_scores AS (SELECT query_id, key, round(sum(w), 6) AS score FROM asked JOIN weighted USING (term) GROUP BY query_id, key),
bm25 AS (SELECT * FROM (SELECT query_id, key, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM bm25_scores) WHERE rank <= 50)"""

DENSE_CTE = """
dense AS (SELECT * FROM (
  SELECT query_id, key, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM (
    SELECT q.item_id AS query_id, e.vec_id AS key, round(list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id, embeddings e)) WHERE rank <= 50)"""


def rrf_sql(weights: tuple[float, float]) -> str:
    return f"""
fused AS (
  SELECT query_id, key, score, lexical_rank, dense_rank, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, first))::INT AS rank FROM (
    SELECT query_id, key, round(sum(part), 9) AS score, max(lexical_rank) AS lexical_rank, max(dense_rank) AS dense_rank, min(list) AS list, arg_min(r, list) AS first FROM (
      SELECT query_id, key, {weights[0]} / (60 + rank) AS part, rank AS lexical_rank, NULL::INT AS dense_rank, 0 AS list, rank AS r FROM bm25
      UNION ALL SELECT query_id, key, {weights[1]} / (60 + rank), NULL, rank, 1, rank FROM dense) GROUP BY query_id, key))"""


def lexical_terms_query(spark, sf_dir):
    d = documents(spark, sf_dir).select("key", lexical_terms(F.col("text")).alias("t"))
    return d.select("key", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


def bm25_search(spark, sf_dir):
    return retrieval.bm25(documents(spark, sf_dir), questions(spark, sf_dir))


def _asked_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return questions(spark, sf_dir).select("query_id").join(v.withColumnRenamed("key", "query_id"), "query_id")


def dense_search(spark, sf_dir):
    return retrieval.dense(vectors(spark, sf_dir), _asked_vectors(spark, sf_dir))


def _fused(spark, sf_dir, weights=None):
    lists = [bm25_search(spark, sf_dir), dense_search(spark, sf_dir)]
    return retrieval.fuse(lists, weights).withColumnRenamed("rank_0", "lexical_rank").withColumnRenamed("rank_1", "dense_rank")


def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "key", "score", "rank")


def weighted_rrf(spark, sf_dir):
    return _fused(spark, sf_dir, [1.0, 0.5]).select("query_id", "key", "score", "rank")


def hybrid_search(spark, sf_dir):
    """The flagship: BM25 and dense lists fused, the best ten with their rank in either list."""
    return _fused(spark, sf_dir).where("rank <= 10").select("query_id", "rank", "key", "score", "lexical_rank", "dense_rank")


def permitted_search(spark, sf_dir):
    """The flagship for an asker who may not read German documents: either list is filtered before it is cut, statistics stay global."""
    permitted = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("key"))
    lists = [retrieval.bm25(documents(spark, sf_dir), questions(spark, sf_dir), permitted=permitted), retrieval.dense(vectors(spark, sf_dir).join(permitted, "key", "left_semi"), _asked_vectors(spark, sf_dir))]
    fused = retrieval.fuse(lists).where("rank <= 10")
    return fused.select("query_id", "rank", "key", "score", F.col("rank_0").alias("lexical_rank"), F.col("rank_1").alias("dense_rank"))


def _by_user(spark, sf_dir):
    """Questions with the tokens of their askers, and documents with those of their readers.

    Document d lies in the folder of nation d % 25 (and every seventh is granted to the group 2, too);
    question i is asked by user i % 50.
    """
    users, members, grants = _grants(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.concat(F.lit("n"), F.col("doc_id") % 25).alias("collection"), F.lit(False).alias("deleted"))
    single = d.where("document % 7 = 0").select(F.col("document").alias("target"), F.lit("group").alias("kind"), F.lit("2").alias("principal"), F.lit("read").alias("permission"))
    t = tree(spark, sf_dir).where("parent is not null").select("parent", "id")
    readers = rel.place_tokens(grants, t, d, document_grants=single).withColumnRenamed("document", "key")
    q = questions(spark, sf_dir).withColumn("user_id", F.col("query_id") % 50)
    askers = users.join(q.select("user_id").distinct(), "user_id", "left_semi")
    q = q.join(rel.place_readers(grants, askers, members), "user_id", "left")
    return q.select("query_id", "text", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")), readers


def permitted_search_by_user(spark, sf_dir):
    """Hybrid search where every question has an asker of its own, and sees only what that user may read."""
    q, readers = _by_user(spark, sf_dir)
    readers = written(readers, "readers")
    lexical = index.search(documents(spark, sf_dir), q, readers=readers)
    asked = _asked_vectors(spark, sf_dir).join(q.select("query_id", "tokens"), "query_id")
    fused = retrieval.fuse([lexical, retrieval.dense(vectors(spark, sf_dir).join(readers, "key"), asked)]).where("rank <= 10")
    return fused.select("query_id", "rank", "key", "score", F.col("rank_0").alias("lexical_rank"), F.col("rank_1").alias("dense_rank"))


def index_search(spark, sf_dir):
    """The best ten of an index that documents were added to, replaced in and deleted from: even ids first, then all, then without every ninth."""
    own = index.SearchIndex(spark, scratch(spark, "index"))
    d = documents(spark, sf_dir)
    own.put(d.where("key % 2 = 0").withColumn("text", F.lower("text")))
    own.put(d)
    own.delete(d.where("key % 9 = 0").select("key"))
    return own.search(questions(spark, sf_dir), k=10)


def _shared_terms(spark, sf_dir, candidates):
    """Stand-in reranker: distinct terms that question and document share."""
    d = documents(spark, sf_dir).select("key", F.array_distinct(lexical_terms(F.col("text"))).alias("d"))
    q = questions(spark, sf_dir).select("query_id", F.array_distinct(lexical_terms(F.col("text"))).alias("q"))
    both = candidates.select("query_id", "key").join(d, "key").join(q, "query_id")
    return both.select("query_id", "key", F.size(F.array_intersect("d", "q")).cast("double").alias("score"))


def rerank_head(spark, sf_dir):
    fused = _fused(spark, sf_dir).where("rank <= 50")
    scores = _shared_terms(spark, sf_dir, fused.where("rank <= 15"))
    return retrieval.rerank(fused, scores).select("query_id", "key", "rank", "rerank_score", "final_rank")


def synonym_expand(spark, sf_dir):
    return retrieval.expand_synonyms(questions(spark, sf_dir), SYNONYMS).select("query_id", "expanded")


def _synonym_sql() -> str:
    line = f"' ' || array_to_string({terms_sql('text')}, ' ') || ' '"
    phrase = lambda p: " " + " ".join(w[:5] for w in p.split()) + " "
    cases = []
    for group in SYNONYMS:
        any_named = " OR ".join(f"instr(line, '{phrase(p)}') > 0" for p in group)
        cases += [f"CASE WHEN ({any_named}) AND instr(line, '{phrase(p)}') = 0 THEN '{p}' END" for p in group]
    return f"""
SELECT query_id, CASE WHEN len(new) > 0 THEN text || chr(10) || array_to_string(new, '; ') ELSE text END AS expanded FROM (
  SELECT query_id, text, list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL) AS new FROM (SELECT item_id AS query_id, text, {line} AS line FROM benchmark))"""


def exact_identifiers(spark, sf_dir):
    """Documents that hold identifiers (long numbers, addresses) that another document holds too."""
    d = documents(spark, sf_dir).select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]{12,}"), F.lit(0)))).alias("identifier"))
    return d.groupBy("identifier").agg(F.count("*").alias("documents"), F.min("key").alias("first_key")).where("documents > 1")


def context_overlap(spark, sf_dir):
    """Hits of a question whose words repeat a better-ranked hit's."""
    hits = bm25_search(spark, sf_dir).where("rank <= 5").join(documents(spark, sf_dir), "key").select("query_id", "rank", F.array_distinct(words(F.col("text"))).alias("w"))
    a = hits.select("query_id", F.col("rank").alias("rank_a"), F.col("w").alias("wa"))
    b = hits.select("query_id", F.col("rank").alias("rank_b"), F.col("w").alias("wb"))
    share = F.size(F.array_intersect("wa", "wb")) / F.least(F.size("wa"), F.size("wb"))
    return a.join(b, "query_id").where("rank_a < rank_b").select("query_id", "rank_a", "rank_b", F.round(share, 6).alias("overlap"))


def range_join_pages(spark, sf_dir):
    """Chunks of ten lines and the pages of four lines that they touch."""
    from ..operators.relational import range_join

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.size(F.split("text", "\n")).alias("lines"))
    chunks = d.select("key", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.col("lines") - 1) / 10).cast("int"))).alias("chunk"))
    chunks = chunks.select("key", "chunk", F.floor(F.col("chunk") * 10 / 4).cast("int").alias("page_start"), F.floor((F.least(F.col("chunk") * 10 + 10, "lines") - 1) / 4).cast("int").alias("page_end"))
    pages = d.select("key", F.explode(F.sequence(F.lit(0), F.floor((F.col("lines") - 1) / 4).cast("int"))).alias("page"))
    return range_join(pages, chunks, "key", "page", "page_start", "page_end").groupBy("key", "chunk").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"))


QUERIES = {"lexical_terms": lexical_terms_query} | {f.__name__: f for f in (bm25_search, dense_search, rrf_fusion, weighted_rrf, hybrid_search, permitted_search, permitted_search_by_user, index_search, rerank_head, synonym_expand, exact_identifiers, context_overlap, range_join_pages)}

SQL = {
    "lexical_terms": f"SELECT key, len(t)::BIGINT AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id AS key, {terms_sql('text')} AS t FROM documents)",
    "bm25_search": f"WITH {BM25_CTE} SELECT query_id, key, score, rank FROM bm25",
    "dense_search": f"WITH {DENSE_CTE} SELECT query_id, key, score, rank FROM dense",
    "rrf_fusion": f"WITH {BM25_CTE}, {DENSE_CTE}, {rrf_sql((1.0, 1.0))} SELECT query_id, key, score, rank FROM fused",
    "weighted_rrf": f"WITH {BM25_CTE}, {DENSE_CTE}, {rrf_sql((1.0, 0.5))} SELECT query_id, key, score, rank FROM fused",
    "hybrid_search": f"WITH {BM25_CTE}, {DENSE_CTE}, {rrf_sql((1.0, 1.0))} SELECT query_id, rank, key, score, lexical_rank, dense_rank FROM fused WHERE rank <= 10",
    "permitted_search": "WITH " + (BM25_CTE.replace("FROM asked JOIN weighted USING (term)", "FROM asked JOIN weighted USING (term) WHERE key IN (SELECT doc_id FROM documents WHERE lang <> 'de')") + ", " + DENSE_CTE.replace("v.vec_id = q.item_id, embeddings e", "v.vec_id = q.item_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')")) + f", {rrf_sql((1.0, 1.0))} SELECT query_id, rank, key, score, lexical_rank, dense_rank FROM fused WHERE rank <= 10",
    "permitted_search_by_user": f"""WITH {_GRANTS_CTE},
readers AS (SELECT DISTINCT c.user_id, d.doc_id AS key FROM documents d JOIN collections c ON c.id = 'n' || (d.doc_id % 25)
  UNION SELECT u.user_id, d.doc_id FROM documents d, users u JOIN members m USING (user_id) WHERE d.doc_id % 7 = 0 AND m.group_id = 2 AND u.status = 'active'),
may AS (SELECT item_id AS query_id, key FROM benchmark JOIN readers ON user_id = item_id % 50), """ + (BM25_CTE.replace("FROM asked JOIN weighted USING (term)", "FROM asked JOIN weighted USING (term) SEMI JOIN may USING (query_id, key)") + ", " + DENSE_CTE.replace("v.vec_id = q.item_id, embeddings e", "v.vec_id = q.item_id, embeddings e SEMI JOIN may ON may.query_id = q.item_id AND may.key = e.vec_id")) + f", {rrf_sql((1.0, 1.0))} SELECT query_id, rank, key, score, lexical_rank, dense_rank FROM fused WHERE rank <= 10",
    "index_search": f"WITH {BM25_CTE.replace('FROM documents)', 'FROM documents WHERE doc_id % 9 <> 0)')} SELECT query_id, key, score, rank FROM bm25 WHERE rank <= 10",
    "rerank_head": f"""WITH {BM25_CTE}, {DENSE_CTE}, {rrf_sql((1.0, 1.0))},
scored AS (SELECT f.query_id, f.key, f.rank, CASE WHEN f.rank <= 15 THEN len(list_intersect(list_distinct(t.terms), list_distinct({terms_sql("b.text")})))::DOUBLE END AS rerank_score
  FROM fused f JOIN terms t USING (key) JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 50)
SELECT * FROM (SELECT query_id, key, rank, rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rank > 15, rerank_score DESC NULLS LAST, rank))::INT AS final_rank FROM scored) WHERE final_rank <= 10""",
    "synonym_expand": _synonym_sql(),
    "exact_identifiers": "SELECT identifier, count(*) AS documents, min(key) AS first_key FROM (SELECT DISTINCT doc_id AS key, unnest(regexp_extract_all(text, '[0-9]{12,}')) AS identifier FROM documents) GROUP BY identifier HAVING count(*) > 1",
    "context_overlap": rf"""WITH {BM25_CTE}, hits AS (SELECT query_id, rank, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM bm25 JOIN documents ON doc_id = key WHERE rank <= 5)
SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.rank < b.rank""",
    "range_join_pages": """WITH d AS (SELECT doc_id AS key, len(string_split(text, chr(10))) AS lines FROM documents),
chunks AS (SELECT key, chunk, chunk * 10 // 4 AS page_start, (least(chunk * 10 + 10, lines) - 1) // 4 AS page_end FROM (SELECT key, lines, unnest(range((lines - 1) // 10 + 1)) AS chunk FROM d)),
pages AS (SELECT key, unnest(range((lines - 1) // 4 + 1)) AS page FROM d)
SELECT p.key, c.chunk::INT AS chunk, count(*) AS pages, max(p.page)::INT AS last_page FROM pages p JOIN chunks c ON p.key = c.key AND p.page BETWEEN c.page_start AND c.page_end GROUP BY p.key, c.chunk""",
}
