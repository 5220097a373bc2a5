"""Retrieval: BM25 over postings, exact dense scan, rank fusion, reranking and synonyms.

Many questions are answered at once: every frame carries ``query_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH, Language, lexical_terms
from .index import SCORES, Best, search
from .tables import parts

RRF_K = 60


def top(df: DataFrame, k: int, *order, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first k rows of each query in a total order; Spark cuts them before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def postings(docs: DataFrame, language: Language = ENGLISH) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf) and (key, length) of (key, text) rows."""
    terms = docs.select("key", lexical_terms(F.col("text"), language).alias("terms"))
    lengths = terms.select("key", F.size("terms").alias("length"))
    return terms.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")), lengths


def bm25(docs: DataFrame, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75, language: Language = ENGLISH, permitted: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the best k documents of each query.

    Statistics come from the whole corpus; ``permitted`` (keys) filters the candidates before the
    cut.  Ties go by key.
    """
    if permitted is None:
        return search(docs, queries, k, k1, b, language)
    everyone = F.array(F.lit("everyone")).alias("tokens")
    return search(docs, queries.select("query_id", "text", everyone), k, k1, b, language, permitted.select("key", everyone).distinct())


def dense(vectors: DataFrame, queries: DataFrame, k: int = 50, block: int = 1000) -> DataFrame:
    """(query_id, key, score, rank): the k vectors of largest cosine for each (query_id, vector).

    Exact.  Queries go in blocks of a bounded size; each task keeps the best k of its vectors for
    each query, so only these are shuffled.  If vectors and queries have ``tokens``, a vector counts
    for a query only if they share one, which is decided before the cut.
    """
    by_reader = "tokens" in vectors.columns and "tokens" in queries.columns
    total = queries.count()
    out = None
    for number in range(max(1, -(-total // block))):
        part = queries if total <= block else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-total // block))) == number)
        rows = part.where("vector is not null").collect()
        if not rows:
            continue
        ids = np.array([r.query_id for r in rows])
        q = np.array([r.vector for r in rows], dtype=float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        named = sorted({t for r in rows for t in r.tokens or []}) if by_reader else []
        place = {t: n for n, t in enumerate(named)}
        holds = np.zeros((len(rows), len(named)), dtype=np.float32)
        for n, r in enumerate(rows if by_reader else []):
            holds[n, [place[t] for t in r.tokens or []]] = 1

        def best(batches: Iterator[pa.RecordBatch], ids=ids, q=q, named=named, holds=holds) -> Iterator[pa.RecordBatch]:
            kept, step = Best(len(ids), k, -1.5), max(1, SCORES // len(ids))
            for batch in (whole.slice(first, step) for whole in parts(batches) for first in range(0, whole.num_rows, step)):
                keys = batch.column("key").to_numpy()
                v = np.array(batch.column("vector").to_pylist(), dtype=float)
                score = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 6)
                if by_reader:
                    held = batch.column("tokens")
                    token = pc.index_in(held.flatten(), pa.array(named, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
                    who = np.repeat(np.arange(len(keys)), pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False))
                    read = np.zeros((len(keys), len(named)), dtype=np.float32)
                    read[who[token >= 0], token[token >= 0]] = 1
                    score[holds @ read.T == 0] = -2
                question, at = np.nonzero(score >= kept.least[:, None])
                kept.add(question, keys[at], score[question, at])
            question, key, score = kept.cut()
            yield pa.RecordBatch.from_arrays([pa.array(ids[question]), pa.array(key.astype(np.int64)), pa.array(score.astype(float))], ["query_id", "key", "score"])

        found = vectors.where("vector is not null").select("key", "vector", *(["tokens"] if by_reader else [])).mapInArrow(best, "query_id long, key long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, key long, score double")
    return top(out, k, F.desc("score"), "key")


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, rank) lists, with the rank in each list.

    Ties go by first appearance: list after list, rank by rank.
    """
    parts = []
    for number, ranked in enumerate(lists):
        mine = [F.col("rank").alias(f"rank_{n}") if n == number else F.lit(None).cast("int").alias(f"rank_{n}") for n in range(len(lists))]
        weight = (weights or [1.0] * len(lists))[number]
        parts.append(ranked.select("query_id", "key", (weight / (k + F.col("rank"))).alias("part"), F.struct(F.lit(number).alias("list"), F.col("rank").alias("rank")).alias("seen"), *mine))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    fused = union.groupBy("query_id", "key").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"), *[F.max(f"rank_{n}").alias(f"rank_{n}") for n in range(len(lists))])
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen"))).drop("seen")


def rerank(ranked: DataFrame, scores: DataFrame, head: int = 15, limit: int = 10) -> DataFrame:
    """The first ``head`` rows reordered by score (ties keep their order), the others behind, then cut.

    Rows without a score count as the lowest of the head.
    """
    joined = ranked.join(scores.select("query_id", "key", F.col("score").alias("rerank_score")), ["query_id", "key"], "left")
    in_head = F.col("rank") <= head
    order = Window.partitionBy("query_id").orderBy(F.when(in_head, 0).otherwise(1), F.when(in_head, F.col("rerank_score")).desc_nulls_last(), "rank")
    return joined.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= limit)


def by_identifiers(asked: DataFrame, held: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, key, held, rank): documents that hold a question's identifiers, those of most first, then the ranking.

    ``asked``: query_id, kind, value; ``held``: key, kind, value; ``ranked``: query_id, key, rank.
    Ties go by the rank in the list, unranked ones by key behind it.
    """
    hits = asked.distinct().join(held.distinct(), ["kind", "value"]).groupBy("query_id", "key").agg(F.count("*").alias("held"))
    both = hits.join(ranked.select("query_id", "key", F.col("rank").alias("_rank")), ["query_id", "key"], "full").withColumn("held", F.coalesce("held", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("held"), F.col("_rank").asc_nulls_last(), "key")
    return both.select("query_id", "key", "held", F.row_number().over(order).alias("rank"))


def identifier_tie_break(reranked: DataFrame, holds: DataFrame, margin: float = 0.5) -> DataFrame:
    """(query_id, key, final_rank): hits within ``margin`` of the best score that hold an identifier of the question go first.

    ``reranked``: query_id, key, rank, score; ``holds``: query_id, key (identifiers that are years
    are left out by the caller's entities).
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = reranked.join(holds.select("query_id", "key").distinct().withColumn("_holds", F.lit(1)), ["query_id", "key"], "left").withColumn("_best", best)
    near = (F.col("score") >= F.col("_best") - margin) & F.col("_holds").isNotNull()
    return rows.select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(near, 0).otherwise(1), "rank")).alias("final_rank"))


def rank_details(fused: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with their heading path and the uncertain identifiers of their pages, distinct and in order.

    ``chunks``: key, document, page_start, page_end, heading_path; ``pages``: document, page,
    uncertain (array).
    """
    own = fused.join(chunks, "key")
    each = own.select("query_id", "key", "document", F.explode(F.sequence("page_start", "page_end")).alias("page")).join(pages, ["document", "page"])
    uncertain = each.select("query_id", "key", F.explode("uncertain").alias("u")).groupBy("query_id", "key").agg(F.array_sort(F.collect_set("u")).alias("uncertain"))
    return own.join(uncertain, ["query_id", "key"], "left").withColumn("uncertain", F.coalesce("uncertain", F.array().cast("array<string>")))


def expand_synonyms(queries: DataFrame, groups: list[list[str]], language: Language = ENGLISH) -> DataFrame:
    """Questions with the other phrases of each group of which they name a phrase.

    Phrases match as contiguous cut terms; additions stand on a new line, joined by "; ".
    """
    terms = lexical_terms(F.col("text"), language)
    line = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    additions = []
    for group in groups:
        named = [F.instr(F.col("_line"), F.concat(F.lit(" "), F.array_join(lexical_terms(F.lit(p), language), " "), F.lit(" "))) > 0 for p in group]
        hit = named[0]
        for n in named[1:]:
            hit = hit | n
        additions += [F.when(hit & ~n, p) for p, n in zip(group, named, strict=True)]
    new = F.filter(F.array(*additions), lambda x: x.isNotNull())
    out = queries.withColumn("_line", line).withColumn("_new", new)
    return out.withColumn("expanded", F.when(F.size("_new") > 0, F.concat("text", F.lit("\n"), F.array_join("_new", "; "))).otherwise(F.col("text"))).drop("_line", "_new")
