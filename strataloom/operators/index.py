"""BM25 over documents dealt to tasks, for many questions at once, and an inverted index that is kept.

Documents are scored where they lie: each task holds a block of questions, adds up the weights of
the terms that its documents share with them, and keeps its best k documents a question.  Only these
are shuffled, never pairs of questions and documents.  Who may read what is decided in the same
step: a document carries the principals that may read it, a question those of its asker.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH, Language, lexical_terms
from .tables import parts, written

#: Questions of one pass over the postings, and scores, or weights that make them, that a task holds at a time.
QUESTIONS, SCORES = 2000, 1 << 20


@dataclass
class Block:
    """Questions of one pass: their terms and tokens, each numbered, and which questions have them (CSR)."""

    ids: np.ndarray
    terms: list[str]
    term_start: np.ndarray
    term_question: np.ndarray
    tokens: list[str] | None
    token_start: np.ndarray
    token_question: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Block:
        def numbered(lists: list) -> tuple[list[str], np.ndarray, np.ndarray]:
            names = sorted({x for own in lists for x in own})
            place = {x: k for k, x in enumerate(names)}
            pairs = np.array([(place[x], q) for q, own in enumerate(lists) for x in set(own)], np.int64).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            return names, np.searchsorted(pairs[:, 0], np.arange(len(names) + 1)), pairs[:, 1]

        named = numbered([r.terms or [] for r in rows])
        tokens = numbered([r.tokens or [] for r in rows]) if rows and "tokens" in rows[0] else (None, np.zeros(1, np.int64), np.zeros(0, np.int64))
        return cls(np.array([r.query_id for r in rows]), *named, *tokens)


def _expanded(start: np.ndarray, entries: np.ndarray, owner: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, item) one (position in owner, entry) for every entry of the item."""
    counts = start[item + 1] - start[item]
    row = np.repeat(np.arange(len(item)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, entries[start[item][row] + place]


class Best:
    """The best k (score, key) of each question so far."""

    def __init__(self, questions: int, k: int, least: float = 0.0):
        self.k, self.least = k, np.full(questions, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, question: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[question]
        self.parts.append((question[good], key[good], score[good]))
        self.held += int(good.sum())
        if self.held > 4 * self.k * len(self.least) + 1000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, key, score = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((key, -score, question))
        question, key, score = question[order], key[order], score[order]
        first = np.searchsorted(question, np.arange(len(self.least)))
        place = np.arange(len(question)) - first[question]
        keep = place < self.k
        last = place == self.k - 1
        self.least[question[last]] = score[last]
        self.parts, self.held = [(question[keep], key[keep], score[keep])], int(keep.sum())
        return self.parts[0]


def _cuts(work: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of at most so many rows whose work adds up to ``most``, or of one row."""
    upto, first = np.cumsum(work), 0
    while first < len(work):
        last = int(np.searchsorted(upto, upto[first] - work[first] + most, "right"))
        last = max(first + 1, min(last, first + rows))
        yield first, last - first
        first = last


def _scored(block, idf: np.ndarray, mean: float, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        best, n = Best(len(q.ids), k), len(q.ids)
        step = max(1, SCORES // max(n, 1))
        for whole in parts(batches):
            lists = whole.column("terms")
            # a common term stands for a weight in each question that has it
            offsets, terms = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            weights = np.append(0, np.cumsum(q.term_start[terms + 1] - q.term_start[terms]))[offsets - offsets[0]]
            if q.tokens is not None:
                held = whole.column("tokens").offsets.to_numpy()
                weights = weights + n * (held - held[0])
            for first, rows in _cuts(np.diff(weights), SCORES, step):
                batch = whole.slice(first, rows)
                keys, length = batch.column("key").to_numpy(), batch.column("length").to_numpy().astype(float)
                lists = batch.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(keys)), sizes)
                term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(float)
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[owner] / mean))
                row, question = _expanded(q.term_start, q.term_question, owner, term)
                cell = owner[row] * n + question
                scores = np.bincount(cell, weight[row], len(keys) * n)
                wanted = scores > 0
                if q.tokens is not None:
                    held = batch.column("tokens")
                    token = pc.index_in(held.flatten(), pa.array(q.tokens, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
                    who = np.repeat(np.arange(len(keys)), pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False))
                    who, token = who[token >= 0], token[token >= 0]
                    row, question = _expanded(q.token_start, q.token_question, who, token)
                    may = np.zeros(len(scores), bool)
                    may[who[row] * n + question] = True
                    wanted &= may
                at = np.flatnonzero(wanted)
                best.add(at % n, keys[at // n], np.round(scores[at], 6))
        question, key, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[question]), pa.array(key.astype(np.int64)), pa.array(score.astype(float))], ["query_id", "key", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(queries: DataFrame, language: Language) -> DataFrame:
    tokens = ["tokens"] if "tokens" in queries.columns else []
    return queries.select("query_id", F.array_distinct(lexical_terms(F.col("text"), language)).alias("terms"), *tokens)


def _blocks(asked: DataFrame, size: int) -> Iterator[list]:
    """The questions, so many at a time; the driver holds one block."""
    rows = asked.toLocalIterator()
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _all(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = frames[0] if frames else spark.createDataFrame([], schema)
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


FOUND = "query_id long, key long, score double"


def _ranked_block(documents: DataFrame, block: list, n: int, mean: float | None, df: dict[int, int], k: int, k1: float, b: float) -> DataFrame:
    spark, own = documents.sparkSession, Block.of(block)
    counts = np.array([df.get(t, 0) for t in range(len(own.terms))], float)
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    return documents.mapInArrow(_scored(spark.sparkContext.broadcast(own), idf, mean or 1.0, k, k1, b), FOUND)


def _postings(terms: list[str]):
    """(key, length, terms, tfs) of the documents that hold one of the terms, by the terms' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        for batch in parts(batches):
            lists = batch.column("terms")
            place = pc.index_in(lists.flatten(), wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            pair, tf = np.unique(owner[place >= 0] * max(len(terms), 1) + place[place >= 0], return_counts=True)
            who, term = pair // max(len(terms), 1), pair % max(len(terms), 1)
            some, first = np.unique(who, return_index=True)
            offsets = pa.array(np.append(first, len(who)).astype(np.int32))
            kept = batch.select(["key", "length"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["key", "length", "terms", "tfs"]
            )

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75, language: Language = ENGLISH, readers: DataFrame | None = None, block: int = QUESTIONS) -> DataFrame:
    """(query_id, key, score, rank) of the best k documents of each question, ties by key.

    ``docs``: key (unique), text; ``queries``: query_id, text, and tokens (the asker's principals) if
    ``readers`` (key, tokens) tells who may read what: then a document counts for a question only if
    they share a token, which is decided before the cut.  Statistics are those of all documents.
    A block of questions is one pass over the texts; a document is one row of at most as many numbers
    as the block has terms.
    """
    asked, found = _asked(queries, language), []
    for rows in _blocks(asked, block):
        terms = Block.of(rows).terms
        seen = Observation()
        each = docs.select("key", lexical_terms(F.col("text"), language).alias("terms")).withColumn("length", F.coalesce(F.size("terms"), F.lit(0)))
        each = each.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
        # one pass over the texts: statistics are observed while the postings are written
        held = written(each.mapInArrow(_postings(terms), "key long, length int, terms array<int>, tfs array<int>"), "postings")
        stats = seen.get
        df = {r.term: r.n for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        documents = held if readers is None else held.join(readers.select("key", "tokens"), "key")
        found.append(_ranked_block(documents, rows, stats["n"], stats["mean"], df, k, k1, b))
    return _top(_all(docs.sparkSession, found, FOUND), k)


def _since(manifest: list) -> int:
    """The place of the last batch that stands for all before it."""
    return max((k for k, r in enumerate(manifest) if r.dropped), default=0)


class SearchIndex:
    """An inverted index in a folder: postings by term, documents with their lengths, and retired keys.

    Every change is a batch of its own: what it adds, and the keys whose earlier rows it retires.  A
    batch counts once its row stands in the manifest, which is written last, so a change that is
    broken off leaves nothing behind, and a search reads the batches of one moment.  ``compact``
    writes what is live as one batch.

    Postings are filed by segment (a hash of the document) and term, and partitioned by a hash of
    the term, so a search reads only the partitions and row groups of the asked terms.
    """

    def __init__(self, spark: SparkSession, path: str, language: Language = ENGLISH, buckets: int = 16, segment_documents: int = 1 << 16):
        self.spark, self.path, self.language, self.buckets, self.segment_documents = spark, path.rstrip("/"), language, buckets, segment_documents

    def _manifest(self) -> list:
        """The committed batches in order: by number, those of writers at the same time by name."""
        try:
            rows = self.spark.read.schema("batch string, seq long, dropped boolean").json(f"{self.path}/manifest").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []  # no batch yet
        return sorted(rows, key=lambda r: (r.seq, r.batch))

    def _read(self, name: str, schema: str, rows: list) -> DataFrame:
        """Rows of the batches of a manifest that count, with the place of their batch in ``seq``."""
        since = _since(rows)
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={r.batch}").select(*names, F.lit(k).alias("seq")) for k, r in enumerate(rows) if k >= since]
        return _all(self.spark, frames, schema + ", seq int")

    def _commit(self, batch: str, dropped: bool = False) -> None:
        last = max((r.seq for r in self._manifest()), default=0)
        self.spark.createDataFrame([(batch, last + 1, dropped)], "batch string, seq long, dropped boolean").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _write(self, docs: DataFrame, retired: DataFrame, dropped: bool = False) -> None:
        """``docs``: key, terms."""
        batch = uuid.uuid4().hex
        folder = lambda name: f"{self.path}/{name}/batch={batch}"
        own = docs.withColumn("length", F.size("terms"))
        own.select("key", "length").write.parquet(folder("documents"))
        n = self.spark.read.schema("key long, length int").parquet(folder("documents")).count()
        segment = F.pmod(F.xxhash64("key"), F.lit(n // self.segment_documents + 1))
        tf = own.select("key", "length", F.explode("terms").alias("term")).groupBy("key", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        entries = F.array_sort(F.collect_list(F.struct("key", "tf", "length")))
        lists = tf.groupBy(segment.alias("segment"), "term").agg(entries.alias("entries")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        lists.repartition("bucket", "segment").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(folder("postings"))
        retired.select(F.col("key").cast("long").alias("key")).distinct().write.parquet(folder("retired"))
        self._commit(batch, dropped)

    def put(self, docs: DataFrame) -> None:
        """Add (key, text) rows; a key that is there is replaced, one that is given twice counts once, with its greatest text."""
        one = docs.where("key is not null").groupBy(F.col("key").cast("long").alias("key")).agg(F.max("text").alias("text"))
        one = written(one.select("key", F.coalesce(lexical_terms(F.col("text"), self.language), F.array().cast("array<string>")).alias("terms")), "terms")
        self._write(one, one)

    def delete(self, keys: DataFrame) -> None:
        none = self.spark.createDataFrame([], "key long, terms array<string>")
        self._write(none, keys)

    def _live(self, rows: DataFrame, manifest: list) -> DataFrame:
        """Rows of the newest batch of their key that no later batch has retired."""
        if len(manifest) - _since(manifest) <= 1:
            return rows  # nothing came later
        gone = self._read("retired", "key long", manifest).groupBy("key").agg(F.max("seq").alias("_gone"))
        return rows.join(gone, "key", "left").where("_gone is null or seq >= _gone").drop("_gone")

    def compact(self) -> None:
        """Write the live documents as one batch that stands for all before it."""
        manifest = self._manifest()
        postings = self._read("postings", "segment long, term string, entries array<struct<key:long,tf:int,length:int>>", manifest)
        rows = self._live(postings.select("term", "seq", F.explode("entries").alias("e")).select("e.*", "term", "seq"), manifest)
        terms = rows.groupBy("key").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("terms"))
        empty = self._live(self._read("documents", "key long, length int", manifest), manifest).where("length = 0").select("key", F.array().cast("array<string>").alias("terms"))
        none = self.spark.createDataFrame([], "key long")
        self._write(written(terms.unionByName(empty), "live"), none, dropped=True)

    def search(self, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75, readers: DataFrame | None = None, block: int = QUESTIONS) -> DataFrame:
        """What ``search`` returns over the live documents; only postings of asked terms are read."""
        manifest = self._manifest()
        stats = self._live(self._read("documents", "key long, length int", manifest), manifest).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        schema = "segment long, term string, entries array<struct<key:long,tf:int,length:int>>, bucket int"
        found = []
        for rows in _blocks(_asked(queries, self.language), block):
            terms = Block.of(rows).terms
            numbers = self.spark.createDataFrame(list(enumerate(terms)), "number int, term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
            held = self._read("postings", schema, manifest).join(F.broadcast(numbers), ["bucket", "term"])  # a block of questions is bounded
            each = self._live(held.select("number", "seq", F.explode("entries").alias("e")).select("e.*", "number", "seq"), manifest)
            documents = written(each.groupBy("key").agg(F.first("length").alias("length"), F.collect_list("number").alias("terms"), F.collect_list("tf").alias("tfs")), "asked")
            df = {r.number: r.n for r in documents.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("n")).collect()}
            if readers is not None:
                documents = documents.join(readers.select("key", "tokens"), "key")
            found.append(_ranked_block(documents, rows, stats.n, stats.mean, df, k, k1, b))
        return _top(_all(self.spark, found, FOUND), k)
