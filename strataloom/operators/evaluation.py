"""Retrieval and answer metrics, calibration, percentiles and text-recognition measures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, words
from .passages import located
from .tables import paired_counts, written


def golden_rank(ranked: DataFrame, evidence: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, golden): the first rank by which every piece of evidence is covered, null if never.

    ``ranked``: query_id, rank, document, page_start, page_end; ``evidence``: query_id, piece,
    document, page; a piece may have alternatives, any of which covers it.
    """
    pieces = evidence.groupBy("query_id").agg(F.countDistinct("piece").alias("pieces"))
    near = ranked.where(F.col("rank") <= depth)
    covered = near.join(evidence, ["query_id", "document"]).where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    first = covered.groupBy("query_id", "piece").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(F.count("*").alias("found"), F.max("rank").alias("last"))
    return pieces.join(first, "query_id", "left").select("query_id", F.when(F.col("found") == F.col("pieces"), F.col("last")).alias("golden"))


def retrieval_metrics(golden: DataFrame, by: str = "type") -> DataFrame:
    """Hit@1, Hit@5, Hit@10 and MRR by type, and over all in the row with a null type."""
    hit = lambda k: F.round(F.avg((F.coalesce("golden", F.lit(10**6)) <= k).cast("double")), 6).alias(f"hit_{k}")
    mrr = F.round(F.avg(F.coalesce(1 / F.col("golden"), F.lit(0.0))), 6).alias("mrr")
    return golden.rollup(by).agg(F.count("*").alias("questions"), hit(1), hit(5), hit(10), mrr)


def _ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, _n, _upto, _total): rows of each value, rows up to it, and all rows of the group.

    Rows are counted map-side first, so a group of very many rows is never sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    return counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_n").over(w))


def nearest_rank(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, share, value): the value at position min(floor(share * n), n - 1), counted from 0."""
    rows = _ranked(df, by, value).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    at = F.least(F.floor(F.col("share") * F.col("_total")), F.col("_total") - 1)
    return rows.where((F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))).select(by, "share", F.col(value).alias("value"))


def worst_decile_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of the max(1, n // 10) lowest values."""
    most = F.greatest(F.lit(1), F.floor(F.col("_total") / 10))
    rows = _ranked(df, by, value).withColumn("taken", F.greatest(F.lit(0), F.least("_n", most - (F.col("_upto") - F.col("_n")))))
    return rows.groupBy(by).agg(F.round(F.sum(F.col(value) * F.col("taken")) / F.sum("taken"), 6).alias("worst_decile"))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, refused_bad, refused_good): shares of label 0 and label 1 rows under each threshold."""
    rows = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    share = lambda label, name: F.round(F.avg(F.when(F.col("label") == label, (F.col("score") < F.col("threshold")).cast("double"))), 6).alias(name)
    return rows.groupBy("threshold").agg(share(0, "refused_bad"), share(1, "refused_good"))


def word_measures(pages: DataFrame) -> DataFrame:
    """(key, truth_words, shared, precision, recall, f1, word_error) of (key, truth, output) rows by word multisets.

    Recall of an empty truth is null; word error is the larger of missed and added words.
    """
    both = paired_counts(pages, words(F.col("truth")), words(F.col("output")))
    sums = both.groupBy("key").agg(F.sum(F.least("t", "o")).alias("shared"), F.sum("t").alias("t"), F.sum("o").alias("o"))
    all_rows = pages.select("key").join(sums, "key", "left").na.fill(0)
    p, r = F.when(F.col("o") > 0, F.col("shared") / F.col("o")), F.when(F.col("t") > 0, F.col("shared") / F.col("t"))
    f1 = F.when(F.col("t") + F.col("o") > 0, 2 * F.col("shared") / (F.col("t") + F.col("o")))
    return all_rows.select("key", F.col("t").alias("truth_words"), "shared", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.greatest(F.col("t") - F.col("shared"), F.col("o") - F.col("shared")).alias("word_error"))


def character_error(truth, output):
    """Edit distance by the truth's length, at most 1; null for an empty truth."""
    return F.when(F.length(truth) > 0, F.least(F.lit(1.0), F.levenshtein(truth, output) / F.length(truth)))


def has_loop(text, size: int = 4, times: int = 3):
    """Some run of ``size`` words stands ``times`` times or more."""

    def repeated(tokens):
        n = F.size(tokens) - size + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " "))
        # in the sorted runs three equal ones stand next to each other
        equal = lambda o: F.exists(F.sequence(F.lit(1), F.greatest(n - times + 1, F.lit(1))), lambda i: F.element_at(o, i) == F.get(o, i + times - 2))
        return F.when(n >= times, F.coalesce(let(F.array_sort(runs), equal), F.lit(False))).otherwise(F.lit(False))

    return let(words(text), repeated)


def gates(current: DataFrame, baseline: DataFrame, drop: float = 0.01) -> DataFrame:
    """(metric, value, was, ok): a metric may not fall by more than ``drop`` under its baseline."""
    both = baseline.select("metric", F.col("value").alias("was")).join(current.select("metric", "value"), "metric", "left")
    return both.withColumn("ok", F.coalesce(F.col("value") >= F.col("was") - drop, F.lit(False)))


def set_problems(golden: DataFrame, types: tuple[str, ...] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(id, problem) of a question set: repeated ids, unknown types, quotes of under 5 or over 40 words, and quotes that don't stand on their page.

    ``golden``: id, quote, and type and page where these are checked; ``pages``: page, text.  All
    quotes are looked up on all pages at once.  A row has one problem of each kind at most.
    """
    repeated = golden.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    n = F.size(words(F.col("quote")))
    out = repeated.union(golden.where(n.isNull() | (n < 5) | (n > 40)).select("id", F.lit("quote_length").alias("problem")))
    if types is not None:
        out = out.union(golden.where(F.col("type").isNull() | ~F.col("type").isin(*types)).select("id", F.lit("unknown_type").alias("problem")))
    if pages is not None:
        quotes = written(golden.withColumn("passage", F.monotonically_increasing_id()), "quotes")
        found = located(quotes.select("passage", F.col("quote").alias("text")), pages.select(F.col("page").alias("key"), "text")).select("passage", F.col("key").alias("page"))
        out = out.union(quotes.join(found, ["passage", "page"], "left_anti").select("id", F.lit("quote_not_on_page").alias("problem")))
    return out


def agreement(readings: DataFrame) -> DataFrame:
    """(agreed, right, precision): words that both engines read, and how many of these the truth holds; by multisets of a key.

    ``readings``: key, truth, a, b.
    """
    count = lambda side: readings.select("key", F.explode(words(F.col(side))).alias("word")).groupBy("key", "word").agg(F.count("*").alias(side))
    both = count("a").join(count("b"), ["key", "word"]).join(count("truth"), ["key", "word"], "left").na.fill(0)
    shared = F.least("a", "b")
    sums = both.agg(F.coalesce(F.sum(shared), F.lit(0)).alias("agreed"), F.coalesce(F.sum(F.least(shared, "truth")), F.lit(0)).alias("right"))
    return sums.withColumn("precision", F.when(F.col("agreed") > 0, F.round(F.col("right") / F.col("agreed"), 6)))


def line_scores(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """(engine, lines, exact, words_right, cer) pooled over all lines; a missing output is an empty one.

    ``truth``: line, text; ``outputs``: engine, line, text.
    """
    engines = outputs.select("engine").distinct()
    wanted = truth.select("line", F.col("text").alias("truth")).join(F.broadcast(engines))
    both = wanted.join(outputs.select("engine", "line", F.col("text").alias("output")), ["engine", "line"], "left").withColumn("output", F.coalesce("output", F.lit("")))
    # words in their places' order don't count: each word as often as both hold it
    t, o = words(F.col("truth")), words(F.col("output"))
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    right = F.aggregate(F.array_distinct(t), F.lit(0), lambda n, w: n + F.least(times(t, w), times(o, w)))
    rows = both.select("engine", (F.col("truth") == F.col("output")).cast("int").alias("exact"), right.alias("right"), F.size(t).alias("n"), F.levenshtein("truth", "output").alias("edits"), F.length("truth").alias("letters"))
    return rows.groupBy("engine").agg(F.count("*").alias("lines"), F.sum("exact").alias("exact"), F.round(F.sum("right") / F.sum("n"), 6).alias("words_right"), F.round(F.sum("edits") / F.sum("letters"), 6).alias("cer"))


def judged(answers: DataFrame, statuses: list[str]) -> DataFrame:
    """By type: questions, shares of correct, cited and found, and how many answers of each status there are.

    ``answers``: type, status, correct, cited, found.
    """
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return answers.groupBy("type").agg(F.count("*").alias("questions"), share("correct"), share("cited"), share("found"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses])


def refused_afterwards(records: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, refused, right): shares of answers (score, correct) under each threshold, and of correct ones that stay."""
    rows = records.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    refused = F.col("score") < F.col("threshold")
    return rows.groupBy("threshold").agg(F.round(F.avg(refused.cast("double")), 6).alias("refused"), F.round(F.avg((F.col("correct") & ~refused).cast("double")), 6).alias("right"))


def pilot(graded: DataFrame) -> DataFrame:
    """(answers, share of each class, critical per 50 answers, median time gained) of rows (grade, critical, minutes_before, minutes_after)."""
    share = lambda g: F.round(F.avg((F.col("grade") == g).cast("double")), 6).alias(g)
    gain = F.expr("percentile(minutes_before - minutes_after, 0.5)")
    return graded.agg(F.count("*").alias("answers"), share("right"), share("partly"), share("wrong"), F.round(50 * F.avg(F.col("critical").cast("double")), 6).alias("critical_per_50"), F.round(gain, 6).alias("minutes_gained"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in which every bit moves every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(df: DataFrame, value: str, resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(mean, low, high): the mean and its bootstrap interval.

    Each row counts so many times in each resample as a Poisson number says that row and seed fix,
    so partitions add up their own sums, and only one row a resample and partition is shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))

    # shares of the numbers 0, 1, 2, ... among Poisson numbers of mean 1, added up
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salts = np.zeros((2, resamples)), _mixed(np.arange(resamples, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        step = max(1, (1 << 21) // resamples)
        for batch in batches:
            v, h = batch.column("v").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            for k in range(0, len(v), step):
                uniform = (_mixed(h[k : k + step, None] ^ salts[None, :]) >> np.uint64(11)) * 2.0**-53
                times = np.searchsorted(upto, uniform, side="right")
                total += np.stack([v[k : k + step] @ times, times.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["resample", "s", "n"])

    means = rows.mapInArrow(sums, "resample int, s double, n double").groupBy("resample").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    edge = (1 - level) / 2
    interval = means.agg(F.expr(f"percentile(m, {edge})").alias("low"), F.expr(f"percentile(m, {1 - edge})").alias("high"))
    return rows.agg(F.avg("v").alias("mean")).join(F.broadcast(interval))


def bottom_k(df: DataFrame, by: str, key: str, k: int, seed: int = 7) -> DataFrame:
    """``k`` rows of each group, chosen and ordered (``place``) by a keyed hash of group and key.

    The choice depends on seed, group and key only, so it is the same on any partitioning; each task
    keeps its own ``k`` first, and only these are shuffled.
    """
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(sample_order(by, key, seed), key))).where(F.col("place") <= k)


def sample_order(by: str, key: str, seed: int):
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(by), F.col(key)), 256)


def context_samples(holding: DataFrame, ranked: DataFrame, sources: int = 6, per_piece: int = 2, seed: int = 7) -> DataFrame:
    """(query_id, key, place): the context of a perfect search, filled up from a ranking and shuffled by ``seed``.

    ``holding``: query_id, piece, key and ``answers`` (the chunk states the answer): the chunks that hold
    a piece of the evidence.  Of each piece ``per_piece`` go in, those that state the answer first, then the
    ranking's (query_id, key, rank), until there are ``sources``.  All cuts are by bounded windows.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "piece").orderBy(F.desc("answers"), "key"))
    first = holding.withColumn("n", best).where(F.col("n") <= per_piece).select("query_id", "key", F.struct(F.lit(0).alias("list"), F.col("piece").cast("long").alias("a"), F.col("n").cast("long").alias("b")).alias("order"))
    rest = ranked.where(F.col("rank") <= sources * (per_piece + 1)).select("query_id", "key", F.struct(F.lit(1).alias("list"), F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("order"))
    each = first.unionByName(rest).groupBy("query_id", "key").agg(F.min("order").alias("order"))
    kept = each.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "key"))).where(F.col("n") <= sources)
    return bottom_k(kept.select("query_id", "key"), "query_id", "key", sources, seed)


def judged_answers(answers: DataFrame, cited: DataFrame, found: DataFrame, evidence: DataFrame, statuses: list[str]) -> DataFrame:
    """``judged`` from what answers cite and find, instead of ready-made flags.

    ``answers``: query_id, type, status, correct; ``cited`` and ``found``: query_id, document, page_start,
    page_end of the sources that the answer cites, and of all it was given; ``evidence``: query_id, piece,
    document, page.  An answer is cited (found) well if every piece of its evidence is covered.
    """
    one = lambda df: golden_rank(df.withColumn("rank", F.lit(1)), evidence, 1).select("query_id", F.col("golden").isNotNull().alias("ok"))
    own = answers.join(one(cited).withColumnRenamed("ok", "cited"), "query_id", "left").join(one(found).withColumnRenamed("ok", "found"), "query_id", "left")
    return judged(own.na.fill(False, ["cited", "found"]), statuses)
