"""Near-duplicate classes by DartMinHash signatures (operator 3).

A document is a weighted set of word shingles, the weight being the number of occurrences.  Each
shingle throws darts at the plane of weight and rank: the plane is cut into cells, weights at 1, 2,
4, 8, ..., ranks at powers of two, and hashes of shingle and cell fix how many darts hit the cell
(Poisson, by its area), and each dart's weight, rank and coordinate.  Darts under the shingle's
weight count, so equal regions hold equal darts.  The dart of least rank on each of k coordinates is
the signature; two signatures agree in a coordinate with a probability that equals the weighted
Jaccard similarity.  Ranks are thrown from below until all coordinates are hit, which takes about
k ln k darts a document, however heavy it is.  Bands of coordinates are joined, and each candidate
pair is verified with the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lean, sliced, written
from .tokens import Words, mix, shingles, words

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Ranks are cut at these powers of two: the first cell holds a dart for a sixteenth of all shingles of weight one.
_LOWEST, _HIGHEST = -4, 40


@dataclass(frozen=True)
class DartParams:
    """A pair of similarity 0.8 shares no band with probability (1 - 0.8^rows)^bands = 5e-5."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5
    block: int = 400


def _counted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes ordered within each text, the text of each, where a new one begins, and the number of its occurrence from 0."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(h))
    return h, o, new, at - np.maximum.accumulate(np.where(new, at, 0))


def unit_elements(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each (shingle, number of the occurrence), and the bounds of each text.

    The sets of these hashes have the weighted Jaccard similarity of the texts, by which pairs are
    verified.
    """
    hashes, bounds = shingles(w, size)
    h, _, _, nth = _counted(hashes, bounds)
    return np.where(nth == 0, h, mix(h + nth.astype(np.uint64) * _GOLD)), bounds


def weighted_shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, their weights, and the bounds of each text."""
    hashes, bounds = shingles(w, size)
    h, o, new, _ = _counted(hashes, bounds)
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(h))).astype(np.float64)
    return h[first], weights, np.searchsorted(o[first], np.arange(len(bounds)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) / (1 << 53)


def _poisson(mean: float) -> np.ndarray:
    """P(at most 0, 1, 2, ... darts), up to where nothing is left."""
    n = np.arange(int(mean + 12 * mean**0.5 + 30))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
    return np.cumsum(np.exp(logs))


def signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """One row of k dart hashes a text, of elements with any positive weights; a text without elements has the hash 0 everywhere.

    Texts whose coordinates are all hit after a range of ranks are done, since later ranges only
    hold darts of higher rank.
    """
    n = len(bounds) - 1
    counts = np.diff(bounds)
    best = np.full(n * k, np.inf)
    owner = np.repeat(np.arange(n), counts)
    live, chosen = np.flatnonzero(counts > 0), np.arange(len(elements))
    low = 0.0
    for power in range(_LOWEST, _HIGHEST):
        if not len(live):
            break
        high, cell = 2.0**power, 0
        left, right = 0.0, 1.0
        heavy = chosen
        while len(heavy):
            tail = _poisson((high - low) * (right - left))
            salt = mix(np.array([(power - _LOWEST) * 64 + cell + 1], dtype=np.uint64) * _GOLD)
            seed = mix(elements[heavy] ^ salt)
            darts = np.searchsorted(tail, _uniform(seed), "right")
            hit = np.flatnonzero(darts)
            total = np.cumsum(darts[hit])
            first = 0
            while first < len(hit):  # some 2^18 darts at a time
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + (1 << 18), "right")))
                part = hit[first:last]
                own = np.repeat(part, darts[part])
                number = np.arange(len(own)) - np.repeat(np.cumsum(darts[part]) - darts[part], darts[part])
                thrown = mix(seed[own] + (number.astype(np.uint64) + _U(1)) * _GOLD)
                own = heavy[own]
                keep = left + (right - left) * _uniform(mix(thrown ^ _U(0x2545F4914F6CDD1D))) < weights[own]
                own, thrown = own[keep], thrown[keep]
                place = (mix(thrown ^ _GOLD) % _U(k)).astype(np.int64)
                np.minimum.at(best, owner[own] * k + place, low + (high - low) * _uniform(thrown))
                first = last
            # the next cell is as wide as all before it
            cell, left, right = cell + 1, right, 2 * right
            heavy = heavy[weights[heavy] > left]
        filled = np.isfinite(best.reshape(n, k)[live]).all(axis=1)
        if filled.any():
            live = live[~filled]
            chosen = chosen[np.isin(owner[chosen], live)]
        low = high
    # a rank has so many bits that it tells its dart
    out = best.view(np.uint64).reshape(n, k)
    out[counts == 0] = 0
    return out


#: What tells texts apart, and which of the texts of one doc_id counts.
TEXT = ("n_words", "text1", "text2")


def _text_keys(w: Words) -> list[pa.Array]:
    """Of each text the number of its words, and the words in their order by two hashes: exact copies but for case, signs and white space."""
    place = np.arange(len(w.hashes)) - w.bounds[:-1][w.docs] if len(w.hashes) else np.zeros(0, np.int64)
    out = [pa.array(np.diff(w.bounds))]
    for salt in (1, 2):
        own = mix(w.hashes + mix(place.astype(np.uint64) + _U(salt << 40)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
        out.append(pa.array((sums[w.bounds[1:]] - sums[w.bounds[:-1]]).view(np.int64)))
    return out


def _signature_rows(params: DartParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = words(batch.column("text"))
            n = batch.num_rows
            rows = signatures(*weighted_shingles(w, params.shingle), params.bands * params.rows)
            keys = np.zeros((n, params.bands), dtype=np.uint64)
            for r in range(params.rows):
                keys = mix(keys ^ rows[:, r :: params.rows]) * _GOLD
            keys = mix(keys + np.arange(params.bands, dtype=np.uint64) * _GOLD)
            flat = pa.array(keys.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * params.bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_text_keys(w), lists], ["doc_id", *TEXT, "bands"])

    return run


def _element_rows(params: DartParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = words(batch.column("text"))
            elements, bounds = unit_elements(w, params.shingle)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_text_keys(w), lists], ["doc_id", *TEXT, "elements"])

    return run


def near_duplicates(docs: DataFrame, params: DartParams = DartParams()) -> DataFrame:
    """(doc_id, class_id, representative): class_id is the least doc_id of the near-duplicate class.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is 0.8 or
    more; classes are the connected components.  Texts of fewer than five words have one shingle of
    all words.  Texts of equal words are one class at once, all empty and null texts one as well,
    and only a representative (least doc_id) goes on.  Rows with a null doc_id are left out; rows
    with the same doc_id count once, with the longest text.

    Every bucket is compared with its leader first, which settles most buckets.  The members of a
    bucket that are not in one class after that are compared with each other in blocks: a task
    holds two blocks of a bucket at most and returns a link a member at most, never all pairs, so
    no link of a bucket is lost and the rows grow with the members.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = own.mapInArrow(lean(_signature_rows(params)), "doc_id long, n_words long, text1 long, text2 long, bands array<long>")
    signed = written(signed, "signatures")
    # the text that counts is chosen before texts are grouped, so a text's id is that of a document it stands for
    once = signed.groupBy("doc_id").agg(F.max(F.struct(*TEXT)).alias("t")).select("doc_id", "t.*")
    named = once.groupBy(*TEXT).agg(F.min("doc_id").alias("text_id"))
    texts = written(signed.groupBy(*TEXT).agg(F.first("bands").alias("bands")).join(named, [*TEXT]), "texts")
    member = once.join(texts.select(*TEXT, "text_id"), [*TEXT]).select("doc_id", "text_id")

    rows = texts.select("text_id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("text_id").alias("leader")).where("n > 1")
    rows = written(rows.join(sizes, "bucket"), "buckets")
    sets = _elements(own, rows.select(F.col("text_id").alias("doc_id")).distinct(), params)
    pairs = rows.where("text_id <> leader").select(F.col("leader").alias("a"), F.col("text_id").alias("b")).distinct()
    linked = written(_linked(pairs, sets, params), "linked")
    found = written(components(linked), "classes").withColumnRenamed("node", "text_id")
    placed = rows.where("n > 2").select("bucket", "text_id").join(found, "text_id", "left").withColumn("component", F.coalesce("component", "text_id"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    within = written(_links_within(placed.join(several, "bucket"), sets, params), "within")
    found = components(linked.union(within)).withColumnRenamed("node", "text_id")
    return member.join(found, "text_id", "left").select("doc_id", F.coalesce("component", "text_id").alias("class_id"), (F.col("doc_id") == F.coalesce("component", "text_id")).alias("representative"))


#: Bits of the filter that keeps texts without a candidate from being shuffled.
_FILTER_BITS = 1 << 24


def _maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id may be among the ids: few others pass while ids are fewer than the filter's bits.

    The filter has ``_FILTER_BITS`` bits whatever the input, at most 2^18 rows of 64 bits, so it is
    broadcast; the caller joins the ids exactly afterwards.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS))
    word, bit = F.shiftright(slot, 6).cast("int").alias("_word"), F.pmod(slot, F.lit(64)).cast("int").alias("_bit")
    bits = ids.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    hit = docs.select("*", word, bit).join(F.broadcast(bits), "_word").where("(shiftright(_bits, _bit) & 1) = 1")
    return hit.select(*docs.columns)


def _elements(docs: DataFrame, ids: DataFrame, params: DartParams) -> DataFrame:
    """(doc_id, elements) of the documents that share a bucket."""
    kinds = "doc_id long, n_words long, text1 long, text2 long, elements array<long>"
    sets = _maybe(docs, ids).mapInArrow(lean(_element_rows(params)), kinds).join(ids, "doc_id", "left_semi")
    # of rows with the same doc_id the text that counts
    sets = sets.groupBy("doc_id").agg(F.max(F.struct(*TEXT, "elements")).alias("e"))
    return written(sets.select("doc_id", "e.elements"), "elements")


def _linked(pairs: DataFrame, sets: DataFrame, params: DartParams) -> DataFrame:
    """(src, dst) of the pairs (a, b) that are similar enough, by their whole texts."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= params.similarity * (F.size("x") + F.size("y") - shared)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _links_within(mixed: DataFrame, sets: DataFrame, params: DartParams) -> DataFrame:
    """(src, dst) that connect what is linked within a bucket; ``mixed``: bucket, text_id, n members.

    A bucket's members are dealt to blocks, and each pair of blocks is a group.
    """
    blocks = F.ceil(F.col("n") / params.block).cast("int")
    dealt = mixed.select("bucket", "text_id", blocks.alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "text_id", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    rows = dealt.join(sets.withColumnRenamed("doc_id", "text_id"), "text_id")
    return rows.groupBy("bucket", "lo", "hi").applyInArrow(_compared(params.similarity), "src long, dst long").distinct()


def _compared(similarity: float):
    """All similarities of a group by products of 0/1 matrices of its shared elements."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("text_id").to_numpy()
        lists = group.column("elements").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n, sizes = len(ids), np.diff(lists.offsets.to_numpy()).astype(np.float64)
        values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(n), sizes.astype(np.int64))
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        several = times[column] > 1
        column, owner = np.unique(column[several], return_inverse=True)[1], owner[several]
        shared = np.zeros((n, n), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = max(256, 4_000_000 // max(n, 1))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [first, first + width])
            part = np.zeros((n, width), dtype=np.float32)
            part[owner[lo:hi], column[lo:hi] - first] = 1
            shared += part @ part.T
        linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared.astype(np.float64))
        label = np.arange(n)
        while True:
            least = np.where(linked, label[None, :], n).min(axis=1, initial=n)
            new = np.minimum(label, least)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        other = np.flatnonzero(label != np.arange(n))
        return pa.table({"src": pa.array(ids[other], pa.int64()), "dst": pa.array(ids[label[other]], pa.int64())})

    return run
