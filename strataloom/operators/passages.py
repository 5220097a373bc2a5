"""Which texts hold which passages, for any number of either.

The first bytes of a passage, as many as the largest power of two that it has, are its head.  Every
window of a text of such a length has a rolling hash; windows whose hash a passage's head may have
meet the heads in an equi-join, and the whole passage is compared at the place where its head stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

BASE = 0x9E3779B97F4A7C15
#: Bits of the filter that tells which hashes a head may have; it is that large whatever the input.
FILTER = 1 << 22
#: Bytes of text that one vectorised step works on; a longer text is taken whole.
STEP = 1 << 20
#: The longest head; longer passages are told apart when they are compared.
LONGEST = 64


def _hashed(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` bytes: sums of powers that double the window at each step."""
    out, width = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE), 1
    while width < size:
        out = out[:-width] * np.uint64(pow(BASE, width + 1, 1 << 64)) + out[width:]
        out ^= out >> np.uint64(29)
        width *= 2
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, hashes = [], []
        for text in batch.column("text").to_pylist():
            size = min(LONGEST, 1 << (len(text).bit_length() - 1))
            sizes.append(size)
            hashes.append(int(_hashed(np.frombuffer(text[:size], np.uint8), size).view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([batch.column("passage"), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], ["passage", "size", "hash"])


def _windows(sizes: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(bits.value).view(bool)
        for batch in batches:
            texts = batch.column("text")
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int32)
            first = 0
            while first < len(texts):
                last = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), STEP, "right")))
                part = batch.slice(first, last - first)
                data = np.frombuffer(b"".join(part.column("text").to_pylist()), np.uint8)
                ends = np.cumsum(lengths[first:last])
                for size in sizes:
                    if len(data) < size:
                        continue
                    h = _hashed(data, size)
                    at = np.flatnonzero(full[(h >> np.uint64(42)).astype(np.int64)])
                    owner = np.searchsorted(ends, at, "right")
                    inside = at + size <= ends[owner]
                    at, owner = at[inside], owner[inside]
                    start = at - (ends[owner] - lengths[first:last][owner])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(owner)), pa.array(np.full(len(at), size, np.int32)), pa.array(h[at].view(np.int64)), pa.array(start.astype(np.int32))], ["key", "size", "hash", "at"]
                    )
                first = last

    return run


def located(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage, key, times, first): how often each text holds each passage, and the character before which it first stands.

    ``passages``: passage, text; ``texts``: key, text; keys are unique and of type long.  Overlapping places
    count each.  Null and empty passages stand nowhere.  Neither side is paired with the other but
    where hashes agree; only texts with such a place are read again.
    """
    spark = texts.sparkSession
    own = passages.where("length(text) > 0").select("passage", F.col("text").cast("binary").alias("text"))
    heads = written(own.mapInArrow(_heads, "passage long, size int, hash long"), "heads")
    sizes = sorted(r.size for r in heads.select("size").distinct().collect())
    slot = F.shiftrightunsigned("hash", 42)
    full = np.zeros(FILTER, bool)
    # 2^16 words of 64 bits at most come to the driver
    for word, mask in heads.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 42) & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)")).collect():
        full[word * 64 : word * 64 + 64] = np.unpackbits(np.array([mask], "<i8").view(np.uint8), bitorder="little").view(bool)
    bits = spark.sparkContext.broadcast(np.packbits(full))
    wide = texts.where("text is not null").select("key", F.col("text").cast("binary").alias("text"))
    met = wide.mapInArrow(_windows(sizes, bits), "key long, size int, hash long, at int").join(heads, ["size", "hash"]).select("key", "passage", "at")
    met = written(met, "met")
    both = met.join(wide, "key").join(own.select("passage", F.col("text").alias("wanted")), "passage")
    holds = F.substring("text", F.col("at") + 1, F.octet_length("wanted")) == F.col("wanted")
    before = F.length(F.substring("text", F.lit(1), F.col("at")).cast("string"))
    return both.where(holds).select("passage", "key", before.alias("at")).groupBy("passage", "key").agg(F.count("*").alias("times"), F.min("at").alias("first"))
