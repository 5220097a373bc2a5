"""Phrase collocations by counts in a minimal perfect hash (operator 12).

Three passes over the texts, none of which shuffles texts or single occurrences:

1. Each task counts the hashed cells of all runs of one to ``longest`` words in numpy arrays, which
   are summed in a tree.  A cell under ``least`` holds no phrase that counts.
2. Runs whose own cell, and those of all runs within them, reach ``least`` may count (a sound form of
   Apriori pruning: no phrase that counts is missed).  Each task sums its own occurrences by key; keys
   whose sums reach ``least`` are the candidates, so a corpus that fills its cells costs a larger
   shuffle, in proportion to its size, but no larger hash.
3. A minimal perfect hash gives each candidate a slot, where its 128-bit key is stored; a run of the
   texts is counted in its slot if the stored key is its own.  The tasks' arrays are summed in a tree.

Counts of phrases and of both parts of every cut are then read from the slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import BitVector
from .shared import lean, written

# Signs that end a piece, and those between words.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")
UNKNOWN = "und"

#: Entries of an array that travel in one row, and arrays that one task sums.
BLOCK, FAN_IN = 1 << 16, 16
TASK_BYTES = 1 << 26


@dataclass(frozen=True)
class PhraseParams:
    """``least`` occurrences make a candidate of 2 to ``longest`` words; ``best`` phrases a language are returned.

    There are as many cells a length of phrase as ``bytes_per_cell`` gives for the corpus, 2^16 to
    2^24; ``slots`` candidates are counted in one pass over the texts.  Neither changes a result:
    with fewer cells more keys are shuffled, with fewer slots there are more passes.  A task works on
    ``step_bytes`` of text at a time (a longer text is taken in parts that end with a piece) and
    sums up to ``remembered`` keys before it emits them (the shuffle merges further sums).
    """

    least: int = 100
    longest: int = 5
    best: int = 2000
    scale: int = 1000
    bytes_per_cell: int = 128
    slots: int = 1 << 20
    step_bytes: int = 1 << 20
    remembered: int = 1 << 18


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(256, np.uint8)
    kind[[ord(c) for c in BLANKS]], kind[[ord(c) for c in BREAKS]] = 1, 2
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


KIND, LOWER = _classes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit moves every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(values: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each value."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values)), "<u8").reshape(-1, 2)


class Words:
    """The words of some texts: their places, pieces and texts, and the keys of runs of them."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([np.zeros(1, np.int8), inside.view(np.int8)])))
        first, end = edge[::2], edge[1::2]
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        #: the text of each word, and the first word of each text
        self.row = np.searchsorted(starts, first, side="right") - 1
        self.first = np.searchsorted(first, starts)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), first)
        offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(end - first, dtype=np.int32)])
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.langs = pa.array(langs, pa.string()).dictionary_encode()
        self.values = _digests(self.names.to_pylist())[self.codes]
        self.lang = self.langs.indices.to_numpy()[self.row]
        self.seeds = _digests([x.encode() for x in self.langs.dictionary.to_pylist()])[self.lang]

    def __len__(self) -> int:
        return len(self.codes)

    def runs(self, longest: int, lanes: tuple[int, ...] = (0, 1)) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(words, which starts are runs within one piece, a key a lane) for every length; entry i begins at word i."""
        keys = [self.seeds[:, lane] for lane in lanes]
        for size in range(1, min(longest, len(self)) + 1):
            m = len(self) - size + 1
            keys = [mix(key[:m] * np.uint64(0x9E3779B97F4A7C15) + self.values[size - 1 :, lane]) for key, lane in zip(keys, lanes, strict=True)]
            yield size, self.piece[:m] == self.piece[size - 1 :], keys

    def spelled(self, at: np.ndarray, size: int) -> pa.Array:
        """The runs of ``size`` words from these words on, joined by spaces."""
        parts = [self.names.take(pa.array(self.codes[at + k])) for k in range(size)]
        return (pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]).cast(pa.string())


def _pieces_of(text: bytes, limit: int) -> Iterator[bytes]:
    start = 0
    while len(text) - start > limit and (cut := BREAK.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _steps(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Words]:
    """Words of batches with the columns text (binary) and lang, by steps of ``limit`` bytes."""
    texts, langs, used = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            for part in _pieces_of(text.as_py() or b"", limit):
                texts.append(part)
                langs.append(lang)
                used += len(part)
                if used > limit:
                    yield Words(texts, langs)
                    texts, langs, used = [], [], 0
    if texts:
        yield Words(texts, langs)


class PerfectHash:
    """Slots 0 to n - 1 for n different keys of two numbers each.

    Each level throws the keys that are left at twice as many places; those alone at their place get
    it.  A key's slot is the number of taken places before its own, over all levels; the key stored
    there tells strangers.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[BitVector] = []
        slot, left, done = np.zeros(len(lo), np.int64), np.arange(len(lo)), 0
        while len(left):
            if len(self.levels) > 100:
                raise ValueError("keys of a perfect hash must be different")
            at = self._places(hi[left], lo[left], len(self.levels), 2 * len(left) + 64)
            alone = np.bincount(at, minlength=2 * len(left) + 64) == 1
            level = BitVector(alone)
            placed = alone[at]
            slot[left[placed]] = done + level.rank(at[placed])
            done += level.ones
            self.levels.append(level)
            left = left[~placed]
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[slot], self.lo[slot] = hi, lo

    def __len__(self) -> int:
        return len(self.lo)

    @staticmethod
    def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(lo ^ mix(hi + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't stored."""
        out, left, done = np.full(len(lo), -1, np.int64), np.arange(len(lo)), 0
        for k, level in enumerate(self.levels):
            at = self._places(hi[left], lo[left], k, level.length)
            taken = level.get(at)
            out[left[taken]] = done + level.rank(at[taken])
            left, done = left[~taken], done + level.ones
        found = np.flatnonzero(out >= 0)
        stranger = (self.hi[out[found]] != hi[found]) | (self.lo[out[found]] != lo[found])
        out[found[stranger]] = -1
        return out


class Counter:
    """An array of counts that indexes are gathered for; counts stay at ``most``, if that is given."""

    def __init__(self, size: int, most: int | None = None):
        self.most, self.waiting, self.held = most, [], 0
        self.counts = np.zeros(size, np.int64 if most is None else np.min_scalar_type(most))

    def add(self, at: np.ndarray) -> None:
        self.waiting.append(at.astype(np.uint32))
        self.held += len(at)
        if self.held >= len(self.counts):
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.put(np.bincount(np.concatenate(self.waiting), minlength=len(self.counts)))
        self.waiting, self.held = [], 0

    def put(self, more: np.ndarray) -> None:
        for k in range(0, len(more), BLOCK):
            total = self.counts[k : k + BLOCK].astype(np.int64) + more[k : k + BLOCK]
            self.counts[k : k + BLOCK] = total if self.most is None else np.minimum(total, self.most)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        for k in range(0, len(self.counts), BLOCK):
            part = self.counts[k : k + BLOCK]
            if part.any():
                yield k // BLOCK, part.tobytes()


ARRAYS = "size int, block int, task int, lang string, n long, data binary"
_ARRAYS = pa.schema([("size", pa.int32()), ("block", pa.int32()), ("task", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("data", pa.binary())])


def _emitted(counters: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for size, counter in counters.items():
        for block, data in counter.blocks():
            yield pa.RecordBatch.from_pylist([{"size": size, "block": block, "task": task, "data": data}], _ARRAYS)


def _tree_sum(rows: DataFrame, tasks: int, most: int | None) -> DataFrame:
    """One array for each size and block: the tasks' arrays summed ``FAN_IN`` at a time."""
    dtype = np.dtype(np.int64 if most is None else np.min_scalar_type(most))

    def summed(table: pa.Table) -> pa.Table:
        counter = None
        for data in table.column("data"):
            part = np.frombuffer(data.as_buffer(), dtype)
            counter = counter or Counter(len(part), most)
            counter.put(part)
        row = table.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([row | {"task": row["task"] // FAN_IN, "data": counter.counts.tobytes()}], _ARRAYS)

    while True:
        rows = rows.groupBy("size", "block", F.floor(F.col("task") / FAN_IN)).applyInArrow(summed, ARRAYS)
        if (tasks := -(-tasks // FAN_IN)) <= 1:
            return rows


def _cells(shift: int, params: PhraseParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {k: Counter(1 << (64 - shift), params.least) for k in range(1, params.longest + 1)}
        totals: dict[str, int] = {}
        for words in _steps(batches, params.step_bytes):
            for size, whole, (lo,) in words.runs(params.longest, (1,)):
                counters[size].add(lo[whole] >> np.uint64(shift))
            for name, n in zip(words.langs.dictionary.to_pylist(), np.bincount(words.lang, minlength=len(words.langs.dictionary)).tolist(), strict=True):
                totals[name] = totals.get(name, 0) + n
        yield from _emitted(counters)
        yield pa.RecordBatch.from_pylist([{"size": 0, "lang": name, "n": n} for name, n in totals.items()], _ARRAYS)

    return run


class Pruned:
    """For each size, which cells reach the least count."""

    def __init__(self, cells: DataFrame, shift: int, params: PhraseParams):
        least, dtype = params.least, np.min_scalar_type(params.least)
        self.shift, self.full = shift, {k: np.zeros(1 << (64 - shift), bool) for k in range(1, params.longest + 1)}

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = [np.packbits(np.frombuffer(x.as_buffer(), dtype) >= least).tobytes() for x in batch.column("data")]
                yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("block"), pa.array(bits, pa.binary())], ["size", "block", "bits"])

        for size, block, bits in cells.mapInArrow(packed, "size int, block int, bits binary").collect():
            self.full[size][block * BLOCK : (block + 1) * BLOCK] = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        self.full = {k: BitVector(v) for k, v in self.full.items()}

    def runs(self, words: Words, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, first words, hi, lo) of the runs that may count."""
        before = None
        for size, whole, (hi, lo) in words.runs(longest):
            if before is not None:
                whole = whole & before[:-1] & before[1:]
            at = np.flatnonzero(whole)
            at = at[self.full[size].get(lo[at] >> np.uint64(self.shift))]
            before = np.zeros(len(lo), bool)
            before[at] = True
            if not len(at):
                return
            yield size, at, hi[at], lo[at]


CANDIDATES = "hi long, lo long, lang string, phrase string, size int, n long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _candidates(pruned, params: PhraseParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # how often each key was seen, and what it stands for, in the same order
        counts: dict[tuple[int, int], int] = {}
        told: list[pa.RecordBatch] = []

        def emitted() -> Iterator[pa.RecordBatch]:
            n, first = np.fromiter(counts.values(), np.int64, len(counts)), 0
            for batch in told:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n[first : first + batch.num_rows])], [*batch.schema.names, "n"])
                first += batch.num_rows
            counts.clear()
            told.clear()

        for words in _steps(batches, params.step_bytes):
            for size, at, hi, lo in pruned.value.runs(words, params.longest):
                order = np.lexsort((hi, lo))
                first = np.ones(len(order), bool)
                first[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
                one, times, new = order[first], np.diff(np.append(np.flatnonzero(first), len(order))), []
                for k, (*key, n) in enumerate(zip(hi[one].tolist(), lo[one].tolist(), times.tolist(), strict=True)):
                    if (key := tuple(key)) in counts:
                        counts[key] += n
                    else:
                        counts[key] = n
                        new.append(k)
                if new:
                    own = one[new]
                    langs = words.langs.dictionary.take(pa.array(words.lang[at[own]]))
                    told.append(pa.RecordBatch.from_arrays([_signed(hi[own]), _signed(lo[own]), langs, words.spelled(at[own], size), pa.array(np.full(len(own), size, np.int32))], ["hi", "lo", "lang", "phrase", "size"]))
            if len(counts) > params.remembered:
                yield from emitted()
        yield from emitted()

    return run


def _counted(pruned, table, params: PhraseParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(len(table.value))
        for words in _steps(batches, params.step_bytes):
            for _, _, hi, lo in pruned.value.runs(words, params.longest):
                slots = table.value.slots(hi, lo)
                counter.add(slots[slots >= 0])
        yield from _emitted({0: counter})

    return run


def _with_counts(table, counts, least: int):
    """Candidates of a pass that count, with their count by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            a = counts.value[table.value.slots(hi, lo)]
            kept = pa.array(a >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("lang", "phrase", "size")] + [pa.array(a).filter(kept)], ["lang", "phrase", "size", "a"])

    return run


def _parts(table, counts, longest: int):
    """For each cut of a phrase, the counts of the parts that this pass's slots hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words([x.encode() for x in batch.column("phrase").to_pylist()], batch.column("lang").to_pylist())
            keys = {size: (hi, lo) for size, _, (hi, lo) in words.runs(longest)}
            length = batch.column("size").to_numpy()
            for size in range(1, longest):
                for side in ("l", "r"):
                    rows = np.flatnonzero(length > size)
                    at, cut = (words.first[rows], np.full(len(rows), size)) if side == "l" else (words.first[rows] + length[rows] - size, length[rows] - size)
                    slots = table.value.slots(*(lane[at] for lane in keys[size])) if len(rows) else np.zeros(0, np.int64)
                    rows, cut, f = rows[slots >= 0], cut[slots >= 0], counts.value[slots[slots >= 0]]
                    part = batch.take(pa.array(rows)).select(["lang", "phrase", "size", "a"])
                    none = pa.nulls(len(rows), pa.int64())
                    both = [pa.array(f), none] if side == "l" else [none, pa.array(f)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cut.astype(np.int32)), *both], ["lang", "phrase", "size", "a", "cut", "l", "r"])

    return run


def phrase_counts(docs: DataFrame, params: PhraseParams = PhraseParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (lang, n); (lang, phrase, size, a) of phrases of 1 to ``longest`` words that occur ``least`` times;
    and (lang, phrase, size, a, cut, l, r) with a row for each cut of those of two words or more.

    The tasks' arrays are bounded: a count a cell (one byte for a ``least`` up to 255) and a count a
    slot.  The driver holds the bits of the cells (10 MB at most) and one pass's keys and counts
    (24 MB at 2^20 slots), which are broadcast.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = 64 - max(16, min(24, (max(1, size // params.bytes_per_cell) - 1).bit_length()))
    held = params.longest * np.min_scalar_type(params.least).itemsize << (64 - shift)
    tasks = max(spark.sparkContext.defaultParallelism, size // max(TASK_BYTES, FAN_IN * held) + 1)
    read = read.coalesce(tasks)

    arrays = written(read.mapInArrow(lean(_cells(shift, params)), ARRAYS), "phrase-cells")
    totals = arrays.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    pruned = spark.sparkContext.broadcast(Pruned(_tree_sum(arrays.where("size > 0"), tasks, params.least), shift, params))

    found = read.mapInArrow(lean(_candidates(pruned, params)), CANDIDATES)
    summed = found.groupBy("hi", "lo").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("lang", "phrase", "size")))
    candidates = written(summed.where(F.col("n") >= params.least).drop("n"), "phrase-candidates")
    passes = candidates.count() // params.slots + 1
    phrases, tables = [], []
    for k in range(passes):
        mine = candidates.where(F.pmod("lo", F.lit(passes)) == k)
        keys = mine.select("hi", "lo").toArrow()
        table = spark.sparkContext.broadcast(PerfectHash(*(keys.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))))
        counts = np.zeros(len(table.value), np.int64)
        for _, block, data in _tree_sum(read.mapInArrow(lean(_counted(pruned, table, params)), ARRAYS), tasks, None).select("size", "block", "data").collect():
            counts[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.int64)
        tables.append((table, spark.sparkContext.broadcast(counts)))
        phrases.append(mine.mapInArrow(_with_counts(*tables[-1], params.least), "lang string, phrase string, size int, a long"))
    frequent = written(_all(phrases), "phrases")
    cut = _all([frequent.where("size > 1").mapInArrow(_parts(*t, params.longest), "lang string, phrase string, size int, a long, cut int, l long, r long") for t in tables])
    return totals, frequent, cut.groupBy("lang", "phrase", "size", "a", "cut").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def ranked(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``best`` phrases of each language.

    The score is that of the lowest cut, of equal ones of the first: floor(scale * a * n / (l * r)),
    exact in whole numbers of 38 digits.  A phrase within a longer one that occurs as often is left
    out.  Null texts are empty, null languages are one of their own; every row counts, repeated ones
    too; other columns aren't read.
    """
    totals, frequent, cuts = phrase_counts(docs, params)
    whole = "decimal(19,0)"
    product = F.lit(params.scale).cast("decimal(9,0)") * F.col("a").cast(whole) * F.col("n").cast(whole)
    scored = cuts.join(totals, "lang").select("*", product.alias("above"), (F.col("l").cast(whole) * F.col("r").cast(whole)).alias("below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("low"))

    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda at: F.array_join(F.slice(words, at, k), " "))))
    inner = frequent.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = lowest.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.best)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def duckdb_sql(params: PhraseParams = PhraseParams()) -> str:
    """``ranked`` of ``documents`` by plain grouping of all runs of words, for DuckDB."""
    return rf"""
        WITH pieces AS (
          SELECT coalesce(lang, '{UNKNOWN}') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
        runs AS (SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS pos FROM pieces, range(1, {params.longest + 1}) AS sizes(size) WHERE len(ws) >= size),
        counts AS (SELECT lang, size, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
        candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= {params.least}),
        cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
        scored AS (
          SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, c.k, CAST({params.scale} AS HUGEINT) * c.f * t.n // (CAST(l.f AS HUGEINT) * r.f) AS score
          FROM cuts c JOIN totals t USING (lang) JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:c.size], ' ')),
        lowest AS (SELECT lang, phrase, a, n, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS low FROM scored GROUP BY ALL),
        spans AS (SELECT lang, f, ws, size, unnest(range(1, size)) AS pos FROM candidates WHERE size > 2),
        inner_phrases AS (SELECT lang, array_to_string(ws[pos:pos + s - 1], ' ') AS phrase, max(f) AS longer FROM spans, range(2, {params.longest}) AS sizes(s) WHERE s < size AND pos + s - 1 <= size GROUP BY ALL),
        kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR longer < a),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY low.score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, low.l AS l, low.r AS r, CAST(n AS BIGINT) AS n, CAST(low.score AS BIGINT) AS score FROM placed WHERE rank <= {params.best}"""
