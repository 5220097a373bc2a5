"""Benchmark decontamination by CGK walks and bit sampling (operator 1).

The walk of Chakraborty, Goldenberg and Koucky embeds a sequence of words into one of equal length
for all: at each step it emits the word under its pointer, and a hash of word and step decides
whether the pointer moves on.  Sequences of few edits give embeddings of small Hamming distance,
since walks that an edit has parted soon meet again.  Each repetition takes another walk, starts
it at every word of a document, so that a window as long as the item begins there, and samples a
few of its steps; the words at the sampled steps are the key under which an item's own walk was
filed.  Repetitions follow from the recall that is asked for.  Found windows are filtered by how
many words of the item they hold, and verified by the exact word edit distance.

Two things keep this cheap.  An edit breaks two pairs of neighbouring words at most, so a window of
fewer known pairs than the edits must leave holds no item, and walks begin elsewhere only.  And
walks that meet stay together, so they are followed as groups of which fewer and fewer remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, sliced, written
from .tokens import mix, words

_U = np.uint64


@dataclass(frozen=True)
class CgkParams:
    """Similarity is 1 - edits / words of the item.

    ``survival`` is the share of windows with as many edits as allowed that keep the key of a
    repetition: measured as 0.25 and more, for 5 to 60 words, where edits are scattered evenly,
    and far more where they lie together or are fewer.
    """

    similarity: float = 0.8
    recall: float = 0.998
    survival: float = 0.25
    #: sampled steps of a key, and the stretch of the walk that they come from
    samples: int = 3
    stretch: int = 10
    #: items of more words are filed in parts, one of which has its share of the edits or fewer
    longest: int = 60
    min_words: int = 1
    items_per_block: int = 4000
    bytes_per_block: int = 8 << 20

    def edits(self, n: int) -> int:
        """Edits that an item of n words may have."""
        return int((1 - self.similarity) * n + 1e-9)

    @property
    def repetitions(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.survival))


@dataclass
class _Keys:
    """What a repetition looks up for the items of about one length."""

    steps: tuple[int, ...]
    #: after each sampled step but the last: which words, or words so far, go on
    tables: list[np.ndarray]
    #: keys in order, their items, and the word of the item that the first sampled step sees
    keys: np.ndarray
    item: np.ndarray
    at: np.ndarray


@dataclass
class _Index:
    items: list[tuple[int, np.ndarray]]
    lengths: np.ndarray
    edits: np.ndarray
    repetitions: list[list[_Keys]]
    #: by classes of lengths: words of a window, and the neighbouring words of items that it holds at least
    windows: list[tuple[int, int]]
    #: the neighbouring words, and the items of one word
    neighbours: np.ndarray
    single: np.ndarray
    #: which pairs of an item and one of its words occur, and their keys in order
    pairs: np.ndarray
    pair_keys: np.ndarray


_FOLD = _U(0xD6E8FEB86659FD93)
#: Words around places that one vectorised step works on.
_STEP = 1 << 18


def _join(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((key ^ (key >> _U(29))) * _FOLD + word)


def _table(keys: np.ndarray, slots: int = 16) -> np.ndarray:
    """A set of slots, one bit each, so many for each key."""
    bits = max(10, int(len(keys) * slots - 1).bit_length())
    table = np.zeros(1 << bits, dtype=bool)
    table[(keys >> _U(64 - bits)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little")


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = (keys >> _U(64 - int(len(table) * 8 - 1).bit_length())).astype(np.int64)
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _pair_keys(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(_join(mix(item.astype(np.uint64) + _U(1)), word))


def _spread(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _stretches(n: np.ndarray) -> Iterator[slice]:
    """Parts of about ``_STEP`` in sum; a single larger number is a part of its own."""
    total, start = np.cumsum(n), 0
    while start < len(n):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + _STEP, "right")))
        yield slice(start, stop)
        start = stop


def walks(hashes: np.ndarray, first: np.ndarray, steps: list[int], repetition: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By step: where the walks from the words ``first`` are, as groups (least start, pointer) of those that have met.

    The walks stop at the last word.  ``first`` and ``steps`` ascend.
    """
    start, at, out = np.arange(len(first), dtype=np.int32), first.astype(np.int32), {}
    wanted, last = set(steps), len(hashes) - 1
    coins, eight = hashes, np.zeros(0, dtype=np.uint8)
    for t in range(steps[-1] + 1 if len(first) else 0):
        if t in wanted:
            out[t] = start, np.minimum(at, last)
        if t % 64 == 0:
            coins = mix(hashes ^ mix(np.array([repetition * 4096 + t // 64 + 1], dtype=np.uint64)))
        if t % 8 == 0:  # the coins of the next steps, none at the end
            eight = np.append((coins >> _U(t % 64)).astype(np.uint8), np.zeros(1, dtype=np.uint8))
            np.minimum(at, last + 1, out=at)
        at = at + ((eight[at] >> np.uint8(t % 8)) & np.uint8(1))
        if t % 4 == 3:
            apart = np.ones(len(at), dtype=bool)
            np.not_equal(at[1:], at[:-1], out=apart[1:])
            start, at = start[apart], at[apart]
    return out


def _sampled(size: int, repetition: int, p: CgkParams) -> tuple[int, ...]:
    """Steps that a repetition samples for items of ``size`` words: the pointer is still within the item there, mostly."""
    rng = np.random.default_rng([size, repetition])
    samples = min(p.samples, size)
    whole = max(samples, int(1.5 * size))
    stretch = min(p.stretch, whole)
    begin = int(rng.integers(whole - stretch + 1))
    return tuple(sorted((begin + rng.choice(stretch, samples, replace=False)).tolist()))


def _class(n: np.ndarray) -> np.ndarray:
    """Lengths of a class differ by a sixth at most."""
    return np.floor(np.log(n + 1e-9) / math.log(1.15)).astype(np.int64)


def _build(items: list[tuple[int, np.ndarray]], p: CgkParams) -> _Index:
    lengths = np.array([len(w) for _, w in items], dtype=np.int64)
    edits = np.array([p.edits(len(w)) for _, w in items], dtype=np.int64)
    # parts of nearly equal length, by the least length of their class
    count = -(-lengths // p.longest)
    whole = np.repeat(np.arange(len(items)), count)
    part = _spread(count)
    begin, stop = lengths[whole] * part // count[whole], lengths[whole] * (part + 1) // count[whole]
    size = np.ceil(1.15 ** _class(stop - begin) - 1e-6).astype(np.int64)
    end = np.zeros(1, dtype=np.uint64)
    every = np.concatenate([x for _, w in items for x in (w, end)])
    offset = np.cumsum(lengths + 1) - (lengths + 1)
    rows = {int(x): (whole[size == x], begin[size == x], (stop - begin)[size == x]) for x in np.unique(size)}
    repetitions = []
    for r in range(p.repetitions):
        own, sampled = [], {size: _sampled(size, r, p) for size in rows}
        for size, (item, a, n) in rows.items():
            steps = sampled[size]
            order = np.argsort(offset[item] + a, kind="stable")
            first = (offset[item] + a)[order]
            seen = walks(every, first, list(steps), r)
            at = [w[np.searchsorted(s, np.arange(len(first)), "right") - 1] for s, w in (seen[t] for t in steps)]
            inside = (at[-1] - first) < n[order]
            item_, word = item[order][inside], [every[x[inside]] for x in at]
            key, tables = word[0], []
            for x in word[1:]:
                tables.append(_table(np.unique(key)))
                key = _join(key, x)
            by = np.argsort(key, kind="stable")
            if len(by):
                own.append(_Keys(steps, tables, key[by], item_[by], (at[0][inside] - offset[item_])[by]))
        repetitions.append(own)
    windows = []
    for c in np.unique(_class(lengths)):
        own = (_class(lengths) == c) & (lengths > 1)
        if own.any():
            windows.append((int((lengths + edits)[own].max()), int((lengths - 1 - 2 * edits)[own].min())))
    neighbours = np.unique(np.concatenate([_join(w[:-1], w[1:]) for _, w in items]))
    single = np.unique(np.concatenate([w for _, w in items if len(w) == 1] or [end[:0]]))
    pairs = np.unique(_pair_keys(np.repeat(np.arange(len(items)), lengths), np.concatenate([w for _, w in items])))
    return _Index(items, lengths, edits, repetitions, windows, _table(neighbours, 64), single, _table(pairs), pairs)


def _live(index: _Index, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the runs of all windows that can hold an item."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    known = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(_marked(index.neighbours, _join(hashes[:-1], hashes[1:])), out=known[1:n])
    known[n] = known[n - 1]
    change = np.zeros(n + 1, dtype=np.int32)
    for size, least in index.windows:
        size = min(size, n)
        # of a window of so many words, one pair less
        begin = np.flatnonzero(known[size - 1 : n] - known[: n - size + 1] >= least)
        change[begin] += 1
        change[begin + size] -= 1
    live = np.cumsum(change[:-1]) > 0
    if len(index.single):
        live |= np.isin(hashes, index.single)
    edge = np.diff(live.astype(np.int8), prepend=0, append=0)
    cut = bounds[(bounds > 0) & (bounds < n)]
    cut = np.unique(cut[live[cut] & live[cut - 1]])  # a run ends where its text does
    return np.sort(np.concatenate([np.flatnonzero(edge > 0), cut])), np.sort(np.concatenate([np.flatnonzero(edge < 0), cut]))


def _found(index: _Index, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items, a word of theirs, and the word where they would begin (before the text even), of all keys that agree."""
    everywhere = np.arange(len(hashes))
    for r, classes in enumerate(index.repetitions):
        if not classes:
            continue
        seen = walks(hashes, everywhere, sorted({t for c in classes for t in c.steps}), r)
        for c in classes:
            start, where = seen[c.steps[0]]
            key = hashes[where]
            for t, table in zip(c.steps[1:], c.tables, strict=True):
                live = np.flatnonzero(_marked(table, key))
                start, where = start[live], where[live]
                s, w = seen[t]
                key = _join(key[live], hashes[w[np.searchsorted(s, start, "right") - 1]])
            low = np.searchsorted(c.keys, key, "left")
            n = np.searchsorted(c.keys, key, "right") - low
            low, where, n = low[n > 0], where[n > 0], n[n > 0]
            for part in _stretches(n):
                entry = np.repeat(low[part], n[part]) + _spread(n[part])
                yield c.item[entry], np.repeat(where[part], n[part]), np.repeat(where[part], n[part]) - c.at[entry]


def _promising(index: _Index, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which regions hold as many words of their item as the allowed edits must leave."""
    out = np.zeros(len(item), dtype=bool)
    for part in _stretches(hi - lo):
        n = (hi - lo)[part]
        region = np.repeat(np.arange(len(n)), n)
        keys = _pair_keys(np.repeat(item[part], n), hashes[np.repeat(lo[part], n) + _spread(n)])
        maybe = np.flatnonzero(_marked(index.pairs, keys))
        known = index.pair_keys[np.minimum(np.searchsorted(index.pair_keys, keys[maybe]), len(index.pair_keys) - 1)] == keys[maybe]
        out[part] = np.bincount(region[maybe[known]], minlength=len(n)) >= (index.lengths - index.edits)[item[part]]
    return out


def _regions(index: _Index, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(run, item, first word, end word) wherever an item can lie; regions of a run and item that touch are one."""
    found: list[np.ndarray] = []
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for item, where, begin in _found(index, hashes):
        # windows that begin at the same word are one
        text = owner[where] * len(index.items) + item
        _, once = np.unique((text << 32) + begin + (1 << 31), return_index=True)
        item, doc, begin = item[once], owner[where[once]], begin[once]
        lo = np.maximum(bounds[doc], begin - index.edits[item])
        hi = np.minimum(bounds[doc + 1], begin + index.lengths[item] + index.edits[item])
        fits = hi - lo >= (index.lengths - index.edits)[item]
        rows = np.stack([doc, item, lo, hi], axis=1)[fits]
        found.append(rows[_promising(index, hashes, rows[:, 2], rows[:, 3], rows[:, 1])])
    out: list[tuple[int, int, int, int]] = []
    for d, i, lo, hi in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
        if out and out[-1][:2] == (d, i) and lo <= out[-1][3]:
            out[-1] = (d, i, out[-1][2], max(hi, out[-1][3]))
        else:
            out.append((d, i, lo, hi))
    return out


def fitting_distance(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least word edits between the pattern and any part of the region, and where that part ends.

    Bit-parallel: one word of the region a step, one bit a word of the pattern.
    """
    m = len(pattern)
    match: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        match[x] = match.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, x in enumerate(region.tolist()):
        eq = match.get(x, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        hp, hn = (down | ~(d0 | up)) & full, up & d0
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = hp << 1, hn << 1
        up, down = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if score < best:
            best, end = score, j + 1
    return best, end


_FOUND = "doc_id long, item_id long, edits int, item_words int, end_word long"


#: Words of the runs that are searched at once.
_AT_ONCE = 1 << 17


def _search(index: _Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[object, int, np.ndarray]] = []
        held = 0
        for batch in sliced(batches, "text"):
            w = words(batch.column("text"))
            first, end = _live(index, w.hashes, w.bounds)
            doc = np.searchsorted(w.bounds, first, "right") - 1
            ids = batch.column("doc_id").take(pa.array(doc)).to_pylist()
            pending += [(x, int(a - w.bounds[d]), w.hashes[a:b].copy()) for x, d, a, b in zip(ids, doc, first, end, strict=True)]
            held += int((end - first).sum())
            if held >= _AT_ONCE:
                yield from _verified(index, pending)
                pending, held = [], 0
        if pending:
            yield from _verified(index, pending)

    return run


def _verified(index: _Index, runs: list[tuple[object, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of the items that the runs (doc_id, first word, words) hold, by their exact distance."""
    hashes = np.concatenate([w for _, _, w in runs])
    bounds = np.concatenate([[0], np.cumsum([len(w) for _, _, w in runs])])
    rows = []
    for r, i, lo, hi in _regions(index, hashes, bounds):
        edits, end = fitting_distance(index.items[i][1], hashes[lo:hi])
        if edits <= index.edits[i]:
            rows.append((runs[r][0], index.items[i][0], edits, len(index.items[i][1]), runs[r][1] + lo + end - int(bounds[r])))
    if rows:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "edits", "item_words", "end_word"])


def leaks(docs: DataFrame, items: DataFrame, params: CgkParams = CgkParams()) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds the item but for 20 % of its words.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read.
    An item that a document holds with the most edits allowed is found with the probability
    ``recall`` or more, one with fewer edits nearly always.  Items of fewer than five words allow no
    edit.  Items of fewer than ``min_words`` words, null or empty items, and documents with null
    text or null doc_id match nothing.  Rows with the same doc_id give one row per item with the
    least edits; ties keep the first place.  Items go in blocks of about ``items_per_block`` rows
    and ``bytes_per_block`` bytes, which bounds what is sent to the tasks however large the
    benchmark is; each block is one pass over the documents without a shuffle, and only found pairs
    are aggregated.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").dropDuplicates()
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-total["n"] // params.items_per_block), -(-total["bytes"] // params.bytes_per_block))
    found = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = part.collect()
        w = words(pa.array([r.text for r in rows], pa.string()))
        known = [(r.item_id, w.hashes[w.bounds[k] : w.bounds[k + 1]]) for k, r in enumerate(rows) if w.bounds[k + 1] - w.bounds[k] >= params.min_words]
        if known:
            own = docs.mapInArrow(lean(_search(_build(known, params))), _FOUND)
            found = own if found is None else found.unionAll(own)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end_word", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.edits", "b.item_words", "b.end_word", F.round(1 - F.col("b.edits") / F.col("b.item_words"), 6).alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, params: CgkParams = CgkParams()) -> DataFrame:
    """The documents that hold no benchmark item; rows with a null doc_id or text stay.

    The found doc_ids are written first, so that Spark chooses the join by their real size.
    """
    found = written(leaks(docs, items, params).select("doc_id").distinct(), "leaking")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
