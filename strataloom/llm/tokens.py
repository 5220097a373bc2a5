"""Words of a batch of texts as 64-bit hashes, without a Python loop over words.

A word is a run of letters and digits of the lower-cased text.  All bytes of non-ASCII
characters count as letters, but for the Latin-1 signs and general punctuation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_POWERS: list[np.ndarray] = []
_PART = _KEPT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; those for very long texts are not kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, _KEPT), base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= _KEPT:
        _POWERS[:] = out
    return out


@dataclass
class Words:
    """Words of all texts in order; text i owns words bounds[i]:bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes of all texts (null: empty), and the offset of each text."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    data, offsets = lowered(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), none, none, data, offsets)
    mask = _WORD[data]
    signs = np.flatnonzero(data == 0xC2)
    if len(signs):
        mask[signs] = False
        mask[np.minimum(signs + 1, n - 1)] = False
    marks = np.flatnonzero(data[:-1] == 0xE2)
    marks = marks[(data[marks + 1] == 0x80) | (data[marks + 1] == 0x81)]
    for k in range(3 if len(marks) else 0):
        mask[np.minimum(marks + k, n - 1)] = False
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    starts = np.flatnonzero(mask & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(mask & ~(after & ~edge[1:])) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):  # the words of about _PART bytes at a time, so that a very long text needs no wide sums
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PART, "right")))
        lo, hi = starts[first], ends[last - 1]
        power, inverse = _powers(hi - lo)
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((data[lo:hi] + _U(1)) * power[: hi - lo], out=sums[1:])
        hashes[first:last] = mix((sums[ends[first:last] - lo] - sums[starts[first:last] - lo]) * inverse[starts[first:last] - lo])
        first = last
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the bounds of each text.

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(w.bounds)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(counts)), n)
    first = w.bounds[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
    last = w.bounds[1:][owner]
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        at = first + k
        inside = at < last
        out = np.where(inside, (out ^ w.hashes[np.minimum(at, max(len(w.hashes) - 1, 0))]) * _BASE + _U(k + 1), out) if len(w.hashes) else out
    return mix(out), bounds
