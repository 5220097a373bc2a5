"""Word by word alignment of two texts: edit distance, operations, and pooled measures of readings.

A pair of texts is one row.  Runs of three words that either text holds once are anchors; their
longest increasing chain cuts the pair into gaps, and only the gaps are compared, within a band that
grows with the edits found.  The sum is the distance if the words that only one side has ask for as
much; else the whole pair is compared, in halves where its band is too large to keep.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import words
from .tables import paired_counts, parts

EQUAL, REPLACE, DELETE, INSERT = "equal", "replace", "delete", "insert"


def _numbered(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    place: dict[str, int] = {}
    return tuple(np.array([place.setdefault(w, len(place)) for w in x], np.int64) for x in (a, b))


def banded(a: np.ndarray, b: np.ndarray, most: int, keep: bool = True) -> tuple[int, np.ndarray | None] | None:
    """Edit distance of two sequences if it is ``most`` or less, and each row's band of costs if ``keep``; else null.

    Row i holds the costs of the first i words of ``a`` against the first i - most to i + most of ``b``.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    width, far = 2 * most + 1, n + m + 1
    shift = np.arange(width)
    rows = np.empty((n + 1 if keep else 2, width), np.int64)
    rows[0] = np.where((shift >= most) & (shift <= m + most), shift - most, far)
    # the word before column j of row i stands at j + most
    padded = np.concatenate([np.full(most + 1, -1), b, np.full(n + most + 1, -1)])
    for i in range(1, n + 1):
        above, row = (rows[i - 1], rows[i]) if keep else (rows[(i - 1) & 1], rows[i & 1])
        np.not_equal(padded[i : i + width], a[i - 1], out=row, casting="unsafe")
        row += above
        np.minimum(row[:-1], above[1:] + 1, out=row[:-1])
        first, last = most - i, m - i + most  # places of the columns 0 and m
        if first >= 0:
            row[:first] = far
            row[first] = i
        row -= shift
        np.minimum.accumulate(row, out=row)
        row += shift
        if last + 1 < width:
            row[last + 1 :] = far
    found = int((rows[n] if keep else rows[n & 1])[m - n + most])
    return (found, rows if keep else None) if found <= most else None


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """A bound under the distance: the larger number of words that one side has more often."""
    values, sides = np.concatenate([a, b]), np.repeat([1, -1], [len(a), len(b)])
    more = np.bincount(np.unique(values, return_inverse=True)[1], sides)
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def _walk(a: np.ndarray, b: np.ndarray, rows: np.ndarray, most: int) -> list[tuple[str, int, int]]:
    """One operation a word, from the last to the first of a filled band; of equal ways a kept or replaced word first, then a deleted one."""
    i, j, out = len(a), len(b), []
    cost = lambda i, j: int(rows[i, j - i + most]) if 0 <= j - i + most < rows.shape[1] else 1 << 30
    while i or j:
        here = cost(i, j)
        if i and j and cost(i - 1, j - 1) + int(a[i - 1] != b[j - 1]) == here:
            out.append((EQUAL if a[i - 1] == b[j - 1] else REPLACE, i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and cost(i - 1, j) + 1 == here:
            out.append((DELETE, i - 1, j))
            i -= 1
        else:
            out.append((INSERT, i, j - 1))
            j -= 1
    return out[::-1]


def _anchors(a: np.ndarray, b: np.ndarray, size: int = 3) -> list[tuple[int, int]]:
    """Places (i, j) of runs that either sequence holds once, as many as go forward in both."""

    def once(x: np.ndarray) -> dict[tuple, int]:
        runs = list(zip(*(x[k:].tolist() for k in range(size)), strict=False))
        times = Counter(runs)
        return {r: k for k, r in enumerate(runs) if times[r] == 1}

    left, right = once(a), once(b)
    pairs = sorted((k, right[r]) for r, k in left.items() if r in right)
    ends, tails, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[k] = tails[at - 1] if at else -1
        ends[at : at + 1], tails[at : at + 1] = [j], [k]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


#: Cells of the largest band that is kept; beyond it a gap is halved.
CELLS = 1 << 22


def _last_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of all of ``a`` against each beginning of ``b``."""
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for x in a:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != x))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[int, list[tuple[str, int, int]]]:
    """Distance and operations within bands of more and more edits; where the band gets too large, the halves of ``a`` against the best cut of ``b``."""
    if not len(a) or not len(b):
        return len(a) + len(b), [(DELETE, i, 0) for i in range(len(a))] + [(INSERT, len(a), j) for j in range(len(b))]
    most = max(8, _least(a, b))
    while len(a) == 1 or (len(a) + 1) * (2 * most + 1) <= CELLS:
        if (found := banded(a, b, most)) is not None:
            return found[0], _walk(a, b, found[1], most)
        most = min(2 * most, len(a) + len(b))
    half = len(a) // 2
    at = int(np.argmin(_last_costs(a[:half], b) + _last_costs(a[:half - 1 : -1] if half else a[::-1], b[::-1])[::-1]))
    (left, first), (right, rest) = _gap(a[:half], b[:at]), _gap(a[half:], b[at:])
    return left + right, first + [(op, i + half, j + at) for op, i, j in rest]


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of words: each word of ``b`` is some operations on numbers of as many bits as ``a`` has words (Myers, Hyyrö)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    top, full = 1 << len(a) - 1, (1 << len(a)) - 1
    # bits tell where the cost rises (up) or falls (down) from one word of a to the next
    up, down, cost = full, 0, len(a)
    for w in b:
        here = places.get(w, 0)
        same = ((here & up) + up ^ up | here | down) & full
        right, left = down | full ^ (same | up), same & up
        cost += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full ^ (same | right), right & same
    return cost


def aligned(a: list[str], b: list[str]) -> tuple[int, list[tuple[str, int, int]]]:
    """Edit distance of two lists of words, and one operation a word with its place in either."""
    x, y = _numbered(a, b)
    parts, i, j = [], 0, 0
    for at, to in [*_anchors(x, y), (len(x), len(y))]:
        if at < i or to < j:
            continue  # within the anchor before
        cost, ops = _gap(x[i:at], y[j:to])
        parts.append((cost, [(op, i + p, j + q) for op, p, q in ops]))
        i, j = at, to
        while i < len(x) and j < len(y) and x[i] == y[j]:
            parts.append((0, [(EQUAL, i, j)]))
            i, j = i + 1, j + 1
    if i < len(x) or j < len(y):  # the last anchor's words ran to the end of one side
        cost, ops = _gap(x[i:], y[j:])
        parts.append((cost, [(op, i + p, j + q) for op, p, q in ops]))
    total = sum(c for c, _ in parts)
    if total > _least(x, y) and distance(a, b) < total:  # there is a cheaper way
        return _gap(x, y)
    return total, [op for _, ops in parts for op in ops]


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        found = [aligned(t or [], o or []) for t, o in zip(batch.column("t").to_pylist(), batch.column("o").to_pylist(), strict=True)]
        ops = [Counter(op for op, _, _ in own) for _, own in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([d for d, _ in found], pa.int64()), *(pa.array([c[op] for c in ops], pa.int64()) for op in (REPLACE, DELETE, INSERT))], ["key", "edits", "replaced", "deleted", "inserted"]
        )


def word_edits(pages: DataFrame) -> DataFrame:
    """(key, edits, replaced, deleted, inserted) of (key, truth, output) rows: the least edits that make the output's words of the truth's.

    Of several cheapest alignments one is taken, so only ``edits`` doesn't depend on the choice.  Null
    texts are empty.  A row is compared by itself, without a shuffle.
    """
    both = pages.select(F.col("key").cast("long").alias("key"), words(F.col("truth")).alias("t"), words(F.col("output")).alias("o"))
    return both.mapInArrow(_distances, "key long, edits long, replaced long, deleted long, inserted long")


def invented(output: list[str], truth: set[str], run: int = 3) -> int:
    """Words of the output in runs of ``run`` or more that the truth doesn't hold at all."""
    marks = "".join(" " if w in truth else "x" for w in output)
    return sum(len(part) for part in marks.split() if len(part) >= run)


def lines_found(lines: list[list[str]], output: set[str], share: float = 0.5) -> int:
    """Lines (their words) of which the output holds ``share`` of the words."""
    return sum(sum(w in output for w in line) >= share * len(line) for line in lines)


def _measured(ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for t, o, lines in zip(*(batch.column(c).to_pylist() for c in ("t", "o", "lines")), strict=True):
                rows.append((distance(t, o) if ordered else None, invented(o, set(t)), lines_found(lines, set(o))))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in columns)], ["key", "ordered_errors", "invented", "lines_found"])

    return run


def word_distances(pages: DataFrame) -> DataFrame:
    """(key, truth_words, ordered_errors) of ``reading_measures`` alone, by row and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            both = list(zip(batch.column("t").to_pylist(), batch.column("o").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array([len(t) for t, _ in both], pa.int64()), pa.array([distance(t, o) for t, o in both], pa.int64())], [*by, "truth_words", "ordered_errors"])

    by = [c for c in pages.columns if c not in ("truth", "output")]
    truth, output = F.coalesce("truth", F.lit("")), F.coalesce("output", F.lit(""))
    both = pages.select(*by, words(truth).alias("t"), words(output).alias("o"))
    return both.mapInArrow(run, ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in by) + ", truth_words long, ordered_errors long")


def reading_measures(pages: DataFrame, ordered: bool = True) -> DataFrame:
    """One row a page (key, truth, output): words, bag and ordered errors, identifiers, invented words, loop, lines and lines found.

    Bag errors are the larger of missed and added words.  An identifier is a word of four letters or
    more of which half at least are digits.  A loop counts where the truth has none.  Keys are unique;
    null texts are empty.  Without ``ordered`` there are no ordered errors, and words aren't aligned.
    """
    from .evaluation import has_loop

    truth, output = F.coalesce("truth", F.lit("")), F.coalesce("output", F.lit(""))
    lines = F.filter(F.transform(F.split(truth, r"\r\n|[\r\n]"), lambda x: words(x)), lambda w: F.size(w) > 0)
    own = pages.select(F.col("key").cast("long").alias("key"), words(truth).alias("t"), words(output).alias("o"), lines.alias("lines"), (has_loop(output) & ~has_loop(truth)).alias("loop"))
    plain = own.select("key", F.size("t").cast("long").alias("truth_words"), F.size("o").cast("long").alias("output_words"), F.size("lines").cast("long").alias("lines"), "loop")
    measured = own.select("key", "t", "o", "lines").mapInArrow(_measured(ordered), "key long, ordered_errors long, invented long, lines_found long")
    both = paired_counts(pages.select(F.col("key").cast("long").alias("key"), "truth", "output"), words(truth), words(output))
    digits = F.length(F.regexp_replace("word", r"[^\p{Nd}]", ""))
    identifier = (F.length("word") >= 4) & (digits > 0) & (2 * digits >= F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]", "")))
    shared, ids = F.least("t", "o"), lambda c: F.sum(F.when(identifier, c).otherwise(0))
    sums = both.groupBy("key").agg(F.greatest(F.sum("t") - F.sum(shared), F.sum("o") - F.sum(shared)).alias("bag_errors"), ids(F.col("t")).alias("ids"), ids(shared).alias("ids_found"))
    out = plain.join(sums, "key", "left").join(measured, "key")
    return (out if ordered else out.drop("ordered_errors")).na.fill(0)


def order() -> Column:
    """Share of all words in order."""
    return F.greatest(F.lit(0.0), 1 - _ratio("ordered_errors", "truth_words")).alias("ordered")


def _ratio(a: str, b: str) -> Column:
    return F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 6)


def pooled(measures: DataFrame, by: str) -> DataFrame:
    """Measures of all pages of a group taken together: shares of words, order, identifiers and lines, of invented words, and the number of loops."""
    ratio = _ratio
    ordered = [order()] if "ordered_errors" in measures.columns else []
    return measures.groupBy(by).agg(
        F.count("*").alias("pages"), F.sum("truth_words").alias("truth_words"), (1 - ratio("bag_errors", "truth_words")).alias("words"), *ordered,
        ratio("ids_found", "ids").alias("ids"), ratio("invented", "output_words").alias("invented"), F.count_if("loop").alias("loops"), ratio("lines_found", "lines").alias("lines"),
    )
