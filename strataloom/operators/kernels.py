"""Numeric and sequential kernels of text recognition: language model, CTC, voting, reading order.

The corpus-wide counting is DataFrame work; the kernels themselves see one line or page each.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _grams(order: int, letters: int = 1 << 20):
    """(g, n): the grams that end at each character of the texts, counted for a stretch of so many letters at a time."""

    def counted(text: str) -> pa.RecordBatch:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alphabet, code = np.unique(codes, return_inverse=True)
        size = len(codes) - order + 1
        gram = code[:size].astype(np.int64)
        for k in range(1, order):  # renumbered, so that no order overflows
            gram = np.unique(gram * len(alphabet) + code[k : k + size], return_inverse=True)[1]
        _, first, n = np.unique(gram, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + order] for i in first.tolist()], pa.string()), pa.array(n, pa.int64())], ["g", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py() or ""
                for at in range(0, len(text), letters):
                    before = text[max(0, at - order + 1) : at]
                    yield counted("^" * (order - 1 - len(before)) + before + text[at : at + letters])

    return run


def witten_bell(texts: DataFrame, order: int = 3) -> DataFrame:
    """(context, char, p): interpolated Witten-Bell probabilities of characters after up to order - 1 others.

    p(c | h) = (n(hc) + t(h) p(c | shorter h)) / (n(h) + t(h)), where t(h) is the number of
    different characters seen after h.  Contexts of one length are one join on the shorter ones.
    """
    # a text is cut once, in time proportional to its length; taking each gram from its beginning would be quadratic
    grams = texts.select("text").mapInArrow(_grams(order), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")  # read once for each length of contexts, twice
    out = None
    for size in range(1, order + 1):
        cut = grams.select(F.substring("g", order - size + 1, size - 1).alias("context") if size > 1 else F.lit("").alias("context"), F.substring("g", order, 1).alias("char"), "n").groupBy("context", "char").agg(F.sum("n").alias("n"))
        total = cut.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        rows = cut.join(total, "context")
        if size == 1:
            level = rows.select("context", "char", (F.col("n") / F.col("total")).alias("p"))
        else:
            shorter = level.select(F.col("context").alias("short"), "char", F.col("p").alias("q"))
            level = rows.withColumn("short", F.expr("substring(context, 2)")).join(shorter, ["short", "char"]).select("context", "char", ((F.col("n") + F.col("types") * F.col("q")) / (F.col("total") + F.col("types"))).alias("p"))
        out = level if out is None else out.unionAll(level)
    return out


def greedy_ctc(frames: list[list[float]], chars: list[str]) -> str:
    """The best character of each frame, repeats merged and blanks (index 0) dropped."""
    out, last = [], 0
    for frame in frames:
        best = max(range(len(frame)), key=frame.__getitem__)
        if best and best != last:
            out.append(chars[best])
        last = best
    return "".join(out)


def beam_ctc(frames: list[list[float]], chars: list[str], score=None, width: int = 8, alpha: float = 0.3, beta: float = 2.0, prune: float = 1e-3, top: int = 12) -> str:
    """Prefix beam search; ``score(prefix, char)`` is a language model's log probability."""
    beams: dict[str, tuple[float, float]] = {"": (1.0, 0.0)}
    extra: dict[str, float] = {"": 0.0}
    for frame in frames:
        best = sorted((i for i in range(len(frame)) if frame[i] >= prune), key=lambda i: -frame[i])[:top]
        new: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for prefix, (blank, other) in beams.items():
            for i in best:
                p = frame[i]
                if i == 0:
                    new[prefix][0] += (blank + other) * p
                elif prefix and chars[i] == prefix[-1]:
                    new[prefix][1] += other * p
                    new[prefix + chars[i]][1] += blank * p
                    extra.setdefault(prefix + chars[i], extra[prefix] + (alpha * score(prefix, chars[i]) if score else 0.0))
                else:
                    new[prefix + chars[i]][1] += (blank + other) * p
                    extra.setdefault(prefix + chars[i], extra[prefix] + (alpha * score(prefix, chars[i]) if score else 0.0))
        weight = lambda x: math.log(sum(new[x]) + 1e-300) + extra[x] + (beta * math.log(len(x) + 1) if score else 0.0)  # noqa: B023, E731
        beams = {x: tuple(new[x]) for x in sorted(new, key=lambda x: (-weight(x), x))[:width]}
    return next(iter(beams))


def decode(lines: DataFrame, chars: list[str], beam: bool = False) -> DataFrame:
    """(key, text) of (key, frames) rows, frames being an array of probability arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = beam_ctc if beam else greedy_ctc
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "text": [f([list(map(float, p)) for p in x], chars) for x in frame["frames"]]})

    return lines.select("key", "frames").mapInPandas(run, "key long, text string")


def vote_words(readings: list[str], pivot: int = 0) -> str:
    """Majority of aligned words; a missing word is a vote for nothing, ties go to the pivot.

    Readings of under 0.3 of the median length don't vote.
    """
    voices = [r.split() for r in readings]
    sizes = sorted(map(len, voices))
    median = sizes[len(sizes) // 2]
    base = voices[pivot]
    votes: list[Counter] = [Counter([w]) for w in base]
    inserted: list[Counter] = [Counter() for _ in range(len(base) + 1)]
    count = 1
    for n, voice in enumerate(voices):
        if n == pivot or len(voice) < 0.3 * median:
            continue
        count += 1
        for op, a, b, c, d in difflib.SequenceMatcher(None, base, voice, autojunk=False).get_opcodes():
            if op == "insert":
                inserted[a][" ".join(voice[c:d])] += 1
                continue
            for k in range(a, b):
                votes[k][voice[c + k - a] if op != "delete" and c + k - a < d else ""] += 1
    out = []
    for k in range(len(base) + 1):
        out += [w for w, n in inserted[k].most_common(1) if 2 * n > count]
        if k < len(base):
            most = max(votes[k].values())
            out.append(base[k] if votes[k][base[k]] == most else min(w for w, n in votes[k].items() if n == most))
    return " ".join(w for w in out if w)


def vote(readings: DataFrame) -> DataFrame:
    """(key, text) of (key, voice, text) rows: the readings of a page, of which there are a few, vote."""
    gathered = readings.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("voice", "text"))).alias("r"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "text": [vote_words([x["text"] or "" for x in r]) for r in frame["r"]]})

    return gathered.mapInPandas(run, "key long, text string")


def reading_order(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Order of line boxes (x0, y0, x1, y1): a clear gutter parts columns, lines that cross it cut bands."""
    if not boxes:
        return []

    def rows(own: list[int]) -> list[int]:
        return sorted(own, key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, boxes[i][0], i))

    def order(own: list[int]) -> list[int]:
        if len(own) < 12:
            return rows(own)
        left, right = min(boxes[i][0] for i in own), max(boxes[i][2] for i in own)
        best = None
        for k in range(20, 81):
            x = left + (right - left) * k / 100
            a = [i for i in own if boxes[i][2] <= x]
            b = [i for i in own if boxes[i][0] >= x]
            cross = len(own) - len(a) - len(b)
            need = max(6, 0.2 * len(own))
            wide = lambda side, width: sorted(boxes[i][2] - boxes[i][0] for i in side)[len(side) // 2] >= 0.7 * width
            if cross <= 0.1 * len(own) and len(a) >= need and len(b) >= need and wide(a, x - left) and wide(b, right - x) and (best is None or cross < best[0]):
                best = cross, x
        if best is None:
            return rows(own)
        x = best[1]
        crossing = rows([i for i in own if boxes[i][0] < x < boxes[i][2]])
        out, rest = [], [i for i in own if i not in set(crossing)]
        for c in [*crossing, None]:
            band = rest if c is None else [i for i in rest if boxes[i][1] < boxes[c][1]]
            rest = [i for i in rest if i not in set(band)]
            out += order([i for i in band if boxes[i][2] <= x]) + order([i for i in band if boxes[i][2] > x])
            out += [] if c is None else [c]
        return out

    return order(list(range(len(boxes))))


def ordered_pages(lines: DataFrame) -> DataFrame:
    """(key, text) of (key, line, x0, y0, x1, y1, text) rows; a page has a bounded number of lines."""
    pages = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "x0", "y0", "x1", "y1", "text"))).alias("l"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for page in frame["l"]:
                at = reading_order([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in page])
                texts.append("\n".join(page[i]["text"] for i in at))
            yield pd.DataFrame({"key": frame["key"], "text": texts})

    return pages.mapInPandas(run, "key long, text string")


def without_tail_loop(text: str, longest: int = 200, times: int = 5, least: int = 100, size: int = 8000) -> str:
    """A long generated text without the unit that it repeats at its end."""
    if len(text) < size:
        return text
    for unit in range(1, longest + 1):
        tail, n = text[-unit:], 1
        while text.endswith(tail * (n + 1)) and (n + 1) * unit <= len(text):
            n += 1
        if n >= times and n * unit >= least:
            return text[: len(text) - (n - 1) * unit]
    return text
