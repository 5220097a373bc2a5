"""Toxicity scores from Levenshtein automata intersected with a lexicon trie (operator 10).

The lexicon is learned: words that documents labelled toxic hold and others don't.  The automaton
that accepts every lexicon term with at most one edit of a letter is intersected with the trie of
the terms, made deterministic once, and then steps through all words of a batch at a time, one
letter a step; words leave when no term can be reached any more.  Each match becomes evidence with
a learned weight per term, less for a misspelt one.

A misspelling is no evidence where it is a usual word: one that clean labelled documents hold, that
the whole corpus uses without other evidence, or that the fixed list names.  A term written with a
digit, a doubled letter, an accent or an ending is disguised and counts as a misspelling at once; another letter
may make another word, so if labels don't show that a term is varied in this way, one such word
alone keeps a text under the middle, and two different ones count in full.

Windows of context tell quotation from abuse: evidence between quotation marks counts hardly,
evidence next to a word of reporting less, evidence close to more evidence the more.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, sliced, written
from .tokens import Words, words

# English terms of abuse that are in the lexicon whatever the labels hold.
SEED_TERMS = ("idiot", "moron", "scum", "loser", "stupid", "worthless", "pathetic", "disgusting")
# Usual words of the four languages that are one letter from a seed term.
USUAL = ("boron", "closer", "idiom", "laser", "leser", "loner", "looser", "lose", "loses", "lover", "lower", "löser", "morn", "poser", "oser", "rosier", "user")
# Words that report somebody else's speech, in English, French, German and Spanish.
REPORTING = ("said", "says", "quoted", "wrote", "called", "word", "term", "dit", "mot", "sagte", "wort", "dijo", "palabra")
# Quotation marks of these languages in UTF-8, and which way those that stand apart from words point.
QUOTES = {'"': 0, "\u00ab": 1, "\u00bb": -1, "\u201c": 1, "\u201d": -1, "\u201e": 1, "\u2039": 1, "\u203a": -1}


@dataclass(frozen=True)
class ToxicParams:
    """``max_labels`` bounds the labelled sample, which a hash of doc_id picks.

    ``max_terms`` is the size of the lexicon.  Terms of ``edit_letters`` letters or more tolerate an
    edit; a misspelt term is worth ``misspelt`` of the right one until labels tell otherwise, for
    which they need some ``prior`` documents.  A word near a term that ``usual_docs`` documents of
    the corpus hold, at most a share of ``usual_share`` of them with other evidence, is usual.
    Evidence in quotation is worth ``quoted``, next to a word of reporting ``reported`` of itself.
    """

    max_labels: int = 20_000
    max_terms: int = 400
    min_docs: int = 4
    min_ratio: float = 20.0
    edit_letters: int = 5
    misspelt: float = 0.8
    prior: float = 5.0
    usual_docs: int = 3
    usual_share: float = 0.2
    quoted: float = 0.05
    reported: float = 0.4
    window: int = 12
    steps: int = 50


@dataclass
class Automaton:
    """Deterministic intersection: ``table[state, letter]``; state 0 is dead, 1 the start.

    ``letters`` numbers the code points of the terms, all others alike; ``term`` and ``edits`` have
    what a word that ends in a state matches (-1: nothing).
    """

    letters: np.ndarray
    table: np.ndarray
    term: np.ndarray
    edits: np.ndarray


def build_automaton(terms: list[str], edit_letters: int) -> Automaton:
    """Terms of fewer letters than ``edit_letters`` are matched exactly; of two terms that match the first counts."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    tolerant = [False]
    for number, term in enumerate(terms):
        node, soft = 0, len(term) >= edit_letters
        tolerant[0] |= soft
        for c in map(ord, term):
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                tolerant.append(False)
            node = children[node][c]
            tolerant[node] |= soft
        ends.setdefault(node, number)
    used = sorted({c for x in children for c in x})
    letters = np.full(0x110000, len(used), dtype=np.uint16)
    letters[used] = np.arange(len(used))
    after = [*used, -1]  # -1: a letter of no term

    def closed(items: dict[int, int]) -> frozenset:
        """With the deletions of a term's letters; of a node only the fewest edits count."""
        for node, edits in list(items.items()):
            if edits == 0:
                for child in children[node].values():
                    if tolerant[child] and items.get(child, 9) > 1:
                        items[child] = 1
        return frozenset(items.items())

    def moved(state: frozenset, c: int) -> frozenset:
        out: dict[int, int] = {}
        for node, edits in state:
            if (child := children[node].get(c)) is not None:
                out[child] = min(out.get(child, 9), edits)
            if edits == 0:
                for child in children[node].values():
                    if tolerant[child]:
                        out[child] = min(out.get(child, 9), 1)
                if tolerant[node]:
                    out[node] = min(out.get(node, 9), 1)
        # paths with an edit go on only towards tolerant terms
        return closed({n: e for n, e in out.items() if e == 0 or tolerant[n]})

    start = closed({0: 0})
    number = {frozenset(): 0, start: 1}
    todo, rows = [start], {0: [0] * len(after)}
    while todo:
        state = todo.pop()
        row = []
        for c in after:
            target = moved(state, c)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows[number[state]] = row
    table = np.array([rows[k] for k in range(len(number))], dtype=np.int32)
    term, edits = (np.full(len(number), v, dtype=np.int32) for v in (-1, 9))
    for state, k in number.items():
        found = [(e, ends[node]) for node, e in state if node in ends and (e == 0 or len(terms[ends[node]]) >= edit_letters)]
        if found:
            edits[k], term[k] = min(found)
    return Automaton(letters, table, term, edits)


def match(a: Automaton, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each matching word, its term and its edits."""
    # code points of all texts, and where each word's lie
    points = np.frombuffer(w.data.tobytes().decode(errors="replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(w.data) + 1, dtype=np.int32)
    np.cumsum((w.data & 0xC0) != 0x80, out=lead[1:])
    first, length = lead[w.starts], lead[w.ends] - lead[w.starts]
    letters = a.letters[np.minimum(points, 0x10FFFF)]
    live = np.arange(len(length))
    state = np.ones(len(length), dtype=np.int32)
    found_word, found_term, found_edits = [], [], []
    step = 0
    while len(live):
        done = length[live] <= step
        if done.any():
            ended = state[done]
            hit = a.term[ended] >= 0
            found_word.append(live[done][hit])
            found_term.append(a.term[ended][hit])
            found_edits.append(a.edits[ended][hit])
            live, state = live[~done], state[~done]
        state = a.table[state, letters[first[live] + step]]
        step += 1
        keep = state != 0
        live, state = live[keep], state[keep]
    if not found_word:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.int32), none.astype(np.int32)
    word, term, edits = (np.concatenate(x) for x in (found_word, found_term, found_edits))
    order = np.argsort(word, kind="stable")
    return word[order], term[order], edits[order]


#: How a word matches a term.
EXACT, DISGUISED, VARIED = 0, 1, 2


def _plain_letters(word: str) -> str:
    """Without accents, and each run of a letter once."""
    return "".join(c for c, _ in groupby(x for x in unicodedata.normalize("NFD", word) if not unicodedata.combining(x)))


def disguised(word: str, term: str) -> bool:
    """Whether a word that isn't the term is still the term: with a sign that is no letter, another accent, a letter doubled, or an ending of one letter."""
    return not word.isalpha() or word[:-1] == term or _plain_letters(word) == _plain_letters(term)


@dataclass
class ToxicModel:
    terms: list[str] = field(default_factory=list)
    #: of each term as it is, in disguise, and with another letter (a missing column is as the one before it)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-4.0, 3.0, 1.0, -2.0, 0.0]))
    #: words near a term that are none
    exceptions: list[str] = field(default_factory=list)
    params: ToxicParams = ToxicParams()
    #: terms of which labels show variants with another letter
    varied: np.ndarray | None = None
    automaton: Automaton | None = None

    def __post_init__(self):
        while self.weights.shape[1] < 3:
            self.weights = np.column_stack([self.weights, self.weights[:, -1]])
        if self.varied is None:
            self.varied = np.zeros(len(self.terms), dtype=bool)
        if self.automaton is None:
            self.automaton = build_automaton(self.terms, self.params.edit_letters)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))

    def alone(self) -> float:
        """The most evidence that keeps a short text under the middle."""
        low, high = 0.0, 10.0
        for _ in range(40):
            v = (low + high) / 2
            inside = self.probability(np.array([1.0, math.log1p(v), math.log1p(v), 0.0, min(v, 5.0)])) < 0.5
            low, high = (v, high) if inside else (low, v)
        return low


class _Scorer:
    """What a task needs of a model."""

    def __init__(self, model: ToxicModel):
        self.model, self.alone = model, model.alone()
        self.exceptions = np.unique(words(pa.array([*model.exceptions, *USUAL], pa.string())).hashes)
        self.reporting = np.unique(words(pa.array(REPORTING)).hashes)
        self.kinds: dict[tuple[bytes, int], int] = {}

    def kind(self, word: bytes, term: int) -> int:
        if len(self.kinds) > 100_000:
            self.kinds.clear()
        if (word, term) not in self.kinds:
            self.kinds[word, term] = DISGUISED if disguised(word.decode(errors="replace"), self.model.terms[term]) else VARIED
        return self.kinds[word, term]

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, term and kind of the matches that are no exception."""
        word, term, edits = match(self.model.automaton, w)
        keep = (edits == 0) | ~np.isin(w.hashes[word], self.exceptions)
        word, term, edits = word[keep], term[keep], edits[keep]
        kind = np.zeros(len(word), dtype=np.int64)
        for k in np.flatnonzero(edits):
            kind[k] = self.kind(w.data[w.starts[word[k]] : w.ends[word[k]]].tobytes(), int(term[k]))
        return word, term, kind

    def _doubtful(self, w: Words, owner: np.ndarray, word: np.ndarray, term: np.ndarray, kind: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Evidence, where the only word of its text that may be another one counts once, and little."""
        open_ = np.flatnonzero((kind == VARIED) & ~self.model.varied[term])
        if not len(open_):
            return whole
        pairs, first = np.unique(np.stack([owner[open_].astype(np.uint64), w.hashes[word[open_]]], axis=1), axis=0, return_index=True)
        single = np.bincount(pairs[:, 0].astype(np.int64), minlength=int(owner.max()) + 1) == 1
        own = open_[single[owner[open_]]]
        whole = whole.copy()
        once = np.isin(own, open_[first])
        whole[own] = np.where(once, np.minimum(whole[own], self.alone), 0)
        return whole

    def features(self, w: Words) -> np.ndarray:
        """Per text: 1, total evidence (log), strongest window (log), share of discounted evidence, evidence per word."""
        n, p = len(w.bounds) - 1, self.model.params
        word, term, kind = self.matches(w)
        out = np.zeros((n, 5))
        out[:, 0] = 1
        if not len(word):
            return out
        owner = np.searchsorted(w.bounds, word, "right") - 1
        whole = self._doubtful(w, owner, word, term, kind, np.maximum(self.model.weights[term, kind], 0))
        reported = np.zeros(len(word), dtype=bool)
        for k in range(1, 4):
            near = np.maximum(word - k, w.bounds[owner])
            reported |= np.isin(w.hashes[near], self.reporting) & (near < word)
        value = np.where(_in_quotes(w, word, owner, p.window), p.quoted, np.where(reported, p.reported, 1.0)) * whole
        total = np.bincount(owner, value, n)
        sums = np.concatenate([[0], np.cumsum(value)])
        upto = np.searchsorted(word, np.minimum(word + p.window, w.bounds[owner + 1] - 1), "right")
        strongest = np.zeros(n)
        np.maximum.at(strongest, owner, sums[upto] - sums[np.arange(len(word))])
        out[:, 1] = np.log1p(total)
        out[:, 2] = np.log1p(strongest)
        out[:, 3] = np.bincount(owner, whole - value, n) / np.maximum(np.bincount(owner, whole, n), 1e-9)
        out[:, 4] = np.minimum(total * 20 / np.maximum(np.diff(w.bounds), 20), 5)
        return out

    def score(self, w: Words) -> np.ndarray:
        return self.model.probability(self.features(w))


def _marks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes where quotations open, and where they close.

    A mark before a word and not behind one opens, the reverse closes; one that stands apart, as in
    French, is taken by its form.
    """
    data, opens, closes = w.data, [], []
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[w.starts] += 1
    change[w.ends] -= 1
    wordy = np.cumsum(change) > 0
    for mark, way in QUOTES.items():
        code = mark.encode()
        at = np.flatnonzero(data == code[0])
        at = at[at + len(code) <= len(data)]
        for k in range(1, len(code)):
            at = at[data[at + k] == code[k]]
        before = np.where(at > 0, wordy[at - 1] | np.isin(data[at - 1], [33, 44, 46, 63]), False)
        after = wordy[np.minimum(at + len(code), len(data))]
        opens.append(at[(after & ~before) | (way > 0) & ~(before & ~after)])
        closes.append(at[(before & ~after) | (way < 0) & ~(after & ~before)])
    return np.sort(np.concatenate(opens)), np.sort(np.concatenate(closes))


def _in_quotes(w: Words, word: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Which words stand in a quotation that opens and closes within ``window`` words of its text."""
    opens, closes = _marks(w)
    if not len(opens) or not len(closes):
        return np.zeros(len(word), dtype=bool)
    start, end = w.starts[word], w.ends[word]
    before = np.searchsorted(opens, start) - 1
    opened = np.where(before >= 0, opens[np.maximum(before, 0)], -1)
    after = np.searchsorted(closes, end)
    closed = np.where(after < len(closes), closes[np.minimum(after, len(closes) - 1)], len(w.data) + 1)
    # nothing closes between the mark and the word, and both marks are near and in the same text
    ended = np.searchsorted(closes, start) - 1
    ended = np.where(ended >= 0, closes[np.maximum(ended, 0)], -1)
    near = (word - np.searchsorted(w.starts, opened) < window) & (np.searchsorted(w.starts, closed) - word <= window)
    return (opened >= w.offsets[owner]) & (closed < w.offsets[owner + 1]) & (opened > ended) & near


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            w = words(pa.array([text], pa.string()))
            raw = w.data.tobytes()
            own = {raw[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True) if 3 < e - s <= 60}
            for x in own:
                if (word := x.decode(errors="ignore")).isalpha():
                    counts[word][toxic] += 1
            if len(counts) > 100_000:
                yield _count_rows(counts)
                counts.clear()
    yield _count_rows(counts)


def _count_rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["term", "toxic", "clean"])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """Newton's method with a small ridge penalty."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(labels: DataFrame, docs: DataFrame, label: str, max_labels: int) -> DataFrame:
    """(doc_id, label, text) of about ``max_labels`` labelled documents at most, chosen by a hash of doc_id."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", label)
    buckets = 1 << 20
    keep = min(buckets, int(buckets * max_labels / max(labels.count(), 1)))
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) < keep).join(docs.select("doc_id", "text"), "doc_id")


def fit(labelled: DataFrame, params: ToxicParams = ToxicParams(), corpus: DataFrame | None = None) -> ToxicModel:
    """Fit on (doc_id, text, toxic 0/1) rows, which ``labelled_sample`` bounds; others are left out.

    Of the rows of a repeated doc_id, and of repeated labels, all count.  The texts of ``corpus``, labelled
    or not, tell which words near a term are usual; without it labels and the fixed list alone do.

    Word counts are summed by Spark; only terms over the thresholds, the lexicon's size at most, and
    one row of five features a labelled document come to the driver.  Without usable labels the
    model has the seed terms with a default weight.
    """
    rows = labelled.where("doc_id is not null and text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = written(rows, "toxic-labels")
    counted = rows.mapInArrow(lean(_distinct_terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = written(counted, "toxic-words")
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    log_ratio = lambda toxic, clean: math.log(((toxic + 0.5) / (n1 + 1)) / ((clean + 0.5) / (n0 + 1)))
    ratio = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    good = counted.withColumn("ratio", ratio).where((F.col("toxic") >= params.min_docs) & (F.col("ratio") >= params.min_ratio))
    best = good.orderBy(F.desc(F.col("toxic") * F.log("ratio")), "term").limit(params.max_terms).collect() if n1 else []
    chosen = {r.term: min(math.log(r.ratio), 6.0) for r in best}
    seen = {r.term: (r.toxic, r.clean) for r in counted.where(F.col("term").isin(*SEED_TERMS)).collect()}
    blend = lambda weight, toxic, clean: max((params.prior * weight + (toxic + clean) * log_ratio(toxic, clean)) / (params.prior + toxic + clean), 0.0) if toxic + clean else weight
    for term in SEED_TERMS:
        chosen.setdefault(term, min(blend(3.0, *seen.get(term, (0, 0))), 6.0))
    model = ToxicModel(list(chosen), np.array([[w, params.misspelt * w] for w in chosen.values()]), params=params)
    if n1 and n0:
        near = written(counted.mapInArrow(lean(_near_words(model)), "word string, term int, kind int, toxic long, clean long"), "near-words")
        usual = near.withColumn("ratio", ratio).where((F.col("clean") >= 2) & (F.col("ratio") < params.min_ratio / 4))
        # at most the words near a term of a bounded sample
        model.exceptions = sorted({r.word for r in usual.select("word").distinct().collect()})
        rest = near.where(~F.col("word").isin(*model.exceptions)) if model.exceptions else near
        for r in rest.groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect():
            model.weights[r.term, r.kind] = min(blend(model.weights[r.term, r.kind], r.toxic, r.clean), model.weights[r.term, EXACT])
            model.varied[r.term] |= r.kind == VARIED and r.toxic >= params.min_docs
    if corpus is not None:
        model.exceptions = sorted({*model.exceptions, *_usual_words(corpus, model)})
    if not n1 or not n0:
        return model
    data = rows.mapInArrow(lean(_feature_rows(model)), "x array<double>, toxic int").toArrow()
    x = np.array(data.column("x").to_pylist())
    y = np.array(data.column("toxic").to_pylist(), dtype=float)
    # labels that hold no quotation say nothing of it; how it counts is set by the parameters
    use = [k for k in range(5) if k != 3]
    model.coefficients = np.zeros(5)
    model.coefficients[use] = _logistic(x[:, use], y, params.steps)
    return model


def _near_words(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            w = words(batch.column("term"))
            word, term, kind = scorer.matches(w)
            word, term, kind = word[kind > 0], term[kind > 0], kind[kind > 0]
            own = batch.take(pa.array(np.searchsorted(w.bounds, word, "right") - 1))
            yield pa.RecordBatch.from_arrays([own.column("term"), pa.array(term, pa.int32()), pa.array(kind, pa.int32()), own.column("toxic"), own.column("clean")], ["word", "term", "kind", "toxic", "clean"])

    return run


def _usual_words(corpus: DataFrame, model: ToxicModel) -> list[str]:
    """Words near a term (of which labels show no variants) that documents use without other evidence.

    Each task counts the documents of such words; there are no more of them than words one letter
    from a term of a lexicon of bounded size.
    """
    p = model.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = _Scorer(model), defaultdict(lambda: [0, 0])
        for batch in sliced(batches, "text"):
            w = words(batch.column("text"))
            word, term, kind = scorer.matches(w)
            owner = np.searchsorted(w.bounds, word, "right") - 1
            open_ = (kind == VARIED) & ~model.varied[term]
            sure = np.bincount(owner[~open_], minlength=batch.num_rows) > 0
            for o, x in {(o, w.data[w.starts[x] : w.ends[x]].tobytes()) for o, x in zip(owner[open_].tolist(), word[open_].tolist(), strict=True)}:
                counts[x][0] += 1
                counts[x][1] += int(sure[o])
        found = {x.decode(errors="ignore"): n for x, n in counts.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([n[k] for n in found.values()], pa.int64()) for k in range(2))], ["word", "docs", "sure"])

    counted = corpus.select("text").mapInArrow(lean(run), "word string, docs long, sure long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("sure").alias("sure"))
    return [r.word for r in counted.where((F.col("docs") >= p.usual_docs) & (F.col("sure") <= p.usual_share * F.col("docs"))).collect()]


def _feature_rows(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in sliced(batches, "text"):
            x = scorer.features(words(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def scored(docs: DataFrame, model: ToxicModel, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, the probability that the text is toxic (null text: as an empty one).

    One pass without a shuffle; every row stays, repeated ones too, and other columns are kept but
    for one of that name, which is replaced.  Texts of any length are read whole.
    """
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.score(words(batch.column("text"))), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), schema)
