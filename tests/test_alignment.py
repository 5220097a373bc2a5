"""Alignment, measures of readings, parser comparison and speakers against plain versions."""

import random
from collections import Counter

import numpy as np

from strataloom.operators import alignment


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def replayed(a, b, ops):
    """The operations make b of a, and each is what it says."""
    i = j = 0
    for op, at, to in ops:
        assert (at, to) == (i, j)
        assert op != alignment.EQUAL or a[i] == b[j]
        i += op != alignment.INSERT
        j += op != alignment.DELETE
    assert (i, j) == (len(a), len(b))
    return sum(op != alignment.EQUAL for op, _, _ in ops)


def test_distance_equals_dynamic_programming(monkeypatch):
    rng = random.Random(1)
    for case in range(400):
        if case == 300:
            monkeypatch.setattr(alignment, "CELLS", 400)  # gaps are halved
        letters = rng.choice([2, 4, 30, 300])
        a = [str(rng.randrange(letters)) for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(25)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [str(rng.randrange(letters)) for _ in range(rng.randrange(3))]
        if rng.random() < 0.2:  # a part moves
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        found, ops = alignment.aligned(a, b)
        assert found == plain_distance(a, b) == replayed(a, b, ops), (a, b)


def test_long_texts_need_little_memory():
    rng = random.Random(2)
    a = [str(rng.randrange(3000)) for _ in range(20_000)]
    b = [w for w in a if rng.random() > 0.05]
    found, ops = alignment.aligned(a, b)
    assert found == len(a) - len(b) == replayed(a, b, ops)


def test_band_is_exact_up_to_its_limit():
    a, b = np.array([1, 2, 3, 4]), np.array([2, 3, 4, 5])
    assert alignment.banded(a, b, 1) is None and alignment.banded(a, b, 2)[0] == 2 == alignment.banded(a, b, 9, keep=False)[0]


def test_reading_measures(spark):
    rows = [
        (1, "The cat sat on the mat.\nInvoice 12345/A of 2020", "the cat sat mat on the\nqx qy qz qa the 12345 of"), (2, None, "made up by itself all of it"), (3, "all of it", None), (4, "", ""),
        (5, "a b c d", "a b c d a b c d a b c d"), (6, "one two three four one two three four one two three four", "one two three four one two three four one two three four"),
    ]
    out = {r.key: r for r in alignment.reading_measures(spark.createDataFrame(rows, "key long, truth string, output string")).collect()}
    assert (out[1].truth_words, out[1].output_words, out[1].invented, out[1].bag_errors, out[1].ids, out[1].ids_found, out[1].lines, out[1].lines_found) == (11, 13, 4, 5, 2, 1, 2, 1)
    assert out[1].ordered_errors == plain_distance("the cat sat on the mat invoice 12345 a of 2020".split(), "the cat sat mat on the qx qy qz qa the 12345 of".split())
    assert (out[2].truth_words, out[2].invented, out[2].bag_errors, out[2].ordered_errors) == (0, 7, 7, 7) and (out[3].bag_errors, out[3].lines_found, out[3].lines) == (3, 0, 1)
    assert (out[4].truth_words, out[4].bag_errors, out[4].loop) == (0, 0, False) and out[5].loop and not out[6].loop


def words_of(text):
    return Counter(text.lower().split())


def test_parser_comparison_equals_plain_version(spark):
    from strataloom.operators import comparison

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)] + ["1234", "55/678"]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6)))
    pages = [(d, p, "\n".join(line() for _ in range(rng.randrange(1, 6))), rng.choice(["", "w0 w1"]), rng.random() < 0.8) for d in range(8) for p in range(1, 5)]
    blocks = [(d, p + rng.choice([0, 0, 0, -1]), x if rng.random() < 0.7 else line()) for d, p, t, _, _ in pages for x in t.split("\n") if rng.random() < 0.8]
    frames = spark.createDataFrame(pages, "doc int, page int, text string, furniture string, usable boolean"), spark.createDataFrame(blocks, "doc int, page int, text string")
    split = lambda t: Counter(t.replace("/", " ").split())
    ids = lambda t: Counter(w for w in t.split() if sum(c.isdigit() for c in w) >= 3)
    for threshold in (0.0, 0.5, 0.9):
        got = {r.doc: (r.words, r.kept, r.extra, r.ids, r.ids_kept, r.replaced) for r in comparison.tally(*frames, threshold).collect()}
        for d in range(8):
            own, want, want_ids, back = [], Counter(), Counter(), 0
            for _, p, text, marked, usable in (x for x in pages if x[0] == d):
                if not usable:
                    continue
                w = split(text) - split(marked)
                near = split(" ".join(t for e, q, t in blocks if e == d and q in (p, p - 1)))
                want, want_ids = want + w, want_ids + (ids(text) - ids(marked))
                if w.total() and (w & near).total() / w.total() < threshold:
                    own, back = [*own, text], back + 1
                else:
                    own += [t for e, q, t in blocks if e == d and q == p]
            have, have_ids = split(" ".join(own)), ids(" ".join(own))
            assert got[d] == (want.total(), (want & have).total(), (have - want).total(), want_ids.total(), (want_ids & have_ids).total(), back)
    missed = {(r.doc, r.page, r.line) for r in comparison.missed_lines(*frames).collect()}
    for d, p, text, marked, usable in pages:
        have = split(" ".join(t for e, q, t in blocks if e == d and q in (p, p - 1)))
        for k, x in enumerate(text.split("\n")):
            own = [w for w in x.replace("/", " ").split() if w not in split(marked)]
            absent = [w for w in own if have[w] <= 0]
            have.subtract(own)
            assert ((d, p, k) in missed) == (usable and bool(own) and len(absent) >= 0.5 * len(own))
