"""Decontamination, near duplicates, toxicity, quality and BPE against plain versions and edge cases."""

import base64
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm import bpe, dartminhash, decontam, quality, toxicity
from strataloom.llm.tokens import words

DOCS = "doc_id long, text string, lang string, edits int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 0.5) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "three four five six"), (4, "x" * 300_000), (5, "— … “ ”")]


def edit_distance(pattern, region):
    """Least edits between the pattern and any part of the region."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_words_are_python_words():
    texts = ["Ab cd-ef, ÉCOLE über 12a", None, "", "«quoted» a b…c", "x"]
    w = words(pa.array(texts))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
    assert got == [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]


def test_fitting_distance():
    rng = random.Random(3)
    for _ in range(200):
        p = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        r = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        assert decontam.fitting_distance(np.array(p), np.array(r, dtype=int))[0] == edit_distance(p, r)


def test_leaks_find_edited_items_and_nothing_else(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(30)] + [(99, None), (98, ""), (97, "too short")]
    rows, planted = [], set()
    for d in range(120):
        body = prose(rng, 150).split()
        if d % 2:
            i = rng.randrange(30)
            w = items[i][1].split()
            for _ in range(int(0.1 * len(w))):
                w[rng.randrange(len(w))] = "zz" + prose(rng, 1)
            body[60:60] = w
            planted.add((d, i))
        rows.append((d, " ".join(body).upper()))
    found = decontam.leaks(frame(spark, rows + [(500 + (i or 0), t) for i, t in EDGES]), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= planted and len(got) >= 0.97 * len(planted)
    exact = decontam.without_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert exact.columns == frame(spark, []).columns
    assert {r.doc_id for r in exact.collect()} >= {d for d in range(0, 120, 2)}
    assert decontam.leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.leaks(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [5, 9, 26, 40, 87, 130])
def test_leaks_find_all_items_at_the_limit(spark, n):
    """A fifth of the words edited at the start, at the end or scattered; one edit more is none."""
    rng, k = random.Random(n), n // 5
    items, rows, planted = [], [], {}
    for i in range(60):
        item = prose(rng, n).split()
        w, cut = list(item), k + (i >= 45)
        where = [range(cut), range(n - cut, n), sorted(rng.sample(range(n), cut))][i % 3]
        for at in reversed(where):
            if i % 2:
                w[at] = f"x{rng.getrandbits(60)}"
            else:
                del w[at]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join([*prose(rng, 40).split(), *w, *prose(rng, 40).split()])))
        least = edit_distance(item, rows[-1][1].split())
        if least <= k:
            planted[i, i] = least
    found = decontam.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {x: e for x, e in (((r.doc_id, r.item_id), r.edits) for r in found) if x[0] == x[1]}
    assert len(planted) >= 45 and len(got) >= len(planted) - 1
    assert got.items() <= planted.items()


def test_short_items_match_word_for_word(spark):
    items = [(1, "zebra"), (2, "quick zebra"), (3, "a b c d"), (4, None)]
    rows = [(1, "The zebra!"), (2, "a quick, ZEBRA"), (3, "quick brown zebra"), (4, "x a b c d"), (5, "a b c"), (6, None)]
    found = {(r.doc_id, r.item_id, r.end_word) for r in decontam.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1, 2), (2, 1, 3), (2, 2, 3), (3, 1, 3), (4, 3, 5)}


def test_walks_that_meet_stay_together():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    seen = decontam.walks(hashes, np.arange(500), [0, 7, 30, 70], 2)
    alone = [decontam.walks(hashes, np.array([k]), [0, 7, 30, 70], 2) for k in range(500)]
    for t, (start, at) in seen.items():
        where = at[np.searchsorted(start, np.arange(500), "right") - 1]
        assert where.tolist() == [int(a[t][1][0]) for a in alone]
    assert len(seen[70][0]) < 100


def test_leaks_in_texts_of_many_words(spark):
    rng = random.Random(9)
    item = prose(rng, 700)
    text = prose(rng, 300_000) + " " + item + " " + prose(rng, 1000)
    assert [(r.doc_id, r.edits) for r in decontam.leaks(frame(spark, [(1, text), (2, item[:2000])]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [(1, 0)]


def plain_classes(rows, size=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)])
    ids = sorted(sets)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                shared = sum((sets[a] & sets[b]).values())
                if a < b and shared >= similarity * sum((sets[a] | sets[b]).values()):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(6)]
    rows = []
    for k in range(60):
        w = base[k % 6].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((k, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One, two!"), (104, "a b a b a b a b a b"), (105, "a b a b a b a b")]
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)
    assert dartminhash.near_duplicates(frame(spark, [])).count() == 0
    twice = dartminhash.near_duplicates(frame(spark, [(1, "a b c d e f")] * 2 + [(None, "x")])).collect()
    assert [(r.doc_id, r.class_id) for r in twice] == [(1, 1)]


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(2)
    base = prose(rng, 80).split()
    rows = []
    for k in range(900):
        w = list(base)
        w[rng.randrange(80)] = prose(rng, 1)
        rows.append((k, " ".join(w)))
    got = dartminhash.near_duplicates(frame(spark, rows), dartminhash.DartParams(block=100))
    assert {r.class_id for r in got.collect()} == {0}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for scale in (0.3, 1.0, 7.5, 200.0):
        x, y = scale * rng.gamma(1, 1, 300), scale * rng.gamma(1, 1, 300)
        a, b = dict(zip(ids[:300].tolist(), x, strict=True)), dict(zip(ids[100:].tolist(), y, strict=True))
        both = a.keys() | b.keys()
        true = sum(min(a.get(i, 0), b.get(i, 0)) for i in both) / sum(max(a.get(i, 0), b.get(i, 0)) for i in both)
        rows = dartminhash.signatures(np.concatenate([ids[:300], ids[100:]]), np.concatenate([x, y]), np.array([0, 300, 600]), 4000)
        assert abs((rows[0] == rows[1]).mean() - true) < 0.04
    one = dartminhash.signatures(ids[:3], np.array([1e-3, 1.0, 1e6]), np.array([0, 1, 1, 3]), 50)
    assert (one[1] == 0).all() and len(np.unique(one[0])) == 50


TERMS = ["idiot", "vequ", "scum", "größe"]


def test_automaton_equals_edit_distance():
    a = toxicity.build_automaton(TERMS, 5)
    rng = random.Random(4)
    alphabet = "idotscumvequx"
    samples = ["idiot", "idiots", "idiott", "idit", "ixiot", "idioxts", "scum", "scums", "vequ", "vequxyz", "veq", "", "idiotxx"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    samples = [s for s in samples if s] + ["grösse", "größe", "große", "grüße", "ïdiot", "iidiot", "größer"]
    word, term, edits = toxicity.match(a, words(pa.array(samples)))
    got = {samples[i]: (TERMS[t], e) for i, t, e in zip(word.tolist(), term.tolist(), edits.tolist(), strict=True)}
    whole = lambda p, s: int(np.array(dp(p, s)))

    def dp(p, s):
        row = list(range(len(s) + 1))
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(s, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    for s in set(samples):
        fits = [(whole(t, s), t) for t in TERMS if s == t or len(t) >= 5 and whole(t, s) <= 1]
        assert got.get(s) == (min(fits)[1], min(fits)[0]) if fits else s not in got


def held_out(spark, label, model_scores):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_usual_words_near_a_term_are_no_abuse(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_sample(labels, docs, "toxic", 20_000), corpus=docs)
    clean = [
        "the laser is a lower cost tool for the closer", "a lover of poetry lost her purse", "a poser posed", "the baker had a crush on a stupor", "der Leser ist ein Löser", "he bought a crash helmet", "the idiom of a user",
        "a bidiot is a made-up bird, and a bidiot flies", "the crown",
    ]
    abuse = ["you are such an idi0t", "what a morron you are", "stupidd people, all of you", "you losers", "you lozer, you ideot, go away", "an idiót", "worthles and patetic"]
    frame_ = spark.createDataFrame(list(enumerate(clean + abuse)), "doc_id long, text string")
    got = [r.t for r in toxicity.scored(frame_, model, "t").orderBy("doc_id").collect()]
    assert max(got[: len(clean)]) < 0.7 <= min(got[len(clean) :]), dict(zip(clean + abuse, got, strict=True))


def test_words_the_corpus_uses_are_exceptions(spark):
    corpus = spark.createDataFrame([(k, f"the stupin grows in field {k}") for k in range(5)] + [(9, "an ideot, an idiot, a moron")] * 4, "doc_id long, text string")
    model = toxicity.fit(corpus.limit(0).withColumn("toxic", F.lit(1)), corpus=corpus)
    assert model.exceptions == ["stupin"]


def test_repeated_ids_lose_no_text(spark):
    """Each case through the operator and through the pipeline's stage, against a plain version."""
    import corpus_pipeline

    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(base[20 * k : 20 * k + rng.randrange(5, 20)]) for k in range(12)]
    cases = [[(5, 0), (5, 1), (9, 1)], [(1, 0), (5, 0), (5, 1), (9, 1)], *([(rng.randrange(6), rng.randrange(5)) for _ in range(rng.randrange(2, 14))] for _ in range(6))]
    for case in cases:
        rows = [(i, texts[t]) for i, t in case]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        counted = {}
        for i, t in rows:
            counted.setdefault(i, set()).add(t)
        got = {r.doc_id: r for r in dartminhash.near_duplicates(df).collect()}
        assert set(got) == set(counted)
        alone = [i for i in counted if len(counted[i]) == 1]
        for i in alone:
            for j in alone:
                assert (got[i].class_id == got[j].class_id) == (counted[i] == counted[j])
        for r in got.values():  # a class is that of a text that all its members hold
            members = [counted[i] for i in got if got[i].class_id == r.class_id]
            assert set.intersection(*members) and r.class_id == min(i for i in got if got[i].class_id == r.class_id)
        kept = [r.text for r in corpus_pipeline.remove_near_copies(spark, df, "").collect()]
        assert sorted(kept) == sorted({t for _, t in rows})


def test_toxicity_held_out(spark):
    docs, labels = held_out(spark, "toxic", None)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = toxicity.fit(toxicity.labelled_sample(labels.where(~fold), docs, "toxic", 20_000))
    rows = toxicity.scored(docs, model).join(labels.where(fold), "doc_id").select("toxic", (F.col("score") >= 0.7).cast("int").alias("p")).collect()
    assert sum(r.toxic == r.p for r in rows) >= 0.95 * len(rows)
    edges = toxicity.scored(frame(spark, EDGES), model, "toxicity").collect()
    assert len(edges) == len(EDGES) and all(0 <= r.toxicity <= 1 for r in edges)
    none = toxicity.fit(labels.limit(0).join(docs, "doc_id"))
    assert [r.t > 0.5 for r in toxicity.scored(frame(spark, [(1, "you idiot, you moron, pathetic scum"), (2, "a kind word")]), none, "t").orderBy("doc_id").collect()] == [True, False]


def labelled(spark, rng, n=400):
    """Toxic documents hold one of some words; clean ones hold "crown", which is near "clown"."""
    bad, rows = ["clown", "worthless", "idiot", "trash", "größenwahn"], []
    for k in range(n):
        w = prose(rng, 40)
        w = w.split()
        w[rng.randrange(40)] = bad[k % 5] if k % 4 == 0 else rng.choice(["crown", "town", "kind"])
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_misspelt_terms_and_quotations(spark):
    rng = random.Random(12)
    model = toxicity.fit(labelled(spark, rng))
    assert {"clown", "worthless", "trash", "größenwahn"} <= set(model.terms) and "crown" in model.exceptions
    said = lambda x: f"{prose(rng, 20)} {x} {prose(rng, 20)}"
    # one word with another letter may be another word, two different ones count
    toxic = ["wzrthless tzash", "tzash and wzrthless", "ïdiot", "clowwn", "größenwahnn", "IDIOT", "mor0n"]
    quoted = ['he heard "you idiot" there', "a « worthless » thing", "das „größenwahn“ hier", "an “absolute clown” then", "un «idiot» ici", 'so "worthless trash", they']
    clean = ["the crown", "a town", "worthy", None, "", "trustless", "tzash", "wzrthless", "tzash tzash"]
    rows = [(k, said(x) if x else x) for k, x in enumerate(toxic + quoted + clean)]
    got = {r.doc_id: r.t for r in toxicity.scored(frame(spark, rows).withColumn("t", F.lit("clash")), model, "t").collect()}
    marked = {x for k, x in enumerate(toxic + quoted + clean) if got[k] >= 0.7}
    assert marked == set(toxic)


def test_quotation_lowers_the_score(spark):
    model = toxicity.ToxicModel(["idiot"], np.array([[4.0, 2.0]]))
    s = {r.doc_id: r.t for r in toxicity.scored(frame(spark, [(1, "what an idiot he is, an idiot"), (2, 'what "an idiot he is, an idiot" then'), (3, 'a "b" idiot "c" idiot'), (4, "x" * 1000 + ' " ' + "word " * 50_000 + "idiot")]), model, "t").collect()}
    assert s[2] < s[1] and s[3] > s[2] and s[4] > s[2]


def test_quality_held_out(spark):
    docs, labels = held_out(spark, "quality", None)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = quality.fit(toxicity.labelled_sample(labels.where(~fold), docs, "quality", 20_000))
    rows = quality.scored(docs, model).join(labels.where(fold), "doc_id").select("quality", (F.col("score") >= 0.3).cast("int").alias("p")).collect()
    assert sum(r.quality == r.p for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.q <= 1 for r in quality.scored(frame(spark, EDGES), model, "q").collect())
    assert {r.q for r in quality.scored(frame(spark, [(1, "a")]), quality.fit(labels.limit(0).join(docs, "doc_id")), "q").collect()} <= {0.4995, 0.5}


def test_isotonic_never_falls():
    at, mean = np.arange(6.0), np.array([0.1, 0.4, 0.2, 0.9, 0.8, 1.0])
    _, values = quality._isotonic(at, mean, np.ones(6))
    assert (np.diff(values) >= 0).all()


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def test_bpe_equals_tiktoken_and_decodes(spark, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "  two\n\n\tlines ", "日本語 текст 🤖 a\u0000b ▁ ▁x", "<unk> <|endoftext|>", "１２ ½ ﬁ \r\n", "a" * 5000] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    v = bpe.Vocabulary.from_file(path, pattern)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for r in bpe.decoded(bpe.encoded(df, v), v).collect():
        want = other.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want) and r.n_tokens == len(want)
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert bpe.encoded(df.limit(0), v).count() == 0


def test_more_distinct_matches_than_are_remembered(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.Vocabulary.from_file(path, pattern).model, pattern)
    for text in (" ".join(map(str, range(600_000))), "12 of them", "\n".join(f"w{i:x}" for i in range(300_000))):
        want = other.encode_ordinary(text)
        assert encoder.encode(text) == struct.pack(f"<{len(want)}I", *want)


def test_ranks_are_checked():
    with pytest.raises(ValueError):
        bpe.read_ranks([b"YQ== 0", b"Yg== 2"])
