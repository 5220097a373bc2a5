"""Fill-in-middle, collocations and URL rules against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import collocations, fim, urls
from strataloom.llm.bits import BitVector
from strataloom.llm.queries import QUERIES, SQL
from tests.compare import connect, difference


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_collocations", "op13_url_filter"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, sf), connect(sf), SQL[name]) == ""


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for length, share in ((0, 0), (1, 1), (63, 0.5), (64, 0), (512, 1), (513, 0.1), (9000, 0.01), (9000, 0.6)):
        bits = rng.random(length) < share
        v = BitVector(bits)
        at = np.arange(length + 1)
        assert v.ones == bits.sum() and (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (v.select(np.arange(v.ones)) == np.flatnonzero(bits)).all() and (v.get(at[:-1]) == bits).all()


def plain_fim(doc_id, text, rate=100, spm=50):
    t = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    a, b, c = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, t
    if h4 % 100 < spm:
        return len(lines), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(lines), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fim_equals_plain_version(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(["\n", "\n", "é", "日本", "a b", "\r", "<", "<S", "P>", ">", "\u2028", "\0"]) for _ in range(rng.randrange(40)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "no end"), (904, "x<S>y\n"), (None, "a\nb\n"), (None, None), (905, "long line " * 60_000 + "\n" + "z\n" * 100_000), (1, "again\n"), (1, "again\n"), (-5, "minus\nfive")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("lang", F.lit("x"))
    for params in (fim.FimParams(), fim.FimParams(rate=60, spm=20)):
        out = fim.transformed(df.withColumn("original", F.col("text")), params)
        out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), params)).collect()
        assert len(out) == len(rows) and all(r.back == (r.original or "") and r.lang == "x" for r in out)
        got = sorted(((r.doc_id, r.original, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
        assert got == sorted(((i, t, *plain_fim(i, t, params.rate, params.spm)) for i, t in rows), key=repr)
    assert fim.transformed(df.limit(0)).count() == 0


def plain_phrases(rows, least, longest=5, best=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = {(lang, w[i : i + k]) for (lang, w), a in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= f[lang, w[i : i + k]]}
    out = []
    for lang in n:
        found = []
        for (own, w), a in candidates.items():
            if own == lang and (own, w) not in covered:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


def test_phrases_equal_plain_version(spark, monkeypatch):
    small = {"step_bytes": 2000, "remembered": 20}  # many steps, and texts that are taken in parts
    monkeypatch.setattr(collocations, "TASK_BYTES", 3000)  # arrays of more tasks than one sum takes
    rng = random.Random(6)
    words = ["New", "york", "CITY", "hall", "a", "the", "É", "straße", "\u00a0", "x\0y", "日本", "ding" * 40]
    text = lambda: "".join(rng.choice(words[: rng.randrange(2, 13)]) + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", "\n", ";", "\x0b"]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(400)]
    rows += [("en", "the same words again and again and again")] * 50 + [("fr", None), ("fr", ""), ("de", "a a a a a a a. " * 4000), ("xx", "one word")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(40)
    for params in (collocations.PhraseParams(least=9, **small), collocations.PhraseParams(least=9, slots=150, best=7, **small), collocations.PhraseParams(least=300, longest=3)):
        got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.ranked(df, params).collect()]
        assert sorted(got) == plain_phrases(rows, params.least, params.longest, params.best) and got
    assert collocations.ranked(df.limit(0)).count() == 0
    assert collocations.ranked(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
        table = collocations.PerfectHash(keys[:, 0], keys[:, 1])
        assert sorted(table.slots(keys[:, 0], keys[:, 1]).tolist()) == list(range(len(keys)))
        other = rng.integers(0, 1 << 63, (500, 2)).astype(np.uint64)
        assert (table.slots(other[:, 0], other[:, 1]) == -1).all() and (table.slots(keys[:, 1], keys[:, 0]) == -1).all()


def plain_verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, action) for h, p, action in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_urls_equal_plain_version(spark):
    rng = random.Random(9)
    hosts = ["Example.com", "www.example.COM", "a.b.c.example.com", "notexample.com", "example.com.", "net", "x.net", "", "ÉX.com", "com", ".com", "a..com", "x.com:80", "u@x.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "//en/", "/e", "/fr/../en/", "/en/%2f", "/a/b/c/d/e/f/g/h"]
    rows = [(k, rng.choice(["http", "HTTPS", "", "x"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#top", "?", "://"])) for k in range(600)]
    rows += [(700, None), (701, ""), (702, "example.com/en/"), (703, "://"), (704, "a://b://net/es/"), (705, "http://" + "a." * 3000 + "net" + "/es" * 3000), (1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, "http://x.net/fr/\n?")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("action", F.lit(1)).withColumn("key", F.lit(1))
    given = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    more = [*given, ("b.c.example.com", "", "block"), ("com", "/e", "block"), ("example.com", "/en", "allow"), ("x.net", "/a/b/c", "block"), ("net", "/a/b/c/d", "allow"), ("com", "/en/x", "allow"), ("éx.com", "", "block")]
    for rules, default in ((given, "allow"), (more, "block"), ([], "allow")):
        # two bytes of a digest make strangers meet often
        out = urls.judged(df, spark.createDataFrame(rules, "host string, path string, action string"), urls.UrlParams(default=default, prefix_bytes=1, salts=3))
        assert set(out.columns) == {"page_id", "url", "action", "key", "host", "path", "rule", "verdict"}
        got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=repr)
        assert got == sorted(((i, u, *plain_verdict(u, rules, default)) for i, u in rows), key=repr)
    assert urls.judged(df.limit(0), spark.createDataFrame(given, "host string, path string, action string")).count() == 0
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("net", "es", "block"), ("NET", None, "allow"), ("net", "", "block")], "host string, path string, action string")
    assert {r.rule for r in urls.judged(df, odd).collect()} == {None, "net"}
