"""Numerals, speakers, replies, leases and repairs against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strataloom.operators import evaluation, maintenance, verification


def test_numerals_become_digits():
    en, tr = verification.ENGLISH_NUMERALS, verification.TURKISH_NUMERALS
    for text, want in {
        "two hundred and five thousand and six men": "205006 men", "twenty-three": "23", "twentythree": "23", "5 thousand": "5000", "1.234.567 and 12,500 but 1.23 and 12.3456": "1234567 and 12500 but 1.23 and 12.3456",
        "a hundred": "a 100", "someone": "someone", "tenth of one million": "tenth of 1000000", "": "", "zero": "0", "hundred": "100", "one two": "3",
    }.items():
        assert verification.with_digits(text, en) == want
    for text, want in {"iki yüz elli bin": "250000", "beşyüz": "500", "5 bin": "5000", "bin": "1000", "yirmi üç kişi": "23 kişi"}.items():
        assert verification.with_digits(text, tr) == want
    assert verification.with_digits(None) is None


def test_comparable_and_stated(spark):
    rows = [("It cost  “Five Thousand” dollars", "5,000"), ("Nothing of it", "5000"), ("paid 12 on 3.4.2020", "on 3.4.2020 paid 12"), (None, "x"), ("x", ""), ("he paid 120", "12")]
    df = spark.createDataFrame(rows, "a string, g string").select(verification.comparable(F.col("a")).alias("a"), verification.comparable(F.col("g")).alias("g"))
    got = df.select("a", verification.states(F.col("a"), F.col("g")).alias("s")).collect()
    assert got[0].a == 'it cost "5000" dollars' and [r.s for r in got] == [True, False, True, None, None, True]


def test_names_and_speakers(spark):
    text = "The Anna Berg said it. But Carl Otto Maria Dahl said no; iPhone Max was The End."
    assert spark.createDataFrame([(text,)], "t string").select(verification.names(F.col("t")).alias("n")).first().n == ["Anna Berg"]
    source = "Anna Berg said the price was 500 euros. Carl Dahl said it was 700 euros. Nobody knew 900."
    rows = [(1, "500", "Carl Dahl"), (2, "500", "Anna Berg"), (3, "700", "Anna Berg"), (4, "111", "Anna Berg"), (5, None, "Anna Berg"), (6, "00", "Anna Berg")]
    df = spark.createDataFrame([(i, c, s, source, ["Anna Berg", "Carl Dahl"]) for i, c, s in rows], "id long, claim string, speaker string, source string, names array<string>")
    assert {r.id: r.given_to for r in verification.misattributed(df).collect()} == {1: "Anna Berg", 2: None, 3: "Carl Dahl", 4: None, 5: None, 6: None}


def test_other_organisations(spark):
    rows = [(1, "What did the Blue Water Bank pay?", ["The Red Stone Bank paid", "Red Stone Bank and Green Court"]), (2, "Blue Water Bank?", ["Blue Water Bank paid, Red Stone Bank too"]), (3, "nothing", ["Red Stone Bank"])]
    got = {r.id: r.others for r in verification.other_organisations(spark.createDataFrame(rows, "id long, asked string, sources array<string>")).collect()}
    assert got == {1: ["Red Stone Bank", "The Red Stone Bank"], 2: [], 3: []}


def test_replies_cut_off_keep_whole_sentences(spark):
    whole = '{"sentences": [{"text": "A \\"q\\".", "citations": [1]}, {"text": "B.", "citations": []}, {"text": "A \\"q\\".", "citations": [2, 1]}]}'
    rows = [(whole,), (whole[:-12],), ("not json",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(verification.parsed_reply(F.col("t")).alias("p")).collect()]
    plain = [None if x is None else [(s.sentence, s.citations) for s in x] for x in got]
    assert plain == [[('A "q".', [1, 2]), ("B.", [])], [('A "q".', [1]), ("B.", [])], [], None]


def test_uncertain_identifiers_and_marks(spark):
    a = spark.createDataFrame([(1, 7, "see AB-123 and 4567"), (2, 7, "see xAB-123"), (3, 8, "AB-123")], "answer_id long, document long, text string")
    u = spark.createDataFrame([(7, "ab-123"), (7, "4567"), (9, "AB-123")], "document long, identifier string")
    assert {r.answer_id: r.identifiers for r in verification.uncertain_in(a, u).collect()} == {1: ["4567", "ab-123"]}
    assert spark.createDataFrame([("£5 and £ 6 but £x",)], "t string").select(verification.currency_marks(F.col("t")).alias("t")).first().t == "₺5 and ₺ 6 but £x"


def test_leases_hold_two_at_once(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), k, rng.random() * 5000, 0.0) for k in range(600)]
    rows = [(u, k, s, s + rng.random() * 900) for u, k, s, _ in rows]
    got = {r.id: r.granted for r in maintenance.leased(spark.createDataFrame(rows, "user long, id long, start double, end double")).collect()}
    want = {}
    for user in range(3):
        taken = []
        for s, k, e in sorted((s, k, e) for u, k, s, e in rows if u == user):
            want[k] = sum(1 for t in taken if t > s) < 2
            if want[k]:
                taken.append(min(e, s + 600))
    assert got == want


def test_errors_and_limits(spark):
    users = spark.createDataFrame([(1, "admin", "active")], "user_id long, role string, status string")
    catalogue = spark.createDataFrame([("admin", "upload")], "role string, permission string")
    with pytest.raises(ValueError):
        maintenance.allowed(users, catalogue, "fly")
    assert maintenance.at_most(users, 1).count() == 1
    with pytest.raises(ValueError):
        maintenance.at_most(users, 0)


def test_bootstrap_interval_holds_the_mean(spark):
    rng = random.Random(5)
    values = [(k, rng.gauss(10, 2)) for k in range(400)]
    df = spark.createDataFrame(values, "k long, v double")
    r, again = evaluation.bootstrap(df, "v").first(), evaluation.bootstrap(df.repartition(3), "v").first()
    mean = sum(v for _, v in values) / 400
    assert abs(r.mean - mean) < 1e-9 and r.low < mean < r.high and abs((r.high - r.low) - 2 * 1.96 * 2 / 20) < 0.08
    assert abs(r.low - again.low) < 1e-9


def test_file_names(spark):
    rows = ["/a/b/My_file-v1.2.pdf?x=1", "http://h/p/", "C:\\x\\re\x01port.docx", "plain", None]
    df = spark.createDataFrame([(x,) for x in rows], "p string").select(maintenance.file_name(F.col("p")).alias("n"))
    got = [(r.n, r.t) for r in df.select("n", maintenance.title_of(F.col("n")).alias("t")).collect()]
    assert got == [("My_file-v1.2.pdf", "My file v1 2"), (None, None), ("report.docx", "report"), ("plain", "plain"), (None, None)]
    assert re.fullmatch(r"\w+", "plain")
