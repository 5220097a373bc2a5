"""Comparing what answers state: numerals, folding, names, speakers and golden answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import claims, fold, stands_in
from .tables import written


@dataclass(frozen=True)
class Numerals:
    """Number words of a language: plain values, words that multiply what stands before, and scales."""

    units: dict[str, int]
    hundred: str
    scales: dict[str, int]
    joints: tuple[str, ...] = ()


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ENGLISH_NUMERALS = Numerals({w: k for k, w in enumerate(_SMALL)} | {w: 10 * k for k, w in enumerate(_TENS, 2)}, "hundred", {"thousand": 10**3, "million": 10**6, "billion": 10**9}, ("and",))
TURKISH_NUMERALS = Numerals(
    {w: k for k, w in enumerate("sıfır bir iki üç dört beş altı yedi sekiz dokuz on".split())} | {w: 10 * k for k, w in enumerate("yirmi otuz kırk elli altmış yetmiş seksen doksan".split(), 2)},
    "yüz", {"bin": 10**3, "milyon": 10**6, "milyar": 10**9},
)


def number_of(words: list[str], numerals: Numerals) -> int | None:
    """Value of a run of number words and digits; null if it is none."""
    total = group = 0
    for w in words:
        if w.isdigit():
            group += int(w)
        elif w in numerals.units:
            group += numerals.units[w]
        elif w == numerals.hundred:
            group = max(group, 1) * 100
        elif w in numerals.scales:
            total += max(group, 1) * numerals.scales[w]
            group = 0
        elif w not in numerals.joints:
            return None
    return total + group


def with_digits(text: str | None, numerals: Numerals = ENGLISH_NUMERALS) -> str | None:
    """Runs of number words, apart, hyphenated or joined, as digits; thousands separators go before exactly three digits.

    A digit before a scale word is multiplied ("5 thousand"); words with other letters stay.
    """
    if text is None:
        return None
    text = re.sub(r"(?<=\d)[.,](?=\d{3}(?!\d))(?<!\d\.\d{2}[.,])", "", text)
    names = sorted((*numerals.units, numerals.hundred, *numerals.scales), key=len, reverse=True)
    one = "|".join(map(re.escape, names))
    joint = "|".join(map(re.escape, numerals.joints)) or "(?!)"
    run = rf"(?<![\w])(?:\d+\s+(?=(?:{'|'.join(map(re.escape, (*numerals.scales, numerals.hundred)))})\b))?(?:{one})+(?:(?:\s+(?:(?:{joint})\s+)?|-)(?:{one})+)*(?![\w])"
    cut = re.compile(rf"\d+|{one}|{joint}")
    return re.sub(run, lambda m: str(number_of(cut.findall(m[0]), numerals)), text)


def comparable(texts: Column, numerals: Numerals = ENGLISH_NUMERALS) -> Column:
    """Lower case, plain quotes and dashes, single spaces, numerals as digits."""

    @F.pandas_udf("string")
    def digits(values: pd.Series) -> pd.Series:
        return values.map(lambda t: with_digits(t, numerals), na_action="ignore")

    plain = F.translate(fold(texts), "’‘“”–— ", "''\"\"-- ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    holds = plain.rlike("|".join((*numerals.units, numerals.hundred, *numerals.scales))) | plain.rlike(r"[0-9][.,][0-9]{3}")
    # only texts that may hold a numeral go through Python
    return F.when(holds, digits(F.when(holds, plain))).otherwise(plain)


def states(answer: Column, golden: Column) -> Column:
    """The golden answer stands in the answer (both comparable), or all its claims do; null for an empty golden answer."""
    named = claims(golden)
    by_claims = (F.size(named) > 0) & F.forall(named, lambda c: stands_in(c, answer))
    return F.when(F.length(golden) > 0, F.contains(answer, golden) | by_claims)


def uncertain_in(answers: DataFrame, uncertain: DataFrame) -> DataFrame:
    """(answer_id, identifiers): uncertain identifiers (document, identifier) of the cited documents that the text states.

    ``answers``: answer_id, document, text.
    """
    both = answers.select("answer_id", "document", F.lower("text").alias("text")).join(uncertain.select("document", F.lower("identifier").alias("low"), "identifier").distinct(), "document")
    return both.where(stands_in(F.col("low"), F.col("text"))).groupBy("answer_id").agg(F.array_sort(F.collect_set("identifier")).alias("identifiers"))


def names(text: Column, stop: tuple[str, ...] = ("The", "This", "That", "In", "On", "At", "And", "But", "For", "Of")) -> Column:
    """Runs of two or three capitalised words with only white space between, distinct, in order.

    A capitalised word has two letters or more, the others all small or all capital.  Stop words end a
    run; a run of four or more words names nobody.
    """
    word = (rf"(?!(?:{'|'.join(stop)})(?![\p{{L}}]))" if stop else "") + r"(?:\p{Lu}\p{Ll}++|\p{Lu}{2,}+)(?![\p{L}])"
    runs = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}]){word}(?:\s++{word})*+"), F.lit(0))
    plain = F.transform(runs, lambda x: F.regexp_replace(x, r"\s+", " "))
    return F.array_distinct(F.filter(plain, lambda x: F.size(F.split(x, " ")).between(2, 3)))


SAYING = ("said", "says", "stated", "told", "argued", "added", "replied", "claimed", "announced", "noted")
#: Words of a language that say nothing of whose words a sentence holds.
PLAIN_WORDS = ("the", "and", "that", "this", "was", "were", "had", "has", "have", "for", "with", "but", "not", "they", "them", "she", "her", "his", "him", "who", "all", "one", *SAYING)


def occurrences(rows: DataFrame, keys: list[str], text: str, pattern: Column) -> DataFrame:
    """(keys, start, end, match) of all matches of a row's pattern in its text, by characters counted from 0.

    What stands between matches and the matches themselves are counted up, so a text of many matches
    costs as much as it is long.
    """
    both = F.zip_with(F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), pattern, F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    each = rows.select(*keys, F.posexplode(both).alias("_n", "_x")).where("_x.match is not null")
    length = F.length("_x.gap") + F.length("_x.match")
    end = F.sum(length).over(Window.partitionBy(*keys).orderBy("_n"))
    return each.select(*keys, (end - F.length("_x.match")).cast("int").alias("start"), end.cast("int").alias("end"), F.col("_x.match").alias("match"))


def _whole(needle: Column) -> Column:
    """A pattern for the needle (letters, digits, spaces and the signs of claims) between signs of no word."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), needle, F.lit(r"\E(?![\p{L}\p{N}_])"))


def spoken(sentences: DataFrame, sources: DataFrame, saying: tuple[str, ...] = SAYING, plain: tuple[str, ...] = PLAIN_WORDS, reach: int = 200) -> DataFrame:
    """(id, n, person, given): sentences that give a person claims or words which the cited sources give others.

    ``sentences``: id, n, text; ``sources``: id, k, text (those that the answer cites).  In a source a
    person's words run from where it names the person to where it names the next who says something:
    the sentence's own person, and each name that a verb of saying follows within ``reach``
    characters.  So every place of a claim is looked up as of the last such name before it.  A claim is
    given wrongly if it stands in sources that name the person, but never in the person's words or
    before anyone speaks.  If there is none, two words in a row count in the same way (by their stems),
    unless something of the sentence stands in the person's own words.  Of a sentence's persons the
    first that is given something wrongly counts.
    """
    says = F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(saying)})(?![\p{{L}}\p{{N}}_])")
    own = sentences.select("id", "n", "text", F.lower("text").alias("low")).where(F.rlike("low", says))
    persons = own.select("id", "n", F.posexplode(names(F.col("text"))).alias("order", "person")).withColumn("person", F.lower("person"))
    src = written(sources.select("id", "k", F.lower("text").alias("low"), F.transform(names(F.col("text")), lambda x: F.lower(x)).alias("names")), "spoken-sources")

    # where each name stands, and whether a verb of saying follows it somewhere
    asked = persons.select("id", "person").distinct()
    named = src.select("id", "k", "low", F.explode("names").alias("name")).unionByName(src.join(asked, "id").select("id", "k", "low", F.col("person").alias("name"))).distinct()
    places = occurrences(named, ["id", "k", "name"], "low", _whole(F.col("name"))).select("id", "k", "name", "start", "end")
    verbs = occurrences(src, ["id", "k"], "low", says).select("id", "k", F.lit(None).cast("string").alias("name"), F.col("start").alias("at"), F.col("start").alias("verb"), F.lit(None).cast("int").alias("start"))
    ahead = Window.partitionBy("id", "k").orderBy("at", F.col("verb").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    marked = places.select("id", "k", "name", F.col("end").alias("at"), F.lit(None).cast("int").alias("verb"), "start").unionByName(verbs).withColumn("next", F.first("verb", ignorenulls=True).over(ahead)).where("name is not null")
    speaks = F.max(F.coalesce(F.col("next") - F.col("at") < reach, F.lit(False))).over(Window.partitionBy("id", "k", "name"))
    mentions = written(marked.select("id", "k", "name", "start", speaks.alias("speaks")), "mentions")
    holding = persons.join(mentions.select("id", "k", F.col("name").alias("person")).distinct(), ["id", "person"])

    # what the sentences state, and where it stands
    stated = own.select("id", "n", F.explode(claims(F.col("text"))).alias("claim"))
    wide = src.select("id", "k", "low")
    claim_places = occurrences(stated.join(wide, "id"), ["id", "k", "n", "claim"], "low", _whole(F.col("claim"))).select("id", "k", "n", F.lit("claim").alias("kind"), F.lit(0).alias("place"), F.col("claim").alias("what"), F.col("start").alias("at"))
    spelled = own.select("id", "n", F.filter(F.regexp_extract_all("low", F.lit(r"\p{L}+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*plain)).alias("w"))
    bare = persons.join(spelled, ["id", "n"]).select("id", "n", "person", F.filter("w", lambda w: ~F.array_contains(F.split("person", " "), w)).alias("w"))
    pair = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda k: k < F.size("w")), lambda k: F.struct(k.alias("place"), F.element_at("w", k).alias("a"), F.element_at("w", k + 1).alias("b")))
    stem = lambda c: F.substring(c, F.lit(1), F.greatest(F.lit(3), F.length(c) - 3))
    pairs = bare.select("id", "n", "person", F.explode(pair).alias("p")).select("id", "n", "person", "p.*", F.substring("p.a", 1, 3).alias("a3"), F.substring("p.b", 1, 3).alias("b3"))
    # a word and the next, if only white space lies between; only words that begin like some of the sentences' go on
    wanted = pairs.groupBy("id").agg(F.collect_set(F.concat_ws(" ", "a3", "b3")).alias("wanted"))
    word = F.lit(r"[\p{L}\p{N}_]+")
    spelt = F.zip_with(F.split("low", word, -1), F.regexp_extract_all("low", word, F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    by_place = Window.partitionBy("id", "k").orderBy("_n")
    heard = src.join(wanted, "id").repartition("id").select("id", "k", "wanted", F.posexplode(spelt).alias("_n", "_x")).where("_x.match is not null")
    heard = heard.withColumn("start", (F.sum(F.length("_x.gap") + F.length("_x.match")).over(by_place) - F.length("_x.match")).cast("int"))
    two = heard.select("id", "k", "wanted", F.lag("start").over(by_place).alias("at"), F.lag("_x.match").over(by_place).alias("first"), F.col("_x.match").alias("second"), F.col("_x.gap").alias("gap"))
    two = two.where(F.col("gap").rlike(r"^\s+$") & F.col("first").isNotNull()).select("id", "k", "wanted", "at", "first", "second", F.substring("first", 1, 3).alias("a3"), F.substring("second", 1, 3).alias("b3"))
    two = two.where(F.array_contains("wanted", F.concat_ws(" ", "a3", "b3"))).drop("wanted")
    pair_places = pairs.join(two, ["id", "a3", "b3"]).where(F.col("first").startswith(stem(F.col("a"))) & F.col("second").startswith(stem(F.col("b"))))
    pair_places = pair_places.select("id", "k", "n", "person", F.lit("pair").alias("kind"), "place", F.concat_ws(" ", "a", "b").alias("what"), "at")

    # the last name before each place, of the person and those who speak
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    probes = holding.join(claim_places, ["id", "k", "n"]).select("id", "n", "order", "person", "k", "kind", "place", "what", "at", none("owner", "string"))
    probes = probes.unionByName(holding.join(pair_places, ["id", "k", "n", "person"]).select("id", "n", "order", "person", "k", "kind", "place", "what", "at", none("owner", "string")))
    said = holding.join(mentions, ["id", "k"]).where("speaks or name = person").select("id", "n", "order", "person", "k", none("kind", "string"), none("place", "int"), none("what", "string"), F.col("start").alias("at"), F.col("name").alias("owner"))
    before = Window.partitionBy("id", "n", "person", "k").orderBy("at", F.col("owner").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    owned = probes.unionByName(said).withColumn("owner", F.last("owner", ignorenulls=True).over(before)).where("kind is not null")

    mine, others = F.col("owner").eqNullSafe(F.col("person")), F.col("owner").isNotNull() & (F.col("owner") != F.col("person"))
    # a claim may stand nowhere in another's words only; two words in a row may stand before anyone speaks, too
    each = owned.groupBy("id", "n", "order", "person", "kind", "what").agg(F.min("place").alias("place"), F.bool_or(mine).alias("mine"), F.bool_or(others).alias("others"), F.bool_and(others).alias("only"))
    hits = lambda kind, good: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & good, F.struct("place", "what"))))
    summed = each.groupBy("id", "n", "order", "person").agg(hits("claim", F.col("only")).alias("c"), hits("pair", F.col("others")).alias("p"), F.bool_or("mine").alias("mine"))
    given = F.transform(F.when(F.size("c") > 0, F.col("c")).when(~F.col("mine"), F.col("p")), lambda x: x["what"])
    first = summed.withColumn("given", given).where("size(given) > 0").groupBy("id", "n").agg(F.min(F.struct("order", "person", "given")).alias("g"))
    return first.select("id", "n", "g.person", "g.given")


def misattributed(statements: DataFrame, saying: tuple[str, ...] = SAYING, reach: int = 200) -> DataFrame:
    """Rows (id, claim, speaker, source, names) with ``given_to``: whom the source has say the claim, if never the speaker.

    A speaker's span runs from a name that a verb of saying follows within ``reach`` characters to the
    next such name; a claim that also stands outside all spans, or in the speaker's own, is not
    misattributed (null), nor one that the source lacks.  ``id`` is unique.
    """
    rows = written(statements, "statements")
    says = F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(saying)})(?![\p{{L}}\p{{N}}_])")
    named = rows.select("id", "source", F.explode(F.array_distinct("names")).alias("name"))
    places = occurrences(named, ["id", "name"], "source", _whole(F.col("name"))).select("id", "name", "start", F.col("end").alias("at"), F.lit(None).cast("int").alias("verb"))
    verbs = occurrences(rows, ["id"], "source", says).select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start"), F.col("start").alias("at"), F.col("start").alias("verb"))
    ahead = Window.partitionBy("id").orderBy("at", F.col("verb").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    mentions = places.unionByName(verbs).withColumn("next", F.first("verb", ignorenulls=True).over(ahead)).where(F.col("name").isNotNull() & (F.col("next") - F.col("at") < reach))
    probes = occurrences(rows.where("length(claim) > 0"), ["id"], "source", _whole(F.col("claim"))).select("id", F.lit(None).cast("string").alias("name"), F.col("start").alias("at"))
    marks = mentions.select("id", "name", F.col("start").alias("at")).unionByName(probes)
    before = Window.partitionBy("id").orderBy("at", F.col("name").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.withColumn("owner", F.last("name", ignorenulls=True).over(before)).where("name is null").join(rows.select("id", "speaker"), "id")
    given = owned.groupBy("id").agg(F.bool_and(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("speaker"))).alias("bad"), F.min(F.struct("at", "owner")).alias("first"))
    return rows.join(given.where("bad").select("id", F.col("first.owner").alias("given_to")), "id", "left").select(*statements.columns, "given_to")


def other_organisations(answers: DataFrame, kinds: tuple[str, ...] = ("Company", "Bank", "University", "Ministry", "Court", "Institute")) -> DataFrame:
    """(id, others): organisations of the asked one's kind that the sources name instead of it.

    ``answers``: id, asked, sources (array of texts).  A name is one to three capitalised words and
    a word of a kind.
    """
    found = lambda text: F.regexp_extract_all(text, F.lit(rf"(?:\p{{Lu}}[\p{{L}}]*+ ){{1,3}}(?:{'|'.join(kinds)})\b"), F.lit(0))
    kind = lambda name: F.substring_index(name, " ", -1)
    asked = F.get(found(F.col("asked")), F.lit(0))
    others = F.array_distinct(F.flatten(F.transform("sources", found)))
    rows = answers.select("id", asked.alias("_asked"), others.alias("_all"))
    missing = ~F.array_contains("_all", F.col("_asked"))
    return rows.select("id", F.when(F.col("_asked").isNotNull() & missing, F.array_sort(F.filter("_all", lambda n: kind(n) == kind(F.col("_asked"))))).otherwise(F.array().cast("array<string>")).alias("others"))


def rendered(sources: DataFrame) -> DataFrame:
    """(query_id, text): the numbered sources of a question in order, each with its title, heading path and text.

    ``sources``: query_id, n, title, path (array), text.
    """
    one = F.concat_ws("\n", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.coalesce("title", F.lit(""))), F.nullif(F.array_join("path", " > "), F.lit("")), "text")
    return sources.select("query_id", F.struct("n", one.alias("t")).alias("s")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("text"))


def parsed_reply(text: Column) -> Column:
    """(sentence, citations) structs of a JSON reply {"sentences": [{"text", "citations"}]}, repeated sentences merged.

    Of a reply that is cut off, the sentences that are complete count.
    """
    item = r'\{\s*"text"\s*:\s*"(?:[^"\\]|\\.)*+"\s*,\s*"citations"\s*:\s*\[[0-9,\s]*+\]\s*\}'
    each = F.transform(F.regexp_extract_all(text, F.lit(item), F.lit(0)), lambda s: F.from_json(s, "text string, citations array<int>"))
    firsts = F.array_distinct(F.transform(each, lambda s: s["text"]))
    return F.transform(firsts, lambda t: F.struct(t.alias("sentence"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(each, lambda s: s["text"] == t), lambda s: s["citations"])))).alias("citations")))


def indexed_text(context: Column, path: Column, text: Column) -> Column:
    """What a chunk is indexed by: context, heading path and text, empty parts left out."""
    return F.array_join(F.filter(F.flatten(F.array(F.array(context), path, F.array(text))), lambda x: x.isNotNull() & (x != "")), "\n")


def currency_marks(text: Column, wrong: str = "£", right: str = "₺") -> Column:
    """A mark that recognition confuses, put right before a digit."""
    return F.regexp_replace(text, rf"{wrong}(?=\s?[0-9])", right)
