"""Text functions as column expressions; language conventions are parameters."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column

WORD = r"[\p{L}\p{N}_]+"
#: Words joined by dots, bars or hyphens, or single ones, so that no search fails within a word and starts anew.
COMPOUND = r"[\p{L}\p{N}_]++(?:[./-]++[\p{L}\p{N}_]++)*+"
JOINT = r"[\p{L}\p{N}_][./-]+[\p{L}\p{N}_]"

@dataclass(frozen=True)
class Language:
    """Conventions of a language: folding, months, kinds of documents, abbreviations and headings."""

    name: str = "en"
    fold_from: str = ""
    fold_to: str = ""
    months: tuple[str, ...] = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    kinds: tuple[tuple[str, str], ...] = (("contract", "contract"), ("invoice", "invoice"), ("decision", "decision"), ("report", "report"), ("letter", "letter"))
    abbreviations: tuple[str, ...] = ("no", "art", "e.g", "i.e", "dr", "mr", "mrs", "prof", "vol", "pp")
    court_marks: tuple[str, ...] = ("e", "k")
    part: str = "part"
    chapter: str = "chapter"
    article: str = "article"
    page: str = "page"


ENGLISH = Language()
TURKISH = Language("tr", "Iİ", "ıi", ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık"), (("sözleşme", "contract"), ("fatura", "invoice"), ("karar", "decision"), ("rapor", "report")), ("no", "md", "vb", "dr"), ("e", "k", "d"), "kısım", "bölüm", "madde", "sayfa")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(text: Column, language: Language = ENGLISH) -> Column:
    """Lower case by the language's own letters; the length in characters stays."""
    moved = F.translate(text, language.fold_from, language.fold_to) if language.fold_from else text
    return F.lower(moved)


def words(text: Column, language: Language = ENGLISH) -> Column:
    return F.regexp_extract_all(fold(text, language), F.lit(WORD), F.lit(0))


def lexical_terms(text: Column, language: Language = ENGLISH, letters: int = 5) -> Column:
    """Search terms: words without a digit cut to five letters, then whole identifiers; repeats are kept."""
    folded, letter = fold(text, language), r"[\p{L}\p{Nl}\p{No}_]"
    # each match is a whole word; its group is the cut one, or all of it if a digit follows
    cut = rf"({letter}{{1,{letters}}}+(?={letter}*+(?!\p{{Nd}}))|[\p{{L}}\p{{N}}_]++)[\p{{L}}\p{{N}}_]*+"
    # a single word is among the words already, so only compound identifiers add something
    compound = F.filter(F.regexp_extract_all(folded, F.lit(COMPOUND), F.lit(0)), lambda x: (F.length(x) >= 4) & x.rlike("[./-]") & x.rlike(r"\p{Nd}"))
    return F.concat(F.regexp_extract_all(folded, F.lit(cut), F.lit(1)), F.when(folded.rlike(JOINT), compound).otherwise(F.array().cast("array<string>")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.6).cast("int")


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """Canonical composition (NFC); only texts with combining marks or conjoining letters have their content sent to Python."""
    marked = text.rlike(r"[\p{M}\u1100-\u11FF\u212A\u212B\u2126]")
    return F.when(marked, F.pandas_udf(_composed, "string")(F.when(marked, text))).otherwise(text)


def plain_letters(text: Column, foreign: str, plain: str) -> Column:
    """Letters that recognition takes from another alphabet, as those of the language."""
    return F.translate(text, foreign, plain)


def opening(text: Column, letters: int = 140) -> Column:
    """The first words of a text in at most so many letters."""
    return F.when(F.length(text) <= letters, text).otherwise(F.regexp_replace(F.substring(text, 1, letters + 1), r"\s+\S*$", ""))


def clean(text: Column) -> Column:
    """Line ends to \\n, composed, control and format characters away, trimmed."""
    plain = F.regexp_replace(composed(F.regexp_replace(text, r"\r\n?", "\n")), r"[\p{C}&&[^\n\t]]", "")
    return F.regexp_replace(plain, r"^\s+|(?<!\s)\s++$", "")


def claims(text: Column, language: Language = ENGLISH) -> Column:
    """Distinct tokens with a digit, in order, once citations are removed and edges stripped."""
    plain = F.regexp_replace(F.lower(text), r"\[[0-9][0-9, ]*\]", " ")
    tokens = F.filter(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}./,_-]+"), F.lit(0)), lambda x: x.rlike(r"\p{Nd}"))
    return F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.,/_-]+|(?<![.,/_-])[.,/_-]++$", "")))


def citations(text: Column) -> Column:
    """Distinct numbers cited as [n] or [n, m], in order."""
    lists = F.regexp_extract_all(text, F.lit(r"\[([0-9][0-9, ]*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))


def stands_in(claim: Column, source: Column) -> Column:
    """The claim is a whole token of the (lower-cased) source."""
    padded = F.concat(F.lit(" "), F.array_join(claims(source), " "), F.lit(" "))
    return F.instr(padded, F.concat(F.lit(" "), claim, F.lit(" "))) > 0


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two word sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))
