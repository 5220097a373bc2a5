"""Typed entities by ordered rules, and metadata suggestions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENGLISH, Language, fold


def rules(language: Language = ENGLISH) -> list[tuple[str, str]]:
    """(kind, pattern) in the order in which they claim spans; groups are what ``value`` reads."""
    month = "|".join(language.months)
    return [
        ("date", r"(?<![\w.])(\d{1,2})[./](\d{1,2})[./](\d{4})(?!\w)"),
        ("date", rf"(?<!\w)(\d{{1,2}}) ({month}) (\d{{4}})(?!\w)"),
        ("amount", r"(?<![\w.,])([€$£₺])\s?(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+(?:,\d{2})?)(?![\w])"),
        ("amount", r"(?<![\w.,])(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+(?:,\d{2})?)\s?(eur|usd|gbp|try|euros?|dollars?)(?!\w)"),
        ("number", rf"(?<!\w)({'|'.join(language.court_marks)})\.\s?:?\s?(\d{{4}}/\d{{1,6}})(?!\w)"),
        ("number", r"(?<!\w)(?:decision|docket|order) (?:no\.? )?(\d{1,6}/\d{1,6}|\d{2,10})(?![\w/])"),
        ("number", r"(?<![\d./])((?:19|20)\d{2}/\d{1,6})(?![\d/])"),
        ("law", r"(?<!\w)law no\.? (\d{2,5})(?!\w)"),
        ("article", rf"(?<!\w){language.article} (\d{{1,4}}(?:/\d{{1,3}})?)(?!\w)"),
        ("article", rf"(?<!\w)(\d{{1,4}})(?:st|nd|rd|th) {language.article}(?!\w)"),
        ("parcel", r"(?<!\w)block (?:no\.? )?(\d{1,6}),? (?:and )?parcel (?:no\.? )?(\d{1,6})(?!\w)"),
        ("parcel", r"(?<!\w)parcel (?:no\.? )?(\d{1,6})(?!\w)"),
    ]


_CURRENCY = {"€": "EUR", "$": "USD", "£": "GBP", "₺": "TRY", "eur": "EUR", "euro": "EUR", "euros": "EUR", "usd": "USD", "dollar": "USD", "dollars": "USD", "gbp": "GBP", "try": "TRY"}


def value(kind: str, groups: tuple[str, ...], language: Language = ENGLISH) -> str | None:
    """The normalised value; None where there is none, as for an impossible date."""
    if kind == "date":
        day, month, year = groups
        number = int(month) if month.isdigit() else language.months.index(month) + 1
        try:
            return date(int(year), number, int(day)).isoformat()
        except ValueError:
            return None
    if kind == "amount":
        sign, digits = (groups[0], groups[1]) if groups[0] in _CURRENCY else (groups[1], groups[0])
        whole, _, cents = digits.replace(".", "").partition(",")
        return f"{int(whole)}.{cents or '00'} {_CURRENCY[sign]}"
    if kind == "number" and len(groups) == 2:  # a court's mark and the number behind it
        return f"{groups[0].upper()}.{groups[1]}"
    return "/".join(groups)


class Claims:
    """Intervals that don't overlap, in order; each question takes the logarithm of their number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return (not k or self.ends[k - 1] <= start) and (k == len(self.starts) or self.starts[k] >= end)

    def take(self, start: int, end: int) -> None:
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def extract(docs: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """(key, start, kind, value, written): the first rule to claim a span wins, overlaps are dropped.

    A match without a value claims nothing.  Span claiming is a fold over a text's matches, so it
    runs in Arrow batches; a shortcut leaves out texts without a digit.
    """
    compiled = [(kind, re.compile(pattern)) for kind, pattern in rules(language)]

    def found(text: str, folded: str) -> Iterator[tuple[int, str, str, str]]:
        claims = Claims()
        for kind, pattern in compiled:
            for m in pattern.finditer(folded):
                if claims.free(*m.span()) and (v := value(kind, m.groups(), language)) is not None:
                    claims.take(*m.span())
                    yield m.start(), kind, v, text[m.start() : m.end()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, *own) for key, text, folded in zip(frame["key"], frame["text"], frame["folded"], strict=True) for own in sorted(found(text, folded))]
            yield pd.DataFrame(rows, columns=["key", "start", "kind", "value", "written"])

    some = docs.where(F.col("text").rlike(r"\p{Nd}")).select("key", "text", fold(F.col("text"), language).alias("folded"))
    return some.mapInPandas(run, "key long, start int, kind string, value string, written string")


def document_kind(title, head, language: Language = ENGLISH, head_letters: int = 1500):
    """The kind whose word stands first, at a word's start; the longer word on ties; the title before the head."""

    def first(text):
        padded = F.concat(F.lit(" "), F.regexp_replace(fold(text, language), r"[^\p{L}\p{N}]", " "))
        found = [F.when(F.instr(padded, F.lit(" " + word)) > 0, F.struct(F.instr(padded, F.lit(" " + word)).alias("at"), F.lit(-len(word)).alias("size"), F.lit(kind).alias("kind"))) for word, kind in language.kinds]
        return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))["kind"]

    return F.coalesce(first(title), first(F.substring(head, 1, head_letters)))


def suggest(documents: DataFrame, entities: DataFrame, language: Language = ENGLISH, head_letters: int = 1500) -> DataFrame:
    """Documents (key, title, text, kind, document_date, reference, by_hand) with suggestions where nobody set a field by hand."""
    head = entities.where(F.col("start") < head_letters).groupBy("key").agg(F.min(F.when(F.col("kind") == "date", F.struct("start", "value"))).alias("d"), F.min(F.when(F.col("kind") == "number", F.struct("start", "value"))).alias("r"))
    both = documents.join(head, "key", "left")
    keep = lambda name, new: F.when(F.array_contains("by_hand", name), F.col(name)).otherwise(F.coalesce(new, F.col(name))).alias(name)
    return both.select("key", keep("kind", document_kind(F.col("title"), F.col("text"), language)), keep("document_date", F.col("d.value").cast("date")), keep("reference", F.col("r.value")))
