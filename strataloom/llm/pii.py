"""Surrogates for personal data, with DataFrame functions only (operator 5).

Entities are found by pattern.  Each is replaced by a keyed surrogate of the same type, format and
script: every letter or digit moves within its own alphabet by an amount that depends on the key
and on the characters already written, first from left to right, then from right to left.  This
is a bijection on the strings of one pattern, so different values stay different and the same
value has the same surrogate everywhere.  A check over the whole corpus re-keys surrogates that
are somebody's real value or that two values share after all (names come from lists).

Found are e-mail and IP addresses, IBANs, card, social security and telephone numbers, and persons
behind a title; the words of these names are replaced wherever else they stand in the text.  Names
without any title in the text are not found.
"""

from __future__ import annotations

import unicodedata
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .shared import written

# The alphabets of the languages at hand.
_SMALL = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
# Latin letters with marks that have both cases, and those that have one.
_MARKED = "".join(c for c in map(chr, range(0xDF, 0x180)) if c.islower() and len(c.upper()) == 1 and 0xC0 <= ord(c.upper()) < 0x180 and c.upper().lower() == c)
_ONE_CASE = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and c not in _MARKED + _MARKED.upper())
#: Alphabets within which a character moves; a letter and its capital stand at the same place.
ALPHABETS = ("0123456789", *(x for a in (*_SMALL, _MARKED) for x in (a, a.upper())), _ONE_CASE)
#: Within names, vowels move among vowels and consonants among consonants.
NAME_ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *ALPHABETS[3:])


def _ranges() -> list[tuple[int, int]]:
    """First and last code points of letters or digits in a row, for all other scripts: of one kind where eight are, else of any.

    The script of a character is the first word of its name.
    """
    kinds = [unicodedata.category(chr(c)) + unicodedata.name(chr(c), "").split(" ")[0] for c in range(0x32000)]
    own, rest, taken = [], [], "".join(ALPHABETS)
    for same in (True, False):
        first = None
        for c in range(0x180, len(kinds) + 1):
            kind = kinds[c] if c < len(kinds) else "end"
            inside = kind[0] in "LN" and chr(c) not in taken and not any(a <= c <= b for a, b in own[-1:] + ([] if same else own))
            if first is not None and (not inside or same and kind != kinds[first] or not same and (kind[0], kind[2:]) != (kinds[first][0], kinds[first][2:])):
                if c - first >= (8 if same else 2):
                    (own if same else rest).append((first, c - 1))
                first = None
            if first is None and inside:
                first = c
    return sorted(own + rest)


RANGES = _ranges()
# Titles that show a gender, and given names of either gender.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Dra")
MALE_NAMES = ("Adam", "Bruno", "Carlos", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "James", "Karl", "Louis", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor")
FEMALE_NAMES = ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ines", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera")

_TITLES = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’]++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: (kind, pattern); the first that matches at a place wins.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}"),
    ("ip", rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\p{{N}})"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\p{N})|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?!\p{N})|(?<![\p{L}\p{N}+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}-])"),
    ("person", rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:(?:{_TITLES})\.? )?{_NAME}(?:[ -]{_NAME}){{0,5}}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Every entity holds one of these.
HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}"


@dataclass(frozen=True)
class PiiParams:
    """``key`` should come from a secret store in production."""

    key: str = "strataloom-surrogates"
    max_rounds: int = 20


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def kind(entity: Column) -> Column:
    """The first pattern that matches the whole entity."""
    out = F.when(F.lit(False), "")
    for name, pattern in PATTERNS:
        out = out.when(entity.rlike(rf"^(?:{pattern})$"), name)
    # a word of a name that stands alone
    return out.otherwise("word")


def _number(*parts: Column) -> Column:
    """A keyed non-negative number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def _shifted(char: Column, by: Column, alphabets: Column) -> Column:
    """The character moved within its alphabet or range; a character of neither stays."""
    own = F.filter(alphabets, lambda a: F.instr(a, char) > 0)
    moved = F.transform(own, lambda a: F.substring(a, (F.pmod(F.instr(a, char) - 1 + by, F.length(a)) + 1).cast("int"), F.lit(1)))
    return F.coalesce(F.get(moved, F.lit(0)), F.when(F.ascii(char) >= 0x180, _ranged(char, by)), char)


def _ranged(char: Column, by: Column) -> Column:
    """The same for scripts without an alphabet: code points move within their range."""
    numbers = lambda k: F.split(F.lit(",".join(str(r[k]) for r in RANGES)), ",").cast("array<int>")
    place = F.size(F.filter(numbers(0), lambda first: first <= F.ascii(char)))

    def moved(r: Column) -> Column:
        point = r["first"] + F.pmod(F.ascii(char) - r["first"] + by, r["last"] - r["first"] + 1)
        return F.when(F.ascii(char) <= r["last"], F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))

    return F.when(place > 0, _let(F.struct(F.get(numbers(0), place - 1).alias("first"), F.get(numbers(1), place - 1).alias("last")), moved))


def _pass(value: Column, key: Column, alphabets: Column) -> Column:
    """Each character moves by an amount that depends on what is already written.

    The case of a letter doesn't count, so values that differ in case only keep doing so.
    """
    step = lambda done, i: F.concat(done, _shifted(F.substring(value, i, F.lit(1)), _number(key, i, F.lower(done)), alphabets))
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.length(value)), lambda i: i > 0), F.lit(""), step)


def _moved(value: Column, key: Column, alphabets: Column) -> Column:
    return _let(F.reverse(_pass(value, key, alphabets)), lambda v: F.reverse(_pass(v, F.concat(key, F.lit("r")), alphabets)))


def _ip(e: Column, key: Column) -> Column:
    """Four numbers below 256 move instead of characters."""

    def go(parts: Column, key: Column) -> Column:
        step = lambda done, x: F.concat(done, F.array(F.pmod(x.cast("long") + _number(key, F.array_join(done, ".")), F.lit(256)).cast("string")))
        return F.aggregate(parts, F.array().cast("array<string>"), step)

    return F.array_join(F.reverse(go(F.reverse(go(F.split(e, r"\."), key)), F.concat(key, F.lit("r")))), ".")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check, the last digit counting once."""
    doubled = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    value = lambda i: _let(F.substring(digits, -i, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 0, doubled(x)).otherwise(x))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that letters and digits stand for: A is 10, B 11, and so on."""
    one = lambda done, c: F.when(c.rlike("[0-9]"), (done * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (done * 100 + F.ascii(c) - 55) % 97).otherwise(done)
    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _iban(moved: Column, original: Column) -> Column:
    """``moved`` with the check digits that leave the remainder of the original."""
    turned = lambda x, check: F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 2), check)
    check = F.pmod(_mod97(turned(original, F.substring(original, 3, 2))) - _mod97(turned(moved, F.lit("00"))), F.lit(97))
    return F.concat(F.substring(moved, 1, 2), F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), F.substring(moved, F.lit(5), F.length(moved)))


def _name_words(person: Column) -> Column:
    """The words of a person's name, without titles."""
    return F.regexp_extract_all(F.regexp_replace(person, rf"^(?:(?:{_TITLES})\.? )+", ""), F.lit(_NAME), F.lit(0))


def _pieces(e: Column, what: Column) -> Column:
    """Pieces of an entity and what happens to them: keep, move, name (moves as a name), male or female (given names of a list)."""
    piece = lambda text, mode: F.struct(text.alias("text"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"))
    rest = lambda text, skipped: F.substring(text, F.length(skipped) + 1, F.length(text))
    top = F.substring_index(e, ".", -1)
    domain = F.substring_index(e, "@", -1)
    country = F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    title = F.regexp_extract(e, rf"^(?:(?:{_TITLES})\.? )+", 0)
    bare = F.regexp_extract(title, r"^\p{L}+", 0)
    parts = F.regexp_extract_all(rest(e, title), F.lit(rf"{_NAME}|[ -]"), F.lit(0))
    gender = F.when(bare.isin(*MALE_TITLES), "male").when(bare.isin(*FEMALE_TITLES), "female")
    listed = lambda x: F.when((gender == "male") & x.isin(*MALE_NAMES) | (gender == "female") & x.isin(*FEMALE_NAMES), gender)
    # a known given name in front of another word becomes another one of its gender
    named = F.transform(parts, lambda x, k: piece(x, F.when(x.rlike("^[ -]$"), "keep").when((k == 0) & (F.size(parts) > 1), F.coalesce(listed(x), F.lit("name"))).otherwise("name")))
    return (
        F.when(what == "email", F.array(piece(F.substring_index(e, "@", 1), "move"), piece(F.lit("@"), "keep"), piece(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), "move"), piece(top, "keep")))
        .when(what == "iban", F.array(piece(F.substring(e, 1, 4), "keep"), piece(F.substring(e, F.lit(5), F.length(e)), "move")))
        .when(what == "card", F.array(piece(F.substring(e, 1, 1), "keep"), piece(F.substring(e, F.lit(2), F.length(e) - 2), "move")))
        .when(what == "phone", F.array(piece(country, "keep"), piece(rest(e, country), "move")))
        .when(what == "person", F.concat(F.array(piece(title, "keep")), named))
        .when(what == "word", F.array(piece(e, "name")))
        .otherwise(F.array(piece(e, "move")))
    )


def _listed(name: Column, key: Column, names: tuple[str, ...]) -> Column:
    """Another name of the list; different names get different ones."""
    all_names = F.array(*map(F.lit, names))
    step = F.pmod(_number(key, F.lit(names[0])), F.lit(len(names) - 1)) + 1
    return F.element_at(all_names, (F.pmod(F.array_position(all_names, name) - 1 + step, F.lit(len(names))) + 1).cast("int"))


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity; another attempt gives another one.

    Of a card number the first digit and the remainder of the Luhn check stay, of an IBAN the
    country and the remainder by 97, of a phone number the country, of an address the top-level
    domain, of a person the titles; a known given name becomes another of its gender.
    """
    k = F.concat(F.lit(key), F.lit("#"), attempt.cast("string"))
    plain, sound = (F.array(*map(F.lit, a)) for a in (ALPHABETS, NAME_ALPHABETS))

    def one(p: Column) -> Column:
        alphabets = F.when(p["mode"] == "move", plain).otherwise(sound)
        return F.when(p["mode"] == "keep", p["text"]).when(p["mode"] == "male", _listed(p["text"], k, MALE_NAMES)).when(p["mode"] == "female", _listed(p["text"], k, FEMALE_NAMES)).otherwise(_moved(p["text"], k, alphabets))

    def whole(x: Column) -> Column:
        joined = F.array_join(F.transform(_pieces(x["e"], x["kind"]), one), "")
        checked = _let(joined, lambda j: F.concat(j, F.pmod(_luhn(_only_digits(x["e"])) - _luhn(F.concat(_only_digits(j), F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(x["kind"] == "ip", _ip(x["e"], k)).when(x["kind"] == "card", checked).when(x["kind"] == "iban", _let(joined, lambda j: _iban(j, x["e"]))).otherwise(joined)

    return _let(F.struct(entity.alias("e"), kind(entity).alias("kind")), whole)


def entities(text: Column) -> Column:
    """All entities of a text in order; an empty array without any or for a null text."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def attempts(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """(value, attempt): the values of the corpus whose first surrogate clashes, and the attempt that doesn't.

    Values are compared in lower case.  A surrogate clashes if it is a value of the corpus or the
    surrogate of a smaller value.  Distinct values only are shuffled.
    """
    values = docs.select(F.explode(F.array_distinct(entities(F.col("text")))).alias("value")).groupBy(F.lower("value").alias("low")).agg(F.min("value").alias("value"))
    keyed = lambda df: df.withColumn("made", F.lower(surrogate(F.col("value"), params.key, F.col("attempt"))))
    made = written(keyed(values.withColumn("attempt", F.lit(0))), "made")
    originals = made.select(F.col("low").alias("made"))
    for round_ in range(params.max_rounds + 1):
        shared = made.groupBy("made").agg(F.count("*").alias("n"), F.min("low").alias("least")).where("n > 1")
        double = made.join(shared, "made").where("low <> least").select("low")
        real = made.join(originals, "made", "left_semi").select("low")
        bad = written(double.union(real).distinct(), "clashes")
        if bad.isEmpty():
            break
        if round_ == params.max_rounds:
            warnings.warn(f"{bad.count()} values, of formats nearly all of whose strings are in use, still share a surrogate after {params.max_rounds} rounds", stacklevel=2)
            break
        # only these are made anew
        again = keyed(made.join(bad, "low", "left_semi").select("low", "value", (F.col("attempt") + 1).alias("attempt")))
        made = written(made.join(bad, "low", "left_anti").unionByName(again), "made")
    return made.where("attempt > 0").select(F.col("low").alias("value"), "attempt")


def replaced(docs: DataFrame, params: PiiParams = PiiParams(), count_name: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of entities and later mentions if ``count_name`` is given.

    Every row stays, repeated ones too; a null text stays null and other columns are kept, but for
    one of the name ``count_name``.  Texts of any length are read whole.  Only where values clash
    are documents joined, by a digest of the text, so that rows with the same or a null doc_id are
    told apart.
    """
    again = written(attempts(docs, params), "attempts")
    columns = [c for c in docs.columns if c != count_name]
    if again.isEmpty():
        docs = docs.withColumn("_again", F.lit(None).cast("map<string,int>"))
    else:
        docs = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
        own = docs.select("_text", F.explode(F.array_distinct(F.transform(entities(F.col("text")), F.lower))).alias("value")).distinct()
        own = own.join(again, "value").groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias("_again"))
        docs = docs.join(own, "_text", "left")
    found = docs.withColumn("_found", entities(F.col("text")))
    one = lambda e: surrogate(e, params.key, F.coalesce(F.element_at("_again", F.lower(e)), F.lit(0)))
    # the words of the names count as entities too, wherever else they stand; one pattern a text, so the cost is one more pass
    persons = F.filter("_found", lambda e: e.rlike(rf"^(?:{_TITLES})\.? "))
    found = found.withColumn("_names", F.when(F.size("_found") > 0, F.array_distinct(F.flatten(F.transform(persons, _name_words)))))
    mention = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}'’])(?=\p{{Lu}})(?:"), F.array_join("_names", "|"), F.lit(r")(?![\p{L}'’])"))
    found = found.withColumn("_pattern", F.when(F.size("_names") > 0, mention).otherwise(ANY))
    found = found.withColumn("_found", F.when(F.size("_names") > 0, F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_found")))
    gaps = F.split("text", F.col("_pattern"), -1)
    # as many gaps as entities and one more: gap, entity, gap, ..., gap
    woven = F.flatten(F.zip_with(gaps, F.transform("_found", one), lambda g, s: F.array(g, F.coalesce(s, F.lit("")))))
    text = F.when(F.size("_found") > 0, F.array_join(woven, "")).otherwise(F.col("text")).alias("text")
    more = [F.size("_found").alias(count_name)] if count_name else []
    return found.select(*[text if c == "text" else F.col(c) for c in columns], *more)
