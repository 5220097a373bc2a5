"""Secret scan with corpus-wide ownership, with DataFrame functions only (operator 7).

Patterns find candidates and their places.  Candidates are hashed and counted over the whole
corpus by distinct repositories and owners: what many owners hold is a copied example, what one
owner alone holds looks live.  Bare tokens of high variety count as secrets only if they look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .shared import written

# The patterns, each with the part that is the secret and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of base64 letters; a bare secret has all three kinds of letters and none of a word's marks.
BARE = r"[A-Za-z0-9+/_=-]{20,}"
#: Shortcuts that hold for every match that counts.
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
LONG_HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class SecretParams:
    """``repository`` and ``owner`` name columns; ``copied_from`` owners make a copied example."""

    repository: str = "doc_id"
    owner: str = "source"
    copied_from: int = 3


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(numbers: Column) -> Column:
    """Sums of the first, the first two, ... numbers of an array.

    Arrays grow by copying, so the sums are made within blocks of about the root of the length and
    the blocks' own sums are added: n numbers cost n^1.5 steps instead of n^2.
    """
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))

    def step(done: Column, x: Column) -> Column:
        total = done["sum"] + x
        return F.struct(total.alias("sum"), F.array_append(done["sums"], total).alias("sums"))

    def plain(xs: Column) -> Column:
        return F.aggregate(xs, zero, step, lambda d: d["sums"])

    def added(blocks: Column) -> Column:
        before = lambda sums: _let(F.transform(sums, lambda s: F.element_at(s, -1)), lambda ends: F.zip_with(plain(ends), ends, lambda total, own: total - own))
        return _let(F.transform(blocks, plain), lambda sums: F.flatten(F.zip_with(sums, before(sums), lambda s, base: F.transform(s, lambda x: x + base))))

    def blocks(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x["n"]))).cast("int")
        starts = F.filter(F.sequence(F.lit(1), F.size(x["n"]), width), lambda k: k > 0)
        return F.transform(starts, lambda k: F.slice(x["n"], k, width))

    whole = lambda x: F.when(F.size(x["n"]) > 0, _let(blocks(x), added)).otherwise(F.array().cast("array<int>"))
    return _let(F.struct(numbers.alias("n")), whole)


_SPANS = "array<struct<start:int,order:int,end:int,kind:string,hash:string>>"


def _spans(text: Column, pattern: str, kind: str, order: int, hint: str, keep, secret) -> Column:
    """Matches with their places in code points, leftmost and without overlap; ``keep`` filters them.

    The gaps between the matches come from a split by the same pattern, so lengths add up to places.
    """

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        pairs = F.filter(F.zip_with(ends, found, lambda end, m: F.struct(end.alias("end"), m.alias("match"))), lambda x: keep(x["match"]))
        return F.transform(pairs, lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(secret(x["match"]), 256).alias("hash")))

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(hint), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; either array is in order and without overlap within itself.

    Of the others that begin before a span ends, the last one alone can reach it.
    """
    marks = F.concat(
        F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("other"), F.lit(None).cast("int").alias("span"))),
        F.transform(spans, lambda s, k: F.struct(s["end"].alias("at"), F.lit(0).alias("other"), k.alias("span"))),
    )

    def of(marks: Column) -> Column:
        counted = F.zip_with(marks, running(F.transform(marks, lambda m: m["other"])), lambda m, n: F.struct(m["span"].alias("span"), n.alias("before")))
        # the spans' marks are in the order of the spans
        before = F.filter(counted, lambda x: x["span"].isNotNull())
        both = F.zip_with(spans, before, lambda s, x: F.struct(s.alias("s"), F.get(others, x["before"] - 1)["end"].alias("reach")))
        return F.transform(F.filter(both, lambda x: F.coalesce(x["reach"] <= x["s"]["start"], F.lit(True))), lambda x: x["s"])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _let(F.array_sort(marks), of)).otherwise(spans)


def candidates(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, repository, owner, base (spans of the three kinds in order) and bare (spans of bare tokens that no base span touches)."""
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    itself, always = (lambda m: m), (lambda m: F.lit(True))
    varied = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    found = docs.select(
        "doc_id", F.col(params.repository).cast("string").alias("repository"), F.col(params.owner).cast("string").alias("owner"),
        _spans(text, ASSIGN, "assign", 0, ASSIGN_HINT, lambda m: F.length(value(m)) >= 12, value).alias("assign"),
        # runs are whole, so asking for the length in the pattern finds the same runs as filtering does
        _spans(text, LONG_ACCESS, "access", 1, LONG_ACCESS, always, itself).alias("access"),
        _spans(text, LONG_HEX, "hex", 2, LONG_HEX, always, itself).alias("hex"),
        _spans(text, BARE, "bare", 3, BARE, varied, itself).alias("bare"),
    )
    for kind in BASE:
        found = found.withColumn("bare", _apart(F.col("bare"), F.col(kind)))
    return found.select("doc_id", "repository", "owner", F.array_sort(F.concat(*BASE)).alias("base"), "bare")


def ownership(found: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """hash, repositories, owners and copied, of every candidate of the corpus.

    Counted in steps with map-side sums, so a secret that a third of all rows hold is spread.
    """
    each = found.select("repository", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "bare"), lambda s: s["hash"]))).alias("hash"))
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    total = by_repository.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("owner").alias("owners"))
    return total.withColumn("copied", F.col("owners") >= params.copied_from)


def scan(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """One row a document: doc_id, base, live_bare, n_live and n_copied.

    ``base`` are the spans of the three base kinds, ``live_bare`` those bare tokens that only one
    owner holds and that no base span touches.  n_live and n_copied count the base spans whose
    secret one owner alone holds, or ``copied_from`` owners or more.  A null text is empty; each
    row is judged by itself, so rows with the same or a null doc_id stay apart.  Only the hashes
    and places of candidates are shuffled, never texts; a secret of very many rows is a skewed key
    of the join with its one ownership row, which Spark splits.
    """
    found = written(candidates(docs, params).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.where(F.size("base") + F.size("bare") > 0)
    known = some.select("row", F.explode(F.concat("base", "bare")).alias("s")).join(ownership(some, params), F.col("s.hash") == F.col("hash"))
    live, is_base = F.col("owners") == 1, F.col("s.kind") != "bare"
    told = known.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(~is_base & live, F.col("s")))).alias("live_bare"),
        F.sum((is_base & live).cast("long")).alias("n_live"), F.sum((is_base & F.col("copied")).cast("long")).alias("n_copied"),
    )
    none, zero = F.array().cast(_SPANS), F.lit(0).cast("long")
    out = found.select("row", "doc_id", "base").join(told, "row", "left")
    return out.select("doc_id", "base", F.coalesce("live_bare", none).alias("live_bare"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def written_out(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
