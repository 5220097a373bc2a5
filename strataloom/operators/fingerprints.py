"""Content hashes, SimHash and identifiers of texts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import ENGLISH, Language, let, words


def content_hash(text: Column, language: Language = ENGLISH) -> Column:
    """SHA-256 of the folded words, joined by single spaces."""
    return F.sha2(F.array_join(words(text, language), " "), 256)


def shingles(tokens: Column, size: int = 3) -> Column:
    """Runs of ``size`` words; one run of all words where there are fewer."""
    many = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), " "))
    return let(tokens, lambda t: F.when(F.size(t) >= size, many(t)).otherwise(F.array(F.array_join(t, " "))))


def simhash(docs: DataFrame, size: int = 3, language: Language = ENGLISH) -> DataFrame:
    """(key, simhash): bit i is set if more shingle hashes have it set than not.

    The bit counts of all shingles are plain sums, so they are added map-side; hashes are the first
    16 hexadecimal digits of SHA-256.
    """
    digits = F.transform(shingles(words(F.col("text"), language), size), lambda s: F.substring(F.sha2(s, 256), 1, 16))
    half = lambda d, k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}")
    # hashed before the rows are exploded, so that the sums below don't hash again
    hashed = docs.select("key", F.explode(F.transform(digits, lambda d: F.struct(half(d, 0), half(d, 1)))).alias("h")).select("key", "h.h0", "h.h1")
    # one sum holds the counts of bit i of either half
    bit = lambda half, i: F.shiftright(F.col(half), i).bitwiseAND(1)
    sums = hashed.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.shiftleft(bit("h0", i), 32) + bit("h1", i)).alias(f"b{i}") for i in range(32)])
    count = {"high": lambda i: F.shiftright(F.col(f"b{i}"), 32), "low": lambda i: F.col(f"b{i}").bitwiseAND(0xFFFFFFFF)}
    whole = lambda half: sum((F.when(2 * count[half](i) > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)), F.lit(0).cast("long"))
    return sums.select("key", whole("high").alias("high"), whole("low").alias("low"))


def hamming(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))


def simhash_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance) of different hashes within the distance, representatives of equal hashes only.

    The 64 bits are cut into six blocks, of which three at least are equal where three bits differ.
    So hashes are joined on each choice of three blocks, some 32 bits, of which even a very large
    corpus holds few by chance.
    """
    if not 0 <= distance <= 3:
        raise ValueError("six blocks find distances up to 3")
    one = hashes.groupBy("high", "low").agg(F.min("key").alias("key"))
    block = lambda k: F.shiftright(F.col("low" if k < 3 else "high"), 11 * (k % 3)).bitwiseAND(0x7FF)
    choices = list(combinations(range(6), 3))
    banded = one.select("key", "high", "low", F.posexplode(F.array(*[F.shiftleft(block(x), 22) + F.shiftleft(block(y), 11) + block(z) for x, y, z in choices])).alias("choice", "value"))
    a, b = banded.alias("a"), banded.alias("b")
    near = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.key") < F.col("b.key")))
    near = near.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), hamming(F.col("a.high"), F.col("a.low"), F.col("b.high"), F.col("b.low")).alias("distance"))
    return near.where(F.col("distance") <= distance).distinct()


def identifiers(text: Column) -> Column:
    """Tokens of four characters or more, half of whose letters and digits are digits, edges stripped; repeats kept."""
    numbered = F.filter(F.split(text, r"\s+"), lambda t: t.rlike("[0-9]"))  # the others needn't be stripped
    bare = F.transform(numbered, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
    digits = lambda t: F.length(F.regexp_replace(t, r"[^0-9]", ""))
    letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.filter(bare, lambda t: (F.length(t) >= 4) & (digits(t) > 0) & (digits(t) * 2 >= letters(t)))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Rows of ``a`` that ``b`` doesn't match, counted: keys, item, n."""
    count = lambda df, name: df.groupBy(*keys, item).agg(F.count("*").alias(name))
    both = count(a, "na").join(count(b, "nb"), [*keys, item], "left")
    return both.withColumn("n", F.col("na") - F.coalesce("nb", F.lit(0))).where("n > 0").select(*keys, item, "n")


def multiset_differences(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, n): how much oftener ``a`` holds an item than ``b``, under 0 where ``b`` does; either side is read once."""
    both = a.select(*keys, item, F.lit(1).alias("n")).unionByName(b.select(*keys, item, F.lit(-1).alias("n")))
    return both.groupBy(*keys, item).agg(F.sum("n").alias("n")).where("n <> 0")
