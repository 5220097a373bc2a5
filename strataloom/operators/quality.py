"""Page quality: character model, artefacts, verdicts, and running headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import ENGLISH, Language, fold
from .tables import written

ALPHABET = 36


def grams(text: Column, size: int, least_letters: int = 1) -> Column:
    """Character grams of the letter runs, each padded by a space on both sides."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda r: F.length(r) >= least_letters)
    padded = F.transform(runs, lambda r: F.concat(F.lit(" "), r, F.lit(" ")))
    cut = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - size + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(size))))
    return F.filter(F.flatten(cut), lambda g: F.length(g) == size)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def char_model(texts: DataFrame, min_count: int = 2, language: Language = ENGLISH) -> tuple[DataFrame, DataFrame]:
    """Trigram counts of at least ``min_count``, and counts of all bigrams that begin a trigram.

    No gram goes over a word's end, so different words are cut once, however often they stand.
    """
    words = texts.select(F.explode(_runs(fold(F.col("text"), language))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = words.select("n", F.explode(grams(F.col("word"), 3)).alias("tri")).groupBy("tri").agg(F.sum("n").alias("n_tri"))
    counts = written(counts, "trigrams")  # read for either count, and by each scoring
    bi = counts.groupBy(F.substring("tri", 1, 2).alias("bi")).agg(F.sum("n_tri").alias("n_bi"))
    return counts.where(F.col("n_tri") >= min_count), bi


def char_scores(pages: DataFrame, model: tuple[DataFrame, DataFrame], least_letters: int = 3, language: Language = ENGLISH) -> DataFrame:
    """(key, positions, score): mean log2 of the smoothed trigram probability over lower-case words.

    Words count once per page, and different words are scored once, so the join is on counted words.
    """
    low = F.filter(_runs(F.col("text")), lambda w: (F.length(w) >= least_letters) & (w == fold(w, language)))
    used = written(pages.select("key", F.explode(low).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n")), "used-words")
    tri, bi = model
    cut = used.select("word").distinct().select("word", F.explode(grams(F.col("word"), 3)).alias("tri")).withColumn("bi", F.substring("tri", 1, 2))
    p = F.log2((F.coalesce("n_tri", F.lit(0)) + 1) / (F.coalesce("n_bi", F.lit(0)) + ALPHABET))
    scored = cut.join(tri, "tri", "left").join(bi, "bi", "left").groupBy("word").agg(F.count("*").alias("grams"), F.sum(p).alias("p"))
    return used.join(scored, "word").groupBy("key").agg(F.sum(F.col("n") * F.col("grams")).alias("positions"), F.round(F.sum(F.col("n") * F.col("p")) / F.sum(F.col("n") * F.col("grams")), 6).alias("score"))


def artefact(word: Column) -> Column:
    """A mark between letters, or a capital after a small letter within a part of six letters or more."""
    parts = F.split(word, r"['’\-]")
    mixed = F.exists(parts, lambda p: (F.length(F.regexp_replace(p, r"\P{L}", "")) >= 6) & p.rlike(r"\p{Ll}\p{Lu}"))
    return word.rlike(r"\p{L}[,;|\\]\p{L}") | mixed


def artefact_share(text: Column) -> Column:
    """Share of words that look broken; words are tokens with a letter."""
    # most texts hold no such sign at all, so their words needn't be looked at one by one
    none = ~text.rlike(r"\p{L}[,;|\\]\p{L}|\p{Ll}\p{Lu}")
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"\p{L}"))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
    return F.when(none, F.lit(0.0)).when(F.size(bare) > 0, F.size(F.filter(bare, artefact)) / F.size(bare)).otherwise(F.lit(0.0))


def verdict(positions: Column, score: Column, n_words: Column, artefacts: Column, name: str = "not_language_like") -> Column:
    """The character verdict comes first: 80 positions under -4.2; then 20 words with over 3 % artefacts."""
    return F.when((positions >= 80) & (score < -4.2), name).when((n_words >= 20) & (artefacts > 0.03), "ocr_artefacts")


def usability(visible: Column, picture_share: Column, n_words: Column, verdict_: Column) -> Column:
    """Pages of under 20 visible characters, or of pictures with under 30 words, have no text."""
    return F.when((visible < 20) | ((picture_share >= 0.5) & (n_words < 30)), "no_text").otherwise(verdict_)


def without_running_lines(pages: DataFrame, page_word: str = "page", edge: int = 2, language: Language = ENGLISH) -> DataFrame:
    """(doc, page, text) without repeated headers and footers, of documents of three pages or more.

    Of each page's first and last ``edge`` filled lines, page numbers always go; a line on at
    least max(3, pages // 2) pages stays at its first place only.
    """
    size = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    filled = F.trim("line") != ""
    by_page = Window.partitionBy("doc", "page")
    lines = lines.withColumn("up", F.sum(filled.cast("int")).over(by_page.orderBy("pos"))).withColumn("all", F.sum(filled.cast("int")).over(by_page))
    at_edge = filled & ((F.col("up") <= edge) | (F.col("up") > F.col("all") - edge))
    lines = lines.withColumn("key", F.when(at_edge, F.trim(fold(F.col("line"), language))))
    number = F.col("key").rlike(rf"^(?:{page_word}\s*)?[-–]?\s*[0-9]{{1,3}}\s*(?:/\s*[0-9]{{1,3}})?\s*[-–]?$")
    edges = lines.where("key is not null")
    counted = edges.groupBy("doc", "key").agg(F.countDistinct("page").alias("on"), F.min(F.struct("page", "pos")).alias("first"))
    out = lines.join(counted, ["doc", "key"], "left").join(size, "doc")
    repeated = (F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))) & (F.struct("page", "pos") != F.col("first"))
    drop = (F.col("pages") >= 3) & F.col("key").isNotNull() & (number | repeated)
    kept = out.withColumn("line", F.when(~F.coalesce(drop, F.lit(False)), F.col("line")))
    return kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("text"))


def better_reading(a: Column, b: Column) -> Column:
    """Which of two readings (struct of verdict, artefacts, score) is better: 'a' or 'b'; ties stay with a."""
    passes = lambda x: x["verdict"].isNull()
    lower = lambda x: F.struct(x["artefacts"], -x["score"])
    return F.when(a["verdict"] == "no_text", "b").when(passes(a) & ~passes(b), "a").when(passes(b) & ~passes(a), "b").when(lower(b) < lower(a), "b").otherwise("a")
