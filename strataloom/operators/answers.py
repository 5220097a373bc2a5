"""Checking answers against their sources, and assembling context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations, claims


def check(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, claim, status, lacking): each claim is supported, uncited or unsupported.

    ``answers``: answer_id, text; ``sources``: answer_id, n (from 1), text.  A claim that only an
    uncited source holds is uncited, and ``lacking`` is the first source that holds it.
    """
    stated = answers.select("answer_id", citations(F.col("text")).alias("cited"), F.posexplode(claims(F.col("text"))).alias("position", "claim"))
    held = sources.select("answer_id", "n", F.explode(claims(F.col("text"))).alias("claim"))
    found = stated.join(held, ["answer_id", "claim"], "left").groupBy("answer_id", "position", "claim").agg(
        F.coalesce(F.bool_or(F.array_contains("cited", F.col("n"))), F.lit(False)).alias("supported"), F.min("n").alias("first"))
    status = F.when(F.col("supported"), "supported").when(F.col("first").isNotNull(), "uncited").otherwise("unsupported")
    return found.select("answer_id", "claim", status.alias("status"), F.when(~F.col("supported"), F.col("first")).alias("lacking"))


def sentences(text, pattern: str = r"(?<=[.!?])(?:\s*\[[0-9, ]+\])*\s+"):
    return F.filter(F.split(text, pattern), lambda s: F.length(F.trim(s)) > 0)


def strip_unsupported(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """(answer_id, text) without the sentences that state an unsupported claim."""
    bad = checked.where("status = 'unsupported'").groupBy("answer_id").agg(F.collect_set("claim").alias("bad"))
    both = answers.join(bad, "answer_id", "left")
    kept = F.filter(sentences(F.col("text")), lambda s: ~F.coalesce(F.arrays_overlap(claims(s), F.col("bad")), F.lit(False)))
    return both.select("answer_id", F.array_join(kept, " ").alias("text"))


def anchored(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id of questions that name an identifier (three digits or more, not a year) that a source holds."""
    named = questions.select("query_id", F.explode(claims(F.col("text"))).alias("claim")).where(r"length(regexp_replace(claim, '[^0-9]', '')) >= 3 and not claim rlike '^(19|20)[0-9]{2}$'")
    held = sources.select("query_id", F.explode(claims(F.col("text"))).alias("claim"))
    return named.join(held, ["query_id", "claim"], "left_semi").select("query_id").distinct()


def refusal(scores: DataFrame, anchors: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(query_id, best, refused): refused if the best score is under the threshold and nothing anchors the question."""
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.join(anchors.withColumn("anchor", F.lit(True)), "query_id", "left").select("query_id", "best", ((F.col("best") < threshold) & F.col("anchor").isNull()).alias("refused"))


def assemble(hits: DataFrame, sources: int = 6, per_document: int = 3, budget: int = 5600, near: float = 0.8) -> DataFrame:
    """(query_id, rank, key) of the hits that make up the context.

    ``hits``: query_id, rank, document, key, terms (array), tokens.  Greedy by rank: a hit goes in if the
    budget, the document's share and its difference from the chosen ones allow; passed-over hits of
    full documents fill places that stay free.  A query has a bounded number of hits.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        sets = [set(t) for t in group["terms"]]
        chosen, later, used = [], [], 0

        def fits(i: int) -> bool:
            if used + group["tokens"][i] > budget:
                return False
            return all(len(sets[i] & sets[j]) < near * max(min(len(sets[i]), len(sets[j])), 1) for j in chosen)

        for i in range(len(group)):
            if len(chosen) == sources:
                break
            if sum(group["document"][j] == group["document"][i] for j in chosen) >= per_document:
                later.append(i)
            elif fits(i):
                chosen.append(i)
                used += group["tokens"][i]
        for i in later:
            if len(chosen) < sources and fits(i):
                chosen.append(i)
                used += group["tokens"][i]
        return group.loc[sorted(chosen), ["query_id", "rank", "key"]]

    return hits.groupBy("query_id").applyInPandas(choose, "query_id long, rank int, key long")


#: Full-match patterns of questions that need no search, at most eight words long.
SMALL_TALK = {"greeting": r"(hi|hello|hey|good (morning|afternoon|evening))", "thanks": r"(thanks|thank you)( very much)?", "farewell": r"(bye|goodbye|see you)( later)?", "library": r"(what|which|how many) (documents|files|folders) (are there|do you have)( here)?"}


def talk_kind(text):
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]+", ""))
    out = F.when(F.size(F.split(plain, " +")) > 8, None)
    for kind, pattern in SMALL_TALK.items():
        out = out.when(plain.rlike(f"^{pattern}$"), kind)
    return out
