"""Known-issue search over log messages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Issue:
    bank: str
    title: str
    patterns: list[str] = field(default_factory=list)
    symptoms: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    root_cause: str = ""


def search(messages: DataFrame, issues: list[Issue], text: str = "text", least: float = 0.3) -> DataFrame:
    """Messages with each issue that scores ``least`` or more.

    A pattern gives 0.40, a symptom with a word of two or more characters in the text 0.15, such a
    title 0.10, a tag 0.10; at most 1. Issues are settings, so each is a column and messages are read
    once. Scores are decimals.
    """
    lower, zero = F.lower(text), F.lit(0).cast("decimal(4,2)")
    points = lambda hit, p: F.when(hit, F.lit(p).cast("decimal(4,2)")).otherwise(zero)

    def any_word(s: str):
        hit = F.lit(False)
        for w in s.lower().split():
            hit = hit | (F.coalesce(lower.contains(w), F.lit(False)) if len(w) >= 2 else F.lit(False))
        return hit

    scored = []
    for i in issues:
        parts = [points(F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)), "0.40") for p in i.patterns]
        parts += [points(any_word(s), "0.15") for s in i.symptoms] + [points(any_word(i.title), "0.10")]
        parts += [points(F.coalesce(lower.contains(t.lower()), F.lit(False)), "0.10") for t in i.tags]
        score = F.least(sum(parts, F.lit(0).cast("decimal(10,2)")), F.lit(1).cast("decimal(10,2)")).cast("decimal(4,2)")
        scored.append(F.struct(F.lit(i.bank).alias("bank"), F.lit(i.title).alias("title"), score.alias("score")))
    found = messages.select(*messages.columns, F.inline(F.array(*scored)))
    return found.where(F.col("score") >= F.lit(str(least)).cast("decimal(4,2)"))


def keyword_search(messages: DataFrame, issues: list[Issue], text: str = "text", least: float = 0.05) -> DataFrame:
    """The variant by shared words: ratios of shared to own words weigh 0.3, 0.2, 0.25 and 0.1, a tag in the text 0.15."""
    words = F.array_distinct(F.split(F.lower(text), r"\s+"))
    own = lambda s: F.array_distinct(F.regexp_extract_all(F.lit(s.lower()), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    ratio = lambda s, w: F.size(F.array_intersect(words, own(s))) / F.greatest(F.size(own(s)), F.lit(1)) * w
    scored = []
    for i in issues:
        parts = [ratio(p, 0.3) for p in i.patterns] + [ratio(s, 0.2) for s in i.symptoms] + [ratio(i.title, 0.25)] + ([ratio(i.root_cause, 0.1)] if i.root_cause else [])
        parts += [F.when(F.lower(text).contains(t.lower()), 0.15).otherwise(0.0) for t in i.tags]
        scored.append(F.struct(F.lit(i.bank).alias("bank"), F.lit(i.title).alias("title"), F.round(F.least(sum(parts, F.lit(0.0)), F.lit(1.0)), 6).alias("score")))
    return messages.select(*messages.columns, F.inline(F.array(*scored))).where(F.col("score") >= least)


def merged_results(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Best score by message, bank and issue over both searches."""
    cols = [*keys, "bank", "title"]
    both = first.select(*cols, F.col("score").cast("double").alias("score")).unionByName(second.select(*cols, F.col("score").cast("double").alias("score")))
    return both.groupBy(*cols).agg(F.max("score").alias("score"))


def statistics(found: DataFrame) -> DataFrame:
    """Hits and distinct issues by bank."""
    return found.groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("issues"))
