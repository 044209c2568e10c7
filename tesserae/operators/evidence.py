"""Evidence features of retrieved texts and the rules that decide on them."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import words


def features(hits: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n, n_sources, high, mean, low, deviation, spread, overlap) of each query, those without hits included.

    ``hits``: (qid, id, score, source); ``texts``: (id, text); ``queries``: (qid, text). overlap is the share of the
    query's words that occur in any of its texts.
    """
    wanted = queries.select("qid", words(F.col("text")).alias("wanted"))
    rows = hits.join(texts, "id").join(F.broadcast(wanted), "qid").withColumn("met", F.array_intersect("wanted", words(F.col("text"))))
    s = F.col("score")
    stats = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.max(s).alias("high"), F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("low"), F.round(F.stddev_pop(s), 6).alias("deviation"), F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    both = wanted.join(stats, "qid", "left")
    share = F.when(F.size("wanted") > 0, F.size(F.coalesce("met", F.array().cast("array<string>"))) / F.size("wanted")).otherwise(0.0)
    return both.select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "high", "mean", "low", "deviation", F.round(F.col("high") - F.col("low"), 6).alias("spread"), F.round(share, 6).alias("overlap"))


def sufficiency(row: DataFrame, low: float = 0.45, middle: float = 0.70) -> DataFrame:
    """(qid, verdict): ordered rules: no evidence or similarity below ``low`` abstains; below ``middle`` without any of
    the query's words is only qualified; else sufficient."""
    verdict = F.when(F.col("n") == 0, "abstain").when(F.col("high") < low, "abstain").when((F.col("high") < middle) & (F.col("overlap") == 0), "qualified").otherwise("sufficient")
    return row.select("qid", verdict.alias("verdict"))


def govern(signals: DataFrame, by: str, signal: Column, similarity: Column, weak: float = 0.70) -> DataFrame:
    """(key, mode): abstain before disputed before trustworthy; disputed counts as trustworthy where evidence is also
    qualified and the similarity is weak."""
    has = lambda kind: F.coalesce(F.max((signal == kind).cast("int")), F.lit(0)) == 1
    rows = signals.groupBy(F.col(by).alias("key")).agg(has("abstain").alias("a"), has("disputed").alias("d"), has("qualified").alias("q"), F.max(similarity).alias("s"))
    mode = F.when(F.col("a"), "abstain").when(F.col("d") & ~(F.col("q") & (F.coalesce("s", F.lit(1.0)) < weak)), "disputed").otherwise("trustworthy")
    return rows.select("key", mode.alias("mode"))


def citation_score(citation: str, context: str) -> float:
    """1 if the citation is in the context; else the larger of the matching ratio and the share of the citation that its
    longest common part is."""
    if not citation:
        return 0.0
    if citation in context:
        return 1.0
    match = difflib.SequenceMatcher(None, citation, context, autojunk=False)
    part = match.find_longest_match(0, len(citation), 0, len(context)).size / len(citation)
    return max(match.ratio(), part)
