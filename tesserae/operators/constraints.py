"""Rules over a question and the texts found for it: relevance, other versions or things than asked for, kinds of
information, and their order. ``queries``: (qid, text); ``texts``: (qid, id, text) and further columns where stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import words
from tesserae.operators.vocabulary import FAMILIES, families

#: Forms of versions, years and quarters, and pairs of words of which one excludes the other.
VERSIONS = (r"x\d+", r"v\d+", r"20\d{2}", r"q[1-4]")
OPPOSITES = (("online", "in-store"), ("in-store", "online"), ("elderly", "children"), ("children", "elderly"), ("before", "after"), ("after", "before"))


def mismatch(query: Column, text: Column) -> Column:
    """Whether a text has other versions, years or quarters than the first the question names, and not that one; or the
    opposite of a word of the question that it lacks."""
    q, t = F.lower(query), F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for form in VERSIONS:
        asked, found = F.regexp_extract(q, f"({form})", 1), F.regexp_extract_all(t, F.lit(f"({form})"), F.lit(1))
        out = out | ((asked != "") & (F.size(found) > 0) & ~F.array_contains(found, asked))
    for a, b in OPPOSITES:
        out = out | (q.contains(a) & ~t.contains(a) & t.contains(b))
    return F.coalesce(out, F.lit(False))


def joined_texts(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, query, n, text): each question with the texts found for it, few by nature, put together; queries without
    texts have null."""
    found = texts.where("text is not null").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ").alias("found"))
    return queries.join(found, "qid", "left").select("qid", F.col("text").alias("query"), F.coalesce("n", F.lit(0)).alias("n"), F.col("found").alias("text"))


def relevance(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, relevant, method): by the entities (array of names) of the texts, else by their summaries, where there are
    any; texts without both say nothing and pass."""
    asked = queries.select("qid", F.lower("text").alias("q"), words(F.col("text")).alias("w"))
    rows = texts.select("qid", "entities", "summary").join(asked, "qid", "right")
    named = F.exists(F.coalesce("entities", F.array().cast("array<string>")), lambda e: (F.length(e) > 2) & F.col("q").contains(F.lower(e)))
    summed = F.arrays_overlap(words(F.coalesce("summary", F.lit(""))), F.col("w"))
    some = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    flags = rows.groupBy("qid").agg(some(F.size("entities") > 0).alias("has_e"), some(F.col("summary") != "").alias("has_s"), some(named).alias("e"), some(summed).alias("s"))
    method = F.when(~F.col("has_e") & ~F.col("has_s"), "no_enrichment").when(F.col("has_e") & F.col("e"), "entity_overlap").when(F.col("has_s") & F.col("s"), "summary_overlap").otherwise("no_enriched_match")
    return flags.select("qid", (method != "no_enriched_match").alias("relevant"), method.alias("method"))


def information(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, signal, reason): qualified where the texts are about another entity, or lack the first kind of information
    that the question asks for; no signal otherwise, nor without texts."""
    both = joined_texts(queries, texts)
    wanted = F.get(families(F.col("query")), 0)
    lacks = wanted.isNotNull() & ~F.array_contains(families(F.col("text")), wanted)
    reason = F.when(F.col("n") == 0, None).when(mismatch(F.col("query"), F.col("text")), "other entity").when(lacks, F.concat(F.lit("no "), wanted))
    return both.select("qid", reason.alias("reason")).select("qid", F.when(F.col("reason").isNotNull(), "qualified").alias("signal"), "reason")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Whether both have a word in common that is no stop word."""
    return F.coalesce(F.arrays_overlap(words(query), words(text)), F.lit(False))


def mentions_all(terms: Column, text: Column) -> Column:
    """Whether a text has all terms of an array, case aside; none is always had, a null text has nothing."""
    return F.forall(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.coalesce(F.lower(text), F.lit("")).contains(F.lower(t)))


def staged(gate: DataFrame, others: list[DataFrame]) -> DataFrame:
    """(qid, signal, reason) of all rules in their order: where the gate abstains the others are not heard."""
    stop = gate.where("signal = 'abstain'").select("qid")
    out = gate.select("qid", F.lit(0).alias("stage"), "signal", "reason")
    for i, df in enumerate(others, 1):
        out = out.unionByName(df.join(stop, "qid", "left_anti").select("qid", F.lit(i).alias("stage"), "signal", "reason"))
    return out.where("signal is not null")


KINDS = tuple(name for name, _ in FAMILIES)
