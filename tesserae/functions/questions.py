"""Rules over the text of a question, as column expressions. No model is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that compare, first words that make a question, and words left out of a question's entities.
COMPARISON_WORDS = ("vs", "versus", "compare", "compared", "differ", "difference", "between")
QUESTION_WORDS = "what how why when where who which is are was were do does did can could should will would".split()
STOP_WORDS = (
    "what where who when how is are does do did the a an of in to for on with by from about it this that these those my your its can could should would will shall may might be been being have has had"
).split()
#: Parts of a question that call for detection.
DETECTION_KEYWORDS = (
    "latest", "recent", "last", "before", "after", "since", "until", "new", "old", "updated", "changed", "history", "previous", "vs", "versus", "compare", "differ", "difference", "between",
    "better", "worse", "advantage", "disadvantage", "how many", "count", "list", "all", "every", "enumerate", "total", "summarize", "overview", "current", "now", "today",
)
#: Fixed values: (reason, pattern) of questions that need rewriting, in order, with the length rule between.
PRONOUNS = r"\b(it|its|they|them|their|theirs|this|that|these|those|he|she|his|her|hers)\b"
COMPOUND = r"\b(and also|as well as|along with|in addition to|plus|additionally)\b|\band\b.*\band\b"
NOISE = r"\b(uhm|umm|uh+|hmm+|like|basically|actually|literally|ok so|so like)\b|[?!]{2,}|\.{3,}"
SIMPLE = r"^(what|where|who|when|which|how|is|are|does|do|can|will|was|were)\s"


def split_words(c: Column) -> Column:
    """Words between whitespace, none for a blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def compares(c: Column) -> Column:
    return F.arrays_overlap(split_words(F.lower(c)), F.array(*map(F.lit, COMPARISON_WORDS)))


def kind(c: Column) -> Column:
    """what, how, why, when_where, who, yes_no or other, by the first word."""
    first = F.regexp_extract(F.lower(F.regexp_replace(c, r"^\s+", "")), rf"^({'|'.join(QUESTION_WORDS)})\b", 1)
    named = F.when(first.isin("what", "which"), "what").when(first.isin("when", "where"), "when_where").when(first.isin("how", "why", "who"), first)
    return named.when(first != "", "yes_no").otherwise("other")


def entities(c: Column, most: int = 8) -> Column:
    """Of a question of at most ``most`` words its words that are no stop words, without trailing punctuation; null for a
    longer one, which needs an analysis."""
    bare = lambda w: F.regexp_replace(w, r"[?.,!;:]+$", "")
    kept = F.filter(split_words(c), lambda w: ~F.lower(bare(w)).isin(*STOP_WORDS) & (F.length(w) > 1))
    return F.when(word_count(c) <= most, F.transform(kept, bare))


def needs_detection(c: Column) -> Column:
    hit = word_count(c) > 10
    for k in DETECTION_KEYWORDS:
        hit = hit | F.lower(c).contains(k)
    return hit


def rewrite_reason(c: Column, has_context: Column | None = None, most_words: int = 15, most_chars: int = 100) -> Column:
    """Why a question needs rewriting, or why not (simple_question, short_query)."""
    n = word_count(c)
    low = F.lower(c)
    rule = F.when(F.lit(False) if has_context is None else has_context, "has_conversation_context")
    rule = rule.when(low.rlike(PRONOUNS), "has_context_pronouns").when(low.rlike(COMPOUND), "has_compound_indicators")
    rule = rule.when((n > most_words) | (F.length(c) > most_chars), "long_query").when(low.rlike(NOISE), "noisy_query")
    return rule.when(low.rlike(SIMPLE), "simple_question").when(n <= 8, "short_query").otherwise("medium_query")


def clean(c: Column, most: int = 500) -> Column:
    """Without tags and outer whitespace, at most ``most`` characters; the trimmed text itself if nothing is left."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bare = trim(F.regexp_replace(c, "<[^>]+>", ""))
    return F.substring(F.when(bare == "", trim(c)).otherwise(bare), 1, most)


def fingerprint(c: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), 256)


def mentions_future_year(c: Column, this_year: int | None = None) -> Column:
    """Whether a year 20xx after ``this_year`` (the current one, if not given) stands in the text."""
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year)
    return F.exists(F.regexp_extract_all(c, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int") > now)


def variations(original: Column, rewritten: Column, decomposed: Column, disambiguated: Column) -> Column:
    """The original, the rewritten text if it differs, then the parts and the readings; repeated ones stay."""
    none = F.array().cast("array<string>")
    changed = F.when(rewritten.isNotNull() & (rewritten != original), F.array(rewritten)).otherwise(none)
    return F.concat(F.array(original), changed, F.coalesce(decomposed, none), F.coalesce(disambiguated, none))


def retrieval_profile(kind: Column, confidence: Column, specificity: Column, answer: Column, multiplier: Column, is_complex: Column, top: int = 30, read: int = 15) -> Column:
    """struct of top_k, top_read, run_hyde, run_agentic, inject_summaries and entity_limit by the kind of a question
    (general, code, data and so on), the confidence in it, how broad it is and what answer it wants."""
    shape = lambda x, c, broad, narrow: F.floor(F.when(c == "broad", x * broad).when(c == "narrow", x * narrow).otherwise(x)).cast("int")
    top_k = F.greatest(F.lit(10), shape(F.lit(top) * multiplier, specificity, 1.5, 0.7))
    read_1 = shape(F.lit(read), specificity, 1.3, 0.8)
    read_2 = F.when(specificity == "narrow", F.greatest(F.lit(5), read_1)).otherwise(read_1)
    top_read = F.floor(F.when(answer == "procedural", read_2 * 1.3).when(answer.isin("comparative", "exploratory"), read_2 * 1.2).otherwise(read_2)).cast("int")
    plain = is_complex | ~(((kind == "code") & (confidence >= 0.7)) | (kind == "data") | (confidence >= 0.9))
    thematic = ~kind.isin("code", "data") & (confidence < 0.6)
    limit = F.when(thematic | (specificity == "broad"), 12).otherwise(3)
    return F.struct(top_k.alias("top_k"), top_read.alias("top_read"), plain.alias("run_hyde"), (kind != "data").alias("run_agentic"), thematic.alias("inject_summaries"), limit.alias("entity_limit"))
