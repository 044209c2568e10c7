"""Keywords in texts: detection by pattern, variations, matching, expansion of queries, and evidence families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import normalize

#: Forms of keywords: (category, pattern, least occurrences).
PATTERNS = (
    ("ticket", r"[A-Z]{2,}-\d+", 1),
    ("version", r"v\d+(?:\.\d+)+", 1),
    ("decimal", r"\d+\.\d{2}", 2),
    ("name", r"[A-Z][a-z]{5,} and [A-Z][a-z]{5,}", 2),
)


def _word(form: str) -> str:
    """A form that stands alone, for ASCII neighbours: word boundaries of regular expressions differ between engines."""
    return f"(?:^|[^a-z0-9_])(?:{form})(?:$|[^a-z0-9_])"


#: Families of evidence: (family, pattern on the lower-case text).
FAMILIES = (
    ("pricing", _word(r"(?:price|prices|cost|costs|fee|fees|usd|eur)")),
    ("quantity", _word(r"\d+ (?:units|items|pages|requests|tonnes|litres)")),
    ("temporal", _word(r"(?:(?:19|20)\d\d|week \d+)")),
    ("specification", _word(r"(?:version|schema|format|protocol)")),
    ("measurement", _word(r"\d+(?:\.\d+)? (?:percent|hours|minutes|seconds|days)")),
    ("decision", _word(r"(?:decided|agrees|agreed|replace|approved)")),
    ("rate", _word(r"(?:ratio|rate|per)")),
    ("warranty", _word(r"(?:warranty|guarantee|liability)")),
)


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """(category, keyword, n, n_sources, first_source): what the patterns find often enough, keywords in lower case."""
    found = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(least).alias("least"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hits")) for c, p, least in PATTERNS))).alias("f"))
    hits = found.select(key, "f.category", "f.least", F.explode("f.hits").alias("k")).groupBy("category", "least", F.lower("k").alias("keyword"), key).agg(F.count(F.lit(1)).alias("n"))
    merged = hits.groupBy("category", "least", "keyword").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"), F.min(key).alias("first_source"))
    return merged.where("n >= least").drop("least")


def variations(keyword: Column) -> Column:
    """The spellings of a keyword in other cases and with other separators, sorted and distinct."""
    base = normalize(keyword)
    forms = [base, F.upper(base), F.initcap(base)]
    return F.array_sort(F.array_distinct(F.array(keyword, *(F.translate(f, " ", s) if s else F.replace(f, F.lit(" "), F.lit("")) for f in forms for s in (" ", "-", "_", "")))))


def contains_all(text: Column, keywords: list[str]) -> Column:
    """Whether a text has every keyword in any spelling; no keyword lets every text pass."""
    flat = F.concat(F.lit(" "), normalize(text), F.lit(" "))
    out = F.lit(True)
    for k in keywords:
        out = out & flat.contains(" ".join(k.lower().replace("-", " ").replace("_", " ").split()))
    return F.coalesce(out, F.lit(False))


def expand(df: DataFrame, text: str, synonyms: dict[str, str], most: int = 4) -> DataFrame:
    """``df`` with the original text and up to ``most`` variants, each with one word replaced by its synonym, as
    (pos, variant)."""
    forms = [F.when(F.lower(text).rlike(rf"\b{w}\b"), F.regexp_replace(text, rf"(?i)\b{w}\b", s)) for w, s in sorted(synonyms.items())]
    made = F.slice(F.filter(F.array(*forms), lambda x: x.isNotNull()), 1, most) if forms else F.array().cast("array<string>")
    return df.select("*", F.posexplode(F.concat(F.array(F.col(text)), made)).alias("pos", "variant"))


def families(text: Column) -> Column:
    """The families of evidence a text shows, as an array."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(low.rlike(p), F.lit(f)) for f, p in FAMILIES)), lambda x: x.isNotNull())

#: Forms of keywords, case aside: (category, pattern, least occurrences of the category).
KEYWORD_FORMS = (
    ("testcase", r"\b(TC[_\-]?\d+)\b", 1),
    ("testcase", r"\b(testcase[_\-\s]?\d+)\b", 1),
    ("ticket", r"\b([A-Z]{2,5}-\d{3,})\b", 1),
    ("pull_request", r"\b(PR[_\-\s#]?\d+)\b", 1),
    ("pull_request", r"\b(pull\s*request[_\-\s#]?\d+)\b", 1),
    ("version", r"\b(v\d+\.\d+(?:\.\d+)?(?:-\w+)?)\b", 2),
    ("version", r"\b(\d+\.\d+\.\d+(?:-\w+)?)\b", 2),
    ("person", r"\b([A-Z][a-z]+\s[A-Z][a-z]+)\b", 2),
    ("file", r"\b(\w+\.(?:yaml|yml|json|py|md|txt|pdf|docx?|xlsx?))\b", 1),
    ("internal_id", r"\b([A-Z]{1,4}\d{3,})\b", 1),
)
#: Further spellings by category, from the parts of a keyword ($1 and so on).
CATEGORY_SPELLINGS = {
    "testcase": (r"(?i)^TC[_\-\s]?(\d+).*$", ("testcase $1", "testcase_$1", "testcase-$1", "test case $1", "test_case_$1", "test-case-$1", "test $1", "test_$1", "TC$1", "TC-$1", "TC_$1", "tc$1", "tc-$1", "tc_$1")),
    "pull_request": (r"(?i)^PR[_\-\s#]?(\d+).*$", ("PR $1", "PR-$1", "PR#$1", "PR$1", "pr $1", "pr-$1", "pr#$1", "pr$1", "pull request $1", "pull request #$1", "pull-request-$1")),
    "version": (r"(?i)^v?(\d+\.\d+(?:\.\d+)?(?:-\w+)?).*$", ("v$1", "V$1", "$1", "version $1", "Version $1", "release $1", "Release $1")),
}


def detect_keywords(df: DataFrame, key: Column, text: Column, case: bool = False) -> DataFrame:
    """(keyword, category, n, n_sources, first_source): what the keyword forms find in all texts, often enough for its
    category. A keyword that several forms find has the category of the first one in the first source. ``case`` asks for
    the case of the forms too."""
    flag = "" if case else "(?i)"
    forms = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("category"), F.lit(least).alias("least"), F.regexp_extract_all(text, F.lit(flag + p), F.lit(1)).alias("hits")) for i, (c, p, least) in enumerate(KEYWORD_FORMS)))
    found = df.select(key.alias("key"), F.explode(forms).alias("f")).select("key", "f.i", "f.category", "f.least", F.explode("f.hits").alias("k"))
    per_source = found.groupBy(F.lower(F.trim("k")).alias("keyword"), "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "category", "least")).alias("c"))
    merged = per_source.groupBy("keyword").agg(F.min_by("c", "key").alias("c"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"), F.min("key").alias("first_source"))
    return merged.where(F.col("n") >= F.col("c.least")).select("keyword", "c.category", "n", "n_sources", "first_source")


def category_spellings(keyword: Column, category: Column) -> Column:
    """The spellings that keywords of a category have beside those of ``variations``, sorted and distinct."""
    none = F.array().cast("array<string>")
    out = none
    for name, (form, spellings) in CATEGORY_SPELLINGS.items():
        made = F.array(*(F.regexp_replace(keyword, form, s) for s in spellings))
        out = F.when((category == name) & keyword.rlike(form), made).otherwise(out)
    prefix, number = (F.regexp_extract(keyword, r"(?i)^([A-Z]+)[_\-\s]?(\d+)", i) for i in (1, 2))
    joined = [F.concat(p, F.lit(sep), number) for p in (F.upper(prefix), F.lower(prefix)) for sep in ("", "-", "_")] + [F.concat(p, F.lit(" "), number) for p in (prefix, F.lower(prefix))]
    out = F.when((category == "ticket") & (number != ""), F.array(*joined)).otherwise(out)
    first, last = F.regexp_extract(keyword, r"^(\S+)\s+.*?(\S+)$", 1), F.regexp_extract(keyword, r"^(\S+)\s+.*?(\S+)$", 2)
    initial = F.substring(first, 1, 1)
    people = [F.concat(initial, F.lit(". "), last), F.concat(F.lower(initial), F.lit(". "), F.lower(last)), F.concat(F.lower(initial), F.lower(last)), F.concat(F.lower(first), F.lit("."), F.lower(last))]
    out = F.when((category == "person") & (first != ""), F.array(*people)).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def keywords_in(texts: DataFrame, keywords: DataFrame, most_words: int = 4) -> DataFrame:
    """(id, keyword): keywords (keyword, spelling) that a text (id, text) has in any spelling as whole words.

    Separators and case do not count. Texts become their runs of up to ``most_words`` words and meet the spellings in a
    join of equals, so neither side is compared with all of the other; longer spellings find nothing."""
    spelled = keywords.select("keyword", normalize(F.col("spelling")).alias("run")).where("run <> ''").distinct()
    words = F.filter(F.split(F.regexp_replace(normalize(F.col("text")), r"[^\p{L}\p{N}#.+]+", " "), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.#+]+(?=\S)|[.]+$", ""))
    cut = texts.where("text is not null").select("id", F.posexplode(bare).alias("i", "w"))
    w = Window.partitionBy("id").orderBy("i")
    ahead = cut.select("id", F.array("w", *(F.lead("w", n).over(w) for n in range(1, most_words))).alias("ws"))
    lengths = F.sequence(F.lit(1), F.size(F.array_compact("ws")))
    made = ahead.select("id", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice("ws", F.lit(1), n), " "))).alias("run"))
    return made.join(spelled, "run").select("id", "keyword").distinct()
