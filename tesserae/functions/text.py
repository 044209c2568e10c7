"""Text functions as column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of word sets.
STOPWORDS = tuple(
    "the and for are was were been have has had does did will would could should may might must can this that these those with from into about what which who whom when where"
    " why how all any both each few more most other some such not only own same than too very".split()
)


def strip(c: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case, each run of whitespace, underscores and hyphens as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens of two characters or more: split at whitespace and / . _ - : ; , ( ) { } [ ], trailing ? ! quotes cut."""
    parts = F.split(F.lower(c), r"[\s/._\-:;,(){}\[\]]+")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, r"[?!\"']+$", ""))
    return F.filter(bare, lambda t: F.length(t) > 1)


def words(c: Column) -> Column:
    """The set of lower-case ASCII words of three letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, common / union).otherwise(0.0)


def matches_globs(c: Column, globs: list[str]) -> Column:
    """Whether a text matches any of some file globs (``*`` any characters, slashes too, ``?`` one, ``[...]`` a set);
    null matches none."""
    patterns = [fnmatch.translate(g).replace("(?s:", "(?s)(?:") for g in globs]
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike("^" + p.replace(r"\Z", "$").replace(r"\z", "$"))
    return F.coalesce(hit, F.lit(False))
