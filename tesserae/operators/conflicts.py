"""Conflicts of numbers and times between the texts of small evidence sets.

A set is what one question retrieved: few texts in an order. ``most`` texts of a set take part, as the rules say; pairs
are made inside a set only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import numbers
from tesserae.functions.text import jaccard, words


def first_texts(items: DataFrame, most: int = 5) -> DataFrame:
    """(set, place, text): the first ``most`` texts of each set, numbered from 1; null texts do not count."""
    w = Window.partitionBy("set").orderBy("pos", "text")
    rows = items.where("set is not null and text is not null").select("set", "pos", "text")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("set", "place", "text")


def _pairs(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of earlier and later texts of a set that agree in ``by``."""
    of = lambda side: rows.select(*(F.col(c).alias(c if c in ("set", *by) else f"{c}_{side}") for c in rows.columns))
    return of("a").join(of("b"), ["set", *by]).where("place_a < place_b")


def is_variance(a: Column, b: Column, direction_a: Column, direction_b: Column, most: float = 0.15) -> Column:
    """Whether two values of one unit differ by no more than ``most`` of their mean size; opposite directions are no
    variance, two zeros are."""
    mean = (F.abs(a) + F.abs(b)) / 2
    against = F.coalesce(direction_a != direction_b, F.lit(False))
    return ~against & F.when(mean == 0, True).otherwise(F.abs(a - b) / F.when(mean != 0, mean) <= most)


def variances(texts: DataFrame) -> DataFrame:
    """(set, place_a, place_b, unit, value_a, value_b): values of one unit that vary between two texts, of units that
    each of both has once."""
    found = texts.select("set", "place", F.explode(numbers.mentions(F.col("text"))).alias("m"))
    once = found.groupBy("set", "place", "m.unit").agg(F.count(F.lit(1)).alias("n"), F.first("m.value").alias("value"), F.first("m.direction").alias("direction")).where("n = 1").drop("n")
    met = _pairs(once, "unit").where(is_variance(F.col("value_a"), F.col("value_b"), F.col("direction_a"), F.col("direction_b")))
    return met.select("set", "place_a", "place_b", "unit", "value_a", "value_b")


def divergent(a: Column, b: Column) -> Column:
    """Of two arrays of numbers the ratios of larger to smaller between 1.02 and 2, of all pairs of positive ones."""
    ratio = lambda x, y: F.when((x > 0) & (y > 0), F.greatest(x, y) / F.least(x, y))
    every = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: ratio(x, y))))
    return F.filter(every, lambda r: (r > 1.02) & (r < 2.0))


def divergence(texts: DataFrame) -> DataFrame:
    """(set, n_cross, max_cross, n_within, max_within): divergent pairs of significant numbers between two texts of the
    set and inside one; sets without numbers have zeros."""
    nums = texts.select("set", "place", numbers.significant(F.col("text")).alias("v"))
    ordered = F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    own = F.flatten(F.transform(ordered, lambda s: divergent(F.array(s["x"]), F.slice("v", s["i"] + 2, F.size("v")))))
    inside = nums.select("set", F.when(F.size("v") >= 2, own).otherwise(F.array().cast("array<double>")).alias("r"))
    within = inside.groupBy("set").agg(F.sum(F.size("r")).alias("n_within"), F.coalesce(F.max(F.array_max("r")), F.lit(0.0)).alias("max_within"))
    pairs = _pairs(nums).select("set", divergent(F.col("v_a"), F.col("v_b")).alias("r"))
    cross = pairs.groupBy("set").agg(F.sum(F.size("r")).alias("n_cross"), F.max(F.array_max("r")).alias("max_cross"))
    return within.join(cross, "set", "left").select("set", F.coalesce("n_cross", F.lit(0)).alias("n_cross"), F.coalesce("max_cross", F.lit(0.0)).alias("max_cross"), "n_within", "max_within")


#: Years, and quarters with an optional year.
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_QUARTER = re.compile(r"\b(Q[1-4])\s*(?:'?(\d{2,4}))?\b", re.IGNORECASE)


def _temporal(text: str | None) -> list[tuple] | None:
    if text is None:
        return None
    around = lambda m: text[max(0, m.start() - 30) : m.end() + 30]
    out = [(int(m[0]), None, around(m)) for m in _YEAR.finditer(text)]
    for m in _QUARTER.finditer(text):
        year = None if not m[2] else int(m[2]) + (0 if len(m[2]) == 4 else 2000)
        out.append((year, m[1].upper(), around(m)))
    return out


def temporal_mentions(c: Column) -> Column:
    """array of (year, quarter, context): years 19xx and 20xx, then quarters with the year beside them, if any."""
    return F.udf(_temporal, "array<struct<year: int, quarter: string, context: string>>", useArrow=True)(c)


def temporal_conflicts(texts: DataFrame) -> DataFrame:
    """(set, place_a, place_b, n): pairs of mentions in two texts that contradict: one year and other quarters, or other
    years in contexts that share more than half of their words."""
    found = texts.select("set", "place", F.explode(temporal_mentions(F.col("text"))).alias("m")).select("set", "place", "m.year", "m.quarter", words(F.col("m.context")).alias("w")).where("year is not null")
    both = _pairs(found)
    quarters = (F.col("year_a") == F.col("year_b")) & F.coalesce(F.col("quarter_a") != F.col("quarter_b"), F.lit(False))
    years = (F.col("year_a") != F.col("year_b")) & (jaccard(F.col("w_a"), F.col("w_b")) > 0.5)
    return both.where(quarters | years).groupBy("set", "place_a", "place_b").agg(F.count(F.lit(1)).alias("n"))


def set_features(texts: DataFrame) -> DataFrame:
    """(set, n, length_cv, chars_deviation, digits, jaccard_max, jaccard_min): spread of lengths (sample deviation of
    words by their mean, population deviation of characters), share of digits, and likeness of the word sets of pairs."""
    t = F.col("text")
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    rows = texts.select("set", "place", n_words.alias("n_words"), F.length(t).alias("n_chars"), F.length(F.regexp_replace(t, "[^0-9]", "")).alias("digits"), words(t).alias("w"))
    cv = F.when(F.avg("n_words") > 0, F.coalesce(F.stddev_samp("n_words"), F.lit(0.0)) / F.avg("n_words")).otherwise(0.0)
    own = rows.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.round(cv, 6).alias("length_cv"), F.round(F.stddev_pop("n_chars"), 6).alias("chars_deviation"), F.round(F.sum("digits") / F.greatest(F.sum("n_chars"), F.lit(1)), 6).alias("digits"))
    alike = _pairs(rows.select("set", "place", "w")).select("set", jaccard(F.col("w_a"), F.col("w_b")).alias("j"))
    likeness = alike.groupBy("set").agg(F.round(F.max("j"), 6).alias("jaccard_max"), F.round(F.min("j"), 6).alias("jaccard_min"))
    return own.join(likeness, "set", "left")
