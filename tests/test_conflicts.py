import pytest
from pyspark.sql import functions as F

from tesserae.functions import questions as q
from tesserae.operators import conflicts as c


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def sets(spark, *texts):
    return c.first_texts(spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(texts)], "set string, pos int, text string"))


def test_variance_needs_one_value_of_a_unit_and_no_opposite_direction(spark):
    texts = sets(spark, ("a", "sales grew 10% here"), ("a", "sales of 11 percent"), ("a", "12% and 50%"), ("b", "profit increased 20%"), ("b", "profit decreased 20%"), ("c", "0 credits"), ("c", "0 credits"), ("d", None), (None, "5%"), ("e", ""))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows(c.variances(texts))] == [("a", 1, 2, 10.0, 11.0), ("c", 1, 2, 0.0, 0.0)]


def test_divergence_equals_all_pairs(spark):
    texts = sets(spark, ("a", "100 and 150 and 1,800 in 1999"), ("a", "120 or 90"), ("b", "no numbers"), ("c", "10 11 10"), ("d", "5"))
    got = {r[0]: tuple(round(x, 6) for x in r[1:]) for r in rows(c.divergence(texts))}
    a, b = [100.0, 150.0, 1800.0], [120.0, 90.0]
    cross = [max(x, y) / min(x, y) for x in a for y in b]
    cross = [r for r in cross if 1.02 < r < 2]
    assert got["a"] == (len(cross), round(max(cross), 6), 2, 1.5) and got["b"] == (0, 0, 0, 0) and got["c"] == (0, 0, 2, 1.1) and got["d"] == (0, 0, 0, 0)


def test_temporal_conflicts(spark):
    texts = sets(spark, ("a", "The launch of the great bridge happened in 2019 downtown"), ("a", "The launch of the great bridge happened in 2021 downtown"), ("b", "grew in Q1 2020"), ("b", "grew in q3 '20"), ("b", "Q2"), ("d", None))
    assert [r[:3] for r in rows(c.temporal_conflicts(texts))] == [("a", 1, 2), ("b", 1, 2)]
    assert c._temporal("Q4'21, 1899 2099") == [(2099, None, "Q4'21, 1899 2099"), (2021, "Q4", "Q4'21, 1899 2099")]


def test_only_the_first_texts_of_a_set(spark):
    df = spark.createDataFrame([("s", i, f"t{i}") for i in range(9)] + [("s", 0, "t0")], "set string, pos int, text string")
    assert rows(c.first_texts(df, 3)) == [("s", 1, "t0"), ("s", 2, "t0"), ("s", 3, "t1")]
    for f in (c.variances, c.divergence, c.temporal_conflicts, c.set_features):
        assert f(c.first_texts(df.limit(0))).count() == 0


def test_set_features(spark):
    texts = sets(spark, ("a", "alpha beta gamma"), ("a", "alpha beta"), ("b", "1 2"))
    assert rows(c.set_features(texts)) == [("a", 2, 0.282843, 3.0, 0.0, 0.666667, 0.666667), ("b", 1, 0.0, 0.0, 0.666667, None, None)]


@pytest.mark.parametrize(
    "text, kind, compares, entities, reason",
    [
        ("What is the Foo-Bar?", "what", False, ["Foo-Bar"], "simple_question"),
        ("  where? A vs B", "when_where", True, ["vs"], "short_query"),
        ("is it fine", "yes_no", False, ["fine"], "has_context_pronouns"),
        ("whatever", "other", False, ["whatever"], "short_query"),
        ("", "other", False, [], "short_query"),
        ("a b c d e f g h i", "other", False, None, "medium_query"),
        ("x and y and z", "other", False, ["and", "and"], "has_compound_indicators"),
        ("umm ok??", "other", False, ["umm", "ok"], "noisy_query"),
        ("x " * 60, "other", False, None, "long_query"),
    ],
)
def test_questions(spark, text, kind, compares, entities, reason):
    t = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(q.kind(t), q.compares(t), q.entities(t), q.rewrite_reason(t)).first()
    assert tuple(r) == (kind, compares, entities, reason)


def test_more_questions(spark):
    t = F.col("t")
    df = spark.createDataFrame([(" <b>Hi</b> you ",), ("<b>",), ("in 2031 or 2020",), (None,)], "t string")
    got = df.select(q.clean(t), q.mentions_future_year(t, 2030), q.needs_detection(t), q.rewrite_reason(t, F.lit(True))).collect()
    assert [tuple(r) for r in got] == [("Hi you", False, False, "has_conversation_context"), ("<b>", False, False, "has_conversation_context"), ("in 2031 or 2020", True, False, "has_conversation_context"), (None, None, None, "has_conversation_context")]
    row = spark.range(1).select(q.variations(F.lit("a"), F.lit("a"), F.array(F.lit("b"), F.lit("a")), F.lit(None)), q.variations(F.lit("a"), F.lit("c"), F.lit(None), F.array(F.lit("d")))).first()
    assert list(row) == [["a", "b", "a"], ["a", "c", "d"]]
