import pytest
from pyspark.sql import functions as F

from tesserae.operators import constraints as c


@pytest.mark.parametrize("query, text, want", [("ProTab X1?", "the x2 and x3", True), ("ProTab X1?", "x2, x1", False), ("sales 2024", "2023 sales", True), ("online orders", "In-Store only", True), ("online", "online and in-store", False), ("a", "b", False), ("x1", None, False), (None, "x1", False), ("q3 plan", "", False)])
def test_mismatch(spark, query, text, want):
    assert spark.createDataFrame([(query, text)], "q string, t string").select(c.mismatch(F.col("q"), F.col("t"))).first()[0] is want


def rows(df):
    return {r["qid"]: tuple(r)[1:] for r in df.collect()}


def test_rules(spark):
    queries = spark.createDataFrame([(1, "what does the lantern cost"), (2, "sales in 2024"), (3, "anything"), (4, "lantern")], "qid int, text string")
    texts = spark.createDataFrame(
        [(1, "a", "the lantern is old", ["Lantern"], None), (1, "b", None, [], ""), (2, "a", "it was 2023", [], "sales of tables"), (4, "a", "a lantern", ["rotor"], "wheels")], "qid int, id string, text string, entities array<string>, summary string"
    )
    assert rows(c.relevance(queries, texts)) == {1: (True, "entity_overlap"), 2: (True, "summary_overlap"), 3: (True, "no_enrichment"), 4: (False, "no_enriched_match")}
    found = c.information(queries, texts)
    assert rows(found) == {1: ("qualified", "no pricing"), 2: ("qualified", "other entity"), 3: (None, None), 4: (None, None)}
    gate = c.relevance(queries, texts).select("qid", F.when(~F.col("relevant"), "abstain").alias("signal"), F.col("method").alias("reason"))
    extra = queries.select("qid", F.lit("disputed").alias("signal"), F.lit("x").alias("reason"))
    got = sorted((r["qid"], r["stage"], r["signal"]) for r in c.staged(gate, [found, extra]).collect())
    assert got == [(1, 1, "qualified"), (1, 2, "disputed"), (2, 1, "qualified"), (2, 2, "disputed"), (3, 2, "disputed"), (4, 0, "abstain")]
    assert c.information(queries, texts.limit(0)).where("signal is not null").count() == 0 and c.relevance(queries.limit(0), texts).count() == 0


def test_terms(spark):
    df = spark.createDataFrame([(["A", "b"], "xa B"), ([], None), (None, "x"), (["a"], None)], "t array<string>, x string")
    assert [r[0] for r in df.select(c.mentions_all(F.col("t"), F.col("x"))).collect()] == [True, True, True, False]
    assert [r[0] for r in spark.createDataFrame([("the lantern", "Lantern x"), ("the", "the"), (None, "x")], "a string, b string").select(c.lexical_overlap(F.col("a"), F.col("b"))).collect()] == [True, False, False]
