import pytest
from pyspark.sql import functions as F

from tesserae.operators import vocabulary as v


def test_detect_keywords(spark):
    texts = [(1, "TC-12 and tc_7, JIRA-4521 see PR #3; v2.0 v2.0 1.2.3"), (2, "jira-4521 config.yaml E016 Pull request 9 v2.1"), (3, None), (4, "")]
    got = {r["keyword"]: (r["category"], r["n"], r["n_sources"], r["first_source"]) for r in v.detect_keywords(spark.createDataFrame(texts, "k int, t string"), F.col("k"), F.col("t"), True).collect()}
    assert got == {"tc-12": ("testcase", 1, 1, 1), "jira-4521": ("ticket", 1, 1, 1), "v2.0": ("version", 2, 1, 1), "config.yaml": ("file", 1, 1, 2), "e016": ("internal_id", 1, 1, 2)}
    loose = {r["keyword"]: r["n"] for r in v.detect_keywords(spark.createDataFrame(texts, "k int, t string"), F.col("k"), F.col("t")).collect()}
    assert loose["jira-4521"] == 2 and loose["tc_7"] == 1 and loose["pull request 9"] == 1


@pytest.mark.parametrize("keyword, category, some", [("TC-12", "testcase", ["test case 12", "tc_12", "TC12"]), ("Jira-45", "ticket", ["JIRA45", "jira_45", "Jira 45", "jira 45"]), ("PR#3", "pull_request", ["pull request #3"]), ("v1.2-a", "version", ["Release 1.2-a", "1.2-a"]), ("John Q Smith", "person", ["J. Smith", "jsmith", "john.smith"]), ("x", "file", []), ("x", "person", [])])
def test_category_spellings(spark, keyword, category, some):
    got = spark.range(1).select(v.category_spellings(F.lit(keyword), F.lit(category))).first()[0]
    assert set(some) <= set(got) and got == sorted(set(got)) and bool(got) == bool(some)


def test_keywords_in_texts(spark):
    texts = spark.createDataFrame([(1, "See Foo-Bar, and baz_qux."), (2, "foobar"), (3, None), (4, "foo  bar foo bar"), (5, "c++ x")], "id int, text string")
    words = spark.createDataFrame([("FB", "foo bar"), ("BQ", "Baz Qux"), ("X", "c++"), ("none", ""), ("FB", "foo_bar")], "keyword string, spelling string")
    assert sorted(tuple(r) for r in v.keywords_in(texts, words).collect()) == [(1, "BQ"), (1, "FB"), (4, "FB"), (5, "X")]
    assert v.keywords_in(texts.limit(0), words).count() == 0
