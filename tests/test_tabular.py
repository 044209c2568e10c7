import pytest

from tesserae import tabular as t
from tesserae.providers import ScriptedChat


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("reply, sql", [("```sql\nSELECT 1;\n```", "SELECT 1"), ("Sure: select a\nfrom b ;", "select a\nfrom b"), ("```\nWITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x"), ("no", "no"), ("", "")])
def test_extract_sql(reply, sql):
    assert t.extract_sql(reply) == sql


@pytest.mark.parametrize("reply, names", [('["B", "a", "x", "b"]', ["b", "a"]), ("use a and b", ["a", "b"]), ("[oops", []), ('Here: ["a"]', ["a"]), ("[1, 2]", [])])
def test_extract_list(reply, names):
    assert t.extract_list(reply, ["a", "b", "c"]) == names


def test_missing_columns():
    assert t.missing_columns('SELECT "First Name", pay FROM d WHERE payer = 1', ["id"], ["First Name", "pay", "id", "ay"]) == ["First Name", "pay"]


def test_ask_file_reads_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    (tmp_path / "s.csv").write_text("name,pay,unit\nann,5,x\nbob,7,x\ncy,1,y\n")
    chat = ScriptedChat(['["unit"]', "```sql\nSELECT unit, sum(CAST(pay AS INT)) AS s FROM data GROUP BY unit\n```"])
    found = t.ask_file(spark, chat, path, "pay by unit?")
    assert rows(found.rows) == [("x", 12), ("y", 1)] and not chat.answers
    bad = t.ask_file(spark, ScriptedChat(["[]", "SELECT nothing FROM data"]), path, "?")
    assert bad.rows is None and "nothing" in bad.error


def test_ask_retries_and_falls_back(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, 2.0)], "k int, w double")
    assert rows(t.ask(spark, ScriptedChat(["SELECT oops", "SELECT v, w FROM a JOIN b ON a.k = b.k"]), "?", {"a": a, "b": b}).rows) == [("x", 2.0)]
    assert rows(t.ask(spark, ScriptedChat(["SELEC"] * 3 + ["SELECT v FROM a"]), "?", {"a": a, "b": b}).rows) == [("x",)]
    assert t.ask(spark, ScriptedChat(["SELECT z FROM a"] * 3), "?", {"a": a}).rows is None


def test_sentence(spark):
    df = spark.range(3).toDF("n")
    assert t.sentence("q", df.limit(0)) == "No results for: q" and t.sentence("q", df.limit(1)) == "n: 0" and t.sentence("q", df, 2) == "n: 0\nn: 1\n..."
