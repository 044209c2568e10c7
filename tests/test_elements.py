import pytest
from pyspark.sql import functions as F

from tesserae.functions.casting import infer_type
from tesserae.sources import elements as e


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


TEXT = """Intro line
goes on

# Title #
## 
- one
  * two
      3. deep
-
> quoted
> more
after

| a | b |
|---|---|
| 1 |   |
| 2 | 3 | 4 |

```python
# no heading

x = 1
```
~~~
"""


def test_markdown_elements():
    assert e.markdown(TEXT) == [
        ("text", "Intro line\ngoes on", None, None),
        ("heading", "Title", 1, None),
        ("list_item", "one", 1, None),
        ("list_item", "two", 2, None),
        ("list_item", "deep", 4, None),
        ("text", "-", None, None),
        ("quote", "quoted\nmore", None, None),
        ("text", "after", None, None),
        ("table", "| a | b |\n|---|---|\n| 1 |   |\n| 2 | 3 | 4 |", None, None),
        ("code_block", "# no heading\n\nx = 1", None, "python"),
    ]
    assert e.markdown("") == [] and e.markdown("``` \nopen") == [("code_block", "open", None, None)]


def test_elements_and_tables(spark):
    df = spark.createDataFrame([(1, TEXT, True), (2, " plain # text \n", False), (3, "  ", None), (4, None, True), (5, "x", None)], "k int, c string, md boolean").withColumns({"key": F.lit(0), "place": F.lit(0)})
    found = e.elements(df, F.col("k"), F.col("c"), F.col("md"))
    assert [(r[0], r[1], r[2]) for r in rows(found, "key", "place")][-2:] == [(2, 0, "text"), (5, 0, "text")] and found.count() == 12
    tables, rest = e.tables_and_rest(found)
    r = tables.first()
    assert r["headers"] == ["a", "b"] and r["rows"] == [["1", ""], ["2", "3"]] and len(r["table_id"]) == 12 and rest.count() == 11
    text = tables.select(e.table_text(F.lit("d"), F.col("headers"), F.col("rows"))).first()[0]
    assert text == "Table from d\nColumns: a, b\nRow count: 2 rows\nSample data:\n  1 | \n  2 | 3"
    assert e.elements(df.limit(0), F.col("k"), F.col("c"), F.col("md")).count() == 0


@pytest.mark.parametrize("text, want", [("| a |", None), ("a|b\n", None), ("|a|\n|-|", None), ("||\n|x|", None), ("a|b\nc", ["a", "b"]), (None, None), ("", None)])
def test_no_table(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(e.pipe_table(F.col("t")).alias("t")).first()["t"]
    assert (got and got["headers"]) == want


def test_files_and_schema(spark):
    paths = ["r/a.py", "r/.git/b.py", "r/dist/c.py", "r/x.bin", "r/B.MD", "s/go.mod", "t/x/go.mod", "u.py", "v/My.csproj"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in e.indexable(df, "path").collect()] == ["r/B.MD", "r/a.py", "u.py"] and e.indexable(df, "path", 1).count() == 1
    assert rows(e.content_kinds(df, "path")) == [("r", "documents"), ("s", "codebase"), ("t", "documents"), ("v", "codebase")]
    import hashlib

    assert e.schema_version("t", [("a", "string")], "a", 3) == hashlib.sha256(b'{"columns": [["a", "string"]], "pk": "a", "rows": 3, "table": "t"}').hexdigest()[:12]
    kinds = spark.createDataFrame([("number", 0.5, False), ("number", 0.95, False), ("string", 0.2, False), ("string", 0.5, True), ("date", 1.0, False), ("other", 0.1, False)], "k string, u double, p boolean")
    assert [r[0] for r in kinds.select(e.worth_indexing(F.col("k"), F.col("u"), F.col("p"))).collect()] == [True, False, True, True, True, False]


@pytest.mark.parametrize("text, kind", [("1/2/2024", "date"), ("January 5, 2024", "date"), ("March 5 2024", "date"), ("5 March 2024", "date"), ("5-6-2024", "date"), ("2024-01-02T10:00:00Z", "date"), ("2024/01/02", "string"), ("1,200", "number"), ("yes", "boolean"), (" ", None), ("x", "string")])
def test_dates_in_all_their_forms(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(infer_type(F.col("t"))).first()[0] == kind


def test_csv_document(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n2,b\n")
    text, df = e.csv_document(spark, str(tmp_path / "a.csv"))
    assert text.endswith("Columns: x, y") and rows(df) == [("1", ""), ("2", "b")]
