import pytest
from pyspark.sql import functions as F

from tesserae import store as st
from tesserae.operators.ingest import safe_column_names


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "tables"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_write_upsert_append_delete_drop(spark, store):
    assert store.names() == [] and not store.has("a") and store.drop("a") == 0
    with pytest.raises(KeyError):
        store.read("a")
    store.write("a", spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"))
    store.upsert("a", spark.createDataFrame([(2, "z"), (3, None), (3, None)], "k int, v string"), "k")
    assert rows(store.read("a")) == [(1, "x"), (2, "z"), (3, None)]
    store.append("a", spark.createDataFrame([(1, "x")], "k int, v string"))
    assert store.delete("a", F.col("v") == "x") == 2 and rows(store.read("a")) == [(2, "z"), (3, None)]
    store.upsert("b", spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "i int, j int, v int"), "i", "j")
    store.upsert("b", spark.createDataFrame([(1, 2, 7)], "i int, j int, v int"), "i", "j")
    assert rows(store.read("b")) == [(1, 1, 5), (1, 2, 7)] and store.names() == ["a", "b"]
    assert store.drop("b") == 2 and store.names() == ["a"]


def test_an_unfinished_write_changes_nothing(spark, store, tmp_path):
    store.write("a", spark.range(3))
    (tmp_path / "tables/a/v=2").mkdir()
    assert store.read("a").count() == 3
    store.write("a", spark.range(5))
    assert store.read("a").count() == 5


def test_loosely_typed_tables(spark, store):
    df = spark.createDataFrame([(1, "a", ""), (2, None, "5")], "_row_num int, `First Name` string, `1st` string")
    store.store_table("people", df.orderBy(F.desc("_row_num")), source_file="p.csv")
    assert store.read("people").columns == ["_row_num", "first_name", "c_1st"]
    assert [tuple(r) for r in store.retrieve("people").collect()] == [("a", None), (None, "5")] and store.retrieve("people").columns == ["First Name", "1st"]
    assert store.has_columns("people", ["x", "1st", "First Name"]) == (["1st", "First Name"], ["x"]) and store.has_columns("no", ["x"]) == ([], ["x"])
    first = store.registry().collect()[0]
    import hashlib

    assert first["hash"] == hashlib.sha256(b"First Name,1st\na,\n,5\n").hexdigest()[:16] and first["row_count"] == 2
    store.store_table("people", df.limit(0))
    assert store.registry().count() == 1 and store.retrieve("people").count() == 0
    assert store.delete_table("people") and not store.delete_table("people")
    with pytest.raises(KeyError):
        store.retrieve("people")


def test_safe_column_names():
    assert safe_column_names(["A b", "a_b", "", "9", "A B"]) == ["a_b", "a_b_1", "col", "c_9", "a_b_2"]


def test_vocabulary(spark):
    kind = "id string, category string, match array<string>, occurrences int, user_defined boolean"
    stored = spark.createDataFrame([("Foo", "c", ["foo"], 3, False), ("bar", "c", ["bar"], 1, False), ("mine", "u", ["m"], 1, True), ("n", "u", None, None, None)], kind)
    found = spark.createDataFrame([("foo", "d", ["FOO"], 5, False), ("new", "d", ["new", "new"], 1, False)], kind)
    merged = st.merge_keywords(stored, found)
    assert rows(merged, "id") == [("Foo", "c", ["FOO", "foo"], 5, False), ("mine", "u", ["m"], 1, True), ("new", "d", ["new"], 1, False)]
    added = st.add_keywords(stored, spark.createDataFrame([("FOO", "x", ["f"], 1, False), ("z", "x", ["z"], 1, False)], kind))
    assert [r["id"] for r in added.orderBy("id").collect()] == ["Foo", "bar", "mine", "n", "z"]
    assert [r["match"] for r in st.add_spelling(stored, "FOO", "fu").where("id = 'Foo'").collect()] == [["foo", "fu"]]
    assert st.remove_keyword(stored, "foo").count() == 3


def test_positions_cascade_and_stale(spark):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, "c")], "file string, pos int, s string")
    out = st.update_by_position(df, "file", ["pos"], spark.createDataFrame([("f", ["x"]), ("g", ["y", "z"])], "file string, values array<string>"), "s")
    assert rows(out) == [("f", 1, "x"), ("f", 2, "b"), ("g", 1, "y")]
    gone = st.cascade(df.select("file").distinct(), "file", spark.createDataFrame([("f",)], "file string"), {"rows": (df, "file")})
    assert rows(gone["parents"]) == [("g",)] and rows(gone["rows"]) == [("g", 1, "c")]
    d = st.derived_rows(df, F.col("file"), F.col("s"), F.when(F.col("pos") == 1, "v1"))
    kept = st.without_stale(d, spark.createDataFrame([("f", "v1")], "source string, version string"))
    assert sorted((r["source"], r["sentence"]) for r in kept.collect()) == [("f", "a"), ("g", "c")]
