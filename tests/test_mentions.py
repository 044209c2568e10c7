from pyspark.sql import functions as F

from tesserae.functions.numbers import mentions
from tesserae.plans.ingestion import numeric_mentions


def run(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(r) for r in df.select(F.explode(mentions(F.col("text"))).alias("m")).select("m.*").collect()]


def test_values_units_directions_and_spans(spark):
    assert run(spark, "1,200 units") == [(1200.0, "units", None, 0, 11)]
    assert run(spark, "Sales rose: growth 12.5% now") == [(12.5, "%", "increase", 19, 24)]
    assert run(spark, "fell by 7 Percent") == [(7.0, "%", "decrease", 8, 17)]
    assert run(spark, "5GB") == [(5.0, "bytes", None, 0, 3)]
    assert run(spark, "$ 2 million") == [(2.0, "million", None, 2, 11), (2.0, "currency", None, 0, 11)]
    assert run(spark, "299,792,458 meters at 30 °C, 3 mph") == [(3.0, "speed", None, 29, 34), (299792458.0, "meters", None, 0, 18), (30.0, "°c", None, 22, 27)]
    assert run(spark, "nothing") == [] and run(spark, None) == []


def test_query(spark, tmp_path):
    texts = ["1,200 units and 90 units", "3 UNITS, 40 percent", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["unit"]: (r["n"], r["n_docs"], r["high"], r["low"]) for r in numeric_mentions(spark, str(tmp_path)).collect()}
    assert got == {"units": (3, 2, 1200.0, 3.0), "%": (1, 1, 40.0, 40.0)}
