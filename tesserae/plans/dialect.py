"""Queries of the small SQL dialect and of filter documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import minisql
from tesserae.tables import current_table, table

_TEXTS = {
    "minisql_group_aggs": ("lineitem", "SELECT l_returnflag, COUNT(*) AS n, AVG(l_quantity) AS q, MIN(l_shipmode) AS low FROM lineitem WHERE l_discount >= 0.03 GROUP BY l_returnflag"),
    "minisql_topn": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 400000 ORDER BY o_totalprice DESC LIMIT 25"),
    "minisql_in_like": ("customer", "SELECT COUNT(*) AS n, COUNT(DISTINCT c_nationkey) AS nations, MAX(c_acctbal) AS top FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1%' AND c_nationkey != 3"),
    "minisql_group_concat": ("nation", "SELECT n_regionkey, GROUP_CONCAT(n_name) AS names FROM nation GROUP BY n_regionkey"),
}
_TEXTS["minisql_group_aggs"] = ("lineitem", _TEXTS["minisql_group_aggs"][1].replace("MIN(l_shipmode)", "MIN(l_linestatus)"))


def _query(name: str, text: str, compat: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = minisql.query(text, {name: table(spark, sf_dir, name)}, compat)
        return out.select(*(F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))

    return query


def filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {"must": [{"key": "chunk_index", "range": {"gte": 1, "lt": 6}}], "should": [{"key": "chunk_index", "match": {"value": 2}}, {"key": "content", "range": {"gt": 0}}, {"must": [{"key": "chunk_index", "match": {"value": 4}}]}], "must_not": [{"key": "doc_id", "match": {"value": "none"}}]}
    rows = current_table(spark, sf_dir, "chunks", "payload").where(minisql.filter_document(chosen))
    return rows.select("id", F.get_json_object("payload", "$.chunk_index").cast("int").alias("chunk_index"))


QUERIES = {**{name: _query(*spec) for name, spec in _TEXTS.items()}, "minisql_compat": _query("customer", "SELECT COUNT(*) AS n, SUM(c_name) AS none FROM customer WHERE c_nationkey != 3 AND c_mktsegment LIKE '%BUILDING%' ORDER BY n LIMIT 0", True), "filter_documents": filter_documents}
SQL = {
    "minisql_group_aggs": "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS q, min(l_linestatus) AS low FROM lineitem WHERE l_discount >= 0.03::DOUBLE GROUP BY 1",
    "minisql_topn": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "minisql_in_like": "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(max(c_acctbal), 4) AS top FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1%' AND c_nationkey <> 3",
    "minisql_group_concat": "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "minisql_compat": "SELECT count(*) AS n, 0::DOUBLE AS none FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_documents": """SELECT id, (payload->>'$.chunk_index')::INT AS chunk_index FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)
WHERE (payload->>'$.chunk_index')::INT BETWEEN 1 AND 5 AND (payload->>'$.chunk_index')::INT IN (2, 4) AND payload->>'$.doc_id' <> 'none'""",
}
