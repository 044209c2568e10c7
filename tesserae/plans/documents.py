"""Queries over files as documents, descriptions of tables, and further vector searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.casting import profile
from tesserae.operators import search
from tesserae.plans.lookups import _CHUNKS, _FILES, _SECTIONS
from tesserae.plans.retrieval import _hundredths, _vectors
from tesserae.sources import elements
from tesserae.tables import current_table, table


def _files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "raw_files", "path", *columns)


def _is_markdown() -> Column:
    return F.lower("path").endswith(".md")


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each type and level all Markdown and text files have, and how many characters."""
    texts = _files(spark, sf_dir, "content").where(_is_markdown() | F.lower("path").endswith(".txt"))
    found = elements.elements(texts, F.col("id"), F.col("content"), _is_markdown())
    return found.groupBy("type", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _files(spark, sf_dir, "content").where(_is_markdown())
    found, _ = elements.tables_and_rest(elements.elements(texts, F.col("id"), F.col("content"), F.lit(True)))
    return found.select(F.col("key").alias("id"), "place", "table_id", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"))


def plain_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a single element: its trimmed text, if anything is left."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("content"))
    return rows.where("content <> ''").select("doc_id", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.indexable(_files(spark, sf_dir), "path", 2000).select("id", "path")


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.content_kinds(_files(spark, sf_dir), "path")


def table_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a description of a table."""
    rows = table(spark, sf_dir, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_nationkey"].cast("string"), s["n_name"])).alias("rows"))
    return rows.select(elements.table_text(F.lit("nation"), F.array(F.lit("n_nationkey"), F.lit("n_name")), F.col("rows")).alias("text"))


def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of the customers are worth an index."""
    p = profile(table(spark, sf_dir, "customer"))
    ratio = F.when(F.col("n") > 0, F.col("n_distinct") / F.col("n")).otherwise(0.0)
    return p.select("column", "type", elements.worth_indexing(F.col("type"), ratio, F.col("column") == "c_custkey").alias("indexed"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _embeddings(spark, sf_dir).select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def vector_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the label of the nearest centre, if that is near enough."""
    return search.nearest(_embeddings(spark, sf_dir), _centers(spark, sf_dir)).where("score > 0.2").select("id", F.col("center").alias("label"))


def relevant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stated query vector all section vectors of a cosine of at least 0.3."""
    return search.knn(_vectors(spark, sf_dir), _hundredths(spark, sf_dir), 1 << 30, floor=0.3).select("qid", "id", "score")


def concept_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels whose most similar vector reaches a threshold, for each stated query vector."""
    rows = _embeddings(spark, sf_dir).select(F.col("label").alias("group"), "vector")
    return search.best_by_group(rows, _hundredths(spark, sf_dir)).where("score >= 0.35").select("qid", F.col("group").alias("label"))


def search_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are the labels, with their centres as summaries: the five most similar, of these the ones above a floor."""
    return search.knn(_centers(spark, sf_dir), _hundredths(spark, sf_dir), 5).where("score >= 0.05").select("qid", "id", "score", "rank")


def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar chunks for queries that find fewer than five sections above a floor."""
    queries = _hundredths(spark, sf_dir)
    found = search.knn(_vectors(spark, sf_dir), queries, 10, floor=0.3).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    poor = queries.join(found, "qid", "left").where(F.coalesce("n", F.lit(0)) < 5).select("qid", "vector")
    chunks = current_table(spark, sf_dir, "chunks", "vector")
    return search.knn(chunks, poor, 3).select("qid", "id", "rank")


def knn_floor_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_floor, for every query vector whose id is divisible by 100."""
    return search.knn(_vectors(spark, sf_dir), _hundredths(spark, sf_dir), 10, floor=0.3)


def dedup_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with one user and type: the first one stays, with all distinct keys of the group, and with the highest
    value where later ones brought new keys."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", k.alias("k"))
    g = rows.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value", "k"), "event_id").alias("f"), F.array_sort(F.collect_set("k")).alias("refs"), F.max("value").alias("high"))
    return g.select("user_id", "event_type", "f.event_id", F.size("refs").alias("n_refs"), F.when(F.size("refs") > 1, F.col("high")).otherwise(F.col("f.value")).alias("value"))


def heading_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in the order of a file, grouped from one of level 1 to the next."""
    rows = current_table(spark, sf_dir, "section_index", "raw_file_id", "level", "pos")
    w = Window.partitionBy("raw_file_id").orderBy(F.col("pos").asc_nulls_last(), "id")
    grouped = rows.withColumn("island", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w))
    return grouped.groupBy("raw_file_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


_GOOD = "len({v}) = 64 AND isfinite(list_sum(list_transform({v}, lambda x: x::DOUBLE * x))) AND list_sum(list_transform({v}, lambda x: x::DOUBLE * x)) > 0"
_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"
_QV = "q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0)"
_SV = f"s AS (SELECT id, summary_vector AS v FROM {_SECTIONS} WHERE {_GOOD.format(v='summary_vector')})"
_CENTERS = "c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label)"
_BY = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"
_FLOOR = f"{_QV}, {_SV}, f AS (SELECT qid, id, {_COS.format(a='s.v', b='q.v')} AS score FROM s, q)"

QUERIES = {
    q.__name__: q
    for q in (
        document_elements, document_tables, plain_elements, file_list, content_kinds, table_description, index_columns, vector_label, relevant_vectors, concept_labels, search_tables,
        chunk_fallback, knn_floor_all, dedup_temporal, heading_groups,
    )
}
SQL = {
    "plain_elements": r"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t FROM documents) WHERE t <> ''",
    "file_list": f"""SELECT id, path FROM {_FILES} WHERE list_contains(['{"', '".join(elements.INDEXABLE)}'], lower(regexp_extract(path, '(\\.[^./]*)$', 1)))
  AND NOT regexp_matches('/' || path, '/(?:{"|".join(s.replace("*", "[*]").replace(".", "[.]") for s in elements.SKIPPED)}|[.][^/]*)/') ORDER BY path LIMIT 2000""",
    "content_kinds": f"""SELECT string_split(path, '/')[1] AS root, CASE WHEN bool_or(regexp_matches(path, '^[^/]*/(?:{"|".join(m.replace(".", "[.]").replace("*", "[^/]*") for m in elements.MARKERS)})$')) THEN 'codebase' ELSE 'documents' END AS kind
FROM {_FILES} WHERE path LIKE '%/%' GROUP BY 1""",
    "table_description": """SELECT 'Table from nation' || chr(10) || 'Columns: n_nationkey, n_name' || chr(10) || 'Row count: ' || count(*) || ' rows' || chr(10) || 'Sample data:' || chr(10) || '  ' ||
  string_agg(n_nationkey || ' | ' || n_name, chr(10) || '  ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey < 3) AS text FROM nation""",
    "index_columns": """WITH c AS (SELECT 'c_custkey' AS "column", 'number' AS type, true AS indexed UNION ALL SELECT 'c_name', 'string', (SELECT count(DISTINCT c_name) / count(*) < 0.3 FROM customer)
  UNION ALL SELECT 'c_nationkey', 'number', (SELECT count(DISTINCT c_nationkey) / count(*) BETWEEN 0.0100001 AND 0.8999999 FROM customer)
  UNION ALL SELECT 'c_acctbal', 'number', (SELECT count(DISTINCT c_acctbal::VARCHAR) / count(*) BETWEEN 0.0100001 AND 0.8999999 FROM customer)
  UNION ALL SELECT 'c_mktsegment', 'string', (SELECT count(DISTINCT c_mktsegment) / count(*) < 0.3 FROM customer)) FROM c""",
    "vector_label": f"""WITH {_CENTERS}, f AS (SELECT e.vec_id AS id, c.label, {_COS.format(a='e.embedding', b='c.v')} AS score FROM embeddings e, c)
SELECT id, label FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1 AND score > 0.2""",
    "relevant_vectors": f"WITH {_FLOOR} SELECT qid, id, score FROM f WHERE score >= 0.3",
    "concept_labels": f"WITH {_QV} SELECT qid, label FROM embeddings e, q GROUP BY ALL HAVING max({_COS.format(a='e.embedding', b='q.v')}) >= 0.35",
    "search_tables": f"WITH {_QV}, {_CENTERS}, f AS (SELECT qid, label AS id, {_COS.format(a='c.v', b='q.v')} AS score FROM c, q), r AS (SELECT *, {_BY} AS rank FROM f) SELECT * FROM r WHERE rank <= 5 AND score >= 0.05",
    "chunk_fallback": f"""WITH {_FLOOR}, n AS (SELECT qid, count(*) AS n FROM f WHERE score >= 0.3 GROUP BY qid), p AS (SELECT q.* FROM q LEFT JOIN n USING (qid) WHERE coalesce(n, 0) < 5),
k AS (SELECT id, vector AS v FROM {_CHUNKS} WHERE {_GOOD.format(v='vector')}), g AS (SELECT qid, id, {_COS.format(a='k.v', b='p.v')} AS score FROM k, p)
SELECT qid, id, {_BY} AS rank FROM g QUALIFY rank <= 3""",
    "knn_floor_all": f"WITH {_FLOOR} SELECT qid, id, score, {_BY} AS rank FROM f WHERE score >= 0.3 QUALIFY rank <= 10",
    "dedup_temporal": """SELECT user_id, event_type, min(event_id) AS event_id, count(DISTINCT (props->>'$.k')::INT) AS n_refs, CASE WHEN count(DISTINCT (props->>'$.k')::INT) > 1 THEN max(value) ELSE min_by(value, event_id) END AS value FROM events GROUP BY ALL""",
    "heading_groups": f"""WITH g AS (SELECT id, raw_file_id, sum((level = 1)::INT) OVER (PARTITION BY raw_file_id ORDER BY pos NULLS LAST, id) AS island FROM (SELECT id, raw_file_id, pos, coalesce(level, 0) AS level FROM {_SECTIONS}))
SELECT raw_file_id, island::BIGINT AS island, count(*) AS n, min(id) AS first_id FROM g GROUP BY ALL""",
}
