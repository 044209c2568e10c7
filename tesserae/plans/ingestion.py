"""Queries of ingestion, chunking and loosely typed tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import numbers
from tesserae.functions.casting import infer_type, profile
from tesserae.operators import chunking, ingest
from tesserae.sources import files
from tesserae.tables import current_table, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def scan_schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "customer"))


def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred types of the words of the event payloads and of the order dates as text."""
    k = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("v"))
    d = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v"))
    return k.unionByName(d).groupBy(infer_type(F.col("v")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def diff_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current files against what is known of them: the oldest state of each file that symbols or sections refer to;
    a file they refer to that is not there any more is deleted."""
    rows = table(spark, sf_dir, "raw_files").select("id", "content_hash", "file_type", "updated_at")
    w = Window.partitionBy("id").orderBy("updated_at")
    oldest = rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "content_hash", "file_type")
    referred = table(spark, sf_dir, "section_index").select("raw_file_id").unionByName(table(spark, sf_dir, "symbol_index").select("raw_file_id"))
    known = referred.where("raw_file_id is not null").distinct().select(F.col("raw_file_id").alias("id")).join(oldest, "id", "left")
    return ingest.diff(current_table(spark, sf_dir, "raw_files", "content_hash", "file_type"), known, "id", "content_hash", "file_type")


def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = current_table(spark, sf_dir, "raw_files", "content_hash", "size_bytes")
    arrived = stored.where("size_bytes > 1500").select(F.when(F.col("size_bytes") % 2 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")).alias("id"), F.lit("x").alias("content_hash"), F.lit(1).alias("size_bytes"))
    return ingest.upsert(stored, arrived, "id")


def incremental_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row_num"), "c_name")
    extra = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("_row_num"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("C_NAME"), "c_acctbal")
    return ingest.add_columns(rows, extra)


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.number_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), F.col("p_partkey"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_table(spark, sf_dir, "section_index", "title").where("title is not null")
    return rows.select(ingest.table_name(F.col("title")).alias("table_name"), ingest.column_name(F.col("title")).alias("column_name")).distinct()


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"), ingest.chunk_id(F.sha2("text", 256), F.col("doc_id"), F.lit("md.v1")).alias("chunk_id"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def retrieval_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_table(spark, sf_dir, "section_index", "raw_file_id").groupBy("raw_file_id").agg(F.collect_list("id").alias("ids"))
    return rows.select("raw_file_id", ingest.set_fingerprint(F.col("ids")).alias("fingerprint"))


def file_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_table(spark, sf_dir, "raw_files", "path").groupBy(files.authority(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed(_documents(spark, sf_dir), F.col("doc_id"), F.col("text"), 1000, 200)
    return chunks.select(F.col("key").alias("doc_id"), "chunk_index", F.md5("chunk").alias("digest"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.recursive(_documents(spark, sf_dir), F.col("doc_id"), F.col("text"), 1000, 200)
    return chunks.withColumnRenamed("key", "doc_id")


def _files(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    return current_table(spark, sf_dir, "raw_files", "path", "content").where(F.lower("path").endswith(suffix))


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.markdown(_files(spark, sf_dir, ".md"), F.col("id"), F.col("content"), 1500).withColumnRenamed("key", "id")


def chunk_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.python_code(_files(spark, sf_dir, ".py"), F.col("id"), F.col("content")).withColumnRenamed("key", "id")


def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir, ".md").select("id", F.explode(files.headings(F.col("content"))).alias("h"))
    return found.groupBy("h.level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h.title").alias("n_titles"))


def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_table(spark, sf_dir, "section_index", "raw_file_id", "pos", "level")
    return files.nearest_parents(rows, "raw_file_id", "pos", "level", "id").withColumnRenamed("key", "id")


def numeric_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(numbers.mentions(F.col("text"))).alias("m"))
    return rows.groupBy("m.unit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.max("m.value").alias("high"), F.min("m.value").alias("low"))


def numeric_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and unit the number and the largest ratio of all pairs of distinct values whose ratio is between 1.02 and 2."""
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(numbers.mentions(F.col("text"))).alias("m")).select("doc_id", "m.unit", "m.value").where("value > 0").distinct()
    values = rows.groupBy("doc_id", "unit").agg(F.collect_list("value").alias("values"))
    pairs = F.flatten(F.transform("values", lambda a: F.filter(F.transform("values", lambda b: a / b), lambda r: (r > 1.02) & (r < 2.0))))
    ratios = values.select("doc_id", "unit", F.explode(pairs).alias("ratio"))
    return ratios.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ratio"), 6).alias("ratio"))


def year_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", numbers.years(F.col("text")).alias("y")).where(F.size("y") > 0)
    return rows.select("doc_id", F.size("y").alias("n_years"), F.element_at("y", 1).alias("first"), F.element_at("y", -1).alias("last"))


def evidence_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: length statistics and densities of digits and hedging words."""
    t = F.col("text")
    hedges = F.size(F.regexp_extract_all(F.lower(t), F.lit(r"(?:may|might|could|unless|meanwhile) "), F.lit(0)))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.lower(F.trim("source")).alias("source"), F.length(t).alias("n"), F.length(F.regexp_replace(t, "[^0-9]", "")).alias("digits"), hedges.alias("hedges"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 4).alias("mean_chars"), F.max("n").alias("max_chars"), F.sum("digits").alias("digits"), F.sum("hedges").alias("hedges"))


def markdown_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_to_markdown(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], 15)


QUERIES = {
    f.__name__: f
    for f in (
        scan_schema_profile, value_types, diff_ingest, upsert_files, incremental_columns, row_numbers, safe_names, content_fingerprint, exact_duplicates, retrieval_fingerprint, file_authority, chunk_fixed,
        chunk_recursive, chunk_markdown, chunk_python, markdown_headings, section_parents, numeric_mentions, numeric_divergence, year_features, evidence_text_features, markdown_table_render,
    )
}

_F = "fi AS (SELECT * FROM raw_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_S = "se AS (SELECT * FROM section_index QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)"
_M = rf"""m AS (SELECT doc_id, split_part(x, ' ', 1)::DOUBLE AS value, split_part(x, ' ', 2) AS unit FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)?) ({"|".join(numbers.UNITS)})')) AS x FROM documents))"""
_STRIP = r"regexp_replace({}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


def _profile_sql(columns: dict[str, str]) -> str:
    """Every cell as text, its type, and the type that nine tenths of the filled cells of a column have."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM customer" for c in columns)
    return f"""WITH c AS ({cells}), t AS (SELECT "column", value, CASE WHEN value IS NULL OR trim(value) = '' THEN NULL
  WHEN lower(trim(value)) IN ('true', 'yes', '1', 't', 'y', 'false', 'no', '0', 'f', 'n') THEN 'boolean' WHEN try_cast(replace(trim(value), ',', '') AS DOUBLE) IS NOT NULL THEN 'number'
  WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date' ELSE 'string' END AS t FROM c)
SELECT "column", count(t) AS n, count(DISTINCT value) AS n_distinct, CASE WHEN count(*) FILTER (WHERE t = 'number') >= 0.9 * count(t) THEN 'number' WHEN count(*) FILTER (WHERE t = 'date') >= 0.9 * count(t) THEN 'date'
  WHEN count(*) FILTER (WHERE t = 'boolean') >= 0.9 * count(t) THEN 'boolean' ELSE 'string' END AS type FROM t GROUP BY 1"""


SQL = {
    "scan_schema_profile": _profile_sql(dict.fromkeys(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "")),
    "value_types": """WITH v AS (SELECT props->>'$.k' AS v FROM events UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders)
SELECT CASE WHEN v IN ('0', '1') THEN 'boolean' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'number' WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') THEN 'date' WHEN v IS NOT NULL THEN 'string' END AS type, count(*) AS n FROM v GROUP BY 1""".replace("\\\\", "\\"),
    "diff_ingest": f"""WITH {_F}, a AS (SELECT id, content_hash, file_type FROM fi), o AS (SELECT id, content_hash, file_type FROM raw_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1),
b AS (SELECT r.raw_file_id AS id, content_hash, file_type FROM (SELECT raw_file_id FROM section_index UNION SELECT raw_file_id FROM symbol_index) r LEFT JOIN o ON r.raw_file_id = o.id WHERE r.raw_file_id IS NOT NULL)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'deleted' WHEN a.content_hash IS DISTINCT FROM b.content_hash OR a.file_type IS DISTINCT FROM b.file_type THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.id = b.id""",
    "upsert_files": f"""WITH {_F}, n AS (SELECT CASE WHEN size_bytes % 2 = 0 THEN 'new-' || id ELSE id END AS id FROM fi WHERE size_bytes > 1500)
SELECT id, content_hash, size_bytes FROM fi WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'x', 1 FROM n""",
    "incremental_columns": """SELECT a.c_custkey AS _row_num, a.c_name, nullif(CASE WHEN b.c_mktsegment = 'BUILDING' THEN '' ELSE b.c_mktsegment END, '') AS "C_NAME_1", b.c_acctbal::VARCHAR AS c_acctbal FROM customer a LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) b ON a.c_custkey = b.c_custkey""",
    "row_numbers": "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS _row_num FROM part",
    "safe_names": f"""WITH {_S}, t AS (SELECT title, regexp_replace(title, '[^a-zA-Z0-9]', '_', 'g') AS s FROM se WHERE title IS NOT NULL)
SELECT DISTINCT lower('tbl_' || left(CASE WHEN regexp_matches(s, '^[0-9]') THEN 't_' || s ELSE s END, 55)) AS table_name, lower(CASE WHEN title = '' THEN 'col' WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END) AS column_name FROM t""",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS hash, sha256(coalesce(sha256(text), '') || '|' || doc_id || '|md.v1') AS chunk_id FROM documents",
    "exact_duplicates": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "retrieval_fingerprint": f"WITH {_S} SELECT raw_file_id, sha256(string_agg(id, ':' ORDER BY id)) AS fingerprint FROM se GROUP BY 1",
    "file_authority": f"""WITH {_F}, p AS (SELECT lower('/' || path) AS p FROM fi) SELECT {"CASE " + " ".join(f"WHEN regexp_matches(p, '{form}') THEN '{name}'" for name, form in files.AUTHORITY) + " ELSE 'document' END"} AS kind, count(*) AS n FROM p GROUP BY 1""",
    "chunk_fixed": f"""WITH w AS (SELECT doc_id, s, {_STRIP.format("substr(text, s + 1, 1000)")} AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents WHERE text <> ''))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_index, md5(c) AS digest FROM w WHERE c <> '' AND (s = 0 OR length(c) > 200)""",
    "section_parents": f"""WITH {_S}, r AS (SELECT id, raw_file_id, pos, level FROM se WHERE pos IS NOT NULL AND level IS NOT NULL)
SELECT a.id, arg_max(b.id, (b.pos, b.id)) AS parent FROM r a LEFT JOIN r b ON a.raw_file_id IS NOT DISTINCT FROM b.raw_file_id AND (b.pos, b.id) < (a.pos, a.id) AND b.level < a.level GROUP BY a.id""",
    "numeric_mentions": f"WITH {_M} SELECT unit, count(*) AS n, count(DISTINCT doc_id) AS n_docs, max(value) AS high, min(value) AS low FROM m GROUP BY 1",
    "numeric_divergence": f"""WITH {_M}, d AS (SELECT DISTINCT doc_id, unit, value FROM m WHERE value > 0), r AS (SELECT doc_id, unit, value / lag(value) OVER (PARTITION BY doc_id, unit ORDER BY value) AS ratio FROM d)
SELECT doc_id, unit, count(*) AS n, round(max(ratio), 6) AS ratio FROM r WHERE ratio > 1.02::DOUBLE AND ratio < 2 GROUP BY ALL""",
    "year_features": r"WITH y AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(text, '[^0-9]+'), lambda x: regexp_matches(x, '^(?:19|20)[0-9][0-9]$')))) AS y FROM documents) SELECT doc_id, len(y)::INT AS n_years, y[1] AS first, y[-1] AS last FROM y WHERE len(y) > 0",
    "evidence_text_features": r"""SELECT lower(trim(source)) AS source, count(*) AS docs, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS max_chars, sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS digits,
  sum(len(regexp_extract_all(lower(text), '(?:may|might|could|unless|meanwhile) ')))::BIGINT AS hedges FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "markdown_table_render": """SELECT 1 AS line, '| n_nationkey | n_name | n_regionkey |' AS text UNION ALL SELECT 2, '| --- | --- | --- |'
UNION ALL SELECT (row_number() OVER (ORDER BY n_nationkey) + 2)::INT, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 15)""",
}
