"""Point and batch lookups, deletes and small updates of the stored tables, with their SQL. A batch of keys is a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae import store
from tesserae.operators import vocabulary
from tesserae.plans.knowledge import _edges, _imports
from tesserae.session import Scratch
from tesserae.tables import current_table, squeeze, table


def _files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "raw_files", *columns)


def files_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that have symbols, by their ids."""
    wanted = current_table(spark, sf_dir, "symbol_index", "raw_file_id").select(F.col("raw_file_id").alias("id"))
    return _files(spark, sf_dir, "path", "file_type", "size_bytes").join(wanted, "id", "left_semi")


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "path", "content_hash").groupBy("path").agg(F.max_by("content_hash", "id").alias("content_hash"))


def file_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = current_table(spark, sf_dir, "section_index", "raw_file_id").select(F.col("raw_file_id").alias("id"))
    return _files(spark, sf_dir, "updated_at").join(wanted, "id", "left_semi").select("id", F.unix_micros("updated_at").alias("updated_us"))


def symbols_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_table(spark, sf_dir, "symbol_index", "raw_file_id", "name", "summary", "start_line")
    w = Window.partitionBy("raw_file_id").orderBy(F.col("start_line").asc_nulls_last(), "id")
    return rows.select("raw_file_id", F.row_number().over(w).alias("place"), "id", "name", "summary")


def sections_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_table(spark, sf_dir, "section_index", "raw_file_id", "title", "pos")
    w = Window.partitionBy("raw_file_id").orderBy(F.col("pos").asc_nulls_last(), "id")
    return rows.select("raw_file_id", F.row_number().over(w).alias("place"), "id", "title")


def summaries_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sections of each file take its first three titles, in the order of the titles, as summaries: a
    positional update from lists."""
    sections = current_table(spark, sf_dir, "section_index", "raw_file_id", "pos", "summary", "title")
    values = sections.groupBy("raw_file_id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("title"))), 1, 3).alias("values"))
    return store.update_by_position(sections, "raw_file_id", ["pos", "id"], values, "summary").select("id", "summary")


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table once the files without a file type, and all that hangs on them, are deleted."""
    files = _files(spark, sf_dir, "file_type")
    gone = files.where("file_type is null or trim(file_type) = ''")
    children = {n: (current_table(spark, sf_dir, n, "raw_file_id"), "raw_file_id") for n in ("section_index", "symbol_index")}
    left = store.cascade(files, "id", gone, children)
    return store.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()])


def imports_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def importers_of_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).groupBy("target").agg(F.count(F.lit(1)).alias("n_importers"), F.min("source").alias("first_importer"))


def first_chunks_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten chunks of each entity, in the order of their ids."""
    w = Window.partitionBy("entity").orderBy("chunk")
    return _edges(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


def edges_without_lost_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after the edges to chunks that do not exist are removed; stored mention counts are not touched."""
    chunks = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk"))
    left = _edges(spark, sf_dir).join(chunks, "chunk", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("n_left"))
    names = table(spark, sf_dir, "entities").select(squeeze("name").alias("entity"), "mention_count")
    return left.join(names, "entity", "left").select("entity", "n_left", "mention_count")


def _keywords(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = current_table(spark, sf_dir, name, "keywords").select(F.explode("keywords").alias("id")).where("id is not null")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("occurrences")).select("id", F.lit(name).alias("category"), F.array("id", F.upper("id")).alias("match"), "occurrences", F.col("id").like("%e").alias("user_defined"))


def vocabulary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of sections merged into those stored for symbols, of which the ones ending in e are a user's."""
    merged = store.merge_keywords(_keywords(spark, sf_dir, "symbol_index"), _keywords(spark, sf_dir, "section_index"))
    return merged.select("id", "category", F.array_join("match", ",").alias("match"), "occurrences", "user_defined")


def vocabulary_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _keywords(spark, sf_dir, "symbol_index").unionByName(_keywords(spark, sf_dir, "section_index"))
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols written oldest version first, then upserted by the current ones and read back."""
    tables = store.Store(spark, Scratch(spark, "store").path("symbols"))
    rows = table(spark, sf_dir, "symbol_index").select("id", "name", "start_line", "created_at")
    w = Window.partitionBy("id").orderBy("created_at")
    tables.write("symbols", rows.withColumn("r", F.row_number().over(w)).where("r = 1 and name < 'm'").drop("r", "created_at"))
    tables.upsert("symbols", current_table(spark, sf_dir, "symbol_index", "name", "start_line").where("name >= 'c'"), "id")
    return tables.read("symbols")


def stored_delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections written, those of level 3 and deeper deleted, read back."""
    tables = store.Store(spark, Scratch(spark, "store").path("sections"))
    tables.write("sections", current_table(spark, sf_dir, "section_index", "raw_file_id", "level"))
    tables.delete("sections", F.col("level") >= 3)
    return tables.read("sections").groupBy("raw_file_id").agg(F.count(F.lit(1)).alias("n"))


def stored_table_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uploaded tables and their registry entries."""
    tables = store.Store(spark, Scratch(spark, "store").path("tables"))
    tables.store_table("region", table(spark, sf_dir, "region").withColumn("_row_num", F.col("r_regionkey")))
    tables.store_table("nation", table(spark, sf_dir, "nation").withColumn("_row_num", F.col("n_nationkey")))
    return tables.registry().select("table_id", F.array_join("columns", ",").alias("columns"), "row_count", "hash")


def table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as one document of headers and rows."""
    rows = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.array(F.col("r_regionkey").cast("string"), "r_name"))).alias("rows"))
    return rows.select(F.to_json(F.struct(F.array(F.lit("r_regionkey"), F.lit("r_name")).alias("headers"), "rows")).alias("document"))


def derived_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for every part, by brand and with the size as version; of each brand the largest size is current."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name", F.col("p_size").cast("string").alias("v"))
    derived = store.derived_rows(parts, F.col("p_brand"), F.concat(F.col("p_name"), F.lit(" is a part")), F.col("v"))
    return store.without_stale(derived, parts.groupBy(F.col("p_brand").alias("source")).agg(F.max("v").alias("version")))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, vectors and their sizes by collection."""
    parts = [current_table(spark, sf_dir, n, v).select(F.lit(n).alias("collection"), F.size(v).alias("d")) for n, v in (("chunks", "vector"), ("section_index", "summary_vector"), ("symbol_index", "summary_vector"))]
    some = F.when(F.col("d") >= 0, F.col("d"))
    return store.union_all(parts).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count(some).alias("n_vectors"), F.min(some).alias("least_size"), F.max(some).alias("largest_size"))


def documents_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def detected_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.detect_keywords(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), True).select("keyword", "n", "n_sources", "first_source")


def keywords_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all sections' keywords each section has in its content, whatever its own are."""
    texts = current_table(spark, sf_dir, "section_index", "content").withColumnRenamed("content", "text")
    words = _keywords(spark, sf_dir, "section_index").select(F.col("id").alias("keyword"), F.col("id").alias("spelling"))
    return vocabulary.keywords_in(texts, words).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_sections"), F.min("id").alias("first_id"))


def _current(name: str, columns: str, version: str = "created_at") -> str:
    return f"(SELECT {columns} FROM (SELECT * FROM {name} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {version} DESC) = 1))"


_FILES = _current("raw_files", "*", "updated_at")
_SECTIONS, _SYMBOLS, _CHUNKS = _current("section_index", "*"), _current("symbol_index", "*"), _current("chunks", "*")
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_EDGES = f"""edges AS (SELECT DISTINCT lower(trim(regexp_replace(entity_name, '{_WS}', ' ', 'g'))) AS entity, chunk_id AS chunk FROM entity_chunks
  WHERE chunk_id IS NOT NULL AND trim(regexp_replace(entity_name, '{_WS}', ' ', 'g')) <> '')"""
_IMPORTS = f"imports AS (SELECT DISTINCT raw_file_id AS source, t AS target FROM (SELECT raw_file_id, unnest(imports) AS t FROM {_SYMBOLS}) WHERE t IS NOT NULL)"


def _keyword_sql(name: str) -> str:
    return f"""SELECT id, '{name}' AS category, [id, upper(id)] AS match, count(*) AS occurrences, id LIKE '%e' AS user_defined
  FROM (SELECT unnest(keywords) AS id FROM {_current(name, '*')}) WHERE id IS NOT NULL GROUP BY id"""


def _digest_sql(name: str, key: str, columns: list[str]) -> str:
    cells = " || ',' || ".join(f"coalesce({c}::VARCHAR, '')" for c in columns)
    return f"""SELECT '{name}' AS table_id, '{",".join(columns)}' AS columns, count(*) AS row_count,
  substr(sha256('{",".join(columns)}' || chr(10) || string_agg({cells} || chr(10), '' ORDER BY {key})), 1, 16) AS hash FROM {name}"""


QUERIES = {
    q.__name__: q
    for q in (
        files_by_id, file_hashes, file_timestamps, symbols_by_file, sections_by_file, summaries_by_position, cascade_counts, imports_of_file, importers_of_module, first_chunks_of_entity,
        edges_without_lost_chunks, vocabulary_merge, vocabulary_categories, stored_upsert, stored_delete_by_file, stored_table_registry, table_json, derived_invalidate, collection_stats, documents_by_collection,
        detected_keywords, keywords_in_sections,
    )
}
SQL = {
    "files_by_id": f"SELECT id, path, file_type, size_bytes FROM {_FILES} WHERE id IN (SELECT raw_file_id FROM {_SYMBOLS})",
    "file_hashes": f"SELECT path, max_by(content_hash, id) AS content_hash FROM {_FILES} GROUP BY path",
    "file_timestamps": f"SELECT id, epoch_us(updated_at) AS updated_us FROM {_FILES} WHERE id IN (SELECT raw_file_id FROM {_SECTIONS})",
    "symbols_by_file": f"SELECT raw_file_id, row_number() OVER (PARTITION BY raw_file_id ORDER BY start_line NULLS LAST, id) AS place, id, name, summary FROM {_SYMBOLS}",
    "sections_by_file": f"SELECT raw_file_id, row_number() OVER (PARTITION BY raw_file_id ORDER BY pos NULLS LAST, id) AS place, id, title FROM {_SECTIONS}",
    "summaries_by_position": f"""WITH s AS (SELECT id, raw_file_id, summary, title, row_number() OVER (PARTITION BY raw_file_id ORDER BY pos NULLS FIRST, id) AS r FROM {_SECTIONS}),
v AS (SELECT raw_file_id, list_sort(list(DISTINCT title))[1:3] AS v FROM s WHERE title IS NOT NULL GROUP BY raw_file_id)
SELECT s.id, CASE WHEN r <= coalesce(len(v), 0) THEN v[r] ELSE summary END AS summary FROM s LEFT JOIN v USING (raw_file_id)""",
    "cascade_counts": f"""WITH gone AS (SELECT id FROM {_FILES} WHERE file_type IS NULL OR trim(file_type) = '')
SELECT 'parents' AS name, count(*) AS n FROM {_FILES} WHERE id NOT IN (FROM gone)
UNION ALL SELECT 'section_index', count(*) FROM {_SECTIONS} WHERE raw_file_id IS NULL OR raw_file_id NOT IN (FROM gone)
UNION ALL SELECT 'symbol_index', count(*) FROM {_SYMBOLS} WHERE raw_file_id IS NULL OR raw_file_id NOT IN (FROM gone)""",
    "imports_of_file": f"WITH {_IMPORTS} SELECT source, list_sort(list(target)) AS targets FROM imports GROUP BY source",
    "importers_of_module": f"WITH {_IMPORTS} SELECT target, count(*) AS n_importers, min(source) AS first_importer FROM imports GROUP BY target",
    "first_chunks_of_entity": f"WITH {_EDGES} SELECT entity, chunk FROM edges QUALIFY row_number() OVER (PARTITION BY entity ORDER BY chunk) <= 10",
    "edges_without_lost_chunks": f"""WITH {_EDGES}, n AS (SELECT entity, count(*) AS n_left FROM edges WHERE chunk IN (SELECT id FROM chunks) GROUP BY entity)
SELECT n.entity, n_left, mention_count FROM n LEFT JOIN entities e ON lower(trim(e.name)) = n.entity""",
    "vocabulary_merge": f"""WITH a AS ({_keyword_sql('symbol_index')}), b AS ({_keyword_sql('section_index')}),
sa AS (SELECT lower(id) AS k, min(id) AS id, 'symbol_index' AS category, list_distinct(flatten(list(match))) AS match, max(occurrences) AS occurrences, bool_or(user_defined) AS user_defined FROM a GROUP BY 1),
sb AS (SELECT lower(id) AS k, min(id) AS id, 'section_index' AS category, list_distinct(flatten(list(match))) AS match, max(occurrences) AS occurrences FROM b GROUP BY 1)
SELECT coalesce(sa.id, sb.id) AS id, coalesce(sa.category, sb.category) AS category,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(sa.match, []), coalesce(sb.match, [])))), ',') AS match,
  greatest(sa.occurrences, sb.occurrences) AS occurrences, coalesce(user_defined, false) AS user_defined
FROM sa FULL JOIN sb ON sa.k = sb.k WHERE sb.k IS NOT NULL OR user_defined""",
    "vocabulary_categories": f"SELECT category, count(*) AS n, min(id) AS first_id FROM ({_keyword_sql('symbol_index')} UNION ALL {_keyword_sql('section_index')}) GROUP BY category",
    "stored_upsert": f"""WITH old AS (SELECT id, name, start_line FROM symbol_index QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1),
new AS (SELECT id, name, start_line FROM {_SYMBOLS} WHERE name >= 'c')
FROM new UNION ALL SELECT * FROM old WHERE name < 'm' AND id NOT IN (SELECT id FROM new)""",
    "stored_delete_by_file": f"SELECT raw_file_id, count(*) AS n FROM {_SECTIONS} WHERE level IS NULL OR level < 3 GROUP BY raw_file_id",
    "stored_table_registry": f"{_digest_sql('region', 'r_regionkey', ['r_regionkey', 'r_name'])} UNION ALL {_digest_sql('nation', 'n_nationkey', ['n_nationkey', 'n_name', 'n_regionkey'])}",
    "table_json": """SELECT '{"headers":["r_regionkey","r_name"],"rows":[' || string_agg('["' || r_regionkey || '","' || r_name || '"]', ',' ORDER BY r_regionkey::VARCHAR) || ']}' AS document FROM region""",
    "derived_invalidate": """WITH p AS (SELECT p_brand AS source, p_name || ' is a part' AS sentence, p_size::VARCHAR AS version FROM part)
SELECT substr(sha256(source || ':' || sentence), 1, 16) AS id, source, sentence, version FROM p QUALIFY version = max(version) OVER (PARTITION BY source)""",
    "collection_stats": f"""SELECT collection, count(*) AS n, count(d) AS n_vectors, min(d) AS least_size, max(d) AS largest_size FROM (
  SELECT 'chunks' AS collection, len(vector) AS d FROM {_CHUNKS} UNION ALL SELECT 'section_index', len(summary_vector) FROM {_SECTIONS}
  UNION ALL SELECT 'symbol_index', len(summary_vector) FROM {_SYMBOLS}) GROUP BY collection""",
    "keywords_in_sections": rf"""WITH w AS (SELECT DISTINCT id, regexp_replace(unnest(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}#.+]+')), '^[.#+]+|[.]+$', '', 'g') AS w FROM {_SECTIONS}),
k AS (SELECT DISTINCT unnest(keywords) AS keyword FROM {_SECTIONS})
SELECT keyword, count(DISTINCT id) AS n_sections, min(id) AS first_id FROM k JOIN w ON lower(keyword) = w GROUP BY keyword""",
    "documents_by_collection": "SELECT collection, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY collection",
}
