"""Queries over code: resolved imports, context of symbols, neighbours and the staged retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import code_context as code
from tesserae.plans.knowledge import _imports
from tesserae.plans.lookups import _CHUNKS, _FILES, _IMPORTS, _SECTIONS, _SYMBOLS
from tesserae.tables import current_table


def _files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "raw_files", "path", *columns).withColumnRenamed("id", "file")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _imports(spark, sf_dir).select("source", F.col("target").alias("module"), F.lit(None).cast("string").alias("target"))
    return code.resolve(edges, code.module_names(_files(spark, sf_dir)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, module, target): the files that a file's references lead to, by the last dotted part of their names; of
    symbols with one name the one with the largest id counts. References to the file itself are left out."""
    rows = _symbols(spark, sf_dir, "name", "refs")
    refs = rows.select(F.col("file").alias("source"), F.explode("refs").alias("module")).where("source is not null and module is not null").distinct()
    names = rows.where("file is not null").groupBy("name").agg(F.max_by("file", "id").alias("target"))
    return refs.join(names, F.element_at(F.split("module", r"\."), -1) == F.col("name")).where("source <> target").select("source", "module", "target")


def _symbols(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "symbol_index", "raw_file_id", "start_line", *columns).withColumnRenamed("raw_file_id", "file")


def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def import_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.import_summaries(_symbols(spark, sf_dir), _links(spark, sf_dir))


def import_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import block of every file that has symbols."""
    files = _files(spark, sf_dir, "content").join(_symbols(spark, sf_dir).select("file"), "file", "left_semi")
    return files.select("file", code.import_block(F.col("content")).alias("block")).where("block is not null")


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with a class: a stated selection that grows with the data."""
    return _symbols(spark, sf_dir, "kind").where("kind = 'class'").select("file").distinct()


def directory_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.siblings(_selected(spark, sf_dir), _files(spark, sf_dir), 10)


def code_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.staged_retrieval(_selected(spark, sf_dir), _links(spark, sf_dir), _files(spark, sf_dir), 1, 1)


def package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.package_edges(_links(spark, sf_dir), _files(spark, sf_dir))


def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every symbol in the current text of its file, as a digest and a count."""
    rows = _symbols(spark, sf_dir, "end_line").join(_files(spark, sf_dir, "content"), "file").where("content is not null and start_line is not null and end_line is not null")
    text = code.line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))
    return rows.select("id", F.md5(text.cast("binary")).alias("digest"), F.length(text).alias("n_chars"))


def section_parents_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders resolved: each section but the first names the one before it in its file by place."""
    rows = current_table(spark, sf_dir, "section_index", "raw_file_id", "pos")
    w = Window.partitionBy("raw_file_id").orderBy(F.col("pos").asc_nulls_last(), "id")
    placed = rows.withColumn("place", F.row_number().over(w) - 1)
    named = placed.withColumn("wanted", F.when(F.col("place") > 0, F.concat(F.lit("_parent_"), F.col("place") - 1)))
    at = F.regexp_extract("wanted", r"^_parent_(\d+)$", 1).try_cast("int")
    parents = placed.select(F.col("raw_file_id").alias("f"), F.col("place").alias("p"), F.col("id").alias("parent_id"))
    return named.join(parents, (F.col("raw_file_id") == F.col("f")) & (at == F.col("p")), "left").select("id", "parent_id")


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of symbols with one file, name and first line the one with the smallest id."""
    return _symbols(spark, sf_dir, "name").groupBy("file", "name", "start_line").agg(F.min("id").alias("id"))


def entities_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity graph from the entities of symbols: each normalised name, its type (unknown if there is none), and how
    many symbols have it."""
    rows = _symbols(spark, sf_dir, "entities").select("id", F.explode("entities").alias("e")).select("id", F.lower(F.trim("e.name")).alias("name"), F.coalesce("e.type", F.lit("unknown")).alias("type"))
    pairs = rows.where("name is not null and name <> ''").groupBy("name", "id").agg(F.min("type").alias("type"))
    return pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type"))


def sections_by_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the parser in their metadata, and how dense each group is."""
    rows = current_table(spark, sf_dir, "section_index", "metadata", "content")
    name = F.coalesce(F.get_json_object("metadata", "$.parser"), F.lit("_ungrouped"))
    groups = rows.groupBy(name.alias("parser")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"))
    density = F.when((F.col("n") < 3) | (F.col("n_chars") < 500), "sparse").when((F.col("n") < 10) | (F.col("n_chars") < 3000), "moderate").otherwise("dense")
    return groups.withColumn("density", density)


def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: files of at least two sections and 1,000 characters, and all of them together."""
    rows = current_table(spark, sf_dir, "section_index", "raw_file_id", "content").select("raw_file_id", F.coalesce(F.length("content"), F.lit(0)).alias("c"))
    first = rows.groupBy("raw_file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("n_chars")).where("n >= 2 and n_chars >= 1000")
    one = first.select(F.lit(1).alias("level"), F.col("raw_file_id").alias("name"), "n", "n_chars")
    two = first.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars")).select(F.lit(2).alias("level"), F.lit("corpus").alias("name"), "n", "n_chars")
    return one.unionByName(two)


def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the nested payloads of chunks by path, and one set."""
    rows = current_table(spark, sf_dir, "chunks", "payload")
    parsed = F.from_json("payload", "doc_id string, chunk_index int, content string")
    changed = F.to_json(parsed.withField("chunk_index", parsed["chunk_index"] + 1).dropFields("content"))
    return rows.select("id", F.get_json_object("payload", "$.doc_id").alias("doc_id"), F.get_json_object("payload", "$.chunk_index").alias("chunk_index"), changed.alias("changed"))


def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose path matches any of some globs."""
    from tesserae.functions.text import matches_globs

    return _files(spark, sf_dir).where(matches_globs(F.col("path"), ["*/docs/*.md", "*/src/*/[a-m]*.py", "*.t?ml"])).select("file", "path")


_MODULES = f"""files AS (SELECT id AS file, path FROM {_FILES} WHERE path IS NOT NULL),
parts AS (SELECT file, path, string_split(regexp_replace(regexp_replace(path, '\\.[^./]*$', ''), '/__init__$', ''), '/') AS p FROM files),
tails AS (SELECT file, path, p[i:] AS t FROM (SELECT file, path, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
modules AS (SELECT module, max_by(file, path || chr(1) || file) AS file FROM (SELECT file, path, array_to_string(t, '.') AS module FROM tails UNION SELECT file, path, array_to_string(t, '/') FROM tails) GROUP BY module),
{_IMPORTS}, edges AS (SELECT source, i.target AS module, m.file AS target FROM imports i LEFT JOIN modules m ON m.module = i.target)"""
_LINKS = f"""files AS (SELECT id AS file, path FROM {_FILES}), names AS (SELECT name, max_by(raw_file_id, id) AS target FROM {_SYMBOLS} WHERE raw_file_id IS NOT NULL GROUP BY name),
edges AS (SELECT source, module, target FROM (SELECT DISTINCT raw_file_id AS source, unnest(refs) AS module FROM {_SYMBOLS}) JOIN names ON name = string_split(module, '.')[-1] WHERE source <> target)"""
_DIR = "regexp_extract(path, '^(.*/)?[^/]*$', 1)"
_CHOSEN = f"chosen AS (SELECT DISTINCT raw_file_id AS file FROM {_SYMBOLS} WHERE kind = 'class' AND raw_file_id IS NOT NULL)"
_NEW = f"""new AS (SELECT f.file, {_DIR} AS dir FROM files f WHERE {_DIR} IN (SELECT {_DIR} FROM files WHERE file IN (FROM chosen)) AND file NOT IN (FROM chosen))"""

QUERIES = {
    q.__name__: q
    for q in (
        resolve_imports, import_summaries, import_blocks, directory_siblings, code_retrieval, package_dependencies, symbol_lines, section_parents_by_place, first_occurrence, entities_of_symbols,
        sections_by_parser, hierarchy_rollup, nested_paths, path_globs,
    )
}
SQL = {
    "resolve_imports": f"WITH {_MODULES} SELECT source, module, target FROM edges",
    "import_summaries": f"""WITH {_LINKS}, s AS (SELECT id, raw_file_id AS file, start_line FROM {_SYMBOLS}),
f AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY module, start_line NULLS LAST, s.id) AS place, s.id AS target_id
  FROM (SELECT DISTINCT * FROM edges WHERE target IS NOT NULL) e JOIN s ON s.file = e.target QUALIFY place <= 5)
SELECT s.id, place, target_id FROM s JOIN f ON s.file = f.source""",
    "import_blocks": f"""WITH l AS (SELECT file, i, x, trim(x) LIKE 'import %' OR trim(x) LIKE 'from %' AS imp, trim(x) <> '' AND trim(x) NOT LIKE '#%' AS full_line
  FROM (SELECT id AS file, unnest(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS i
    FROM {_FILES} WHERE id IN (SELECT raw_file_id FROM {_SYMBOLS}))),
a AS (SELECT file, min(i) AS first FROM l WHERE imp GROUP BY file),
b AS (SELECT l.file, min(i) AS stop FROM l JOIN a ON l.file = a.file AND i > first WHERE NOT imp AND full_line GROUP BY l.file)
SELECT l.file, string_agg(x, chr(10) ORDER BY i) AS block FROM l LEFT JOIN b ON l.file = b.file WHERE imp AND i < coalesce(stop, 1000000000) GROUP BY l.file""",
    "directory_siblings": f"""WITH files AS (SELECT id AS file, path FROM {_FILES}), {_CHOSEN}, {_NEW}
SELECT file FROM new QUALIFY count(*) OVER (PARTITION BY dir) <= 10""",
    "code_retrieval": f"""WITH {_LINKS}, {_CHOSEN}, links AS (SELECT DISTINCT source, target FROM edges WHERE target IS NOT NULL AND source <> target), {_NEW},
imported AS (SELECT DISTINCT target AS file FROM links WHERE source IN (FROM chosen)), dirs AS (SELECT {_DIR} AS d FROM files WHERE file IN (FROM chosen) OR file IN (FROM imported)),
ways AS (SELECT file, 0 AS r FROM chosen UNION ALL SELECT file, 1 FROM imported
  UNION ALL SELECT file, 2 FROM files WHERE regexp_extract(path, '([^/]*)$', 1) IN ('__init__.py', 'index.ts') AND {_DIR} IN (SELECT d FROM dirs)
  UNION ALL (SELECT source, 3 FROM links GROUP BY source HAVING count(*) > 1 ORDER BY count(*) DESC, source LIMIT 10)
  UNION ALL SELECT target, 4 FROM links GROUP BY target HAVING count(*) > 1 UNION ALL SELECT file, 5 FROM new)
SELECT file, ['selected', 'import', 'facade', 'hub', 'foundation', 'neighbor'][min(r) + 1] AS origin, [1.0, 0.95, 0.93, 0.92, 0.9, 0.8][min(r) + 1]::DOUBLE AS score FROM ways GROUP BY file""",
    "package_dependencies": f"""WITH {_LINKS}, p AS (SELECT file, string_split(path, '/')[1] AS package FROM files WHERE path LIKE '%/%')
SELECT DISTINCT a.package, b.package AS uses FROM edges e JOIN p a ON a.file = e.source JOIN p b ON b.file = e.target WHERE a.package <> b.package""",
    "symbol_lines": f"""SELECT s.id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT s.id, array_to_string((string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)))[greatest(start_line, 1):end_line], chr(10)) AS t
  FROM {_SYMBOLS} s JOIN {_FILES} f ON s.raw_file_id = f.id WHERE content IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL) s""",
    "section_parents_by_place": f"SELECT id, lag(id) OVER (PARTITION BY raw_file_id ORDER BY pos NULLS LAST, id) AS parent_id FROM {_SECTIONS}",
    "first_occurrence": f"SELECT raw_file_id AS file, name, start_line, min(id) AS id FROM {_SYMBOLS} GROUP BY ALL",
    "entities_of_symbols": f"""WITH e AS (SELECT id, lower(trim(e.name)) AS name, coalesce(e.type, 'unknown') AS type FROM (SELECT id, unnest(entities) AS e FROM {_SYMBOLS}))
SELECT name, count(DISTINCT id) AS n, min(type) AS type FROM e WHERE name <> '' GROUP BY name""",
    "sections_by_parser": f"""SELECT *, CASE WHEN n < 3 OR n_chars < 500 THEN 'sparse' WHEN n < 10 OR n_chars < 3000 THEN 'moderate' ELSE 'dense' END AS density
FROM (SELECT coalesce(metadata->>'$.parser', '_ungrouped') AS parser, count(*) AS n, coalesce(sum(length(content)), 0)::BIGINT AS n_chars FROM {_SECTIONS} GROUP BY 1)""",
    "hierarchy_rollup": f"""WITH f AS (SELECT raw_file_id AS name, count(*) AS n, sum(coalesce(length(content), 0))::BIGINT AS n_chars FROM {_SECTIONS} GROUP BY 1 HAVING n >= 2 AND n_chars >= 1000)
SELECT 1 AS level, name, n, n_chars FROM f UNION ALL SELECT 2, 'corpus', count(*), coalesce(sum(n_chars), 0)::BIGINT FROM f""",
    "nested_paths": f"""SELECT id, payload->>'$.doc_id' AS doc_id, payload->>'$.chunk_index' AS chunk_index,
  '{{"doc_id":"' || (payload->>'$.doc_id') || '","chunk_index":' || ((payload->>'$.chunk_index')::INT + 1) || '}}' AS changed FROM {_CHUNKS}""",
    "path_globs": f"SELECT id AS file, path FROM {_FILES} WHERE path GLOB '*/docs/*.md' OR path GLOB '*/src/*/[a-m]*.py' OR path GLOB '*.t?ml'",
}
