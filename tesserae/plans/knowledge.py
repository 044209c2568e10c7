"""Queries over the entity graph, the code symbols and the section trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.tables import bare, current_table, squeeze, table

#: Stated terms of the topic and name searches.
TOPICS = ["trunk", "survey", "ledger"]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entity_chunks").select(squeeze("entity_name").alias("entity"), F.col("chunk_id").alias("chunk"))
    return rows.where("entity <> '' and chunk is not null").distinct()


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks with the smallest ids: a stated seed set."""
    return current_table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk")).orderBy("chunk").limit(5)


def related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(_edges(spark, sf_dir), _seeds(spark, sf_dir), 2, 20)


def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities_of(_edges(spark, sf_dir), current_table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk")))


def chunks_for_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by how many of the three most mentioned entities they have."""
    top = table(spark, sf_dir, "entities").orderBy(F.col("mention_count").desc_nulls_last(), "name").limit(3).select(squeeze("name").alias("entity"))
    return _edges(spark, sf_dir).join(F.broadcast(top), "entity").groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "chunk").limit(50)


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("entity").alias("n_entities"), F.count_distinct("chunk").alias("n_chunks"))


def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("name", "entity_type", "mention_count").orderBy(F.col("mention_count").desc_nulls_last(), "name").limit(10)


def related_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lit(False)
    for t in TOPICS:
        hit = hit | F.col("name").contains(t)
    return table(spark, sf_dir, "entities").where(hit).select("name", "mention_count").orderBy(F.col("mention_count").desc_nulls_last(), "name").limit(20)


def mention_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose stored count differs from the number of distinct chunks that mention them."""
    real = _edges(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n_chunks"))
    both = table(spark, sf_dir, "entities").join(real, F.col("name") == F.col("entity"), "left").select("name", "mention_count", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return both.where(~F.col("mention_count").eqNullSafe(F.col("n_chunks")))


def entities_without_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "entities").select(squeeze("name").alias("entity"))
    return _edges(spark, sf_dir).select("entity").distinct().join(names, "entity", "left_anti")


def _symbols(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "symbol_index", "raw_file_id", *columns)


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, "imports").select(F.col("raw_file_id").alias("source"), F.explode("imports").alias("target")).where("target is not null").distinct()


def import_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_imports(spark, sf_dir), "source", "target")


def import_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files that import most, of those with more than one import."""
    return import_degrees(spark, sf_dir).where("out_degree > 1").orderBy(F.col("out_degree").desc(), "node").limit(10).select("node", "out_degree")


def import_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _imports(spark, sf_dir).select(F.col("source").alias("node")).distinct().orderBy("node").limit(20)
    return graph.expand(_imports(spark, sf_dir), seeds, "source", "target")


def same_file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each symbol up to three other symbols of its file that its references name by their last dotted part."""
    rows = _symbols(spark, sf_dir, "refs", "name")
    wanted = rows.select("id", "raw_file_id", F.posexplode("refs").alias("place", "ref")).withColumn("last", F.element_at(F.split("ref", r"\."), -1))
    targets = rows.select(F.col("id").alias("target"), "raw_file_id", F.col("name").alias("last"))
    met = wanted.join(targets, ["raw_file_id", "last"]).where("id <> target").groupBy("id", "target").agg(F.min("place").alias("place"))
    return graph.first_n(met, 3, ["id"], [F.col("place"), F.col("target")]).select("id", "target", "pos")


def class_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each method: the part of its qualified name before the last dot, in the same file."""
    rows = _symbols(spark, sf_dir, "kind", "qualified_name")
    methods = rows.where("kind = 'method'").select("id", "raw_file_id", F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1).alias("owner"))
    classes = rows.where("kind = 'class'").select(F.col("id").alias("class_id"), "raw_file_id", F.col("qualified_name").alias("owner"))
    return methods.join(classes, ["raw_file_id", "owner"]).groupBy("id").agg(F.min("class_id").alias("class_id"))


def symbol_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, "name", "qualified_name").where(F.col("name").ilike("%ledger%") | F.col("qualified_name").ilike("%ledger%")).select("id", "name")


def structural_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the names of their symbols in line order."""
    files = current_table(spark, sf_dir, "raw_files", "path").select(F.col("id").alias("raw_file_id"), "path")
    rows = _symbols(spark, sf_dir, "name", "start_line").join(files, "raw_file_id").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), F.col("id"), F.col("name")))).alias("s"))
    return rows.select("path", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: F.coalesce(x["name"], F.lit(""))), ",").alias("names"))


def _sections(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "section_index", "parent_section_id", *columns).withColumns({"key": bare("id"), "parent": F.nullif(bare("parent_section_id"), F.lit(""))})


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir, "pos", "title")
    return rows.where("parent is not null").groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("p"), "id"))), lambda s: s["id"]), ",").alias("children"))


def section_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections share a section's parent, or are parentless in its file; itself included."""
    rows = _sections(spark, sf_dir, "raw_file_id")
    family = F.coalesce("parent", F.concat(F.lit("file:"), F.coalesce("raw_file_id", F.lit(""))))
    sizes = rows.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("id", family.alias("family")).join(sizes, "family").select("id", "n")


def parent_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir, "title")
    parents = rows.select(F.col("key").alias("p"), F.col("title").alias("parent_title"))
    return rows.join(parents, F.col("parent") == F.col("p"), "left").select("id", F.concat_ws(" > ", "parent_title", "title").alias("location"))


def breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir, "title").select(F.col("key").alias("id"), "parent", "title")
    return graph.ancestors_path(rows, "title", 5)


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections one of whose keywords is among the stated terms."""
    return current_table(spark, sf_dir, "section_index", "keywords").where(F.arrays_overlap(F.transform("keywords", lambda k: F.lower(k)), F.array(*map(F.lit, TOPICS)))).select("id")


def keyword_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of sections and symbols merged by lower case: occurrences, and the spellings met."""
    both = current_table(spark, sf_dir, "section_index", "keywords").unionByName(current_table(spark, sf_dir, "symbol_index", "keywords"))
    words = both.select(F.explode("keywords").alias("k")).where("k is not null")
    return words.groupBy(F.lower("k").alias("keyword")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("k")), ",").alias("spellings"))


def symbol_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_table(spark, sf_dir, "symbol_index", "entities").select(F.explode("entities").alias("e")).where("e.name is not null")
    return rows.groupBy(squeeze("e.name").alias("entity"), F.coalesce("e.type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def metadata_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_table(spark, sf_dir, "section_index", "metadata").groupBy(F.get_json_object("metadata", "$.parser").alias("parser")).agg(F.count(F.lit(1)).alias("n"))


def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per document, read from the JSON payload."""
    rows = current_table(spark, sf_dir, "chunks", "payload").select(F.from_json("payload", "doc_id string, chunk_index int, content string").alias("p"))
    return rows.groupBy("p.doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("p.chunk_index").alias("last"), F.sum(F.length("p.content")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        related_chunks, chunk_entities, chunks_for_entities, graph_stats, top_entities, related_topics, mention_drift, entities_without_record, import_degrees, import_hubs, import_expand, same_file_references,
        class_context, symbol_name_search, structural_manifest, section_children, section_siblings, parent_titles, breadcrumb, keyword_overlap, keyword_vocabulary, symbol_entities, metadata_flag, payload_documents,
    )
}

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sq(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_WS}', ' ', 'g')))"


def _br(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g'))"


def _cur(name: str, alias: str, version: str = "created_at") -> str:
    return f"{alias} AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {version} DESC) = 1)"


_E = f"edges AS (SELECT DISTINCT {_sq('entity_name')} AS entity, chunk_id AS chunk FROM entity_chunks WHERE chunk_id IS NOT NULL AND {_sq('entity_name')} <> '')"
_C, _S, _Y, _F = _cur("chunks", "ch"), _cur("section_index", "se"), _cur("symbol_index", "sy"), _cur("raw_files", "fi", "updated_at")
_N = f"{_S}, sn AS (SELECT *, {_br('id')} AS k, nullif({_br('parent_section_id')}, '') AS parent FROM se)"
_I = f"{_Y}, im AS (SELECT DISTINCT source, target FROM (SELECT raw_file_id AS source, unnest(imports) AS target FROM sy) WHERE target IS NOT NULL)"
_D = f"{_I}, im2 AS (SELECT * FROM im WHERE source IS NOT NULL), dg AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM im2 UNION ALL SELECT target, 0, 1 FROM im2) GROUP BY node)"
SQL = {
    "related_chunks": f"""WITH {_E}, {_C}, sd AS (SELECT id AS chunk FROM ch ORDER BY 1 LIMIT 5), en AS (SELECT DISTINCT entity FROM edges WHERE chunk IN (SELECT chunk FROM sd)),
r AS (SELECT chunk, count(*) AS shared FROM edges WHERE entity IN (SELECT entity FROM en) AND chunk NOT IN (SELECT chunk FROM sd) GROUP BY 1 HAVING count(*) >= 2)
SELECT chunk, shared, row_number() OVER (ORDER BY shared DESC, chunk) AS rank FROM r QUALIFY rank <= 20""",
    "chunk_entities": f"WITH {_E}, {_C} SELECT id AS chunk, count(entity) AS n_entities FROM ch LEFT JOIN edges ON id = chunk GROUP BY 1",
    "chunks_for_entities": f"WITH {_E}, t AS (SELECT {_sq('name')} AS entity FROM (SELECT name FROM entities ORDER BY mention_count DESC NULLS LAST, name LIMIT 3)) SELECT chunk, count(*) AS n FROM edges JOIN t USING (entity) GROUP BY 1 ORDER BY n DESC, chunk LIMIT 50",
    "graph_stats": f"WITH {_E} SELECT count(*) AS n_edges, count(DISTINCT entity) AS n_entities, count(DISTINCT chunk) AS n_chunks FROM edges",
    "top_entities": "SELECT name, entity_type, mention_count FROM entities ORDER BY mention_count DESC NULLS LAST, name LIMIT 10",
    "related_topics": f"SELECT name, mention_count FROM entities WHERE {' OR '.join(f'contains(name, {t!r})' for t in TOPICS)} ORDER BY mention_count DESC NULLS LAST, name LIMIT 20",
    "mention_drift": f"WITH {_E}, r AS (SELECT entity, count(*) AS n FROM edges GROUP BY 1) SELECT name, mention_count, coalesce(n, 0) AS n_chunks FROM entities LEFT JOIN r ON name = entity WHERE mention_count IS DISTINCT FROM coalesce(n, 0)",
    "entities_without_record": f"WITH {_E} SELECT DISTINCT entity FROM edges WHERE entity NOT IN (SELECT {_sq('name')} FROM entities WHERE name IS NOT NULL)",
    "import_degrees": f"WITH {_D} SELECT * FROM dg",
    "import_hubs": f"WITH {_D} SELECT node, out_degree FROM dg WHERE out_degree > 1 ORDER BY out_degree DESC, node LIMIT 10",
    "import_expand": f"WITH {_I}, sd AS (SELECT DISTINCT source FROM im ORDER BY 1 LIMIT 20) SELECT DISTINCT target AS node FROM im WHERE source IN (SELECT source FROM sd) AND target NOT IN (SELECT source FROM sd)",
    "same_file_references": f"""WITH {_Y}, w AS (SELECT id, raw_file_id, i - 1 AS place, regexp_extract(refs[i], '([^.]*)$', 1) AS last FROM (SELECT *, unnest(range(1, len(refs) + 1)) AS i FROM sy)),
m AS (SELECT w.id, t.id AS target, min(place) AS place FROM w JOIN sy t ON t.raw_file_id = w.raw_file_id AND t.name = w.last AND t.id <> w.id GROUP BY ALL)
SELECT id, target, row_number() OVER (PARTITION BY id ORDER BY place, target) AS pos FROM m QUALIFY pos <= 3""",
    "class_context": rf"WITH {_Y} SELECT m.id, min(c.id) AS class_id FROM sy m JOIN sy c ON m.raw_file_id = c.raw_file_id AND c.kind = 'class' AND c.qualified_name = regexp_extract(m.qualified_name, '^(.*)\.[^.]*$', 1) WHERE m.kind = 'method' GROUP BY 1",
    "symbol_name_search": f"WITH {_Y} SELECT id, name FROM sy WHERE name ILIKE '%ledger%' OR qualified_name ILIKE '%ledger%'",
    "structural_manifest": f"WITH {_Y}, {_F} SELECT fi.path, count(*) AS n, string_agg(coalesce(sy.name, ''), ',' ORDER BY coalesce(start_line, 0), sy.id) AS names FROM sy JOIN fi ON sy.raw_file_id = fi.id GROUP BY 1",
    "section_children": f"WITH {_N} SELECT parent, string_agg(id, ',' ORDER BY coalesce(pos, 0), id) AS children FROM sn WHERE parent IS NOT NULL GROUP BY 1",
    "section_siblings": f"WITH {_N}, f AS (SELECT id, coalesce(parent, 'file:' || coalesce(raw_file_id, '')) AS family FROM sn) SELECT id, count(*) OVER (PARTITION BY family) AS n FROM f",
    "parent_titles": f"WITH {_N} SELECT a.id, concat_ws(' > ', b.title, a.title) AS location FROM sn a LEFT JOIN sn b ON a.parent = b.k",
    "breadcrumb": f"""WITH RECURSIVE {_N}, w(id, next, path, n) AS (SELECT k, parent, coalesce(title, ''), 0 FROM sn
  UNION ALL SELECT w.id, s.parent, coalesce(s.title, '') || ' > ' || w.path, n + 1 FROM w JOIN sn s ON w.next = s.k WHERE n < 5)
SELECT id, arg_max(path, n) AS path FROM w GROUP BY id""",
    "keyword_overlap": f"WITH {_S} SELECT id FROM se WHERE list_has_any(list_transform(keywords, lambda k: lower(k)), {TOPICS})",
    "keyword_vocabulary": f"WITH {_S}, {_Y}, k AS (SELECT unnest(keywords) AS k FROM se UNION ALL SELECT unnest(keywords) FROM sy) SELECT lower(k) AS keyword, count(*) AS n, string_agg(DISTINCT k, ',' ORDER BY k) AS spellings FROM k WHERE k IS NOT NULL GROUP BY 1",
    "symbol_entities": f"WITH {_Y}, e AS (SELECT unnest(entities) AS e FROM sy) SELECT {_sq('e.name')} AS entity, coalesce(e.type, 'unknown') AS type, count(*) AS n FROM e WHERE e.name IS NOT NULL GROUP BY ALL",
    "metadata_flag": f"WITH {_S} SELECT metadata->>'$.parser' AS parser, count(*) AS n FROM se GROUP BY 1",
    "payload_documents": f"WITH {_C} SELECT payload->>'$.doc_id' AS doc_id, count(*) AS n, max((payload->>'$.chunk_index')::INT) AS last, sum(length(payload->>'$.content'))::BIGINT AS n_chars FROM ch GROUP BY 1",
}
