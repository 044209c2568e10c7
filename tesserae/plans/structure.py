"""Queries and SQL of the two general problems: heavy keys and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.heavy_keys import distinct_counts, distinct_sets
from tesserae.operators.hierarchy import cycle_descendants, descendants, hierarchy
from tesserae.session import Scratch
from tesserae.tables import bare, current_table, squeeze, table


def _entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_counts(table(spark, sf_dir, "entity_chunks"), squeeze("entity_name"), F.col("chunk_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Scratch(spark, "entities").put(_entity_counts(spark, sf_dir), "counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.where(F.col("n") * 100 >= F.lit(total)).select(F.col("key").alias("entity_name"))


def p1_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_counts(spark, sf_dir).select(F.col("key").alias("entity_name"), F.col("n").alias("n_chunks"))


def p1_entity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = distinct_sets(table(spark, sf_dir, "entity_chunks"), squeeze("entity_name"), F.col("chunk_id"))
    return sets.select(F.col("key").alias("entity_name"), "piece", F.col("first_value").alias("first_chunk_id"), "n", F.col("values").alias("chunk_ids"))


def _tree(spark: SparkSession, sf_dir: str, with_path: bool, *extra: str) -> DataFrame:
    sections = current_table(spark, sf_dir, "section_index", "parent_section_id", "level")
    return hierarchy(sections, bare("id"), bare("parent_section_id"), F.struct("id", "level"), with_path)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir, False)
    return tree.where(~F.col("depth").eqNullSafe(F.col("label.level"))).select(F.col("label.id").alias("id"), F.col("root").alias("root_id"), "depth")


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir, True)
    return tree.select(F.col("label.id").alias("id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every section, also of those on or below a cycle."""
    tree = _tree(spark, sf_dir, True)
    return descendants(tree).unionByName(cycle_descendants(tree))


#: A class of whitespace characters as RE2 writes it.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PAIRS = f"""pairs AS (
  SELECT DISTINCT lower(trim(regexp_replace(entity_name, '{_WS}', ' ', 'g'))) AS entity_name, chunk_id
  FROM entity_chunks WHERE chunk_id IS NOT NULL AND trim(regexp_replace(entity_name, '{_WS}', ' ', 'g')) <> '')"""
_TREE = f"""cur AS (
  SELECT lower(regexp_replace(id, '^{_WS}|{_WS}$', '', 'g')) AS k, id, level,
         nullif(lower(regexp_replace(parent_section_id, '^{_WS}|{_WS}$', '', 'g')), '') AS p
  FROM section_index QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),
links AS (SELECT c.k, c.id, c.level, q.k AS p FROM cur c LEFT JOIN cur q ON c.p = q.k),
down(k, root, depth, path) AS (
  SELECT k, k, 1, k FROM links WHERE p IS NULL
  UNION ALL SELECT l.k, d.root, d.depth + 1, d.path || '/' || l.k FROM down d JOIN links l ON l.p = d.k),
rest AS (SELECT k, p FROM links WHERE k NOT IN (SELECT k FROM down)),
up(k, a) AS (SELECT k, p FROM rest UNION SELECT u.k, r.p FROM up u JOIN rest r ON u.a = r.k),
ring AS (SELECT k FROM up WHERE k = a),
rooted AS (SELECT u.k, min(u.a) AS root FROM up u JOIN ring g ON u.a = g.k GROUP BY u.k),
tree AS (SELECT k, root, depth, path FROM down UNION ALL SELECT k, root, 0, '' FROM rooted)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_entity_counts": p1_entity_counts,
    "p1_entity_sets": p1_entity_sets,
    "p2_found": p2_found,
    "p2_hierarchy": p2_hierarchy,
    "p2_descendants": p2_descendants,
}
SQL = {
    "p1_found": f"WITH {_PAIRS} SELECT entity_name FROM pairs GROUP BY 1 HAVING count(*) * 100 >= (SELECT count(*) FROM pairs)",
    "p1_entity_counts": f"WITH {_PAIRS} SELECT entity_name, count(*) AS n_chunks FROM pairs GROUP BY 1",
    "p2_found": f"WITH RECURSIVE {_TREE} SELECT l.id, t.root AS root_id, t.depth FROM tree t JOIN links l USING (k) WHERE t.depth IS DISTINCT FROM l.level",
    "p2_hierarchy": f"WITH RECURSIVE {_TREE} SELECT l.id, t.root AS root_id, t.depth, t.path FROM tree t JOIN links l USING (k)",
    "p2_descendants": f"""WITH RECURSIVE {_TREE}, pairs(ancestor, descendant, distance) AS (
  SELECT p, k, 1 FROM links WHERE p IS NOT NULL AND k IN (SELECT k FROM down)
  UNION ALL SELECT l.p, d.descendant, d.distance + 1 FROM pairs d JOIN links l ON l.k = d.ancestor WHERE l.p IS NOT NULL)
SELECT ancestor, descendant, distance FROM pairs""",
}
