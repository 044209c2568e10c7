"""Queries of vocabulary, evidence and code extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import vocabulary as v
from tesserae.plans.retrieval import TEXTS
from tesserae.sources import code
from tesserae.tables import bare, current_table, table

SYNONYMS = {"audit": "review", "harvest": "yield", "invoice": "bill", "panel": "board", "ratio": "share"}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vocabulary_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.detect(_documents(spark, sf_dir), "doc_id", "text")


def vocabulary_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = current_table(spark, sf_dir, "section_index", "keywords").select(F.explode("keywords").alias("keyword")).where("keyword is not null").distinct()
    return words.select("keyword", F.array_join(v.variations(F.col("keyword")), "|").alias("forms"))


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(v.contains_all(F.col("text"), ["Fell-from", "the_ratio"])).select("doc_id")


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(list(TEXTS.items()), "qid int, text string")
    return v.expand(texts, "text", SYNONYMS).select("qid", "pos", "variant")


def info_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("text is not null").select(F.explode(v.families(F.col("text"))).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = table(spark, sf_dir, "languages").select(bare("file_type").alias("suffix"), "language")
    rows = current_table(spark, sf_dir, "raw_files", "path", "content").withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))).join(languages, "suffix")
    return code.extract(rows, F.col("id"), F.col("language"), F.col("content"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select(F.col("key").alias("raw_file_id"), "language", F.explode("symbols").alias("s")).select("raw_file_id", "language", "s.*")


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select(F.explode("imports").alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n_files"))


def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).where("language in ('json', 'toml')").select(F.col("key").alias("raw_file_id"), F.posexplode("keys").alias("pos", "name"))


def kmeans_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight groups of the embeddings by k-means with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=42, maxIter=10).fit(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("group"))


QUERIES = {f.__name__: f for f in (vocabulary_detect, vocabulary_variations, keyword_filter, query_expansion, info_families, code_symbols, code_imports, config_keys, kmeans_groups)}

_HITS = " UNION ALL ".join(f"SELECT '{c}' AS category, {least} AS least, doc_id, unnest(regexp_extract_all(text, '{p}')) AS k FROM documents" for c, p, least in v.PATTERNS)
_NORM = r"trim(regexp_replace(lower({}), '[\s\x0b_-]+', ' ', 'g'))"
SQL = {
    "vocabulary_detect": f"WITH h AS ({_HITS}) SELECT category, lower(k) AS keyword, count(*) AS n, count(DISTINCT doc_id) AS n_sources, min(doc_id) AS first_source FROM h GROUP BY category, least, lower(k) HAVING count(*) >= least",
    "keyword_filter": f"SELECT doc_id FROM documents WHERE contains({_NORM.format('text')}, 'fell from') AND contains({_NORM.format('text')}, 'the ratio')",
    "query_expansion": f"""WITH q(qid, text) AS (VALUES {", ".join(f"({q}, '{t}')" for q, t in TEXTS.items())}), s(w, y) AS (VALUES {", ".join(f"('{w}', '{y}')" for w, y in SYNONYMS.items())}),
e AS (SELECT qid, w, regexp_replace(text, '(?i)\\b' || w || '\\b', y, 'g') AS variant FROM q JOIN s ON regexp_matches(lower(text), '\\b' || w || '\\b'))
SELECT qid, 0 AS pos, text AS variant FROM q UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY w)::INT, variant FROM e""".replace("\\\\", "\\"),
    "info_families": " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '{p}') HAVING count(*) > 0" for f, p in v.FAMILIES),
}
