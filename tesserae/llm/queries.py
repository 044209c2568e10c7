"""Queries and SQL of the training-data problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.mixing import mix_sources
from tesserae.llm.near import NearDuplicates, near_duplicates
from tesserae.llm.spans import SharedSpans, shared_spans
from tesserae.llm.splitting import split_items
from tesserae.llm.syntax import FREE, check_files
from tesserae.llm.tokens import count_tokens, encode_texts
from tesserae.llm.vectors import similar_vectors
from tesserae.session import Scratch
from tesserae.tables import VERSION_COLUMN, bare, current, current_table, table

#: Fixed values of the problem statement: limit and overlap in characters, by kind.
SPLIT = {"file": ("raw_files", 5000, 200), "section": ("section_index", 1200, 120)}


def _split(spark: SparkSession, sf_dir: str, long_only: bool) -> DataFrame:
    parts = []
    for kind, (name, limit, overlap) in SPLIT.items():
        items = current_table(spark, sf_dir, name, "content")
        if long_only:  # the current row is chosen first; only its content, if over the limit, goes through the shuffle
            slim = table(spark, sf_dir, name).select("id", F.when(F.length("content") > limit, F.col("content")).alias("content"), VERSION_COLUMN[name])
            items = current(slim, VERSION_COLUMN[name]).where("content is not null")
        parts.append(split_items(items, F.col("id"), F.col("content"), limit, overlap).select(F.lit(kind).alias("kind"), F.col("key").alias("id"), "n_chars", "cut_at", "pieces"))
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, True).select("kind", "id", "cut_at")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _split(spark, sf_dir, True).select("kind", "id", F.posexplode("pieces").alias("piece", "p"))
    return pieces.select("kind", "id", "piece", "p.start", "p.cut", "p.overlap", "p.text")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every item over the limit: the digest of its pieces joined without their overlaps, which is that of its content,
    whether all pieces are within the limit, and whether all but the last are followed by their overlap."""
    pieces = p5_pieces(spark, sf_dir)
    limit = F.when(F.col("kind") == "file", SPLIT["file"][1]).otherwise(SPLIT["section"][1])
    own = F.struct("piece", F.expr("substring(text, overlap + 1)").alias("t"))
    rows = pieces.groupBy("kind", "id").agg(F.array_sort(F.collect_list(own)).alias("p"), (F.max(F.length("text") - limit) <= 0).alias("within"), (F.count_if(F.col("cut") == "end") == 1).alias("one_end"))
    return rows.select("kind", "id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "").cast("binary")).alias("digest"), "within", "one_end")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current files with language, repository and what the parse says. Contents that need no parse don't travel."""
    files = table(spark, sf_dir, "raw_files")
    named = F.regexp_replace(bare("file_type"), r"^\.?(?=.)", ".")
    by_path = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kind = F.coalesce(F.nullif(named, F.lit("")), by_path)
    languages = table(spark, sf_dir, "languages").select(bare("file_type").alias("kind"), "language").distinct()
    version = VERSION_COLUMN["raw_files"]
    typed = files.select("id", "path", "content", version, kind.alias("kind")).join(languages, "kind", "left")
    slim = typed.select("id", "language", F.when(F.col("language").isin(*FREE) & F.col("content").isNotNull(), "").otherwise(F.col("content")).alias("content"), F.split("path", "/")[0].alias("repository"), version)
    return check_files(current(slim, version), F.col("id"), F.col("language"), F.col("content"), F.col("repository"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where("valid = false").select(F.col("key").alias("id"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).withColumnRenamed("key", "id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _checked(spark, sf_dir).where("valid is not null")
    rates = judged.groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return rates.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def p3_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files the rates count, by repository and language, and whether each rate is that of its counts."""
    rates = p3_rates(spark, sf_dir)
    sound = (F.col("n_invalid") <= F.col("n_files")) & (F.abs(F.col("rate") * F.col("n_files") - F.col("n_invalid")) < 0.01)
    return rates.select("repository", "language", "n_files", sound.alias("sound"))


#: The vector column of each kind's table.
VECTORS = {"chunk": ("chunks", "vector"), "section": ("section_index", "summary_vector"), "symbol": ("symbol_index", "summary_vector")}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [current_table(spark, sf_dir, name, column).select(F.lit(kind).alias("kind"), "id", F.col(column).alias("vector")) for kind, (name, column) in VECTORS.items()]
    found = similar_vectors(reduce(DataFrame.unionByName, parts), F.col("kind"), F.col("id"), F.col("vector"), k=10, floor=0.85, dims=64)
    return found.select("kind", "id", "neighbor_id")


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    files = current_table(spark, sf_dir, "raw_files", "content").withColumn("kind", F.lit("file"))
    sections = current_table(spark, sf_dir, "section_index", "content").withColumn("kind", F.lit("section"))
    return near_duplicates(files.unionByName(sections), F.col("kind"), F.col("id"), F.col("content"), 0.7, 3)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs().select("kind", "id_a", "id_b")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).classes()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encode_texts(documents, F.col("doc_id"), F.col("text")).select(F.col("key").alias("doc_id"), "ids")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = count_tokens(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), F.col("source"))
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", bare("source"))
    return mix_sources(counted, F.col("key"), bare("source"), F.col("n_tokens"), targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mix and source, whether the selection keeps to the caps, to the source's own documents, and adds up to the
    report, and whether the tokens are within one document of the target unless the source is short of them."""
    selection, shares = _mix(spark, sf_dir)
    selection = Scratch(spark, "mix").put(selection, "selection")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), bare("source").alias("own"))
    caps = table(spark, sf_dir, "mix_targets").select("mix", bare("source").alias("source"), "max_repeats")
    kept = selection.join(documents, "doc", "left").join(caps, ["mix", "source"], "left")
    good = kept.groupBy("mix", "source").agg(F.every((F.col("copies") >= 1) & (F.col("copies") <= F.col("max_repeats"))).alias("capped"), F.every(F.col("own").eqNullSafe(F.col("source"))).alias("own"), F.sum(F.col("copies") * F.col("n_tokens")).alias("sum"), F.max("n_tokens").alias("longest"))
    both = shares.select("mix", "source", "tokens", "target_tokens", F.col("capped").alias("short")).join(good, ["mix", "source"], "left")
    near = F.col("short") | (F.abs(F.col("tokens") - F.col("target_tokens")) <= F.coalesce("longest", F.lit(0)))
    return both.select("mix", "source", F.coalesce("capped", F.lit(True)).alias("within_caps"), F.coalesce("own", F.lit(True)).alias("own_documents"), (F.coalesce("sum", F.lit(0)) == F.col("tokens")).alias("adds_up"), near.alias("near_target"))


def _spans(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return shared_spans(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), 200)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).pairs()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).spans().select(F.col("doc").alias("doc_id"), "start", "length")


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, also the null and short ones: its length, how many of its characters are in shared spans,
    and their share (0 for no characters)."""
    shared = _spans(spark, sf_dir).spans().groupBy("doc").agg(F.sum("length").alias("shared"))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    rows = documents.join(shared, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "n_chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"))
    return rows.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))


def _cut_sql(kind: str, name: str, version: str, limit: int) -> str:
    def fits(run: str) -> str:
        return f"list_max(list_transform(string_split_regex(content, '{run}'), lambda x: length(x))) <= {limit}"

    return f"""SELECT '{kind}' AS kind, id,
  CASE WHEN {fits(r'(?:\r?\n){2,}')} THEN 'paragraph' WHEN {fits(r'\r?\n')} THEN 'line'
       WHEN {fits(r'[ \t\r\n]+')} THEN 'word' ELSE 'char' END AS cut_at
FROM (SELECT id, content FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {version} DESC) = 1)
WHERE length(content) > {limit}"""


_NEAR = """WITH items AS (
  SELECT 'file' AS kind, id, content FROM raw_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1
  UNION ALL SELECT 'section', id, content FROM section_index QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),
w AS (SELECT kind, id, list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)) AS w FROM items),
grams AS (SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
sizes AS (SELECT kind, id, count(*) AS n FROM grams GROUP BY ALL),
rare AS (SELECT kind, g FROM grams GROUP BY ALL HAVING count(*) > 1),
kept AS (SELECT kind, id, g FROM grams JOIN rare USING (kind, g)),
able AS (SELECT kind, id, count(*) AS m FROM kept GROUP BY ALL),
alive AS (SELECT k.kind, k.id, k.g, s.n FROM kept k JOIN able USING (kind, id) JOIN sizes s USING (kind, id) WHERE m >= 0.7 * n - 1e-9),
common AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, count(*) AS c
  FROM alive a JOIN alive b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id
    AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL)"""
_NEAR_SQL = f"""{_NEAR}
SELECT kind, id_a, id_b FROM common WHERE c >= 0.7 * (n_a + n_b - c) - 1e-9"""
_CLASSES_SQL = f"""{_NEAR}, met AS (SELECT kind, id_a AS id, id_b AS other, c = n_a AND c = n_b AS same FROM common WHERE c >= 0.7 * (n_a + n_b - c) - 1e-9
  UNION ALL SELECT kind, id_b, id_a, c = n_a AND c = n_b FROM common WHERE c >= 0.7 * (n_a + n_b - c) - 1e-9),
named AS (SELECT s.kind, s.id, least(s.id, min(other) FILTER (WHERE same)) AS class_id FROM sizes s LEFT JOIN met b ON s.kind = b.kind AND s.id = b.id GROUP BY s.kind, s.id)
SELECT n.kind, n.id, n.class_id, count(DISTINCT o.class_id) FILTER (WHERE o.class_id <> n.class_id) AS n_links
FROM named n LEFT JOIN met b ON n.kind = b.kind AND n.id = b.id LEFT JOIN named o ON o.kind = b.kind AND o.id = b.other GROUP BY ALL"""

#: Every run of 200 characters that two documents have, with its places.
_RUNS_SQL = """WITH texts AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE length(text) >= 200 GROUP BY doc_id),
windows AS (SELECT doc_id, i, substr(text, i, 200) AS run FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM texts)),
common AS (SELECT run FROM windows GROUP BY run HAVING min(doc_id) < max(doc_id)),
places AS (SELECT doc_id, i, run FROM windows JOIN common USING (run))"""

_PAIRS_SQL = f"""{_RUNS_SQL}, held AS (SELECT DISTINCT run, doc_id FROM places)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.run = b.run AND a.doc_id < b.doc_id"""

_SPANS_SQL = f"""{_RUNS_SQL},
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS opens FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
islands AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked)
SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + 200 AS length FROM islands GROUP BY doc_id, island"""

_COVERAGE_SQL = f"""WITH spans AS ({_SPANS_SQL}), shared AS (SELECT doc_id, sum(length) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(n, 0) AS shared_chars,
  CASE WHEN length(d.text) > 0 THEN round(coalesce(n, 0) / length(d.text), 6) ELSE 0 END AS share
FROM documents d LEFT JOIN shared s ON d.doc_id = s.doc_id"""

_VECTORS_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, id, {column} AS v FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1" for kind, (name, column) in VECTORS.items())
#: All pairs: for small tables only, where the index is expected to lose nothing.
_SIMILAR_SQL = f"""WITH r AS (SELECT kind, id, v::DOUBLE[] AS v FROM ({_VECTORS_SQL}) WHERE len(v) = 64), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM r),
u AS (SELECT kind, id, list_transform(v, lambda x: x / n) AS v FROM n WHERE isfinite(n) AND n > 0 AND list_count(v) = 64),
p AS (SELECT a.kind, a.id, b.id AS neighbor_id, round(list_dot_product(a.v, b.v), 12) AS c FROM u a JOIN u b ON a.kind = b.kind AND a.id <> b.id WHERE c >= 0.85)
SELECT kind, id, neighbor_id FROM p QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY c DESC, neighbor_id) <= 10"""
_REBUILT_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, id, md5(content) AS digest, true AS within, true AS one_end FROM (SELECT id, content FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {VERSION_COLUMN[name]} DESC) = 1) WHERE length(content) > {limit}"
    for kind, (name, limit, _) in SPLIT.items()
)
_JUDGED_SQL = """WITH f AS (SELECT path, content, coalesce(nullif(regexp_replace(lower(trim(file_type)), '^[.]?(.)', '.\\1'), ''), lower(regexp_extract(path, '([.][^./]*)$', 1))) AS t
  FROM raw_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)
SELECT string_split(path, '/')[1] AS repository, language, count(*) AS n_files, true AS sound FROM f JOIN languages l ON l.file_type = f.t WHERE content IS NOT NULL GROUP BY ALL"""
_KEPT_SQL = "SELECT mix, lower(trim(source)) AS source, true AS within_caps, true AS own_documents, true AS adds_up, true AS near_target FROM mix_targets"

QUERIES = {"p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates, "p3_judged": p3_judged, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt, "p6_found": p6_found, "p6_classes": p6_classes, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_found": p9_found, "p9_spans": p9_spans, "p9_coverage": p9_coverage}
SQL = {"p3_judged": _JUDGED_SQL, "p4_found": _SIMILAR_SQL, "p5_rebuilt": _REBUILT_SQL, "p6_classes": _CLASSES_SQL, "p8_kept": _KEPT_SQL, "p5_found": _cut_sql("file", "raw_files", "updated_at", 5000) + " UNION ALL " + _cut_sql("section", "section_index", "created_at", 1200), "p6_found": _NEAR_SQL, "p9_found": _PAIRS_SQL, "p9_spans": _SPANS_SQL, "p9_coverage": _COVERAGE_SQL}
