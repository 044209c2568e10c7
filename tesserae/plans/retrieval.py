"""Retrieval queries over the tables of sections, symbols, files and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import STOPWORDS, jaccard, normalize, tokens, words
from tesserae.operators import evidence, search
from tesserae.tables import current_table, table

#: The stated query set of the lexical and fused searches.
TEXTS = {1: "lantern harvest", 2: "girder ledger audit", 3: "sparse rotor", 4: "conveyor gateway schema", 5: "silent turbine", 6: "invoice ratio panel"}
PHRASES = {1: "the ratio of", 2: "do not move the", 3: "may reach the"}


def _texts(spark: SparkSession, texts: dict[int, str] = TEXTS) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "qid int, text string")


def _sections(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "section_index", "content", *columns).withColumnRenamed("content", "text")


def _vectors(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "section_index", "summary_vector", *columns).withColumnRenamed("summary_vector", "vector")


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector for each stated text: those of the embeddings whose id is a hundred times the text's."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin([100 * q for q in TEXTS])).select((F.col("vec_id") / 100).cast("int").alias("qid"), F.col("embedding").alias("vector"))


def _hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.knn(data, _hundredths(spark, sf_dir), 5)


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").where("label >= 5").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.knn(data, _hundredths(spark, sf_dir), 3)


def knn_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10, floor=0.3)


def centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label by the cosine to the label's mean vector."""
    rows = table(spark, sf_dir, "embeddings")
    mean = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centers = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    best = search.nearest(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), centers.select(F.col("label").alias("id"), "vector"))
    return best.select(F.col("id").alias("vec_id"), F.col("center").alias("label"), "score")


def concept_max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stated query vector and label the highest cosine to a vector of the label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("embedding").alias("vector"))
    return search.best_by_group(rows, _hundredths(spark, sf_dir)).withColumnRenamed("group", "label")


def lexical_tf_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_saturated(_sections(spark, sf_dir), _texts(spark), 50)


def lexical_bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_sections(spark, sf_dir), _texts(spark), 20)


def lexical_bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_sections(spark, sf_dir), _texts(spark), 20, all_terms=True)


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_search(_sections(spark, sf_dir), _texts(spark, PHRASES))


def websearch_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.web_search(_sections(spark, sf_dir), ["ratio"], ["lantern", "girder", "rotor", "turbine"], ["invoice", "tenant"], "fell from")


def _lists(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    return search.bm25(_sections(spark, sf_dir), _texts(spark), k), search.knn(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), k)


def hybrid_rrf_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, dense = _lists(spark, sf_dir, 40)
    return search.rrf([(lexical, 0.6), (dense, 0.4)], 20, rank_base=0)


def hybrid_rrf_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, dense = _lists(spark, sf_dir, 40)
    return search.rrf_outer(dense, lexical, 0.7, 20)


def hybrid_score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, dense = _lists(spark, sf_dir, 40)
    titles = current_table(spark, sf_dir, "section_index", "title").withColumnRenamed("title", "text")
    return search.score_fusion(search.lexical_saturated(titles, _texts(spark), 20), lexical, dense, 20)


def hyde_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = search.knn(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10)
    other = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin([100 * q + 1 for q in TEXTS])).select(((F.col("vec_id") - 1) / 100).cast("int").alias("qid"), F.col("embedding").alias("vector"))
    return search.merge_extra(first, search.knn(_vectors(spark, sf_dir), other, 10)).select("qid", "id", "score", "origin")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = current_table(spark, sf_dir, "section_index", "raw_file_id", "title", "keywords", "parent_section_id")
    return hybrid_rrf_union(spark, sf_dir).join(facts, "id")


def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.1 for hits one of whose keywords shares a token with the query, ranked again."""
    fused = _fused(spark, sf_dir).join(F.broadcast(_texts(spark).select("qid", tokens(F.col("text")).alias("terms"))), "qid")
    own = F.flatten(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: tokens(k)))
    return search.boost(fused, F.when(F.arrays_overlap(own, F.col("terms")), 0.1).otherwise(0.0)).select("qid", "id", "score", "rank")


def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current_table(spark, sf_dir, "raw_files", "updated_at").select(F.col("id").alias("raw_file_id"), "updated_at")
    return search.recency_boost(_fused(spark, sf_dir).join(files, "raw_file_id", "left"), "raw_file_id", "updated_at").select("qid", "id", "score", "rank")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_wins(_fused(spark, sf_dir), "raw_file_id", "title").select("qid", "id", "rank")


def file_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.diversify(_fused(spark, sf_dir), "raw_file_id", 1).select("qid", "id", "rank")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sections(spark, sf_dir).select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return search.budget(hybrid_rrf_union(spark, sf_dir).join(texts, "id"), F.col("n_chars"), 6000).select("qid", "id", "rank", "running")


def retrieve_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists, fused, keyword boost, first of equal titles in a file, at most two of a file first, with the
    parent's title."""
    fused = _fused(spark, sf_dir).join(F.broadcast(_texts(spark).select("qid", tokens(F.col("text")).alias("terms"))), "qid")
    own = F.flatten(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: tokens(k)))
    boosted = search.boost(fused, F.when(F.arrays_overlap(own, F.col("terms")), 0.1).otherwise(0.0))
    spread = search.diversify(search.first_wins(boosted, "raw_file_id", "title"), "raw_file_id", 2).where("rank <= 10")
    parents = current_table(spark, sf_dir, "section_index", "title").select(F.col("id").alias("p"), F.col("title").alias("parent_title"))
    named = spread.join(parents, F.col("parent_section_id") == F.col("p"), "left")
    return named.select("qid", "rank", "id", "score", F.concat_ws(" > ", "parent_title", "title").alias("location"))


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search quality of the embeddings against their own labels: a hit has the query's label."""
    rows = table(spark, sf_dir, "embeddings")
    labels = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    relevant = labels.join(rows.select("label", F.col("vec_id").alias("id")), "label").where("id <> qid").select("qid", "id")
    run = knn_run(spark, sf_dir)
    return search.ir_metrics(run, relevant, 10)


def knn_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search.knn(data, _hundredths(spark, sf_dir), 11).where("id <> qid").drop("rank")
    return search.ranked(found, "score", "qid", k=10)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.knn(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10, floor=0.3)
    texts = _sections(spark, sf_dir, "raw_file_id")
    return evidence.features(hits.join(texts.select("id", F.col("raw_file_id").alias("source")), "id"), texts.select("id", "text"), _texts(spark))


def evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


def insufficient_evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sufficiency(_evidence(spark, sf_dir))


def title_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = current_table(spark, sf_dir, "section_index", "title").select(normalize(F.col("title")).alias("title"))
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def summary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the word sets of each section's title and summary."""
    rows = current_table(spark, sf_dir, "section_index", "title", "summary").where("summary is not null")
    return rows.select("id", F.round(jaccard(words(F.col("title")), words(F.col("summary"))), 6).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_batch, knn_filtered, knn_floor, centroid_assign, concept_max_similarity, lexical_tf_saturation, lexical_bm25_or, lexical_bm25_and, phrase_search, websearch_bool, hybrid_rrf_union,
        hybrid_rrf_outer, hybrid_score_fusion, hyde_merge, keyword_boost, recency_boost, dedup_first_wins, file_diversity, context_budget, retrieve_end_to_end, ir_metrics, evidence_features, insufficient_evidence_rules, title_normalization, summary_overlap,
    )
}

# SQL ------------------------------------------------------------------------------------------------------------------
_TOKENS = r"""list_filter(list_transform(string_split_regex(lower({}), '[\s/._\-:;,(){{}}\[\]]+'), lambda t: regexp_replace(t, '[?!"'']+$', '')), lambda t: length(t) > 1)"""
_VALUES = ", ".join(f"({q}, '{t}')" for q, t in TEXTS.items())
_CUR = "cur AS (SELECT * FROM section_index QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)"
_LEX = f"""{_CUR}, q AS (SELECT qid, unnest({_TOKENS.format('text')}) AS term FROM (VALUES {_VALUES}) v(qid, text)),
qt AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL),
docs AS (SELECT id, {_TOKENS.format('content')} AS t FROM cur WHERE content IS NOT NULL),
m AS (SELECT qid, id, term, qf, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS n FROM docs JOIN qt ON list_contains(t, term)),
df AS (SELECT qid, term, count(*) AS df FROM m GROUP BY ALL), st AS (SELECT count(*) AS nd, avg(len(t)) AS av FROM docs),
bm AS (SELECT qid, id, round(sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * qf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av))), 6) AS score, count(*) AS n_terms
  FROM m JOIN df USING (qid, term), st GROUP BY qid, id)"""
_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"
_USABLE = "len({v}) = 64 AND list_sum(list_transform({v}, lambda x: abs(x)::DOUBLE)) > 0 AND NOT isnan(list_sum({v}::DOUBLE[])) AND list_count({v}) = 64"
_RANKED = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"


def _dense(k: int, shift: int = 0, name: str = "dn", extra: str = "") -> str:
    ids = ", ".join(str(100 * q + shift) for q in TEXTS)
    return f"""{name} AS (SELECT qid, id, score, {_RANKED} AS rank FROM (
  SELECT ((e.vec_id - {shift}) // 100)::INT AS qid, c.id, {_COS.format(a='c.summary_vector', b='e.embedding')} AS score
  FROM (SELECT id, summary_vector FROM cur WHERE {_USABLE.format(v='summary_vector')}) c, (SELECT * FROM embeddings WHERE vec_id IN ({ids})) e){extra} QUALIFY {_RANKED} <= {k})"""


_LISTS = f"{_LEX}, {_dense(40)}, lx AS (SELECT qid, id, score, {_RANKED} AS rank FROM bm QUALIFY {_RANKED} <= 40)"
_RRF = f"""{_LISTS}, fu AS (SELECT qid, id, round(sum(s), 9) AS score FROM (SELECT qid, id, 0.6::DOUBLE / (59 + rank) AS s FROM lx UNION ALL SELECT qid, id, 0.4::DOUBLE / (59 + rank) FROM dn) GROUP BY ALL),
rrf AS (SELECT qid, id, score, {_RANKED} AS rank FROM fu QUALIFY {_RANKED} <= 20)"""
_FACTS = f"{_RRF}, f AS (SELECT rrf.*, raw_file_id, title, keywords, parent_section_id FROM rrf JOIN cur USING (id))"
_KEYED = f"""{_FACTS}, kb AS (SELECT * EXCLUDE (base), row_number() OVER (PARTITION BY qid ORDER BY score DESC, base) AS rank FROM (
  SELECT f.* EXCLUDE (score, rank), rank AS base, round(score + CASE WHEN list_has_any(flatten(list_transform(coalesce(keywords, []), lambda k: {_TOKENS.format('k')})), terms) THEN 0.1 ELSE 0 END, 9) AS score
  FROM f JOIN (SELECT qid, list(term) AS terms FROM qt GROUP BY qid) USING (qid)))"""
_EMB = f"SELECT q.vec_id AS qid, e.vec_id AS id, {_COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"

_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z]{{{{3,}}}}'), lambda x: NOT list_contains({list(STOPWORDS)}, x)))"
_EVIDENCE = f"""{_CUR}, {_dense(10, extra=' WHERE score >= 0.3')}, qw AS (SELECT qid, {_WORDS.format('text')} AS w FROM (VALUES {_VALUES}) v(qid, text)),
h AS (SELECT dn.*, raw_file_id, list_intersect(w, {_WORDS.format('content')}) AS met FROM dn JOIN cur USING (id) JOIN qw USING (qid)),
st AS (SELECT qid, count(*) AS n, count(DISTINCT raw_file_id) AS n_sources, max(score) AS high, round(avg(score), 6) AS mean, min(score) AS low, round(stddev_pop(score), 6) AS deviation, len(list_distinct(flatten(list(met)))) AS m FROM h GROUP BY qid),
ev AS (SELECT qid, coalesce(n, 0) AS n, coalesce(n_sources, 0) AS n_sources, high, mean, low, deviation, round(high - low, 6) AS spread, round(coalesce(m, 0)::DOUBLE / len(w), 6) AS overlap FROM qw LEFT JOIN st USING (qid))"""

SQL = {
    "knn_batch": f"SELECT qid, id, score, {_RANKED} AS rank FROM ({_EMB}) QUALIFY {_RANKED} <= 5",
    "knn_filtered": f"SELECT qid, id, score, {_RANKED} AS rank FROM ({_EMB} WHERE e.label >= 5) QUALIFY {_RANKED} <= 3",
    "knn_floor": f"WITH {_CUR}, {_dense(10, extra=' WHERE score >= 0.3')} SELECT * FROM dn",
    "centroid_assign": f"""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)
SELECT vec_id, label, score FROM (SELECT e.vec_id, c.label, {_COS.format(a='e.embedding', b='c.v')} AS score FROM embeddings e, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""",
    "concept_max_similarity": f"SELECT q.vec_id AS qid, e.label, max({_COS.format(a='e.embedding', b='q.embedding')}) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q GROUP BY ALL",
    "lexical_tf_saturation": f"WITH {_LEX}, s AS (SELECT qid, id, round(sum(qf * tf / (tf + 1 + 0.5::DOUBLE * n / 100)), 9) AS score FROM m GROUP BY ALL) SELECT qid, id, score, {_RANKED} AS rank FROM s QUALIFY {_RANKED} <= 50",
    "lexical_bm25_or": f"WITH {_LEX} SELECT qid, id, score, {_RANKED} AS rank FROM bm QUALIFY {_RANKED} <= 20",
    "lexical_bm25_and": f"WITH {_LEX}, ok AS (SELECT bm.* FROM bm JOIN (SELECT qid, count(*) AS needed FROM qt GROUP BY qid) USING (qid) WHERE n_terms = needed) SELECT qid, id, score, {_RANKED} AS rank FROM ok QUALIFY {_RANKED} <= 20",
    "phrase_search": f"""WITH {_CUR}, d AS (SELECT id, {_TOKENS.format('content')} AS t FROM cur WHERE content IS NOT NULL),
p AS (SELECT qid, {_TOKENS.format('text')} AS w FROM (VALUES {", ".join(f"({q}, '{t}')" for q, t in PHRASES.items())}) v(qid, text))
SELECT qid, id, len(list_filter(range(1, len(t) - len(w) + 2), lambda i: t[i:i + len(w) - 1] = w))::INT AS n FROM d, p WHERE n > 0""",
    "websearch_bool": f"""WITH {_CUR}, d AS (SELECT id, {_TOKENS.format('content')} AS t FROM cur WHERE content IS NOT NULL) SELECT id FROM d WHERE list_contains(t, 'ratio') AND list_has_any(t, ['lantern', 'girder', 'rotor', 'turbine'])
  AND NOT list_has_any(t, ['invoice', 'tenant']) AND contains(' ' || array_to_string(t, ' ') || ' ', ' fell from ')""",
    "hybrid_rrf_union": f"WITH {_RRF} SELECT * FROM rrf",
    "hybrid_rrf_outer": f"""WITH {_LISTS}, b AS (SELECT qid, id, d.rank AS dense_rank, l.rank AS lexical_rank, round(coalesce(0.7::DOUBLE / (60 + d.rank), 0) + coalesce((1 - 0.7::DOUBLE) / (60 + l.rank), 0), 9) AS score FROM dn d FULL JOIN lx l USING (qid, id))
SELECT *, {_RANKED} AS rank FROM b QUALIFY {_RANKED} <= 20""",
    "hybrid_score_fusion": f"""WITH {_LISTS}, td AS (SELECT id, {_TOKENS.format('title')} AS t FROM cur WHERE title IS NOT NULL),
tm AS (SELECT qid, id, round(sum(qf * tf / (tf + 1 + 0.5::DOUBLE * n / 100)), 9) AS score FROM (SELECT qid, id, qf, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS n FROM td JOIN qt ON list_contains(t, term)) GROUP BY ALL),
nm AS (SELECT qid, id, {_RANKED} AS rank FROM tm QUALIFY {_RANKED} <= 20),
u AS (SELECT qid, id, 1::DOUBLE / rank AS n, 0::DOUBLE AS x, 0::DOUBLE AS d FROM nm UNION ALL SELECT qid, id, 0, score, 0 FROM lx UNION ALL SELECT qid, id, 0, 0, score FROM dn),
s AS (SELECT qid, id, sum(n) AS n, sum(x) AS x, sum(d) AS d FROM u GROUP BY ALL),
z AS (SELECT qid, id, round(CASE WHEN qid IN (SELECT qid FROM lx) THEN (0.4::DOUBLE * n + 0.3::DOUBLE * x + 0.6::DOUBLE * d) / (0.4::DOUBLE + 0.3::DOUBLE + 0.6::DOUBLE) ELSE 0.4::DOUBLE * n + 0.6::DOUBLE * d END, 9) AS score FROM s)
SELECT qid, id, score, {_RANKED} AS rank FROM z QUALIFY {_RANKED} <= 20""",
    "hyde_merge": f"""WITH {_CUR}, {_dense(10)}, {_dense(10, 1, 'dx')} SELECT qid, id, score, 0 AS origin FROM dn
UNION ALL SELECT qid, id, round(score * 0.5::DOUBLE, 9), 1 FROM dx WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.qid = dx.qid AND dn.id = dx.id)""",
    "keyword_boost": f"WITH {_KEYED} SELECT qid, id, score, rank FROM kb",
    "recency_boost": f"""WITH {_FACTS}, fr AS (SELECT id AS raw_file_id, updated_at FROM raw_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
w AS (SELECT f.*, updated_at FROM f LEFT JOIN fr USING (raw_file_id)), g AS (SELECT qid, raw_file_id, max(updated_at) AS upd FROM w GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY upd DESC NULLS LAST, raw_file_id) AS p, count(*) OVER (PARTITION BY qid) AS n FROM g),
b AS (SELECT qid, id, rank AS base, round(score + CASE WHEN p <= greatest(1, n // 4) THEN 0.1 WHEN p <= greatest(1, n // 2) THEN 0.05 ELSE 0 END, 9) AS score FROM w JOIN p USING (qid, raw_file_id))
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base) AS rank FROM b""",
    "dedup_first_wins": f"WITH {_FACTS} SELECT qid, id, rank FROM f QUALIFY row_number() OVER (PARTITION BY qid, raw_file_id, title ORDER BY rank) = 1",
    "file_diversity": f"WITH {_FACTS}, o AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid, raw_file_id ORDER BY rank) > 1 AS over FROM f) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY over, rank) AS rank FROM o",
    "context_budget": f"WITH {_RRF}, r AS (SELECT qid, id, rank, sum(coalesce(length(content), 0)) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS running FROM rrf JOIN cur USING (id)) SELECT * FROM r WHERE running <= 6000",
    "retrieve_end_to_end": f"""WITH {_KEYED}, fw AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY qid, raw_file_id, title ORDER BY rank) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, raw_file_id ORDER BY rank) > 2 AS over FROM fw), dv AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY over, rank) AS rank FROM o)
SELECT dv.qid, dv.rank, dv.id, dv.score, concat_ws(' > ', p.title, dv.title) AS location FROM dv LEFT JOIN cur p ON dv.parent_section_id = p.id WHERE dv.rank <= 10""",
    "ir_metrics": f"""WITH a AS (SELECT qid, id, score, {_RANKED} AS r0 FROM ({_EMB}) QUALIFY r0 <= 11), run AS (SELECT qid, id, {_RANKED} AS rank FROM a WHERE id <> qid QUALIFY {_RANKED} <= 10),
rel AS (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
h AS (SELECT run.*, CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END AS hit FROM run LEFT JOIN rel USING (qid, id)),
u AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS seen FROM h),
s AS (SELECT qid, sum(hit / log2(rank + 1)) AS dcg, sum(hit) AS found, sum(hit * seen::DOUBLE / rank) AS ps, min(CASE WHEN hit = 1 THEN rank END) AS first FROM u GROUP BY qid),
t AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid)
SELECT qid, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(found::DOUBLE / n, 0), 6) AS recall, round(coalesce(ps / least(n, 10), 0), 6) AS average_precision,
  round(coalesce(1::DOUBLE / first, 0), 6) AS reciprocal_rank, round(coalesce(found::DOUBLE / 10, 0), 6) AS precision FROM t LEFT JOIN s USING (qid)""",
    "evidence_features": f"WITH {_EVIDENCE} SELECT * FROM ev",
    "insufficient_evidence_rules": f"WITH {_EVIDENCE} SELECT qid, CASE WHEN n = 0 OR high < 0.45 THEN 'abstain' WHEN high < 0.7 AND overlap = 0 THEN 'qualified' ELSE 'sufficient' END AS verdict FROM ev",
    "title_normalization": rf"WITH {_CUR} SELECT trim(regexp_replace(lower(title), '[\s_-]+', ' ', 'g')) AS title, count(*) AS n FROM cur GROUP BY 1",
    "summary_overlap": f"""WITH {_CUR}, w AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: NOT list_contains({list(STOPWORDS)}, x))) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(summary), '[a-z]{{3,}}'), lambda x: NOT list_contains({list(STOPWORDS)}, x))) AS b FROM cur WHERE summary IS NOT NULL)
SELECT id, CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) WHEN a IS NULL OR b IS NULL THEN 0 ELSE 0 END AS similarity FROM w""",
}
