"""Search strategies by kind of unit, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import search
from tesserae.plans import retrieval as r
from tesserae.tables import current_table, table

#: Weights of the strategies in the union.
WEIGHTS = {"section": 1.0, "symbol": 0.02}


def _symbols(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_table(spark, sf_dir, "symbol_index", *columns)


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by name, by text that has all terms, and by vector, fused by score."""
    rows = _symbols(spark, sf_dir, "name", "qualified_name", "summary")
    names = search.lexical_saturated(rows.select("id", F.concat_ws(" ", "name", "qualified_name").alias("text")), r._texts(spark), 20)
    texts = search.bm25(rows.select("id", F.concat_ws(" ", "name", "qualified_name", "summary").alias("text")), r._texts(spark), 20, all_terms=True)
    dense = search.knn(_symbols(spark, sf_dir, "summary_vector").withColumnRenamed("summary_vector", "vector"), r._query_vectors(spark, sf_dir), 20)
    return search.score_fusion(names, texts, dense, 20)


def cross_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the section and the symbol strategy with their weights, at most two units of a file first, top 10."""
    sections = r.hybrid_rrf_union(spark, sf_dir).select("qid", "id", F.round(F.col("score") * WEIGHTS["section"], 9).alias("score"), F.lit("section").alias("kind"))
    symbols = code_search(spark, sf_dir).select("qid", "id", F.round(F.col("score") * WEIGHTS["symbol"], 9).alias("score"), F.lit("symbol").alias("kind"))
    files = current_table(spark, sf_dir, "section_index", "raw_file_id").withColumn("kind", F.lit("section")).unionByName(_symbols(spark, sf_dir, "raw_file_id").withColumn("kind", F.lit("symbol")))
    both = sections.unionByName(symbols).join(files, ["kind", "id"])
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "kind", "id")
    return search.diversify(both.withColumn("rank", F.row_number().over(w)), "raw_file_id", 2).where("rank <= 10").select("qid", "rank", "kind", "id", "score")


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of all terms of all documents: the inverted index's dictionary, counted before its shuffle."""
    from tesserae.functions.text import tokens

    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


QUERIES = {"code_search": code_search, "cross_strategy": cross_strategy, "term_statistics": term_statistics}


def _lexical(p: str, text: str) -> str:
    return f"""{p}d AS (SELECT id, {r._TOKENS.format(text)} AS t FROM sy), {p}m AS (SELECT qid, id, term, qf, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS n FROM {p}d JOIN qt ON list_contains(t, term)),
{p}f AS (SELECT qid, term, count(*) AS df FROM {p}m GROUP BY ALL), {p}s AS (SELECT count(*) AS nd, avg(len(t)) AS av FROM {p}d)"""


_ids = ", ".join(str(100 * q) for q in r.TEXTS)
_CODE = f"""sy AS (SELECT * FROM symbol_index QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),
{_lexical("ya", "concat_ws(' ', name, qualified_name)")}, {_lexical("yb", "concat_ws(' ', name, qualified_name, summary)")},
an AS (SELECT qid, id, round(sum(qf * tf / (tf + 1 + 0.5::DOUBLE * n / 100)), 9) AS score FROM yam GROUP BY ALL), ar AS (SELECT qid, id, {r._RANKED} AS rank FROM an QUALIFY {r._RANKED} <= 20),
bs0 AS (SELECT qid, id, round(sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * qf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av))), 6) AS score, count(*) AS n_terms FROM ybm JOIN ybf USING (qid, term), ybs GROUP BY qid, id),
bk AS (SELECT qid, id, score FROM bs0 JOIN (SELECT qid, count(*) AS needed FROM qt GROUP BY qid) USING (qid) WHERE n_terms = needed QUALIFY {r._RANKED} <= 20),
cd AS (SELECT qid, id, score FROM (SELECT (e.vec_id // 100)::INT AS qid, c.id, {r._COS.format(a='c.summary_vector', b='e.embedding')} AS score FROM (SELECT id, summary_vector FROM sy WHERE {r._USABLE.format(v='summary_vector')}) c, (SELECT * FROM embeddings WHERE vec_id IN ({_ids})) e) QUALIFY {r._RANKED} <= 20),
cu AS (SELECT qid, id, 1::DOUBLE / rank AS n, 0::DOUBLE AS x, 0::DOUBLE AS d FROM ar UNION ALL SELECT qid, id, 0, score, 0 FROM bk UNION ALL SELECT qid, id, 0, 0, score FROM cd),
cs AS (SELECT qid, id, sum(n) AS n, sum(x) AS x, sum(d) AS d FROM cu GROUP BY ALL),
cz AS (SELECT qid, id, round(CASE WHEN qid IN (SELECT qid FROM bk) THEN (0.4::DOUBLE * n + 0.3::DOUBLE * x + 0.6::DOUBLE * d) / (0.4::DOUBLE + 0.3::DOUBLE + 0.6::DOUBLE) ELSE 0.4::DOUBLE * n + 0.6::DOUBLE * d END, 9) AS score FROM cs),
code AS (SELECT qid, id, score, {r._RANKED} AS rank FROM cz QUALIFY {r._RANKED} <= 20)"""
_QT = f"q AS (SELECT qid, unnest({r._TOKENS.format('text')}) AS term FROM (VALUES {r._VALUES}) v(qid, text)), qt AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL)"
SQL = {
    "code_search": f"WITH {_QT}, {_CODE} SELECT * FROM code",
    "cross_strategy": f"""WITH {r._RRF}, {_CODE},
u AS (SELECT qid, id, round(score * {WEIGHTS['section']}::DOUBLE, 9) AS score, 'section' AS kind FROM rrf UNION ALL SELECT qid, id, round(score * {WEIGHTS['symbol']}::DOUBLE, 9), 'symbol' FROM code),
fl AS (SELECT 'section' AS kind, id, raw_file_id FROM cur UNION ALL SELECT 'symbol', id, raw_file_id FROM sy),
k AS (SELECT u.*, raw_file_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, id) AS r0 FROM u JOIN fl USING (kind, id)),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, raw_file_id ORDER BY r0) > 2 AS over FROM k),
z AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY over, r0) AS rank, kind, id, score FROM o) SELECT * FROM z WHERE rank <= 10""",
    "term_statistics": rf"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({r._TOKENS.format("regexp_replace(text, '[^\x20-\x7e\n\t]+', ' ', 'g')")})) AS term FROM documents) GROUP BY 1",
}
