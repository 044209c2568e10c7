"""Queries over questions and small evidence sets, conversations, work queues and evaluations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import questions
from tesserae.functions.text import STOPWORDS
from tesserae.operators import conflicts, constraints
from tesserae.operators.code_context import directory
from tesserae.operators.ingest import number_rows
from tesserae.plans.lookups import _CHUNKS, _FILES, _SECTIONS, _SYMBOLS
from tesserae.tables import current_table, table

#: Stated beginnings that make questions of titles.
STARTS = ("what is", "how does", "compare", "is it", "latest")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every section: one of the stated beginnings, by the length of the title, and the title."""
    rows = current_table(spark, sf_dir, "section_index", "title").where("title is not null")
    start = F.element_at(F.array(*map(F.lit, STARTS)), (F.length("title") % len(STARTS) + 1).cast("int"))
    return rows.select("id", F.concat(start, F.lit(" "), F.col("title")).alias("q"))


def question_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _questions(spark, sf_dir).select("id", questions.word_count(q).alias("n_words"), questions.kind(q).alias("kind"), questions.compares(q).alias("compares"), questions.needs_detection(q).alias("detects"), questions.fingerprint(q).alias("fingerprint"))


def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("id", F.array_join(questions.entities(F.col("q")), "|").alias("entities"))


def question_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).groupBy(questions.rewrite_reason(F.col("q")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def retrieval_profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles for every event, read as the analysis of a question: type from the event, confidence from its value."""
    kind = F.when(F.col("event_type") == "click", "code").when(F.col("event_type") == "view", "data").otherwise("general")
    k = F.get_json_object("props", "$.k").cast("int")
    breadth = F.when(k % 3 == 0, "broad").when(k % 3 == 1, "narrow").otherwise("moderate")
    answer = F.when(k % 4 == 0, "procedural").when(k % 4 == 1, "comparative").otherwise("factual")
    rows = table(spark, sf_dir, "events").select("event_id", questions.retrieval_profile(kind, F.col("value") / 200, breadth, answer, k % 2 + 1, k % 5 == 0).alias("p"))
    return rows.select("event_id", "p.*")


def future_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention a year after 2025."""
    return table(spark, sf_dir, "documents").where(questions.mentions_future_year(F.col("text"), 2025)).select("doc_id")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chunks of each file as an evidence set, as the pairwise rules take them."""
    p = F.from_json("payload", "doc_id string, chunk_index int, content string")
    rows = current_table(spark, sf_dir, "chunks", "payload").select(p.alias("p"))
    return conflicts.first_texts(rows.select(F.col("p.doc_id").alias("set"), F.col("p.chunk_index").alias("pos"), F.col("p.content").alias("text")))


def evidence_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conflicts.divergence(_sets(spark, sf_dir))
    return rows.select("set", "n_cross", F.round("max_cross", 6).alias("max_cross"), "n_within", F.round("max_within", 6).alias("max_within"))


def evidence_set_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.set_features(_sets(spark, sf_dir)).drop("jaccard_max", "jaccard_min")


def evidence_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.variances(_sets(spark, sf_dir))


def evidence_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.temporal_conflicts(_sets(spark, sf_dir))


def conversation_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten messages (five turns) of each user, in order."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 10")
    back = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return last.select("user_id", "event_id", F.row_number().over(back).alias("place"))


def hop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each file whose first 500 characters, with 20 more for each, fit into a budget of 5,000."""
    p = F.from_json("payload", "doc_id string, chunk_index int, content string")
    rows = current_table(spark, sf_dir, "chunks", "payload").select("id", p.alias("p")).select("id", "p.doc_id", "p.chunk_index", F.least(F.length("p.content"), F.lit(500)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(F.coalesce("n", F.lit(0)) + 20).over(w)).where("used <= 5000").select("id", "doc_id", "used")


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files in the order they are worked on: priority (asked for 1, beside such 2, else 4), then size."""
    files = current_table(spark, sf_dir, "raw_files", "path", "size_bytes").withColumn("dir", directory(F.col("path")))
    asked = current_table(spark, sf_dir, "symbol_index", "raw_file_id", "kind").where("kind = 'class'").select(F.col("raw_file_id").alias("id")).distinct().withColumn("asked", F.lit(True))
    near = files.join(asked, "id").select("dir").distinct().withColumn("near", F.lit(True))
    ranked = files.join(asked, "id", "left").join(near, "dir", "left").select("id", "size_bytes", F.when(F.col("asked"), 1).when(F.col("near"), 2).otherwise(4).alias("priority"))
    return number_rows(ranked, F.col("priority"), F.col("size_bytes"), F.col("id"), name="place").select("id", "priority", "place")


def files_not_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are in neither of the two later states: no sections and no symbols."""
    later = current_table(spark, sf_dir, "section_index", "raw_file_id").select("raw_file_id").unionByName(current_table(spark, sf_dir, "symbol_index", "raw_file_id").select("raw_file_id"))
    return current_table(spark, sf_dir, "raw_files", "path").join(later, F.col("id") == F.col("raw_file_id"), "left_anti").select("id", "path")


def set_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each section's keywords the share that its content has as words, and whether all are there."""
    rows = current_table(spark, sf_dir, "section_index", "keywords", "content").where("size(keywords) > 0")
    held = F.filter("keywords", lambda k: F.lower(F.coalesce("content", F.lit(""))).contains(F.lower(k)))
    return rows.select("id", F.size("keywords").alias("n"), F.size(held).alias("n_found"), F.round(F.size(held) / F.size("keywords"), 6).alias("recall"), (F.size(held) == F.size("keywords")).alias("complete"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each event type follows each other one of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("expected"), F.col("event_type").alias("actual")).where("expected is not null")
    return rows.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def macro_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pass rate of each event type, and their plain mean (not that of all cases)."""
    rates = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("double")).alias("rate"))
    every = rates.agg(F.avg("rate").alias("rate")).select(F.lit("overall").alias("name"), "rate")
    return rates.select(F.col("event_type").alias("name"), "rate").unionByName(every).select("name", F.round("rate", 6).alias("rate"))


def question_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of documents' first 60 characters against the document of the next number, if there is one: whether
    versions, years or opposites differ, and whether they share a word."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("q"), F.col("text").alias("t"))
    later = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("other"))
    return a.join(later, "doc_id").select("doc_id", constraints.mismatch(F.col("q"), F.col("other")).alias("differs"), constraints.lexical_overlap(F.col("q"), F.col("other")).alias("shares"))


_Q = f"""q AS (SELECT id, ['{"', '".join(STARTS)}'][length(title) % {len(STARTS)} + 1] || ' ' || title AS q FROM {_SECTIONS} WHERE title IS NOT NULL),
w AS (SELECT id, q, list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '') AS w FROM q)"""
_SETS = f"""sets AS (SELECT payload->>'$.doc_id' AS set, row_number() OVER (PARTITION BY payload->>'$.doc_id' ORDER BY (payload->>'$.chunk_index')::INT, payload->>'$.content') AS place, payload->>'$.content' AS text
  FROM {_CHUNKS} WHERE payload->>'$.content' IS NOT NULL AND payload->>'$.doc_id' IS NOT NULL QUALIFY place <= 5)"""
_WORDS_RE = "^(" + "|".join(questions.QUESTION_WORDS) + ")\\b"
_ENDS = "regexp_replace(x, '[?.,!;:]+$', '')"

QUERIES = {
    q.__name__: q
    for q in (
        question_features, question_entities, question_rewrites, retrieval_profile_rules, future_years, evidence_divergence, evidence_set_features, evidence_variances, evidence_times,
        conversation_recent, hop_context, work_queue, files_not_parsed, set_recall, confusion, macro_pass_rate, question_mismatches,
    )
}
SQL = {
    "question_features": f"""WITH {_Q}, f AS (SELECT *, regexp_extract(lower(q), '{_WORDS_RE}', 1) AS f FROM w)
SELECT id, len(w) AS n_words, CASE WHEN f IN ('what', 'which') THEN 'what' WHEN f IN ('when', 'where') THEN 'when_where' WHEN f IN ('how', 'why', 'who') THEN f WHEN f <> '' THEN 'yes_no' ELSE 'other' END AS kind,
  list_has_any(list_transform(w, lambda x: lower(x)), ['{"', '".join(questions.COMPARISON_WORDS)}']) AS compares,
  len(w) > 10 OR regexp_matches(lower(q), '{"|".join(questions.DETECTION_KEYWORDS)}') AS detects, sha256(lower(trim(q))) AS fingerprint FROM f""",
    "question_entities": f"""WITH {_Q} SELECT id, CASE WHEN len(w) <= 8 THEN array_to_string(list_transform(list_filter(w, lambda x: length(x) > 1 AND NOT list_contains(['{"', '".join(questions.STOP_WORDS)}'], lower({_ENDS}))), lambda x: {_ENDS}), '|') END AS entities FROM w""",
    "question_rewrites": f"""WITH {_Q} SELECT CASE WHEN regexp_matches(lower(q), '{questions.PRONOUNS}') THEN 'has_context_pronouns' WHEN regexp_matches(lower(q), '{questions.COMPOUND}') THEN 'has_compound_indicators'
  WHEN len(w) > 15 OR length(q) > 100 THEN 'long_query' WHEN regexp_matches(lower(q), '{questions.NOISE}') THEN 'noisy_query' WHEN regexp_matches(lower(q), '{questions.SIMPLE}') THEN 'simple_question'
  WHEN len(w) <= 8 THEN 'short_query' ELSE 'medium_query' END AS reason, count(*) AS n FROM w GROUP BY 1""",
    "retrieval_profile_rules": """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'code' WHEN 'view' THEN 'data' ELSE 'general' END AS kind, value / 200 AS c, (props->>'$.k')::INT AS k FROM events),
r AS (SELECT *, floor(CASE k % 3 WHEN 0 THEN 15 * 1.3 WHEN 1 THEN 15 * 0.8 ELSE 15 END) AS r FROM e)
SELECT event_id, greatest(10, floor(CASE k % 3 WHEN 0 THEN 30 * (k % 2 + 1) * 1.5 WHEN 1 THEN 30 * (k % 2 + 1) * 0.7 ELSE 30 * (k % 2 + 1) END))::INT AS top_k,
  floor(CASE k % 4 WHEN 0 THEN greatest(r, CASE WHEN k % 3 = 1 THEN 5 ELSE 0 END) * 1.3 WHEN 1 THEN greatest(r, CASE WHEN k % 3 = 1 THEN 5 ELSE 0 END) * 1.2 ELSE r END)::INT AS top_read,
  k % 5 = 0 OR NOT (kind = 'code' AND c >= 0.7 OR kind = 'data' OR c >= 0.9) AS run_hyde, kind <> 'data' AS run_agentic,
  kind NOT IN ('code', 'data') AND c < 0.6 AS inject_summaries, CASE WHEN kind NOT IN ('code', 'data') AND c < 0.6 OR k % 3 = 0 THEN 12 ELSE 3 END AS entity_limit FROM r""",
    "future_years": r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, '\b(20\d{2})\b', 1), lambda y: y::INT > 2025)) > 0",
    "evidence_divergence": rf"""WITH {_SETS}, n AS (SELECT set, place, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT set, place, list_filter(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)),
    lambda x: x >= 2 AND NOT (x BETWEEN 1900 AND 2099 AND x = floor(x))) AS v FROM sets)),
p AS (SELECT a.set, a.place <> b.place AS crossing, greatest(a.x, b.x) / least(a.x, b.x) AS r FROM n a JOIN n b ON a.set = b.set AND (a.place < b.place OR a.place = b.place AND a.i < b.i) AND a.x > 0 AND b.x > 0),
d AS (SELECT * FROM p WHERE r > 1.02::DOUBLE AND r < 2)
SELECT s.set, count(*) FILTER (WHERE crossing) AS n_cross, coalesce(round(max(r) FILTER (WHERE crossing), 6), 0) AS max_cross, count(*) FILTER (WHERE NOT crossing) AS n_within, coalesce(round(max(r) FILTER (WHERE NOT crossing), 6), 0) AS max_within
FROM (SELECT DISTINCT set FROM sets) s LEFT JOIN d ON d.set = s.set GROUP BY s.set""",
    "evidence_set_features": rf"""WITH {_SETS}, f AS (SELECT set, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w, length(text) AS c, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d FROM sets)
SELECT set, count(*) AS n, round(CASE WHEN avg(w) > 0 THEN coalesce(stddev_samp(w), 0) / avg(w) ELSE 0 END, 6) AS length_cv, round(stddev_pop(c), 6) AS chars_deviation, round(sum(d) / greatest(sum(c), 1), 6) AS digits FROM f GROUP BY set""",
    "conversation_recent": """WITH l AS (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM l""",
    "hop_context": f"""SELECT id, doc_id, used FROM (SELECT id, payload->>'$.doc_id' AS doc_id, sum(coalesce(least(length(payload->>'$.content'), 500), 0) + 20)
  OVER (PARTITION BY payload->>'$.doc_id' ORDER BY (payload->>'$.chunk_index')::INT, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {_CHUNKS}) WHERE used <= 5000""",
    "work_queue": f"""WITH f AS (SELECT id, size_bytes, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dir, id IN (SELECT raw_file_id FROM {_SYMBOLS} WHERE kind = 'class') AS asked FROM {_FILES}),
p AS (SELECT id, size_bytes, CASE WHEN asked THEN 1 WHEN bool_or(asked) OVER (PARTITION BY dir) THEN 2 ELSE 4 END AS priority FROM f)
SELECT id, priority, row_number() OVER (ORDER BY priority, size_bytes NULLS FIRST, id) AS place FROM p""",
    "files_not_parsed": f"SELECT id, path FROM {_FILES} WHERE id NOT IN (SELECT raw_file_id FROM {_SECTIONS} WHERE raw_file_id IS NOT NULL) AND id NOT IN (SELECT raw_file_id FROM {_SYMBOLS} WHERE raw_file_id IS NOT NULL)",
    "set_recall": f"""SELECT id, n, f AS n_found, round(f / n, 6) AS recall, f = n AS complete FROM (SELECT id, len(keywords) AS n, len(list_filter(keywords, lambda k: contains(lower(coalesce(content, '')), lower(k)))) AS f
  FROM {_SECTIONS} WHERE len(keywords) > 0)""",
    "confusion": "SELECT expected, actual, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expected, event_type AS actual FROM events) WHERE expected IS NOT NULL GROUP BY ALL",
    "question_mismatches": "WITH p AS (SELECT a.doc_id, lower(substr(a.text, 1, 60)) AS q, lower(coalesce(b.text, '')) AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, coalesce("
    + " OR ".join(f"regexp_extract(q, '({f})', 1) <> '' AND len(regexp_extract_all(t, '({f})', 1)) > 0 AND NOT list_contains(regexp_extract_all(t, '({f})', 1), regexp_extract(q, '({f})', 1))" for f in constraints.VERSIONS)
    + "".join(f" OR contains(q, '{a}') AND NOT contains(t, '{a}') AND contains(t, '{b}')" for a, b in constraints.OPPOSITES)
    + f", false) AS differs, coalesce(list_has_any(list_filter(regexp_extract_all(q, '[a-z]{{3,}}'), lambda x: NOT list_contains({list(STOPWORDS)}, x)), regexp_extract_all(t, '[a-z]{{3,}}')), false) AS shares FROM p",
    "macro_pass_rate": "WITH r AS (SELECT event_type AS name, avg((value > 50)::INT) AS rate FROM events GROUP BY 1) SELECT name, round(rate, 6) AS rate FROM r UNION ALL SELECT 'overall', round(avg(rate), 6) FROM r",
}
