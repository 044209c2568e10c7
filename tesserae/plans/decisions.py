"""Decision-log queries over ``events``: event_type as the mode, user_id as the key, value as the latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import decision_log as log
from tesserae.operators import evidence
from tesserae.streaming.log import read_files, stream_last_state, stream_trend
from tesserae.tables import table

MODES = ["view", "click", "signup", "purchase", "error", "refund"]
RANKS = {"error": 1, "view": 2, "click": 3, "signup": 4, "purchase": 5}
FROM, TO = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.between(_events(spark, sf_dir), "ts", FROM, TO)


def mode_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.mode_distribution(_ranged(spark, sf_dir), "event_type", MODES)


def constraint_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.concat(F.lit("mode:"), F.col("event_type")), F.concat(F.lit("latency:"), F.floor(F.col("value") / 50).cast("string")), F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "even").otherwise("odd"))
    return log.tag_frequency(_ranged(spark, sf_dir), tags, 10)


def mode_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.flips(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


def flip_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.classify_flips(mode_flips(spark, sf_dir), RANKS)


def total_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def _trend(unit: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return log.trend(_events(spark, sf_dir), "ts", "event_type", "error", unit)

    return query


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.windows(_events(spark, sf_dir), "ts", "6 hours", None, "event_type")


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.windows(_events(spark, sf_dir), "ts", "2 hours", "1 hour")


def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.sessions(_events(spark, sf_dir), "ts", "user_id", "30 minutes")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(spark, f"{sf_dir}/events*.parquet", _events(spark, sf_dir).schema)


def stream_trend_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_trend(_stream(spark, sf_dir), "ts", "event_type", "error", "1 day")


def stream_last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_last_state(_stream(spark, sf_dir), "user_id", "event_type", "ts", "event_id").withColumnRenamed("key", "user_id")


def json_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on a path of a JSON payload, range and equality."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).where((k >= 50) & (k < 90)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(k), 6).alias("avg_k"))


def governor_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each key from its signals: abstain before disputed before trustworthy; disputed falls back to
    trustworthy where evidence is only qualified and weak."""
    top = F.max("value").over(Window.partitionBy("user_id"))
    rows = _events(spark, sf_dir).withColumn("top", top)
    kind = F.when((F.col("event_type") == "error") & (F.col("top") > 150), "abstain").when((F.col("event_type") == "click") & (F.col("value") > 100), "disputed").when(F.col("event_type") == "view", "qualified")
    modes = evidence.govern(rows.withColumn("signal", kind), "user_id", F.col("signal"), F.col("value"), weak=130)
    return modes.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key: number, distinct sources, and mean, extremes, deviations and spread of the scores."""
    v = F.col("value")
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_sources"), F.round(F.avg(v), 8).alias("mean"), F.max(v).alias("high"), F.min(v).alias("low"), F.round(F.stddev_pop(v), 6).alias("deviation"))
    return rows.withColumn("spread", F.round(F.col("high") - F.col("low"), 6))


QUERIES = {
    "mode_distribution": mode_distribution, "constraint_frequency": constraint_frequency, "mode_flips": mode_flips, "flip_classification": flip_classification, "total_queries": total_queries,
    "abstain_trend_hour": _trend("hour"), "abstain_trend_day": _trend("day"), "abstain_trend_week": _trend("week"), "event_tumbling": event_tumbling, "event_sliding": event_sliding, "event_session": event_session,
    "stream_trend_available_now": stream_trend_available_now, "stream_last_states": stream_last_states, "json_payload_filter": json_payload_filter, "governor_decision": governor_decision, "score_features": score_features,
}

_IN = f"ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"
_FLIPS = """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
f AS (SELECT a.user_id, a.event_type AS mode, b.event_type AS previous FROM r a JOIN r b ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 2 AND a.event_type <> b.event_type)"""
_TREND = "SELECT date_trunc('{}', ts)::TIMESTAMP AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_of, round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 6) AS rate FROM events GROUP BY 1"
SQL = {
    "mode_distribution": f"""WITH m(mode) AS (VALUES {", ".join(f"('{m}')" for m in MODES)}), c AS (SELECT m.mode, count(e.event_id) AS n FROM m LEFT JOIN (SELECT * FROM events WHERE {_IN}) e ON e.event_type = m.mode GROUP BY 1)
SELECT mode, n, round(n::DOUBLE / (SELECT sum(n) FROM c), 6) AS rate FROM c""",
    "constraint_frequency": f"""WITH e AS (SELECT * FROM events WHERE {_IN}), t AS (SELECT unnest(['mode:' || event_type, 'latency:' || floor(value / 50)::INT, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'even' ELSE 'odd' END]) AS tag FROM e)
SELECT tag, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 6) AS share FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 10""",
    "mode_flips": f"{_FLIPS} SELECT * FROM f",
    "flip_classification": f"""{_FLIPS}, k(m, r) AS (VALUES {", ".join(f"('{m}', {r})" for m, r in RANKS.items())}), z AS (SELECT coalesce(a.r, 0) AS x, coalesce(b.r, 0) AS y FROM f LEFT JOIN k a ON a.m = mode LEFT JOIN k b ON b.m = previous)
SELECT CASE WHEN x > y THEN 'improvement' WHEN x < y THEN 'regression' ELSE 'neutral' END AS kind, count(*) AS n FROM z GROUP BY 1""",
    "total_queries": f"SELECT count(*) AS n FROM events WHERE {_IN}",
    **{f"abstain_trend_{u}": _TREND.format(u) for u in ("hour", "day", "week")},
    "event_tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "event_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_trend_available_now": "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_of FROM events GROUP BY 1",
    "stream_last_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY user_id",
    "json_payload_filter": "SELECT event_type, count(*) AS n, round(avg((props->>'$.k')::INT), 6) AS avg_k FROM events WHERE (props->>'$.k')::INT >= 50 AND (props->>'$.k')::INT < 90 GROUP BY 1",
    "governor_decision": """WITH s AS (SELECT user_id, bool_or(event_type = 'error') AS abstain, bool_or(event_type = 'click' AND value > 100) AS disputed, bool_or(event_type = 'view') AS qualified, max(value) AS top FROM events GROUP BY 1)
SELECT CASE WHEN abstain AND top > 150 THEN 'abstain' WHEN disputed AND NOT (qualified AND top < 130) THEN 'disputed' ELSE 'trustworthy' END AS mode, count(*) AS n FROM s GROUP BY 1""",
    "score_features": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_sources, round(avg(value), 8) AS mean, max(value) AS high, min(value) AS low, round(stddev_pop(value), 6) AS deviation, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1",
}
