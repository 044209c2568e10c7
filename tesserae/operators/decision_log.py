"""Analytics over a log of decisions: (key, mode, ts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of a closed time range; the bounds reach the scan."""
    return df.where(F.col(ts).between(F.lit(start).cast(df.schema[ts].dataType), F.lit(end).cast(df.schema[ts].dataType)))


def mode_distribution(df: DataFrame, mode: str, modes: list[str]) -> DataFrame:
    """(mode, n, rate) for each of ``modes``, zero-filled; rate of all rows with one of them."""
    known = df.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    counts = df.where(F.col(mode).isin(modes)).groupBy(F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    filled = known.join(F.broadcast(counts), "mode", "left").select("mode", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row a mode
    return filled.withColumn("rate", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6))


def tag_frequency(df: DataFrame, tags: Column, top: int) -> DataFrame:
    """(tag, n, share of rows): how many rows have each tag of an array column, the most frequent ``top``."""
    total = df.count()
    counts = df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.lit(max(total, 1)), 6)).orderBy(F.col("n").desc(), "tag").limit(top)


def latest_two(df: DataFrame, key: str, mode: str, *order: str) -> DataFrame:
    """(key, mode, previous): the last mode of each key and the one before it, in one aggregation with two slots."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    two = df.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return two.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col(mode))).alias("mode"), F.max(F.when(F.col("rn") == 2, F.col(mode))).alias("previous"))


def flips(df: DataFrame, key: str, mode: str, *order: str) -> DataFrame:
    """The keys whose last mode differs from the one before."""
    return latest_two(df, key, mode, *order).where("mode <> previous")


def classify_flips(df: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(kind, n) of flips: improvement to a mode of a higher rank, regression to a lower one."""
    rank = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    now, before = F.coalesce(rank[F.col("mode")], F.lit(0)), F.coalesce(rank[F.col("previous")], F.lit(0))
    kind = F.when(now > before, "improvement").when(now < before, "regression").otherwise("neutral")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def trend(df: DataFrame, ts: str, mode: str, of: str, unit: str) -> DataFrame:
    """(bucket, n, n_of, rate) by hour, day or week."""
    bucket = F.date_trunc(unit, F.col(ts).cast("timestamp")).cast("timestamp_ntz")
    rows = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(mode) == of).alias("n_of"))
    return rows.withColumn("rate", F.round(F.col("n_of") / F.col("n"), 6))


def windows(df: DataFrame, ts: str, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    """(start, keys..., n) of tumbling or sliding windows."""
    at = F.window(F.col(ts).cast("timestamp"), length, slide) if slide else F.window(F.col(ts).cast("timestamp"), length)
    return df.groupBy(at.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """(key, start, n): rows of a key less than ``gap`` apart are one session."""
    rows = df.groupBy(F.session_window(F.col(ts).cast("timestamp"), gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
