"""Structured Streaming forms of the log analytics: the same rows as the batch operators, from files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.session import Scratch


def read_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _drain(stream: DataFrame, work: Scratch, mode: str, name: str) -> DataFrame:
    """Runs a streaming plan over all that is there and gives the result table as it then stands. A batch is written
    under its number, so one that is run again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(work.path(name if mode == "complete" else f"{name}/batch={number}"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", work.path(f"{name}-state")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(work.path(name)).select(*stream.columns)


def stream_trend(stream: DataFrame, ts: str, mode: str, of: str, length: str) -> DataFrame:
    """(bucket, n, n_of): counts by event-time window, late rows included for a day."""
    work = Scratch(stream.sparkSession, "stream")
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", "1 day")
    counts = timed.groupBy(F.window("__ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(mode) == of).alias("n_of"))
    return _drain(counts.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "n_of"), work, "complete", "trend")


def stream_last_state(stream: DataFrame, key: str, state: str, ts: str, order: str) -> DataFrame:
    """(key, state, n): the state machine of each key: rows seen and the state of the latest one, kept across batches."""
    work = Scratch(stream.sparkSession, "stream")
    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.col(state).alias("state"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).cast("bigint").alias("tie"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last, at, tie, n = held.get if held.exists else ("", -1, -1, 0)
        for batch in batches:
            n += len(batch)
            top = batch.sort_values(["at", "tie"]).iloc[-1]
            if (top["at"], top["tie"]) > (at, tie):
                last, at, tie = top["state"], int(top["at"]), int(top["tie"])
        held.update((last, at, tie, n))
        yield pd.DataFrame({"key": [group[0]], "state": [last], "n": [n]})

    states = rows.groupBy("key").applyInPandasWithState(step, "key bigint, state string, n bigint", "last string, at bigint, tie bigint, n bigint", "update", "NoTimeout")
    updates = _drain(states, work, "update", "states")
    return updates.groupBy("key").agg(F.max_by("state", "n").alias("state"), F.max("n").alias("n"))
