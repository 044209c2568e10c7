"""Per-key distinct sets where a few keys hold most rows.

Repeats of a pair within a batch of input rows are dropped where they are read, so that a pair repeated over and over
costs one row a batch. Rows are range partitioned on the composite (key, value) with sampled quantiles. A heavy key is therefore cut into as
many partitions as its share of the rows asks for, while equal (key, value) rows stay together, so duplicates are
removed inside a partition without a second exchange. Each partition then holds a partial state per key (only the keys
at its borders continue in a neighbour), and the partial states are stitched by one exchange of one small row per key
and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread_pairs(df: DataFrame, key: Column, value: Column, partitions: int | None = None) -> DataFrame:
    """Distinct (key, value) rows, range partitioned by both.

    Null or blank keys and null values do not count. Columns of ``df`` other than those in the two expressions are
    pruned, whatever their names. An empty input gives an empty result.
    """
    pairs = df.select(key.alias("key"), value.alias("value")).where("key is not null and key <> '' and value is not null")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    if not any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in pairs.schema.fields):
        pairs = pairs.mapInArrow(_once, kinds)
    spread = pairs.repartitionByRange(partitions, "key", "value") if partitions else pairs.repartitionByRange("key", "value")
    return spread.distinct()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(["key", "value"]).aggregate([]).to_batches()


def distinct_counts(df: DataFrame, key: Column, value: Column, partitions: int | None = None) -> DataFrame:
    """(key, n): number of distinct values of each key; see ``spread_pairs`` for nulls, blanks and ties."""
    return spread_pairs(df, key, value, partitions).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def distinct_sets(df: DataFrame, key: Column, value: Column, partitions: int | None = None, piece_rows: int = 4096) -> DataFrame:
    """(key, piece, first_value, n, values): the set of each key as sorted, disjoint pieces of at most ``piece_rows``.

    A key may hold any share of the rows, so its set is never gathered in one row; the pieces of a key in the order of
    ``first_value`` are the whole sorted set. ``piece`` numbers the pieces of a key within its partition and has the
    partition in its high bits, so (key, piece) is unique.
    """
    kind = df.select(value.alias("v")).schema["v"].dataType
    schema = T.StructType(
        [
            T.StructField("key", df.select(key.alias("k")).schema["k"].dataType),
            T.StructField("piece", T.LongType()),
            T.StructField("first_value", kind),
            T.StructField("n", T.IntegerType()),
            T.StructField("values", T.ArrayType(kind)),
        ]
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        values: list = []
        number = 0

        def row() -> tuple:
            return (held[0], held[1] * (1 << 33) + number, values[0], len(values), list(values))

        for batch in batches:
            out = []
            for k, v, pid in zip(batch["key"], batch["value"], batch["pid"]):
                if held is None or k != held[0] or len(values) == piece_rows:
                    if held is not None:
                        out.append(row())
                    number = number + 1 if held is not None and k == held[0] else 0
                    held, values = (k, pid), []
                values.append(v)
            yield pd.DataFrame(out, columns=schema.names)
        if held is not None:
            yield pd.DataFrame([row()], columns=schema.names)

    pairs = spread_pairs(df, key, value, partitions).sortWithinPartitions("key", "value")
    return pairs.withColumn("pid", F.spark_partition_id()).mapInPandas(pieces, schema)
