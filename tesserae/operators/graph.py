"""Entity, import and section graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def related(edges: DataFrame, seeds: DataFrame, least: int, top: int) -> DataFrame:
    """(chunk, shared, rank): other chunks that share at least ``least`` entities with the seed chunks.

    ``edges``: distinct (entity, chunk); ``seeds``: (chunk). Entities of the seeds come first, then their edges; the
    count is pre-aggregated before its shuffle, so a hot entity costs no more than its edges.
    """
    of_seeds = edges.join(seeds, "chunk", "left_semi").select("entity").distinct()
    counted = edges.join(of_seeds, "entity", "left_semi").groupBy("chunk").agg(F.count(F.lit(1)).alias("shared"))
    rest = counted.where(F.col("shared") >= least).join(seeds, "chunk", "left_anti")
    return rest.orderBy(F.col("shared").desc(), "chunk").limit(top).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("shared").desc(), "chunk")))


def entities_of(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, n_entities): also for chunks without any."""
    counts = edges.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return chunks.join(counts, "chunk", "left").select("chunk", F.coalesce("n", F.lit(0)).alias("n_entities"))


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, out_degree, in_degree) of distinct edges, in one aggregation."""
    distinct = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct()
    ends = distinct.select(F.explode(F.array(F.struct(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def expand(edges: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """(node): one hop forward from the seeds (node), without the seeds."""
    hop = edges.join(seeds.select(F.col("node").alias(source)), source, "left_semi").select(F.col(target).alias("node")).where("node is not null").distinct()
    return hop.join(seeds, "node", "left_anti")


def ancestors_path(nodes: DataFrame, label: str, up: int, sep: str = " > ") -> DataFrame:
    """(id, path): the labels of up to ``up`` levels of parents and the node's own, root first.

    ``nodes``: (id, parent, label). Bounded walk: one join a level, each on the rows that still have a parent.
    """
    walk = nodes.select("id", F.col("parent").alias("next"), F.array(F.coalesce(label, F.lit(""))).alias("labels"))
    lookup = nodes.select(F.col("id").alias("p"), F.col("parent").alias("pp"), F.coalesce(label, F.lit("")).alias("pl"))
    for _ in range(up):
        walk = walk.join(lookup, F.col("next") == F.col("p"), "left").select("id", F.col("pp").alias("next"), F.when(F.col("p").isNotNull(), F.concat(F.array("pl"), F.col("labels"))).otherwise(F.col("labels")).alias("labels"))
    return walk.select("id", F.array_join("labels", sep).alias("path"))


def first_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group in an order."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= n)
