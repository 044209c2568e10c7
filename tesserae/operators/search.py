"""Search: dense, lexical and fused top-k for many queries at once.

Every result has an explicit rank from 1 with a total order (score, then id). ``queries`` frames are stated query sets;
dense search takes them in blocks of bounded size, lexical search sends only the query's own terms to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokens
from tesserae.session import Scratch

#: Queries sent to all tasks at once (documented bound).
QUERY_BLOCK = 16_384
#: Queries multiplied with a batch of rows at once.
QUERY_TILE = 512


def ranked(df: DataFrame, score: str, *by: str, key: str = "id", k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 by score descending, then key; only the first ``k`` if given."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    out = df.withColumn(name, F.row_number().over(w))
    return out if k is None else out.where(F.col(name) <= k)


def _block(df: DataFrame) -> tuple[list, np.ndarray]:
    rows = df.collect()
    x = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))
    return [r["qid"] for r in rows], x


def _unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable vectors of a batch, and those vectors at length one."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(sizes == dims)
    v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    size = np.linalg.norm(v, axis=1)
    good = np.isfinite(size) & (size > 0)
    return at[good], v[good] / size[good][:, None]


def nearest(data: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, center, score): for each row of ``data`` (id, vector) the one of ``centers`` (id, vector) with the highest
    cosine; ties go to the first center in the order of ids. The centers, a fitted set, go to the rows; rows do not
    move. Unusable vectors take no part."""
    known = centers.where("vector is not null").orderBy("id").collect()
    x = np.array([r["vector"] for r in known], np.float64).reshape(len(known), -1)
    norms = np.linalg.norm(x, axis=1) if len(known) else np.empty(0)
    good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    shared = data.sparkSession.sparkContext.broadcast(([known[i]["id"] for i in good], x[good] / norms[good][:, None] if len(good) else x))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(centers.schema["id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        for batch in batches if names else ():
            at, v = _unit_rows(batch.column(1), c.shape[1])
            s = np.round(v @ c.T, 9)
            best = s.argmax(axis=1)
            columns = [batch.column(0).take(pa.array(at)), pa.array(names, kind).take(pa.array(best)), pa.array(s[np.arange(len(s)), best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "center", "score"])

    return data.select("id", "vector").mapInArrow(score, f"id {data.schema['id'].dataType.simpleString()}, center {centers.schema['id'].dataType.simpleString()}, score double")


def best_by_group(data: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, group, score): for each of ``queries`` (qid, vector), a stated set, and each group of ``data`` (group,
    vector) the highest cosine, in one scan: every batch sends one row for each query and group that it holds."""
    ids, x = _block(queries.where("vector is not null"))
    norms = np.linalg.norm(x, axis=1) if len(ids) else np.empty(0)
    good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    shared = data.sparkSession.sparkContext.broadcast(([ids[i] for i in good], x[good] / norms[good][:, None] if len(good) else x))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(queries.schema["qid"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for batch in batches if names else ():
            at, v = _unit_rows(batch.column(1), q.shape[1])
            if not len(at):
                continue
            groups = batch.column(0).take(pa.array(at)).dictionary_encode()
            code = np.asarray(groups.indices.fill_null(len(groups.dictionary)))
            order = np.argsort(code, kind="stable")
            held, first = np.unique(code[order], return_index=True)
            values = groups.dictionary.take(pa.array(held, pa.int64(), mask=held == len(groups.dictionary)))
            for a in range(0, len(names), QUERY_TILE):
                s = np.maximum.reduceat(v[order] @ q[a : a + QUERY_TILE].T, first, axis=0)
                n = s.shape[1]
                columns = [pa.array(names[a : a + QUERY_TILE] * len(held), kind), values.take(pa.array(np.repeat(np.arange(len(held)), n))), pa.array(s.ravel(), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "group", "score"])

    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, group {data.schema['group'].dataType.simpleString()}, score double"
    found = data.select("group", "vector").mapInArrow(score, schema)
    return found.groupBy("qid", "group").agg(F.round(F.max("score"), 9).alias("score"))


def knn(data: DataFrame, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """(qid, id, score, rank): of ``data`` (id, vector) the ``k`` rows with the highest cosine for each of ``queries``
    (qid, vector), exactly.

    Vectors that are null, of another size than the queries', all zero or not finite take no part; neither do such
    queries. Each batch keeps its own best rows, so at most k rows a query and batch are shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        ids, x = _block(part.where("vector is not null"))
        norms = np.linalg.norm(x, axis=1) if len(ids) else np.empty(0)
        good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
        unit = x[good] / norms[good][:, None] if len(ids) else x
        shared = data.sparkSession.sparkContext.broadcast(([ids[i] for i in good], unit))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            if not qids:
                return
            for batch in batches:
                at, v = _unit_rows(batch.column(1), q.shape[1])
                out_q, out_k, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
                for first in range(0, len(qids) if len(at) else 0, QUERY_TILE):
                    s = q[first : first + QUERY_TILE] @ v.T
                    edge = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
                    r, c = np.nonzero((s >= edge[:, None] - 1e-12) & (True if floor is None else s >= floor))
                    out_q.append(r + first)
                    out_k.append(at[c])
                    out_s.append(s[r, c])
                found_q = pa.array(qids, qid_type).take(pa.array(np.concatenate(out_q)))
                found_k = batch.column(0).take(pa.array(np.concatenate(out_k)))
                yield pa.RecordBatch.from_arrays([found_q, found_k, pa.array(np.concatenate(out_s), pa.float64())], ["qid", "id", "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        qid_type = to_arrow_type(queries.schema["qid"].dataType)
        schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {data.schema['id'].dataType.simpleString()}, score double"
        found.append(data.select("id", "vector").mapInArrow(score, schema))
    scored = reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 9))
    return ranked(scored, "score", "qid", k=k)


def term_matches(docs: DataFrame, queries: DataFrame, seen: Observation | None = None) -> DataFrame:
    """(qid, id, term, qf, tf, n_tokens): for each query term its count in each text that has it.

    ``docs``: (id, text); ``queries``: (qid, text), a stated set of short texts. Only the terms of all queries, some
    kB, go to the texts; only matches leave them, so no postings are shuffled. ``seen`` takes the number of texts and
    their average number of tokens from the same pass.
    """
    terms = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    wanted = [r["term"] for r in terms.select("term").distinct().orderBy("term").collect()]
    sized = docs.select("id", tokens(F.col("text")).alias("t"))
    if seen is not None:
        n = F.when(F.col("t").isNotNull(), F.size("t"))
        sized = sized.observe(seen, F.count(n).alias("n_docs"), F.avg(n).alias("avg_tokens"))
    listed = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    hits = sized.select("id", F.size("t").alias("n_tokens"), F.filter("t", lambda t: F.array_contains(listed, t)).alias("hits")).where(F.size("hits") > 0)
    counts = hits.select("id", "n_tokens", "hits", F.explode(F.array_distinct("hits")).alias("term"))
    counted = counts.select("id", "n_tokens", "term", F.size(F.filter("hits", lambda h: h == F.col("term"))).alias("tf"))
    return counted.join(F.broadcast(terms), "term").select("qid", "id", "term", "qf", "tf", "n_tokens")


def lexical_saturated(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Sum over terms of qf * tf / (tf + 1 + 0.5 * length / 100): saturating counts, no document frequencies."""
    weight = F.col("qf") * F.col("tf") / (F.col("tf") + 1 + 0.5 * F.col("n_tokens") / 100)
    scored = term_matches(docs, queries).groupBy("qid", "id").agg(F.round(F.sum(weight), 9).alias("score"))
    return ranked(scored, "score", "qid", k=k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, all_terms: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi scores over all documents; with ``all_terms`` only texts that have every term of the query."""
    seen = Observation()
    matches = Scratch(docs.sparkSession, "matches").put(term_matches(docs, queries, seen), "matches")  # texts are read once
    n_docs, average = seen.get["n_docs"], seen.get["avg_tokens"] or 1.0
    per_term = matches.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("qf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / average))
    scored = matches.join(F.broadcast(per_term), ["qid", "term"]).groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if all_terms:
        needed = queries.select("qid", F.size(F.array_distinct(tokens(F.col("text")))).alias("needed"))
        scored = scored.join(F.broadcast(needed), "qid").where("n_terms = needed").drop("needed")
    return ranked(scored.drop("n_terms"), "score", "qid", k=k)


def phrase_search(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, id, n): texts that hold the tokens of a phrase one after the other, and how often."""
    spaced = docs.select("id", F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), "  "), F.lit(" ")).alias("t"))
    rows = phrases.select("qid", F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), "  "), F.lit(" ")).alias("p")).where("p <> '  '").collect()
    kind = phrases.schema["qid"].dataType
    stated = F.array(*(F.struct(F.lit(r["qid"]).cast(kind).alias("qid"), F.lit(r["p"]).alias("p")) for r in rows))
    if not rows:
        return spaced.select(F.lit(None).cast(kind).alias("qid"), "id", F.lit(0).alias("n")).where(F.lit(False))
    held = F.filter(stated, lambda s: F.col("t").contains(s["p"]))
    met = spaced.select("id", "t", F.explode(held).alias("s"))
    n = (F.length("t") - F.length(F.replace(F.col("t"), F.col("s.p"), F.lit("")))) / F.length("s.p")
    return met.select("s.qid", "id", n.cast("int").alias("n"))


def web_search(docs: DataFrame, must: list[str], any_of: list[str], without: list[str], phrase: str | None = None) -> DataFrame:
    """(id): texts with all of ``must``, one of ``any_of`` if given, none of ``without``, and the phrase if given."""
    t = docs.select("id", tokens(F.col("text")).alias("t"))
    test = F.lit(True)
    for term in must:
        test = test & F.array_contains("t", term)
    if any_of:
        test = test & F.arrays_overlap("t", F.array(*map(F.lit, any_of)))
    if without:
        test = test & ~F.arrays_overlap("t", F.array(*map(F.lit, without)))
    if phrase:
        test = test & F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).contains(f" {phrase} ")
    return t.where(test).select("id")


def rrf(lists: list[tuple[DataFrame, float]], k: int, constant: int = 60, rank_base: int = 1) -> DataFrame:
    """Weighted reciprocal rank fusion of (qid, id, rank) lists whose ranks start at 1."""
    parts = [df.select("qid", "id", (F.lit(w) / (constant + F.col("rank") - 1 + rank_base)).alias("s")) for df, w in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    return ranked(fused, "score", "qid", k=k)


def rrf_outer(dense: DataFrame, lexical: DataFrame, alpha: float, k: int, constant: int = 60) -> DataFrame:
    """The same for two lists, as a full outer join that keeps both ranks."""
    a = dense.select("qid", "id", F.col("rank").alias("dense_rank"))
    b = lexical.select("qid", "id", F.col("rank").alias("lexical_rank"))
    part = lambda w, c: F.coalesce(F.lit(w) / (constant + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "id"], "full").withColumn("score", F.round(part(alpha, "dense_rank") + part(1 - alpha, "lexical_rank"), 9))
    return ranked(both, "score", "qid", k=k)


def score_fusion(names: DataFrame, lexical: DataFrame, dense: DataFrame, k: int, weights: tuple[float, float, float] = (0.4, 0.3, 0.6)) -> DataFrame:
    """Name hits by 1 / rank, lexical and dense by score; the weights are brought to a sum of 1 if a query has lexical
    hits, and the lexical one is left out if not."""
    n, x, d = weights
    parts = [names.select("qid", "id", (1 / F.col("rank")).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("d")), lexical.select("qid", "id", F.lit(0.0).alias("n"), F.col("score").alias("x"), F.lit(0.0).alias("d")), dense.select("qid", "id", F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.col("score").alias("d"))]
    sums = reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(*(F.sum(c).alias(c) for c in "nxd"))
    has = lexical.select("qid").distinct().withColumn("has", F.lit(True))
    full = F.lit(n) * F.col("n") + F.lit(x) * F.col("x") + F.lit(d) * F.col("d")
    fused = sums.join(has, "qid", "left").withColumn("score", F.round(F.when(F.col("has"), full / (n + x + d)).otherwise(F.lit(n) * F.col("n") + F.lit(d) * F.col("d")), 9))
    return ranked(fused.select("qid", "id", "score"), "score", "qid", k=k)


def merge_extra(first: DataFrame, extra: DataFrame, factor: float = 0.5) -> DataFrame:
    """Hits of extra query vectors, scaled, behind those of the first: an id already there is not added again."""
    a = first.select("qid", "id", "score", F.lit(0).alias("origin"))
    b = extra.select("qid", "id", F.round(F.col("score") * factor, 9).alias("score"), F.lit(1).alias("origin"))
    w = Window.partitionBy("qid", "id").orderBy("origin", F.col("score").desc())
    return a.unionByName(b).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def boost(df: DataFrame, amount: Column, k: int | None = None) -> DataFrame:
    """Adds to the score and ranks again; ties keep the former order."""
    moved = df.withColumn("score", F.round(F.col("score") + amount, 9))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("rank"))
    out = moved.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def recency_boost(df: DataFrame, source: str, updated: str) -> DataFrame:
    """Of the distinct sources of a query's hits by latest update, the top quarter (one at least) gets 0.1, the rest of
    the top half 0.05."""
    sources = df.groupBy("qid", source).agg(F.max(updated).alias("at"))
    w = Window.partitionBy("qid").orderBy(F.col("at").desc_nulls_last(), source)
    placed = sources.withColumn("p", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    gain = F.when(F.col("p") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4)), 0.1).when(F.col("p") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), 0.05).otherwise(0.0)
    return boost(df.join(placed.select("qid", source, gain.alias("gain")), ["qid", source]), F.col("gain")).drop("gain")


def first_wins(df: DataFrame, *keys: str) -> DataFrame:
    """The best-ranked row of each key within a query."""
    w = Window.partitionBy("qid", *keys).orderBy("rank")
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def diversify(df: DataFrame, source: str, per_source: int = 3) -> DataFrame:
    """The first rows of each source in rank order, then the overflow in rank order, ranked anew."""
    w = Window.partitionBy("qid", source).orderBy("rank")
    marked = df.withColumn("over", (F.row_number().over(w) > per_source).cast("int"))
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("over", "rank"))).drop("over")


def budget(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """The rows, in rank order, whose running size stays within the limit."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= limit)


def ir_metrics(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg, recall, average_precision, reciprocal_rank, precision) at ``k``; ``relevant``: (qid, id)."""
    hits = run.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = hits.withColumn("seen", F.sum("hit").over(w))
    sums = upto.groupBy("qid").agg(F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("hit").alias("found"), F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("precisions"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    totals = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = totals.join(sums, "qid", "left").withColumn("ideal", ideal)
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return joined.select("qid", r(F.col("dcg") / F.col("ideal"), "ndcg"), r(F.col("found") / F.col("n"), "recall"), r(F.col("precisions") / F.least("n", F.lit(k)), "average_precision"), r(1 / F.col("first"), "reciprocal_rank"), r(F.col("found") / k, "precision"))
