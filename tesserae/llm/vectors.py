"""The most similar vectors of every vector, by score-aware quantisation.

Vectors go to the lists of their nearest centroids, always the same number of them, and all that meet in a list are
compared: a pair is found if it shares any list, however far down its two rankings, and it counts for both. Of vectors
without groups larger than a list this loses about one neighbour in 200 with thousands of lists, where meeting in the
nearest list of one of the two loses one in six. The number of lists grows with the rows; when the sample for fitting
has no room for more centroids the lists grow, and later they get a second level, the centroids of what is left.

With a vector travels its four-bit code, one for each two dimensions, chosen with the anisotropic loss: an error along
the vector, which moves every high score, weighs more than one across it. In a list the products of all vectors with the
decoded codes are scanned. For every vector the error of its code is known, so the scan keeps all that can still be
among the best; those are ranked again by the exact cosine in double precision. Only the choice of lists can lose a
neighbour.

A list of very many rows is cut into blocks of queries and blocks of members, and each block of the one meets each of
the other in its own group; groups hold a bounded number of rows.

Centroids and codewords are fitted on at most about ``FIT_ROWS`` vectors of a kind; every vector is indexed. Vectors
that are equal are one class: one of them is indexed, and results are spread to the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Rows of a kind for fitting (documented bound), of them those for the codewords, and rows aimed at in a list.
FIT_ROWS, CODE_ROWS, LIST_ROWS = 24_000, 6_000, 2_048
#: At least so many fitting rows for each centroid: bounds the centroids of a level by FIT_ROWS / 8, the lists by its
#: square.
ROWS_PER_CENTROID = 8
#: Lists grow to so many times LIST_ROWS before there is a second level, which parts more neighbours than the first.
GROWN = 4
#: Rows of a block of queries and of a block of members; lists within both are one group.
QUERY_BLOCK, MEMBER_BLOCK = 65_536, 65_536
#: Queries and members multiplied at once.
TILE_QUERIES, TILE_MEMBERS = 512, 2_048
#: Pairs found before they are merged into the best so far, if those are not more.
PENDING = 65_536
#: Lists a vector goes to.
LISTS = 5
#: Weight of the error along the vector against that across it, from the published rule (d - 1) t^2 / (1 - t^2).
ALIGNED_SCORE = 0.2


def usable(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and those vectors as float32: the right size, finite, not all zero."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(array), -1))
    at = np.flatnonzero(sizes == dims)
    flat = array.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return at[good], flat[good]


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first rows of ``x``, whose order is that of a hash."""
    c = x[:n].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        c[own] = np.add.reduceat(x[order], first, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def encode(x: np.ndarray, words: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows, subspaces) of unit vectors by coordinate descent on |r|^2 + (eta - 1) (r along x)^2."""
    parts = x.reshape(len(x), words.shape[0], -1)
    codes = np.empty(parts.shape[:2], np.uint8)
    square, along = [], []
    for s in range(words.shape[0]):
        product = parts[:, s] @ words[s].T
        own = (parts[:, s] ** 2).sum(axis=1, keepdims=True)
        square.append(own - 2 * product + (words[s] ** 2).sum(axis=1))
        along.append(own - product)
        codes[:, s] = square[s].argmin(axis=1)
    rows = np.arange(len(x))
    total = sum(along[s][rows, codes[:, s]] for s in range(len(words)))
    for _ in range(sweeps):
        for s in range(len(words)):
            rest = total - along[s][rows, codes[:, s]]
            codes[:, s] = (square[s] + (eta - 1) * (rest[:, None] + along[s]) ** 2).argmin(axis=1)
            total = rest + along[s][rows, codes[:, s]]
    return codes


def decode(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([words[s][codes[:, s]] for s in range(len(words))], axis=1)


def codewords(x: np.ndarray, eta: float, width: int = 2, rounds: int = 6) -> np.ndarray:
    """(subspaces, 16, width) codewords minimising the anisotropic loss over ``x``."""
    parts = x.reshape(len(x), -1, width)
    n = parts.shape[1]
    pick = np.linspace(0, len(x) - 1, 16).astype(int)
    words = np.stack([parts[np.argsort(parts[:, s].sum(axis=1))[pick], s] for s in range(n)])
    for _ in range(rounds):
        codes = encode(x, words, eta, 1)
        error = parts - decode(codes, words).reshape(parts.shape)
        along = (error * parts).sum(axis=2)
        total = along.sum(axis=1)
        for s in range(n):
            part = parts[:, s]
            rest = total - along[:, s] + (part**2).sum(axis=1)
            right = part + (eta - 1) * rest[:, None] * part
            left = np.eye(width) + (eta - 1) * part[:, :, None] * part[:, None, :]
            for code in range(16):
                own = codes[:, s] == code
                if own.any():
                    words[s, code] = np.linalg.solve(left[own].sum(axis=0), right[own].sum(axis=0))
    return words


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the earlier one in the lower half."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def unpack(packed: np.ndarray, n: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, :n]


def scan(queries: np.ndarray, codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Approximate products (rows, queries) of queries and codes."""
    return decode(codes, words).astype(np.float32) @ queries.astype(np.float32).T


def similar_vectors(df: DataFrame, kind: Column, key: Column, vector: Column, k: int = 10, floor: float = 0.85, dims: int = 64, lists: int | None = None) -> DataFrame:
    """(kind, id, neighbor_id, cosine): the up to ``k`` other rows of the kind with the highest cosine, ``floor`` at least.

    Ties go to the smaller id. Rows whose vector is null, of another size, all zero or not finite take no part, nor
    those with a null key; a repeated key must be resolved before. Other columns are pruned, whatever their names. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    work = Scratch(spark, "vectors")
    rows = df.select(kind.alias("kind"), key.cast("string").alias("id"), vector.cast("array<float>").alias("vector")).where("kind is not null and id is not null")
    stored = work.put(rows.mapInArrow(_store(dims), "kind string, id string, one bigint, two bigint, vector binary"), "stored")
    ids = stored.select("kind", "id", "one", "two")
    classes = ids.groupBy("kind", "one", "two").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    copies = work.put(ids.join(classes, ["kind", "one", "two"]).select("kind", "id", "rep"), "copies")
    chosen = stored.join(copies.where("id <> rep").select("kind", "id"), ["kind", "id"], "left_anti").select("kind", "id", "vector")

    model = _fit(stored, dims, lists or LISTS, floor)
    shared = spark.sparkContext.broadcast(model)
    counted = chosen.mapInArrow(_place(shared, dims, False), "kind string, list bigint")
    sizes = counted.groupBy("kind", "list").agg(F.count(F.lit(1)).alias("rows"))
    large = work.put(sizes.where(F.col("rows") > min(QUERY_BLOCK, MEMBER_BLOCK)), "large")
    placed = chosen.mapInArrow(_place(shared, dims, True), "kind string, list bigint, id string, vector binary, code binary, slack float, lists binary")
    grouped = _blocks(placed.join(large, ["kind", "list"], "left"))
    found = grouped.groupBy("kind", "list", "q", "m").applyInArrow(_scan_group(shared, dims, k, floor), "kind string, id string, neighbor_id string, cosine double")
    best = _top(found, k)

    # equal vectors: of a neighbour's class the k + 1 smallest ids can count, for a class itself all its members do
    w = Window.partitionBy("kind", "rep").orderBy("id")
    first = copies.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    first = first.groupBy("kind", "rep").agg(F.sort_array(F.collect_list("id")).alias("others")).withColumnRenamed("rep", "neighbor_id")
    own = copies.where("id = rep").select("kind", "id", F.col("id").alias("neighbor_id"), F.lit(1.0).alias("cosine"))
    spread = best.unionByName(own).join(first, ["kind", "neighbor_id"], "left")
    spread = spread.select("kind", "id", F.explode(F.coalesce("others", F.array("neighbor_id"))).alias("neighbor_id"), "cosine")
    members = copies.select("kind", F.col("id").alias("member"), F.col("rep").alias("id"))
    spread = spread.join(members, ["kind", "id"], "left").select("kind", F.coalesce("member", "id").alias("id"), "neighbor_id", "cosine").where("id <> neighbor_id")
    return _top(spread, k)


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("kind", "id").orderBy(F.col("cosine").desc(), "neighbor_id")
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _store(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = usable(batch.column(2), dims)
            at = pa.array(at)
            data = [v.tobytes() for v in vectors + np.float32(0)]  # no negative zeros
            digest = [xxhash.xxh3_128_intdigest(d) for d in data]
            one, two = ([(h >> 64) - (1 << 63) for h in digest], [(h & ((1 << 64) - 1)) - (1 << 63) for h in digest])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(data, pa.binary())], ["kind", "id", "one", "two", "vector"])

    return run


def _blocks(placed: DataFrame) -> DataFrame:
    """Each row once for every group it is in: as a query (role 1), a member (2) or both (3)."""
    n_q, n_m = (F.ceil(F.col("rows") / size).cast("int") for size in (QUERY_BLOCK, MEMBER_BLOCK))
    q, m = F.pmod(F.xxhash64("id"), n_q).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), n_m).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda q, m, role: F.struct(q.alias("q"), m.alias("m"), role.cast("int").alias("role"))
    queries = F.transform(each(n_m), lambda b: group(q, b, F.when(b == m, 3).otherwise(1)))
    members = F.transform(each(n_q), lambda b: group(b, m, F.lit(2)))
    whole = F.array(group(F.lit(0), F.lit(0), F.lit(3)))
    groups = F.when(F.col("rows").isNull(), whole).otherwise(F.concat(queries, F.filter(members, lambda g: g["q"] != q)))
    return placed.withColumn("group", F.explode(groups)).select("kind", "list", "group.q", "group.m", "group.role", "id", "vector", "code", "slack", "lists")


def _fit(stored: DataFrame, dims: int, lists: int, floor: float) -> dict:
    """Centroids of both levels and codewords by kind, from a hash sample of about FIT_ROWS rows of each kind at most."""
    sizes = {r["kind"]: r["n"] for r in stored.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = F.lit(1)
    for kind, n in sizes.items():
        every = F.when(F.col("kind") == kind, max(1, -(-n // FIT_ROWS))).otherwise(every)
    order = F.xxhash64("id")
    sample = stored.where(F.pmod(order, every.cast("bigint")) == 0).select("kind", order.alias("o"), "vector").toPandas().sort_values(["kind", "o"])
    eta = (dims - 1) * ALIGNED_SCORE**2 / (1 - ALIGNED_SCORE**2)
    model = {"eta": eta, "lists": lists, "across": np.sqrt(max(0.0, 1 - floor * floor))}
    for kind, n in sizes.items():
        x = unit(np.frombuffer(b"".join(sample.loc[sample["kind"] == kind, "vector"]), np.float32).reshape(-1, dims))
        if len(x) == 0:  # tiny tables whose sample came out empty
            x = np.eye(1, dims)
        wanted, most = -(-n // LIST_ROWS), max(1, len(x) // ROWS_PER_CENTROID)
        first = centroids(x.astype(np.float32), max(1, min(wanted, most)))
        rest = x - first[(x @ first.T).argmax(axis=1)]
        second = residual_centroids(rest.astype(np.float32), min(-(-n // (GROWN * LIST_ROWS * len(first))), most))
        model[kind] = (first, second, codewords(x[:CODE_ROWS], eta).astype(np.float32))
    return model


def residual_centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means of what is left beside the first centroids; a single one is the origin."""
    if n <= 1:
        return np.zeros((1, x.shape[1]), np.float32)
    c = x[:n].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        own, first, counts = np.unique(near[order], return_index=True, return_counts=True)
        c[own] = np.add.reduceat(x[order], first, axis=0) / counts[:, None]
    return c


def nearest_lists(x: np.ndarray, first: np.ndarray, second: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ``m`` nearest lists of each row, and which of them is the nearest; of the first level the ``m``
    best are tried."""
    scores = x @ first.T
    tried = min(m, len(first))
    top = np.argpartition(-scores, tried - 1, axis=1)[:, :tried] if tried < len(first) else np.tile(np.arange(tried), (len(x), 1))
    if len(second) == 1:
        return top.astype(np.int64), top == scores.argmax(axis=1)[:, None]
    half = (second**2).sum(axis=1) / 2
    cross = first @ second.T
    inner = x @ second.T - half
    # half the squared distance to the sum of both centroids, less that of the row itself
    score = np.stack([(scores[np.arange(len(x)), top[:, t]] - 0.5)[:, None] + inner - cross[top[:, t]] for t in range(tried)], axis=1).reshape(len(x), -1)
    m = min(m, score.shape[1])
    cell = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.tile(np.arange(m), (len(x), 1))
    at = np.take_along_axis(top, cell // len(second), axis=1)
    return at.astype(np.int64) * len(second) + cell % len(second), cell == score.argmax(axis=1)[:, None]


def _place(shared, dims: int, whole: bool):
    """Each vector in each of its lists, with its code and the error that the code can make in a score that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            kinds = np.asarray(batch.column(0).to_pylist(), object)
            for kind in dict.fromkeys(kinds):
                at = np.flatnonzero(kinds == kind)
                for piece in range(0, len(at), 1024):
                    own = pa.array(at[piece : piece + 1024])
                    vectors = batch.column(2).take(own)
                    x = unit(np.frombuffer(b"".join(vectors.to_pylist()), np.float32).reshape(-1, dims))
                    first, second, words = model[kind]
                    to, _ = nearest_lists(x.astype(np.float32), first, second, model["lists"])
                    rows = pa.array(np.repeat(np.arange(len(x)), to.shape[1]))
                    columns = [pa.array([kind] * len(rows), pa.string()), pa.array(to.ravel())]
                    names = ["kind", "list"]
                    if whole:
                        words = words.astype(np.float64)
                        codes = encode(x, words, model["eta"])
                        error = x - decode(codes, words)
                        along = (error * x).sum(axis=1)
                        slack = np.stack([np.abs(along), np.linalg.norm(error - along[:, None] * x, axis=1)])
                        slack = (slack[0] + model["across"] * slack[1] + 1e-5).astype(np.float32)
                        code = pa.array([c.tobytes() for c in pack(codes)], pa.binary())
                        lists = pa.array([t.tobytes() for t in to.astype(np.int32)], pa.binary())
                        columns += [c.take(rows) for c in (batch.column(1).take(own), vectors, code, pa.array(slack), lists)]
                        names += ["id", "vector", "code", "slack", "lists"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _scan_group(shared, dims: int, k: int, floor: float):
    """Of one group the best members of every query; in a list that is one group each pair is looked at once, for both."""

    def run(rows: pa.Table) -> pa.Table:
        model = shared.value
        kind = rows.column("kind")[0].as_py()
        words = model[kind][2]
        role = np.asarray(rows.column("role"))
        ids = np.asarray(rows.column("id").to_pylist(), object)
        x = unit(np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32).reshape(-1, dims))
        packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        slack = np.asarray(rows.column("slack"))
        lists = np.frombuffer(b"".join(rows.column("lists").to_pylist()), np.int32).reshape(len(x), -1)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(ids))
        queries, members = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        both = bool((role == 3).all())
        # one more dimension adds the error of the code to the product with it
        asked = np.concatenate([x[queries], np.ones((len(queries), 1))], axis=1).astype(np.float32)
        coded = np.concatenate([decode(unpack(packed[members], len(words)), words), slack[members, None]], axis=1).astype(np.float32)
        least = np.full(len(x), floor)  # what a partner must reach: the k-th best so far, if there are as many
        best, pending, n_pending = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0
        for b in range(0, len(queries), TILE_QUERIES):
            q = queries[b : b + TILE_QUERIES]
            for a in range(b if both else 0, len(members), TILE_MEMBERS):
                m = members[a : a + TILE_MEMBERS]
                reach = coded[a : a + TILE_MEMBERS] @ asked[b : b + TILE_QUERIES].T
                kept = reach >= np.float32(floor)
                if np.count_nonzero(kept) * 16 > kept.size:
                    needed = np.minimum(least[q][None, :], least[m][:, None]) if both else np.broadcast_to(least[q], kept.shape)
                    kept &= reach >= needed
                if np.count_nonzero(kept) * 16 > kept.size:
                    exact = np.round(x[m] @ x[q].T, 12)
                    exact[m[:, None] <= q[None, :] if both else m[:, None] == q[None, :]] = -2
                    i, j = np.nonzero(kept & (exact >= _reached(exact, needed, k)))
                    score = exact[i, j]
                else:
                    i, j = np.divmod(np.flatnonzero(kept), kept.shape[1])
                    apart = m[i] > q[j] if both else m[i] != q[j]
                    i, j = i[apart], j[apart]
                    score = np.round(np.einsum("ij,ij->i", x[m[i]], x[q[j]]), 12)
                i, j = m[i], q[j]
                to_query, to_member = score >= least[j], (score >= least[i]) & both
                pending.append((np.r_[j[to_query], i[to_member]], np.r_[i[to_query], j[to_member]], np.r_[score[to_query], score[to_member]]))
                n_pending += len(pending[-1][0])
                if n_pending >= max(PENDING, len(best[0])):
                    best, pending, n_pending = _best(*(np.concatenate(c) for c in zip(best, *pending)), rank, k), [], 0
                    owner, first, count = np.unique(best[0], return_index=True, return_counts=True)
                    full = count == k
                    least[owner[full]] = np.maximum(floor, best[2][first[full] + k - 1])
        i, j, score = _best(*(np.concatenate(c) for c in zip(best, *pending)), rank, k)
        # one of the k best of all is one of the k best in every list that both are in: the first of those gives it
        common = (lists[i][:, :, None] == lists[j][:, None, :]).any(axis=2)
        given = np.where(common, lists[i], np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max) == rows.column("list")[0].as_py()
        i, j, score = i[given], j[given], score[given]
        return pa.table({"kind": pa.array([kind] * len(i), pa.string()), "id": pa.array(ids[i], pa.string()), "neighbor_id": pa.array(ids[j], pa.string()), "cosine": pa.array(score, pa.float64())})

    return run


def _reached(exact: np.ndarray, needed: np.ndarray, k: int) -> np.ndarray:
    """What a score of a tile must reach to be one of the k best, ties included, of its row or its column."""
    of_row = np.partition(exact, -k, axis=1)[:, -k] if exact.shape[1] > k else np.full(len(exact), -1.0)
    of_column = np.partition(exact, -k, axis=0)[-k] if len(exact) > k else np.full(exact.shape[1], -1.0)
    return np.maximum(needed, np.minimum(of_row[:, None], of_column[None, :]))


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best partners of each row; ties go to the smaller id."""
    order = np.lexsort((rank[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    keep = place < k
    return i[keep], j[keep], score[keep]
