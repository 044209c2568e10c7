"""Mixing sources to target weights by balanced sampling (cube method).

For each mix and source the wanted tokens over the tokens at hand say how often each text is used: the whole part for
all of them, the rest as an inclusion probability for one use more. The flight phase moves those probabilities through
the null space of the two balancing constraints, the sum of tokens and the number of texts, three texts at a time, until
each is 0 or 1 but for at most two. It runs in blocks of texts; what each block leaves over, with the constraints still
met exactly, makes the blocks of the next round, until one block per source is left. Landing then decides its last
texts so that the token total is off least.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Texts in a block of the flight phase.
BLOCK_ROWS = 4096
_EDGE = 1e-9
_PARTS = "mix string, source string, doc bigint, n_tokens bigint, base int, chance double"


def flight(tokens: list[int], chance: list[float], rng: random.Random) -> None:
    """Moves ``chance`` in place; at most two of them stay strictly between 0 and 1. Keeps the sum of ``chance`` and
    that of ``tokens`` x ``chance``."""
    active: list[int] = []
    for k in range(len(tokens)):
        if not _EDGE < chance[k] < 1 - _EDGE:
            chance[k] = float(round(chance[k]))
            continue
        active.append(k)
        while len(active) == 3 or len(active) == 2 and tokens[active[0]] == tokens[active[1]]:
            if len(active) == 3:
                a, b, c = active
                move = (tokens[b] - tokens[c], tokens[c] - tokens[a], tokens[a] - tokens[b])
                if move == (0, 0, 0):
                    move = (1, -1, 0)
            else:
                move = (1, -1)
            up = down = float("inf")
            for i, u in zip(active, move):
                if u > 0:
                    up, down = min(up, (1 - chance[i]) / u), min(down, chance[i] / u)
                elif u < 0:
                    up, down = min(up, chance[i] / -u), min(down, (1 - chance[i]) / -u)
            step = up if rng.random() * (up + down) < down else -down
            for i, u in zip(active, move):
                chance[i] += step * u
            left = [i for i in active if _EDGE < chance[i] < 1 - _EDGE]
            for i in active:
                if i not in left:
                    chance[i] = float(round(chance[i]))
            if len(left) == len(active):  # rounding kept the nearest one off its edge
                i = min(left, key=lambda i: min(chance[i], 1 - chance[i]))
                chance[i] = float(round(chance[i]))
                left.remove(i)
            active = left


def land(tokens: list[int], chance: list[float], repairs: int = 3) -> None:
    """Decides the last texts: of all ways the one whose tokens, then number, are nearest to what is wanted. A last text
    may be very long; what the total is then off by is made up for by turning at most ``repairs`` decided texts."""
    left = [i for i, p in enumerate(chance) if _EDGE < p < 1 - _EDGE]
    wanted, number = sum(tokens[i] * chance[i] for i in left), sum(chance[i] for i in left)
    ways = [[i for b, i in enumerate(left) if way >> b & 1] for way in range(1 << len(left))]
    taken = min(ways, key=lambda w: (abs(sum(tokens[i] for i in w) - wanted), abs(len(w) - number), w))
    for i in left:
        chance[i] = float(i in taken)
    over = sum(tokens[i] for i in taken) - wanted
    free = [i for i in range(len(tokens)) if i not in left]
    for _ in range(repairs):
        turn = min((i for i in free if (chance[i] == 1) == (over > 0)), key=lambda i: (abs(tokens[i] - abs(over)), i), default=None)
        if turn is None or abs(tokens[turn] - abs(over)) >= abs(over):
            break
        over += tokens[turn] if chance[turn] == 0 else -tokens[turn]
        chance[turn] = 1 - chance[turn]
        free.remove(turn)


def _fly(last: bool, seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc")
        tokens, chance = rows.column("n_tokens").to_pylist(), rows.column("chance").to_pylist()
        rng = random.Random(f"{seed}/{'/'.join(str(k.as_py()) for k in key)}")
        order = list(range(len(tokens)))
        rng.shuffle(order)
        mixed_tokens, mixed = [tokens[i] for i in order], [chance[i] for i in order]
        flight(mixed_tokens, mixed, rng)
        if last:
            land(mixed_tokens, mixed)
        for i, p in zip(order, mixed):
            chance[i] = p
        names = ["mix", "source", "doc", "n_tokens", "base"]
        return pa.table({**{c: rows.column(c) for c in names}, "chance": pa.array(chance, pa.float64())})

    return run


def mix_sources(documents: DataFrame, key: Column, source: Column, tokens: Column, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    ``targets`` has mix, source, weight, max_repeats and size_ratio. The weights of a mix are taken relative to their
    sum; a null weight is 0, null max_repeats 1, null size_ratio 1, of repeated rows of a (mix, source) the one with
    the largest weight counts, rows without a mix or source are dropped. A source gets its weight of size_ratio x all
    tokens of ``documents`` (those of no source included), or, if that is more than max_repeats times its tokens, all
    it has so often: other sources don't make up for it, and the report shows it. ``key`` is an integer; repeated rows
    of a key count once; texts without tokens, null keys and null sources are never selected. Other columns are pruned,
    whatever their names. Empty tables give an empty selection and a report of zeros.

    selection: (mix, source, doc, copies, n_tokens), 1 <= copies <= max_repeats. shares: (mix, source, weight,
    target_tokens, available_tokens, tokens, n_documents, n_copies, share, capped), share being of the mix's tokens.
    """
    spark = documents.sparkSession
    work = Scratch(spark, "mixing")
    docs = documents.select(key.cast("bigint").alias("doc"), source.alias("source"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n_tokens"))
    docs = docs.groupBy("doc").agg(F.max("n_tokens").alias("n_tokens"), F.min("source").alias("source"))
    docs = work.put(docs.where(F.col("doc").isNotNull() & (F.col("n_tokens") > 0)).select("doc", "source", "n_tokens"), "docs")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n"))
    sizes = work.put(sizes, "sizes")
    total = sizes.agg(F.sum("have")).first()[0] or 0
    rows = targets.where("mix is not null and source is not null").groupBy("mix", "source").agg(F.max_by(F.struct("weight", "max_repeats", "size_ratio"), F.coalesce("weight", F.lit(0.0))).alias("t"))
    rows = rows.select("mix", "source", F.greatest(F.coalesce("t.weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("t.max_repeats", F.lit(1)), F.lit(0)).alias("most"), F.coalesce("t.size_ratio", F.lit(1.0)).alias("ratio"))
    sums = rows.groupBy("mix").agg(F.sum("weight").alias("sum"))
    rows = rows.join(sums, "mix").withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") / F.col("sum")).otherwise(0.0))
    rows = rows.join(sizes.where("source is not null"), "source", "left").select("mix", "source", "weight", "most", (F.col("weight") * F.col("ratio") * F.lit(total)).alias("wanted"), F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("n", F.lit(0)).alias("n"))
    uses = F.when(F.col("have") > 0, F.least(F.col("wanted") / F.col("have"), F.col("most").cast("double"))).otherwise(0.0)
    plan = work.put(rows.withColumn("uses", uses).withColumn("base", F.floor("uses").cast("int")), "plan")

    used = docs.join(plan.where("uses > 0").select("mix", "source", "uses", "base", "n"), "source")
    blocks = F.pmod(F.xxhash64("doc", "mix"), F.ceil(F.col("n") / BLOCK_ROWS))
    units = used.select("mix", "source", "doc", "n_tokens", "base", (F.col("uses") - F.col("base")).alias("chance"), blocks.alias("block"))
    whole = units.where(F.col("chance") <= _EDGE).select("mix", "source", "doc", "n_tokens", "base", F.lit(0.0).alias("chance"))
    done = [whole]
    waiting = units.where(F.col("chance") > _EDGE)
    most = plan.agg(F.max("n")).first()[0] or 0
    turn = 0
    while True:
        last = most <= BLOCK_ROWS
        flown = work.put(waiting.groupBy("mix", "source", "block").applyInArrow(_fly(last, seed + turn), _PARTS), f"flown-{turn}")
        between = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.where(~between))
        if last:
            break
        turn += 1
        left = flown.where(between)
        most = left.groupBy("mix", "source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        waiting = left.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(max(1, -(-most // BLOCK_ROWS)))))
    selection = done[0]
    for part in done[1:]:
        selection = selection.unionByName(part)
    copies = (F.col("base") + F.col("chance").cast("int")).alias("copies")
    selection = selection.select("mix", "source", "doc", copies, "n_tokens").where("copies > 0")
    got = selection.groupBy("mix", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"))
    got = work.put(got, "got")
    sums = got.groupBy("mix").agg(F.sum("tokens").alias("all"))
    shares = plan.join(got, ["mix", "source"], "left").join(sums, "mix", "left").select(
        "mix", "source", "weight", F.col("wanted").alias("target_tokens"), F.col("have").alias("available_tokens"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "n_documents", "n_copies")),
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), (F.col("wanted") > F.col("have") * F.col("most")).alias("capped"),
    )
    return selection, shares
