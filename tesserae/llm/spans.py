"""Long spans shared verbatim between texts, by a parse of every text relative to indexed reference blocks.

1. Index. Reference blocks are runs of half the span length, chosen by content: of every window of positions the one
   whose block has the smallest hash. Any run of the full span length is a window, so wherever two texts share such a
   run both have a block inside it, at the same place of the run. Kept are blocks of two texts at least; the reference
   of a block is its first place: the smallest (text, place).
2. Parse. Each text is factored left to right. At a block that the index knows the copy of its reference is followed
   from block to block, as far as every text that has the block goes on alike (the stretch from a block to its next is
   compared by hash). The factor is that longest common copy: (start, length, reference text, place there), and the
   next one begins where it ends. A factor of the span length is a shared span of all texts that have it.
3. Factor boundaries. Where texts with the same block go on differently, to the left or to the right, a factor ends; a
   shared run may lie across. There the characters around the block are compared: every run of the span length over
   the block is a key, first in coarse steps (a shorter run that several of them contain), then, for coarse keys that
   two texts have, one by one.

That is all: a shared run of the span length holds a block of both texts. If one of the blocks in it is a boundary, its
keys meet; if none is, both texts go on alike up to blocks that are not wholly in the run, so the run lies in a common
factor. Texts that share a factor or key are its members, and pairs are made from members only when asked for. Texts
that are equal as a whole are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Characters hashed at once; longer texts are taken in overlapping slices.
SLICE = 1_000_000
#: Coarse keys of a boundary block.
COARSE = 4
#: Multipliers of the two independent hashes.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    if (size, which) not in _powers:
        if len(_powers) > 8:
            _powers.clear()
        base = _BASES[which]
        up, down = np.full(size, base, np.uint64), np.full(size, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[size, which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[size, which]
    return up[:n], down[:n]


class RunHashes:
    """64-bit hashes of any runs of a text's characters; equal runs have equal hashes."""

    def __init__(self, codes: np.ndarray, which: int = 0) -> None:
        up, self.down = _power_tables(len(codes) + 1, which)
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + _BASES[which]) * up[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[stop] - self.prefix[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return _mix((self.prefix[width:] - self.prefix[:-width]) * self.down[:n] + np.uint64(width))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def choose_blocks(texts: list[str], span: int) -> tuple[np.ndarray, ...]:
    """Of texts put one after the other, all at once: the number of each reference block's text, its place there, its
    hash, and a hash of how the text goes on from it to the block before and the one after (0 if either is missing).

    Of each window the block with the smallest upper hash bits is chosen, the rightmost of ties: the choice depends on
    the window's characters only. Blocks that follow each other are a window apart at most.
    """
    block = span // 2
    window = span - block + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    codes = _codes("".join(texts))
    found, hashes = [], []
    for at in range(0, len(codes) - span + 1, SLICE):
        h = RunHashes(codes[at : at + SLICE + span - 1]).all(block)
        n = len(h)
        ranked = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64))
        padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = ranked
        rows = padded.reshape(-1, window)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
        first = np.arange(at, at + len(least))
        whole = first + span <= ends[np.searchsorted(ends, first, side="right")]  # windows within one text
        chosen = np.unique(0xFFFFFF - (least[whole] & np.uint64(0xFFFFFF)).astype(np.int64))
        found.append(at + chosen)
        hashes.append(h[chosen])
    place, first = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_index=True)
    hashed = np.concatenate([np.empty(0, np.uint64), *hashes])[first]
    owner = np.searchsorted(ends, place, side="right")
    way = np.zeros(len(place), np.uint64)
    links = np.zeros(max(0, len(place) - 1), np.uint64)
    for at in range(0, len(codes), SLICE):
        own = np.flatnonzero((place[:-1] >= at) & (place[:-1] < at + SLICE) & (owner[:-1] == owner[1:]))
        if len(own):
            runs = RunHashes(codes[at : at + SLICE + window + block], 1)
            links[own] = runs.of(place[own] - at, place[own + 1] + block - at)
    if len(place) > 2:
        inner = (owner[:-2] == owner[1:-1]) & (owner[2:] == owner[1:-1])
        ways = _mix(_mix(_mix(links[:-1] ^ hashed[:-2]) ^ links[1:]) ^ hashed[2:]) | np.uint64(1)
        way[1:-1] = np.where(inner, ways, np.uint64(0))
    return owner, place - begins[owner], hashed, way


@dataclass
class SharedSpans:
    """``members``: (doc, class_id, n_chars, ...), every text of at least the span length; a class is texts equal as a whole.
    ``factors``: (doc, start, length, ref_doc, ref_start), the parse of each class: its factors of the span length.
    ``shared``: (how, one, two, doc), the classes that have one factor or boundary run in common; runs with the same
    classes are given once. ``intervals``: (doc, start, stop), the shared parts of each class, as pieces that may
    overlap. Null, empty and short texts are nowhere."""

    members: DataFrame
    factors: DataFrame
    shared: DataFrame
    intervals: DataFrame

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: all pairs of texts that share a span, those of one class included."""
        m, run = self.members, ["how", "one", "two"]
        left, right = self.shared.withColumnRenamed("doc", "doc_a"), self.shared.withColumnRenamed("doc", "doc_b")
        links = left.join(right, run).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
        a, b = m.select(F.col("doc").alias("x"), F.col("class_id").alias("doc_a")), m.select(F.col("doc").alias("y"), F.col("class_id").alias("doc_b"))
        across = links.join(a, "doc_a").join(b, "doc_b").select("x", "y")
        within = a.join(b, F.col("doc_a") == F.col("doc_b")).where("x < y").select("x", "y")
        return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def spans(self) -> DataFrame:
        """(doc, start, length): the maximal shared parts of every text, disjoint and not touching."""
        sizes = self.members.groupBy("class_id", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
        whole = sizes.where("copies > 1").select(F.col("class_id").alias("doc"), F.lit(0).alias("start"), F.col("n_chars").alias("stop"))
        pieces = self.intervals.unionByName(whole).distinct()
        w = Window.partitionBy("doc").orderBy("start", "stop")
        ahead = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("start") <= F.col("ahead"), 0).otherwise(1)).over(w)
        joined = pieces.withColumn("ahead", ahead).withColumn("island", island).groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        of_class = joined.select(F.col("doc").alias("class_id"), "start", (F.col("stop") - F.col("start")).alias("length"))
        return self.members.select("doc", "class_id").join(of_class, "class_id").select("doc", "start", "length")


def shared_spans(df: DataFrame, key: Column, text: Column, span: int = 200) -> SharedSpans:
    """Runs of at least ``span`` characters, compared exactly, that two texts with different ``key`` share.

    ``key`` is an integer and names one text; repeated rows of it count once, of different texts under one key the one
    with the smallest hash counts. Rows with a null key or text take no part. Other columns are pruned, whatever their names. An empty table gives empty results.
    """
    if span < 4:
        raise ValueError("a span has at least 4 characters")
    work = Scratch(df.sparkSession, "spans")
    rows = df.select(key.cast("bigint").alias("doc"), text.alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    blocks, members = _index(work, rows, span)
    parsed = _parse(work, blocks, members, span)
    factors = parsed.select("doc", F.explode("factors").alias("f")).select("doc", "f.*")
    contexts, held = _boundaries(work, parsed, members, rows, span)
    runs = _runs_in_common(work, contexts, span)

    # texts of one factor or run; of those with the same texts one is enough
    by_run = runs.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor(F.xxhash64("c", "d")).alias("x"), F.bit_xor(F.xxhash64("d", "c")).alias("y"))
    once = by_run.groupBy("n", "low", "high", "x", "y").agg(F.min(F.struct("one", "two")).alias("run")).select("run.one", "run.two")
    of_runs = runs.select("one", "two", "c", "d").join(once, ["one", "two"]).join(held.select("c", "d", "doc").distinct(), ["c", "d"])
    of_factors = factors.select(F.lit("factor").alias("how"), F.col("ref_doc").alias("one"), F.col("ref_start").cast("bigint").alias("two"), "doc")
    texts = work.put(of_factors.unionByName(of_runs.select(F.lit("run").alias("how"), "one", "two", "doc")).distinct(), "texts")
    sets = texts.groupBy("how", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    distinct = sets.where("low < high").groupBy("n", "low", "high", "x", "y").agg(F.min(F.struct("how", "one", "two")).alias("run")).select("run.*")
    shared = texts.join(distinct, ["how", "one", "two"])

    # shared runs one after the other are one interval of their context
    w = Window.partitionBy("c", "d").orderBy("shift")
    places = runs.select("c", "d", "shift").distinct()
    islands = places.withColumn("island", F.col("shift") - F.row_number().over(w)).groupBy("c", "d", "island").agg(F.min("shift").alias("first"), F.max("shift").alias("last"))
    across = held.join(islands, ["c", "d"]).select("doc", (F.col("place") + F.col("first")).alias("start"), (F.col("place") + F.col("last") + span).alias("stop"))
    inside = factors.select("doc", "start", (F.col("start") + F.col("length")).alias("stop"))
    return SharedSpans(members.select("doc", "class_id", "n_chars"), factors, shared, inside.unionByName(across))


def _index(work: Scratch, rows: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Every text's blocks, and the classes of equal texts."""
    marked = rows.withColumns({"n_chars": F.length("text"), "one": F.xxhash64("text"), "two": F.xxhash64("text", F.lit(1))})
    blocks = work.put(marked.mapInArrow(_choose(span), "doc bigint, n_chars int, one bigint, two bigint, places array<int>, hashes array<bigint>, ways array<bigint>"), "blocks")
    keys = blocks.groupBy("doc").agg(F.min(F.struct("one", "two", "n_chars")).alias("k")).select("doc", "k.*")
    classes = keys.groupBy("one", "two", "n_chars").agg(F.min("doc").alias("class_id"))
    return blocks, work.put(keys.join(classes, ["one", "two", "n_chars"]), "members")


def _parse(work: Scratch, blocks: DataFrame, members: DataFrame, span: int) -> DataFrame:
    """(doc, factors, ends) of each class: its long factors and the places of its boundary blocks."""
    chosen = blocks.join(members.where("doc = class_id").select("doc", "one", "two"), ["doc", "one", "two"], "left_semi")
    placed = chosen.select("doc", F.posexplode(F.arrays_zip("places", "hashes", "ways")).alias("i", "b"))
    placed = placed.select("doc", "i", F.col("b.places").alias("place"), F.col("b.hashes").alias("hash"), F.col("b.ways").alias("way"))
    alike = (F.min("way") == F.max("way")) & (F.min("way") != 0)
    index = placed.groupBy("hash").agg(F.min(F.struct("doc", "place")).alias("ref"), F.max("doc").alias("high"), alike.alias("alike"))
    index = index.where("ref.doc < high").select("hash", "alike", "ref")
    known = placed.select("doc", "i", "place", "hash").join(index, "hash")
    lined = known.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("i", "place", "alike", F.col("ref.doc").alias("ref_doc"), F.col("ref.place").alias("ref_place")))).alias("at"))
    return work.put(lined.mapInArrow(_factor(span), "doc bigint, factors array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>, ends array<int>"), "parsed")


def _boundaries(work: Scratch, parsed: DataFrame, members: DataFrame, rows: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Contexts: the distinct characters around boundary blocks that a run of the span length can cover, with their least
    and greatest text; and the places that have each."""
    ends = parsed.where(F.size("ends") > 0).select("doc", "ends").join(members.select("doc", "one", "two"), "doc")
    whole = ends.join(rows, "doc").where((F.xxhash64("text") == F.col("one")) & (F.xxhash64("text", F.lit(1)) == F.col("two")))
    around = whole.select("doc", "ends", "text").mapInArrow(_around(span), "doc bigint, place int, lead int, around string")
    around = work.put(around.withColumns({"c": F.xxhash64("lead", "around"), "d": F.xxhash64("lead", "around", F.lit(1))}), "around")
    contexts = around.groupBy("c", "d").agg(F.first("lead").alias("lead"), F.first("around").alias("around"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    return work.put(contexts, "contexts"), around.select("c", "d", "doc", "place")


def _runs_in_common(work: Scratch, contexts: DataFrame, span: int) -> DataFrame:
    """(one, two, c, d, low, high, shift): the runs over boundary blocks that two texts have."""
    two_texts = lambda keys, by: keys.groupBy(*by).agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select(*by)
    coarse = work.put(contexts.select("c", "d", "lead", "around", "low", "high").mapInArrow(_coarse_keys(span), "c bigint, d bigint, low bigint, high bigint, step int, one bigint, two bigint"), "coarse")
    by = ["step", "one", "two"]
    steps = coarse.join(two_texts(coarse, by), by).groupBy("c", "d").agg(F.bit_or(F.expr("shiftleft(1, step)")).cast("int").alias("steps"))
    fine = contexts.join(steps, ["c", "d"]).select("c", "d", "low", "high", "lead", "around", "steps").mapInArrow(_fine_keys(span), "c bigint, d bigint, low bigint, high bigint, shift int, one bigint, two bigint")
    fine = work.put(fine, "fine")
    return work.put(fine.join(two_texts(fine, ["one", "two"]), ["one", "two"]), "runs")


def _choose(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin = batch.column(1).to_pylist(), 0
            while begin < len(texts):
                end, size = begin + 1, len(texts[begin])
                while end < len(texts) and size + len(texts[end]) <= SLICE:
                    size, end = size + len(texts[end]), end + 1
                owner, *columns = choose_blocks(texts[begin:end], span)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=end - begin))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (columns[0].astype(np.int32), *(c.view(np.int64) for c in columns[1:]))]
                rest = [batch.column(i).slice(begin, end - begin) for i in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*rest, *lists], ["doc", "n_chars", "one", "two", "places", "hashes", "ways"])
                begin = end

    return run


def _factor(span: int):
    """The parse of texts whose known blocks are given in order: from block to block while all texts go on alike."""
    block = span // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            i, place, alike, ref_doc, ref_place = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in lists.flatten().flatten())
            follows = np.r_[False, (owner[1:] == owner[:-1]) & (i[1:] == i[:-1] + 1)] if len(i) else np.empty(0, bool)
            joined = follows & alike & np.r_[False, alike[:-1]] if len(i) else follows
            first = np.flatnonzero(alike & ~joined)
            last = np.flatnonzero(alike & ~np.r_[joined[1:], False]) if len(i) else first
            # a block where all go on alike has known neighbours in its text: the factor reaches to both
            start, stop = place[first - 1], place[last + 1] + block if len(last) else last
            long = stop - start >= span
            first, start, length = first[long], start[long], (stop - start)[long]
            per_text = np.bincount(owner[first], minlength=len(sizes)) if len(first) else np.zeros(len(sizes), int)
            ref_start = ref_place[first] - (place[first] - start)
            structs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(ref_doc[first], pa.int64()), pa.array(ref_start, pa.int32())], ["start", "length", "ref_doc", "ref_start"])
            factors = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32)), structs)
            parts = ~alike.astype(bool)
            counts = np.bincount(owner[parts], minlength=len(sizes))
            ends = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(place[parts], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), factors, ends], ["doc", "factors", "ends"])

    return run


def _around(span: int):
    """The characters around each boundary block that a run of the span length over the block can cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = span - span // 2
        for batch in batches:
            out = []
            for doc, ends, text in zip(*(c.to_pylist() for c in batch.columns)):
                for p in ends:
                    begin = max(0, p - side)
                    out.append((doc, p, p - begin, text[begin : p + span]))
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "place", "lead", "around"])

    return run


def _step_bounds(span: int) -> list[tuple[int, int]]:
    """The first and last number of characters left of the block in the runs of each coarse step."""
    side = span - span // 2
    return [(s * side // COARSE, (s + 1) * side // COARSE - (s < COARSE - 1)) for s in range(COARSE)]


def _hashed(batch: pa.RecordBatch, lead_column: int) -> tuple[np.ndarray, np.ndarray, list[RunHashes]]:
    """Where each context's block and end are in the batch's characters put one after the other, and their hashes."""
    texts = batch.column(lead_column + 1).to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(np.r_[0, sizes[:-1]]) if len(sizes) else sizes
    codes = _codes("".join(texts))
    return begin + np.asarray(batch.column(lead_column)), begin + sizes, [RunHashes(codes, w) for w in (0, 1)]


def _coarse_keys(span: int):
    """Of each context, for each step, what all runs of the step have in common; none if the context is too short."""
    block = span // 2
    side = span - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, end, hashes = _hashed(batch, 2)
            lead = np.asarray(batch.column(2))
            rows, steps, ones, twos = [], [], [], []
            for step, (least, most) in enumerate(_step_bounds(span)):
                stop = at + block + side - most
                own = np.flatnonzero((lead >= least) & (stop <= end))
                rows.append(own)
                steps.append(np.full(len(own), step, np.int32))
                for out, h in ((ones, hashes[0]), (twos, hashes[1])):
                    out.append(h.of(at[own] - least, stop[own]).view(np.int64))
            take = pa.array(np.concatenate(rows))
            own = [batch.column(i).take(take) for i in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(steps)), pa.array(np.concatenate(ones)), pa.array(np.concatenate(twos))], ["c", "d", "low", "high", "step", "one", "two"])

    return run


def _fine_keys(span: int):
    """Of each context every run of the span length over its block in the steps given, and where it begins beside the block."""
    bounds = _step_bounds(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, end, hashes = _hashed(batch, 4)
            lead, steps = np.asarray(batch.column(4)), np.asarray(batch.column(6))
            rows, shifts = [], []
            for step, (least, most) in enumerate(bounds):
                for left in range(least, most + 1):
                    own = np.flatnonzero(((steps >> step) & 1 == 1) & (lead >= left) & (at - left + span <= end))
                    rows.append(own)
                    shifts.append(np.full(len(own), -left, np.int32))
            row, shift = np.concatenate(rows), np.concatenate(shifts)
            start = at[row] + shift
            keys = [h.of(start, start + span).view(np.int64) for h in hashes]
            own = [batch.column(i).take(pa.array(row)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shift), *map(pa.array, keys)], ["c", "d", "low", "high", "shift", "one", "two"])

    return run
