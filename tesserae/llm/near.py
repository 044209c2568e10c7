"""Near-duplicate texts by the Jaccard similarity of their word n-gram sets, counted in vertical fragments.

1. Every text becomes a set of 64-bit n-gram hashes. A batch of texts sends each distinct n-gram once to the n-gram's
   fragment of the hash order, so a common n-gram costs one entry per batch and size class, not one per text. A text is
   credited for each of its n-grams that another text of a size in reach has; one whose credit is below threshold x
   size can have no partner.
2. Texts with equal sets are one class; only its representative goes on.
3. The n-grams of what is left are put into one global order, rarest first. The order is cut into vertical fragments of
   equal numbers of postings, and each text's set into its segments of them. In a fragment two texts meet at an n-gram
   if it is in the part of both sets that a partner must show; segments before and after bound what a pair can have in
   common, and pairs that can't reach the threshold are never made.
4. The overlap of a candidate pair is counted in each fragment separately, and the partial counts are summed per pair.

No step is approximate except that n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tesserae.session import Scratch

_WORD = re.compile(r"\w+")
#: Distinct words whose hashes a worker keeps, and n-grams after which a batch is sent on.
KEPT_WORDS, BATCH_GRAMS = 1_000_000, 2_000_000
#: Sizes within a factor of STEP are one size class.
STEP = 1.1
#: Vertical fragments of the global order, and parts of it that are measured to find where to cut: steps a doubling of
#: the frequency, and parts of the n-grams of one step.
FRAGMENTS, STEPS, PARTS = 8, 16, 64
#: Characters of text whose n-grams one fragment of the first step holds.
FRAGMENT_CHARS = 8_000_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def words(text: str) -> list[str]:
    """Longest runs of letters, digits, other number signs and underscores, in lower case."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


def gram_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``width`` words; none if there are fewer words."""
    found = words(text) if text else []
    if len(found) < width:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    h = np.full(len(ids) - width + 1, seed, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(h)]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def _seed(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(kind)


@dataclass
class NearDuplicates:
    """``members``: (kind, id, doc, n_grams), the class of each text that has a partner or may have one, named by the
    ``doc`` of its representative. ``links``: (doc_a, doc_b, similarity) between the representatives of two classes.
    ``alone``: (kind, id), the other texts of at least the n-gram's width."""

    members: DataFrame
    links: DataFrame
    alone: DataFrame

    def pairs(self) -> DataFrame:
        """(kind, id_a, id_b, similarity) of all pairs of texts, those of one class included."""
        m = self.members
        a = m.select("kind", F.col("id").alias("id_1"), F.col("doc").alias("doc_a"))
        b = m.select(F.col("id").alias("id_2"), F.col("doc").alias("doc_b"))
        across = self.links.join(a, "doc_a").join(b, "doc_b")
        within = a.join(b, F.col("doc_a") == F.col("doc_b")).where("id_1 < id_2").withColumn("similarity", F.lit(1.0))
        both = across.select("kind", "id_1", "id_2", "similarity").unionByName(within.select("kind", "id_1", "id_2", "similarity"))
        return both.select("kind", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), "similarity")

    def classes(self) -> DataFrame:
        """(kind, id, class_id, n_links): one row per text that takes part; class_id is the smallest id of the texts with
        an equal set, n_links the number of other classes it is similar to."""
        named = self.members.groupBy("doc").agg(F.min("id").alias("class_id"))
        ends = self.links.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
        met = self.members.join(named, "doc").join(ends, "doc", "left").select("kind", "id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return met.unionByName(self.alone.select("kind", "id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def near_duplicates(df: DataFrame, kind: Column, key: Column, text: Column, threshold: float, width: int) -> NearDuplicates:
    """Pairs of texts of one ``kind`` whose sets of ``width`` consecutive words have a similarity of ``threshold``.

    ``key`` is unique within a kind; of repeated rows of a key one must be chosen before. Rows with a null key or text
    take no part, nor do texts of fewer than ``width`` words. Other columns are pruned, whatever their names. An empty
    table gives empty results.
    """
    spark = df.sparkSession
    work = Scratch(spark, "near")
    items = df.select(kind.alias("kind"), key.cast("string").alias("id"), text.alias("text")).where("kind is not null and id is not null and text is not null")
    measured = Observation()
    items = work.put(items.withColumn("doc", F.monotonically_increasing_id() + 1).observe(measured, F.sum(F.length("text")).alias("chars")), "items")
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(measured.get["chars"] or 0) // FRAGMENT_CHARS))

    packed = items.mapInArrow(_pack(width, fragments), "fragment int, docs binary, runs binary, classes binary, hashes binary, items array<string>, sizes binary, credits binary, signatures binary")
    credits = packed.groupBy("fragment").applyInArrow(_credit(threshold), "doc bigint, credit int, n int, signature bigint, item string")
    whole = credits.groupBy("doc").agg(F.sum("credit").alias("credit"), F.max("n").alias("n"), F.max("signature").alias("signature"), F.max("item").alias("item"))
    item = F.split("item", "\u001f", 2)
    able = F.col("credit") >= F.lit(threshold) * F.col("n") - 1e-9
    whole = work.put(whole.select("doc", "n", "signature", item[0].alias("kind"), item[1].alias("id"), able.alias("able")), "whole")
    alive = whole.where("able")
    reps = alive.groupBy("kind", "signature", "n").agg(F.min("doc").alias("rep"))
    members = work.put(alive.join(reps, ["kind", "signature", "n"]).select("kind", "id", F.col("rep").alias("doc"), F.col("n").alias("n_grams"), (F.col("doc") == F.col("rep")).alias("own")), "members")

    chosen = members.where("own").select("doc", F.col("n_grams").alias("n"))
    grams = items.join(chosen, "doc").select("doc", "kind", "n", "text").mapInArrow(_grams(width), "doc bigint, n int, grams array<bigint>")
    grams = work.put(grams, "grams").select("doc", "n", F.explode("grams").alias("gram"))
    shared = work.put(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    fragment = _fragments(shared)
    least = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    ordered = grams.join(shared, "gram").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    ordered = ordered.where(F.size("grams") >= least).select("doc", "n", F.transform("grams", lambda g: F.struct(fragment(g["df"], g["gram"]).alias("f"), g["gram"].alias("gram"))).alias("grams"))
    ordered = work.put(ordered, "ordered")

    #: of the n - least + 1 first n-grams in the global order, those no other text has come first and can't meet
    visible = F.col("n") - least + 1 - (F.col("n") - F.size("grams"))
    shown = ordered.select("doc", "n", F.size("grams").alias("m"), F.posexplode(F.slice("grams", F.lit(1), visible.cast("int"))).alias("pos", "g"))
    shown = shown.select("doc", "n", "pos", (F.col("m") - F.col("pos")).alias("left"), F.col("g.f").alias("f"), F.col("g.gram").alias("gram"))
    of = lambda side: shown.select(*(F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "pos", "left")), "f", "gram")
    alike = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9
    # what comes before a common n-gram and what comes from it on bound the overlap
    reach = F.least("pos_a", "pos_b") + F.least("left_a", "left_b")
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = of("a").join(of("b"), ["f", "gram"]).where("doc_a < doc_b").where(alike).where(reach >= needed)
    candidates = work.put(met.select("doc_a", "doc_b", "n_a", "n_b").distinct(), "candidates")

    segments = F.transform(F.array_distinct("grams.f"), lambda f: F.struct(f.alias("f"), F.transform(F.filter("grams", lambda g: g["f"] == f), lambda g: g["gram"]).alias("part")))
    parts = ordered.select("doc", F.explode(segments).alias("s")).select("doc", "s.f", "s.part")
    part_a = parts.select(F.col("doc").alias("doc_a"), "f", F.col("part").alias("part_a"))
    part_b = parts.select(F.col("doc").alias("doc_b"), "f", F.col("part").alias("part_b"))
    partial = candidates.join(part_a, "doc_a").join(part_b, ["doc_b", "f"]).select("doc_a", "doc_b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
    total = partial.groupBy("doc_a", "doc_b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    links = total.where(F.col("common") >= F.lit(threshold) * union - 1e-9).select("doc_a", "doc_b", (F.col("common") / union).alias("similarity"))
    return NearDuplicates(members.drop("own"), work.put(links, "links"), whole.where("not able").select("kind", "id"))


def _fragments(shared: DataFrame):
    """The vertical fragment of an n-gram of frequency ``df``: fragments are ranges of the global order (df, n-gram) with
    about the same number of postings. The order is measured in at most STEPS a doubling times PARTS parts."""
    step = lambda df: F.floor(F.log2(df) * STEPS).cast("int")
    part = lambda gram: F.shiftright(gram, 64 - PARTS.bit_length() + 1).cast("int") + PARTS // 2
    place = lambda df, gram: step(df) * PARTS + part(gram)
    sizes = sorted((r["place"], r["n"]) for r in shared.groupBy(place(F.col("df"), F.col("gram")).alias("place")).agg(F.sum("df").alias("n")).collect())
    total, seen, cuts = sum(n for _, n in sizes), 0, []
    for at, n in sizes:
        if seen * FRAGMENTS >= total * (len(cuts) + 1):
            cuts.append(at)
        seen += n
    return lambda df, gram: reduce(lambda c, cut: c + (place(df, gram) >= cut).cast("int"), cuts, F.lit(0))


def _pack(width: int, fragments: int):
    """Batches of texts to rows of fragments: each distinct n-gram and size class of a batch once, beside its text if it
    is the only one there (else beside text 0, the texts being credited on the spot); and the texts' own figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, items, sets, signatures, waiting = [], [], [], [], 0

        def rows() -> pa.RecordBatch:
            doc = np.array(docs, np.int64)
            sizes = np.array([len(s) for s in sets], np.int32)
            size_class = np.minimum(np.log(sizes) / np.log(STEP), 255).astype(np.uint8)
            owner = np.repeat(np.arange(len(doc)), sizes)
            grams = (np.concatenate(sets) << np.uint64(8)) | size_class[owner]
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            many = np.diff(np.r_[first, len(grams)]) > 1
            repeated = np.repeat(many, np.diff(np.r_[first, len(grams)]))
            credit = np.bincount(owner[repeated], minlength=len(doc)).astype(np.int32)
            grams = grams[first]
            classes = (grams & np.uint64(255)).astype(np.int64)
            whose = np.where(many, -1 - classes, owner[first])
            fragment = ((grams >> np.uint64(40)) % np.uint64(fragments)).astype(np.int64)
            order = np.lexsort((whose, fragment))
            grams, whose, classes, fragment = (grams[order] >> np.uint64(8)).astype(np.uint32), whose[order], classes[order].astype(np.uint8), fragment[order]
            home = (doc.view(np.uint64) % np.uint64(fragments)).astype(np.int64)
            by_home = np.argsort(home, kind="stable")
            out = []
            for f in np.union1d(fragment, home):
                a, b = np.searchsorted(fragment, (f, f + 1))
                own = whose[a:b]
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if b > a else np.empty(0, np.int64)
                runs = np.diff(np.r_[start, b - a]).astype(np.int32) if b > a else np.empty(0, np.int32)
                keys = np.where(own[start] < 0, 0, doc[np.maximum(own[start], 0)]) if b > a else np.empty(0, np.int64)
                out.append((int(f), keys.tobytes(), runs.tobytes(), classes[a:b][start].tobytes(), grams[a:b].tobytes(), None, None, None, None))
                c, d = np.searchsorted(home[by_home], (f, f + 1))
                if d > c:
                    at = by_home[c:d]
                    out.append((int(f), doc[at].tobytes(), None, None, None, [items[i] for i in at], sizes[at].tobytes(), credit[at].tobytes(), np.array([signatures[i] for i in at], np.int64).tobytes()))
            names = ["fragment", "docs", "runs", "classes", "hashes", "items", "sizes", "credits", "signatures"]
            types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for kind, key, text, doc in zip(*(c.to_pylist() for c in batch.columns)):
                grams = gram_hashes(text, width, _seed(kind))
                if len(grams):
                    docs.append(doc)
                    items.append(f"{kind}\u001f{key}")
                    sets.append(grams)
                    signatures.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63))
                    waiting += len(grams)
                    if waiting >= BATCH_GRAMS:
                        yield rows()
                        docs, items, sets, signatures, waiting = [], [], [], [], 0
        if docs:
            yield rows()

    return run


def _credit(threshold: float):
    """Of one fragment: texts and the number of their n-grams that another batch has too, in a text of a size in reach;
    and the figures sent along."""
    reach = np.uint64(int(np.log(1 / threshold) / np.log(STEP)) + 1)

    def run(rows: pa.Table) -> pa.Table:
        docs, grams, own = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], {"doc": [], "credit": [], "n": [], "signature": []}
        items: list[str] = []
        for row in rows.to_pylist():
            keys = np.frombuffer(row["docs"], np.int64)
            if row["items"] is None:
                runs = np.frombuffer(row["runs"], np.int32)
                docs.append(np.repeat(keys, runs))
                grams.append((np.frombuffer(row["hashes"], np.uint32).astype(np.uint64) << np.uint64(8)) | np.repeat(np.frombuffer(row["classes"], np.uint8), runs))
            else:
                own["doc"].append(keys)
                own["credit"].append(np.frombuffer(row["credits"], np.int32))
                own["n"].append(np.frombuffer(row["sizes"], np.int32))
                own["signature"].append(np.frombuffer(row["signatures"], np.int64))
                items += row["items"]
        doc, gram = np.concatenate(docs), np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        near = ((gram[1:] >> np.uint64(8)) == (gram[:-1] >> np.uint64(8))) & (gram[1:] - gram[:-1] <= reach)
        shared = np.r_[False, near] | np.r_[near, False] if len(gram) else np.empty(0, bool)
        keys, counts = np.unique(doc[shared & (doc != 0)], return_counts=True)
        nulls = [None] * len(keys)
        ints = {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in own.items()}
        return pa.table(
            {
                "doc": pa.array(np.r_[keys, ints["doc"]], pa.int64()),
                "credit": pa.array(np.r_[counts, ints["credit"]], pa.int32()),
                "n": pa.concat_arrays([pa.array(nulls, pa.int32()), pa.array(ints["n"], pa.int32())]),
                "signature": pa.concat_arrays([pa.array(nulls, pa.int64()), pa.array(ints["signature"], pa.int64())]),
                "item": pa.array(nulls + items, pa.string()),
            }
        )

    return run


def _grams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            sets = [gram_hashes(t, width, _seed(k)).view(np.int64) for k, t in zip(kinds, texts)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc", "n", "grams"])

    return run
