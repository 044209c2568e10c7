"""Encoding texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; each word is merged on a contiguous rank array: the boundaries of
its parts, and beside each the rank of joining the two parts that meet after it. The smallest rank is found by a scan,
its boundary is deleted, and the two ranks next to it are refreshed. Words longer than ``SCAN_BYTES`` bytes use a heap
of the same ranks, which gives the same ids without the quadratic scan. Each worker keeps the ids of words already seen.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern by which this vocabulary cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCAN_BYTES = 400
#: Words whose ids a worker keeps; beyond that it forgets them all.
KEPT_WORDS = 1_000_000
#: Texts longer than this are not cut into words all at once.
STREAM_CHARS = 2_000_000
_NONE = 1 << 60


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one short word."""
    rank = ranks.get
    bounds = list(range(len(word) + 1))
    joins = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    joins.append(_NONE)
    while True:
        least = min(joins)
        if least == _NONE:
            break
        i = joins.index(least)
        del bounds[i + 1]
        del joins[i + 1]
        last = len(bounds) - 2
        joins[i] = rank(word[bounds[i] : bounds[i + 2]], _NONE) if i < last else _NONE
        if i:
            joins[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same merges, found by a heap over linked parts."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := ends[i]) == n or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class _Words(dict):
    """Ids by word, filled as words are first met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        data = word.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else (merge_scan if len(data) <= SCAN_BYTES else merge_heap)(data, self.ranks)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(data) <= SCAN_BYTES:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        self.words = _Words(parse_ranks(data))
        self.cut = regex.compile(pattern)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.cut.findall(text) if len(text) <= STREAM_CHARS else (m[0] for m in self.cut.finditer(text))
        return list(chain.from_iterable(map(self.words.__getitem__, words)))


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """The worker's encoder for a vocabulary; it and the words it has seen outlive a task."""
    key = zlib.crc32(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def share_vocabulary(spark: SparkSession, vocabulary: str):
    """The vocabulary file's bytes, read on the driver and broadcast; a file of fixed size, under 1 MB here."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, key: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of each row, in one pass without a shuffle. Null and empty texts have no ids: an empty list.

    Special tokens are never produced; their strings are ordinary text. Repeated rows are kept; other columns are
    pruned, whatever their names.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(key.alias("key"), text.alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            parts, offsets = [], np.zeros(len(batch) + 1, np.int32)
            for i, t in enumerate(batch.column(1)):
                parts.append(np.array(encoder.encode(t.as_py()), np.int32))
                offsets[i + 1] = offsets[i] + len(parts[-1])
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    return rows.mapInArrow(encode, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: Column, text: Column, *carry: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, carried columns...): as ``encode_texts``, but only the number of ids leaves the worker."""
    shared = share_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(text.alias("__text"), key.alias("key"), *carry)
    kept = [f for f in rows.schema.fields if f.name != "__text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            n = pa.array([len(encoder.encode(t.as_py())) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*(f.name for f in kept), "n_tokens"])

    return rows.mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint"]))
