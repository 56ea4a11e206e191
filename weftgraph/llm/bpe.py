"""Byte-level BPE by a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary (hash and displace, built once on the
driver) takes every distinct pre-token of a batch, vectorised in numpy, to the one slot it could
have; its bytes are then compared, so that a pre-token in the vocabulary resolves to its id without
merging.  Second tier: a pre-token that isn't there is merged with a heap of adjacent pairs over a
doubly linked list of its bytes, in n log n steps however long it is.

Defined results: a null or empty text has no ids; other columns of the input stay as they are, but
one that is named like a column made here gives way to it.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import _mix, chunks, utf8

#: Bytes of text (or one document) whose pre-tokens are held at once, and merged pre-tokens that are remembered.
BATCH_BYTES, REMEMBERED = 1 << 21, 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[at[i]:at[i + 1]], by Horner's rule over all strings at once."""
    size, out = np.diff(at), np.full(len(at) - 1, 0x1234567, np.uint64)
    order = np.argsort(-size, kind="stable")
    lengths = size[order]
    for j in range(int(size.max(initial=0))):
        live = order[: np.searchsorted(-lengths, -j, "left")]  # strings longer than j
        out[live] = (out[live] ^ data[at[live] + j]) * _P
        out[live] ^= out[live] >> np.uint64(29)
    return _mix(out ^ size.astype(np.uint64))


def _long_hash(data: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Hashes of strings of up to ``most`` bytes; longer ones can't be in the vocabulary and get 0."""
    fits = np.flatnonzero(np.diff(at) <= most)
    size = np.diff(at)[fits]
    to = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(to[-1]) + np.repeat(at[fits] - to[:-1], size)
    out = np.zeros(len(at) - 1, np.uint64)
    out[fits] = _hash(data[index], to)
    return out


@dataclass
class PerfectHash:
    """Minimal perfect hash of n byte strings: bucket -> displacement -> one of n slots."""

    shift: np.ndarray  # of each bucket
    key_at: np.ndarray  # n + 1 offsets of the keys, in slot order
    keys: np.ndarray
    value: np.ndarray
    longest: int

    @staticmethod
    def slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (_mix(h + shift.astype(np.uint64) * _P) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, entries: dict[bytes, int], per_bucket: int = 4) -> PerfectHash:
        keys = sorted(entries, key=entries.get)
        n, data = len(keys), np.frombuffer(b"".join(keys), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        h = _hash(data, at)
        if len(np.unique(h)) != n:
            raise ValueError("two keys of the vocabulary have the same 64-bit hash")
        buckets = max(1, n // per_bucket)
        of = (h % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(buckets + 1))
        shift, taken, slot = np.zeros(buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        tries = np.arange(512)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            own = by[edges[b] : edges[b + 1]]
            d = 0
            while len(own):  # displacements in blocks: the first that sends the bucket to free and different slots
                to = cls.slots(h[own][None, :], (d + tries)[:, None], n)
                good = ~taken[to].any(1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(to, 1), axis=1) > 0).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    shift[b], slot[own] = d + k, to[k]
                    taken[to[k]] = True
                    break
                d += len(tries)
        order = np.argsort(slot)
        size = np.diff(at)[order]
        return cls(shift, np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(keys[i] for i in order), np.uint8), np.array([entries[keys[i]] for i in order], np.int64), int(size.max()))

    def find(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The value of each byte string data[at[i]:at[i + 1]], or -1; bytes are compared, not hashes."""
        n, size = len(self.value), np.diff(at)
        h = _long_hash(data, at, self.longest)
        slot = self.slots(h, self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)], n)
        same = np.flatnonzero((np.diff(self.key_at)[slot] == size) & (size > 0))
        length = size[same]
        to = np.concatenate([[0], np.cumsum(length)])[:-1]
        step = np.arange(length.sum())
        differ = data[step + np.repeat(at[same] - to, length)] != self.keys[step + np.repeat(self.key_at[slot[same]] - to, length)]
        good = same[np.add.reduceat(differ, to) == 0] if len(same) else same
        out = np.full(len(size), -1, np.int64)
        out[good] = self.value[slot[good]]
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, leftmost first, is joined until none is in the vocabulary.

    ``end[i]`` is where the part that begins at byte i ends, and so where the next one begins (0 if
    no part begins there); ``before[i]`` is where the part before it begins.
    """
    n, get = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # a part of the pair has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Numbers(dict):
    """Numbers keys by first appearance."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Codec:
    """Encoder and decoder of one vocabulary; made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash):
        self.ranks, self.split, self.table = ranks, regex.compile(pattern).findall, table
        self.remembered: dict[bytes, bytes] = {}
        top = max(ranks.values()) + 1
        parts = [b""] * top
        for k, v in ranks.items():
            parts[v] = k
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def pieces(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings, one after the other, and len + 1 offsets."""
        data = np.frombuffer(b"".join(distinct), np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct)))])
        found = self.table.find(data, at)
        missed = np.flatnonzero(found < 0)
        merged = [self._merged(distinct[i]) for i in missed.tolist()]
        size = np.ones(len(distinct), np.int64)
        size[missed] = lengths = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(offsets[-1], np.int32)
        whole = np.flatnonzero(found >= 0)
        flat[offsets[whole]] = found[whole]
        start = np.cumsum(lengths) - lengths
        flat[np.arange(lengths.sum()) + np.repeat(offsets[missed] - start, lengths)] = np.frombuffer(b"".join(merged), np.int32)
        return flat, offsets

    def _merged(self, piece: bytes) -> bytes:
        """Ids of a pre-token that isn't in the vocabulary, as int32."""
        if (ids := self.remembered.get(piece)) is None:
            ids = array("i", merge(piece, self.ranks)).tobytes()
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            if len(piece) <= 64:
                self.remembered[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, and len + 1 offsets."""
        parts = [self.split(t or "") for t in texts]
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        number = _Numbers()
        index = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, edge[-1])
        del parts
        flat, at = self.pieces([x.encode() for x in number])
        size = np.diff(at)[index]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat[np.arange(total[-1]) + np.repeat(at[index] - total[:-1], size)], total[edge]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the sequences of ids, one after the other, and len + 1 offsets."""
        size = (self.at[1:] - self.at[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) + np.repeat(self.at[ids] - total[:-1], size)
        return self.blob[index], total[offsets]


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    ranks = read_ranks(path)
    return ranks, PerfectHash.build(ranks)


_codecs: dict[int, Codec] = {}


def shared_codec(spark: SparkSession, path: str, pattern: str):
    """Broadcast of a vocabulary and its perfect hash (bounded by the vocabulary file); call the result in a worker."""
    sent = spark.sparkContext.broadcast((*_table(path), pattern))

    def get() -> Codec:
        ranks, table, split = sent.value
        if id(ranks) not in _codecs:
            _codecs.clear()
            _codecs[id(ranks)] = Codec(ranks, split, table)
        return _codecs[id(ranks)]

    return get


def _sizes(column: pa.ListArray) -> np.ndarray:
    return np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], offsets: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of bounded bytes, so that what a worker holds doesn't depend on the batch."""
    for b in batches:
        if b.num_rows:
            for i, j in chunks(offsets(b), BATCH_BYTES):
                yield b.slice(i, j - i)


def encode(docs: DataFrame, text_col: str, path: str, pattern: str, ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the array of ids of each text; with ``check_col``, whether the ids decode to the text's bytes."""
    codec = shared_codec(docs.sparkSession, path, pattern)
    names = [ids_col] + [check_col] * bool(check_col)
    text, keep = docs.columns.index(text_col), [i for i, c in enumerate(docs.columns) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, lambda b: utf8(b.column(text))[1]):
            flat, at = codec().encode(b.column(text).to_pylist())
            made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))]
            if check_col:
                data, ends = codec().decode(flat, at)
                own, begins = utf8(b.column(text))
                made.append(pa.array([np.array_equal(data[ends[i] : ends[i + 1]], own[begins[i] : begins[i + 1]]) for i in range(b.num_rows)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *made], [*[b.schema.names[i] for i in keep], *names])

    return docs.mapInArrow(run, T.StructType([*[docs.schema.fields[i] for i in keep], T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(check_col, T.BooleanType())] if check_col else [])]))


def decode(rows: DataFrame, ids_col: str, path: str, pattern: str, bytes_col: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the bytes of each array of ids; a null array has none."""
    codec = shared_codec(rows.sparkSession, path, pattern)
    ids, keep = rows.columns.index(ids_col), [i for i, c in enumerate(rows.columns) if c != bytes_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, lambda b: 4 * np.concatenate([[0], np.cumsum(_sizes(b.column(ids)))])):
            column = b.column(ids)
            data, at = codec().decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(_sizes(column))]))
            made = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(at.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], made.cast(pa.binary())], [*[b.schema.names[i] for i in keep], bytes_col])

    return rows.mapInArrow(run, T.StructType([*[rows.schema.fields[i] for i in keep], T.StructField(bytes_col, T.BinaryType())]))


def digests(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """Per row: the id, n_tokens, and SHA-256 of the ids and of the bytes they decode to."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    ids = encode(rows, "_text", path, pattern, "_ids").select("_id", "_ids")
    return decode(ids, "_ids", path, pattern, "_bytes").select(F.col("_id").alias(id_col), F.size("_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("_bytes"), 256).alias("decoded_sha256"))
