"""What the corpus operators share: table access, checkpoints, and vectorised word hashing.

The hashing kernels work on the UTF-8 bytes of an Arrow string column.  A chunk of documents
becomes a few numpy arrays; there is no Python loop over words.
"""

from __future__ import annotations

import hashlib
import secrets
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import cut
from weftgraph.operators.fixpoint import delete_folder as delete_folder
from weftgraph.operators.fixpoint import ensure_checkpoint_dir as ensure_checkpoint_dir
from weftgraph.operators.fixpoint import folder_exists as folder_exists

#: Words of most contracts are runs of bytes other than ASCII white space; all of UTF-8's other
#: bytes belong to words, so that bytes and code points give the same words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once by the kernels; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator uses, under names of its own.

    ``_id`` and ``_th`` (a hash of the text) together name a row's content: repeated rows share
    them, and so each of them gets the same result.
    """
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_th"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(f"_{c}") for c in more])


def same_row(a: DataFrame, b: DataFrame):
    """Join condition on the name of a row's content, with null ids equal to each other."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together have at most so many bytes, or one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def new_key() -> int:
    """A secret for one run's hashes, drawn on the driver: no text can be made to collide under it beforehand."""
    return secrets.randbits(64)


def _keys(key: int, lane: int) -> list[np.uint64]:
    """Four odd numbers that a secret and a lane stand for."""
    out, state = [], np.array([key % (1 << 64)], np.uint64)
    for k in range(4):
        state = _mix(state + np.uint64((0x9E3779B97F4A7C15 * (1 + 8 * lane + k)) % (1 << 64)))
        out.append(state[0] | np.uint64(1))
    return out


#: Bytes of a word that are hashed in blocks; longer words by BLAKE2.
BLOCKS = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int, lane: int) -> np.ndarray:
    """64-bit hashes of the byte ranges, each block of 8 bytes mixed into the state of those before it."""
    k0, k1, k2, k3 = _keys(key, lane)
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,)) if len(data) else np.zeros(1, np.uint64)
    out = _mix((block[start] & _MASK[np.minimum(size, 8)]) + k0)
    live = np.flatnonzero(size > 8)
    for j in range(8, BLOCKS, 8):
        if not len(live):
            break
        out[live] = _mix((out[live] ^ (block[start[live] + j] & _MASK[np.minimum(size[live] - j, 8)])) + k1)
        live = live[size[live] > j + 8]
    secret = int(k2).to_bytes(8, "little") + int(k3).to_bytes(8, "little")
    for i in live:
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=secret).digest(), "little")
    return _mix((out ^ size.astype(np.uint64)) + k3)


@dataclass
class Words:
    """Words of a chunk: byte ranges, a hash each, and the range of words of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of n documents: n + 1 offsets into the words
    key: int = 0

    def lane(self, lane: int) -> np.ndarray:
        """Hashes of the words that share nothing with those of another lane."""
        return self.hash if lane == 0 else _word_hashes(self.data, self.start, self.end, self.key, lane)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_table(separators: tuple[int, ...] = SPACE_BYTES) -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


_IS_WORD = word_table()


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD, key: int = 0) -> Words:
    """Words of the documents whose bytes are ``data[offsets[i]:offsets[i + 1]]``, hashed under a key."""
    data = np.ascontiguousarray(data[offsets[0] : offsets[-1]])
    offsets = offsets - offsets[0]
    inside = is_word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = inside[full]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, _word_hashes(data, start, end, key, 0), np.searchsorted(start, offsets), key)


def _spans(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values: of halves of halves, each mixed before it meets the next."""
    done, size, left, out = h, 1, k, None
    parts = []
    while left:
        if left & 1:
            parts.append((size, done))
        left >>= 1
        if left:
            done, size = _mix(done[:-size] * np.uint64(0xD1342543DE82EF95) + done[size:]), 2 * size
    at = 0
    for size, made in reversed(parts):
        piece = made[at : len(h) - k + 1 + at]
        out = piece if out is None else _mix(out * np.uint64(0xAF251AF3B0F025B5) + piece)
        at += size
    return out


def windows(w: Words, k: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """Windows of k words inside one document: index of the first word, 64-bit hash, and document.

    With ``second``, a hash made of other hashes of the words follows.
    """
    counts = np.maximum(w.counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) + np.repeat(w.first[:-1] - (np.cumsum(counts) - counts), counts)
    out = [_spans(w.lane(lane), k)[at] if len(at) else np.zeros(0, np.uint64) for lane in range(1 + second)]
    return at, out[0], owner, *out[1:]


def same_words(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of places a are, byte by byte, those of places b."""
    size = (w.end - w.start)[a]
    same = size == (w.end - w.start)[b]
    some = np.flatnonzero(same)
    if len(some):
        size = size[some]
        first = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(first, size)
        differ = w.data[np.repeat(w.start[a[some]], size) + within] != w.data[np.repeat(w.start[b[some]], size) + within]
        same[some] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return same


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n words are in a window of k words that begins at one of the given places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def per_document(first: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Sums over each document's words."""
    total = np.concatenate([[0], np.cumsum(of_word, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def pack_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of compressed texts, and their offsets."""
    own = [zlib.decompress(x.as_buffer()) for x in column]
    return np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)


def packed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of rows (_id, _th, _text) the ones that nodes (_node, _row: a struct of _id and _th) name: _node, _packed (the compressed text).

    Texts are most of what is shuffled, so they are compressed before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.compress(data[i:j], 1) for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["_id", "_th", "_packed"])

    by = lambda i, th: [F.coalesce(i, F.lit(0)).alias("_ik"), i.isNull().alias("_none"), th.alias("_th")]  # noqa: E731  null ids as a key of their own
    own = rows.select("_id", "_th", "_text").mapInArrow(run, "_id long, _th long, _packed binary").select(*by(F.col("_id"), F.col("_th")), "_packed")
    wanted = nodes.select(*by(F.col("_row._id"), F.col("_row._th")), "_node")
    return own.join(wanted, ["_ik", "_none", "_th"]).groupBy("_ik", "_none", "_th", "_node").agg(F.first("_packed").alias("_packed")).select("_node", "_packed")


def signatures(column: pa.Array) -> list[np.ndarray]:
    """Rows of counts, one byte each, from a binary column; a row has as many as its set asked for, a power of 2."""
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column]


#: Counts that are compared at once.
COMPARED = 1 << 22


def apart(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of differences of the counts a[i] and b[j] of each pair; the longer of two rows is folded to the shorter, whose cells are sums of its cells (255 at most)."""
    size, other = np.array([len(x) for x in a], np.int64)[i], np.array([len(x) for x in b], np.int64)[j]
    out = np.zeros(len(i), np.int64)

    def folded(own: list[np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
        rows, back = np.unique(at, return_inverse=True)
        return np.stack([np.minimum(own[x].reshape(-1, k).sum(0, dtype=np.int32), 255) for x in rows])[back]

    for n, m in np.unique(np.stack([size, other], 1), axis=0).tolist():
        some, k = np.flatnonzero((size == n) & (other == m)), min(n, m)
        step = max(1, COMPARED // k)
        for part in (some[s : s + step] for s in range(0, len(some), step)):
            out[part] = np.abs(folded(a, i[part], k) - folded(b, j[part], k)).sum(1, dtype=np.int64)
    return out


def plausible(pairs: DataFrame, nodes: DataFrame, test: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Of pairs (a, b) those whose sizes and distance of signatures pass the test, before any text is sent; nodes: _node, _n, _signs."""
    left = nodes.select(F.col("_node").alias("a"), F.col("_n").alias("na"), F.col("_signs").alias("sa"))
    right = nodes.select(F.col("_node").alias("b"), F.col("_n").alias("nb"), F.col("_signs").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(c).to_numpy().astype(np.int64) for c in (2, 3))
                every = np.arange(b.num_rows)
                some = pa.array(np.flatnonzero(test(n, m, apart(signatures(b.column(4)), signatures(b.column(5)), every, every))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some)], ["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def parts(sized: DataFrame, most: int, most_size: int) -> DataFrame:
    """Rows (_key, _node, _comp, _n) with the number of their part of the key (_part), in the order of components and nodes.

    So many rows, and so much of _n, are in a part: whichever is reached first begins another.  Rows
    are numbered within range partitions, whose own sums for each key come before; no key is one task.
    """
    dealt = cut(sized.select("_key", "_node", "_comp", F.col("_n").cast("long").alias("_n")).repartitionByRange("_key", "_comp", "_node").withColumn("_p", F.spark_partition_id()))
    order = Window.partitionBy("_p", "_key").orderBy("_comp", "_node")
    placed = dealt.withColumn("_at", F.row_number().over(order) - 1).withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    sums = dealt.groupBy("_key", "_p").agg(F.count("*").alias("_rows"), F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_p")  # a row for each range partition of the key
    sums = sums.select("_key", "_p", (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_at0"), (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_before0"))
    part = F.floor((F.col("_at") + F.col("_at0")) / most) + F.floor((F.col("_before") + F.col("_before0")) / most_size)
    return placed.join(sums, ["_key", "_p"]).select("_key", "_node", "_comp", part.cast("int").alias("_part"))


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by their first columns, one list of slices for each group of equal ones; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        names = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(keys)])
        if held and any(held[-1].column(c)[0].as_py() != names[c, 0] for c in range(keys)):
            yield held
            held = []
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k:
                yield held
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held


@contextmanager
def shuffle_joins(spark: SparkSession) -> Iterator[None]:
    """Within it adaptive execution doesn't broadcast a side of a join."""
    conf, key = spark.conf, "spark.sql.adaptive.autoBroadcastJoinThreshold"
    old = conf.get(key, None)
    conf.set(key, "-1")
    try:
        yield
    finally:
        conf.unset(key) if old is None else conf.set(key, old)
