"""Substring dedup with a count-min prefilter.

First pass: each partition hashes its 13-word windows and emits a sparse partial count-min sketch
(two rows of cells that count 0, 1, 2 or more); partials are merged cell by cell.  A cell never
holds less than the count of a window that falls on it, so a window whose two cells don't both
hold 2 occurs once.  Second pass: only windows estimated repeated are grouped, by 96 bits of two hashes
of their words, to the least id of a document with them.  Third pass: words covered by a window that
also starts in a document of a smaller id are removed.  No window that repeats is lost.

The two hashes share nothing: each word is hashed twice, under a secret that each run draws anew, and
runs of words are mixed at each step.  So no text can be made beforehand whose windows collide, and of
n windows two different ones are taken for one with a probability of n**2 / 2**97 (6e-4 at 1e13 windows).

The merged sketch is the one thing that is broadcast: ``2 * width`` bits, 64 MB at the default
width whatever the input's size.  With more windows than cells it prunes less, and the exact
grouping does more of the work; results don't change.

Skew: each task first groups what it has gathered.  Of a window it sends one claim, by the least id
there; its other documents are known to repeat it and are dealt out by document.  So a window that
every document has is one row per task where windows meet.

Defined results: a null text has no words; a document with a null id neither removes nor loses
words; rows with the same id don't remove each other's words; repeated rows each get the same
result.  Columns other than the id and the text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Words, chunks, covered, keyed, new_key, per_document, utf8, windows, words

WINDOW = 13
#: Cells in each of the sketch's two rows.
WIDTH = 1 << 28
#: Cells in a block, in which gaps start anew, and blocks in a group, which is merged at once.
BLOCK_BITS, GROUP_BITS = 16, 6
#: Cells that a task gathers before it emits them as a partial sketch.
FLUSH = 1 << 23
#: Windows that a task gathers before it groups them.
GATHER = 1 << 20


def _cells(h: np.ndarray, g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(width - 1)
    return h & mask, (g & mask) + np.uint64(width)


def _gaps(cells: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells as bytes of the gaps between them, from 0 in each block; 255 goes on to the next byte.

    Returns the bytes and len(blocks) + 1 offsets.
    """
    of = cells >> BLOCK_BITS
    gap = np.diff(cells.astype(np.int64), prepend=0)
    first = np.concatenate([[True], of[1:] != of[:-1]]) if len(cells) else np.zeros(0, bool)
    gap[first] = cells[first] & ((1 << BLOCK_BITS) - 1)
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    at = np.concatenate([np.searchsorted(of, blocks), [len(cells)]])
    return out, np.concatenate([[0], ends])[at]


def _partial(gathered: list[np.ndarray]) -> pa.RecordBatch:
    """Cells seen in a task, by block: those seen, and those seen twice or more."""
    cells = np.sort(np.concatenate(gathered).astype(np.uint32))
    new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
    again = np.concatenate([[False], (cells[1:] == cells[:-1]) & new[:-1]]) if len(cells) else new
    blocks = np.unique(cells >> BLOCK_BITS)

    def column(some: np.ndarray) -> pa.Array:
        data, at = _gaps(some, blocks)
        return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])

    return pa.RecordBatch.from_arrays([pa.array((blocks >> GROUP_BITS).astype(np.int32)), pa.array(blocks.astype(np.int32)), column(cells[new]), column(cells[again])], ["grp", "block", "once", "twice"])


def _offsets(blocks: np.ndarray, column: pa.Array) -> np.ndarray:
    """Cells within their group, from binary rows of gaps."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.int64)
    gaps = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    total = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)])
    row = np.repeat(np.arange(len(blocks)), np.diff(at))
    inside = total[1:] - total[at[:-1] - at[0]][row]
    return (inside + ((blocks & ((1 << GROUP_BITS) - 1)).astype(np.int64) << BLOCK_BITS)[row])[gaps < 255]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sketches of one group of blocks, batch by batch, to the bits of cells that hold 2 or more."""
    seen, twice, group = np.zeros(1 << (BLOCK_BITS + GROUP_BITS), bool), np.zeros(1 << (BLOCK_BITS + GROUP_BITS), bool), None
    for b in batches:
        if not b.num_rows:
            continue
        group = b.column("grp")[0].as_py()
        blocks = b.column("block").to_numpy()
        cells = np.sort(_offsets(blocks, b.column("once")))
        twice[cells[1:][cells[1:] == cells[:-1]]] = True
        twice[cells[seen[cells]]] = True
        seen[cells] = True
        twice[_offsets(blocks, b.column("twice"))] = True
    if group is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())], ["grp", "bits"])


def build_sketch(rows: DataFrame, k: int = WINDOW, width: int = WIDTH, key: int = 0) -> dict[int, bytes]:
    """The merged sketch's cells that hold 2 or more: compressed bits of each group of blocks; of bounded size."""
    text = rows.columns.index("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for b in batches:
            data, at = utf8(b.column(text))
            for i, j in chunks(at):
                _, h, _, g = windows(words(data, at[i : j + 1], key=key), k, second=True)
                gathered += [c.astype(np.uint32) for c in _cells(h, g, width)]
                n += 2 * len(h)
                if n >= FLUSH:
                    yield _partial(gathered)
                    gathered, n = [], 0
        if n:
            yield _partial(gathered)

    partial = rows.mapInArrow(run, "grp int, block int, once binary, twice binary")
    merged = partial.groupBy("grp").applyInArrow(_merge, "grp int, bits binary")
    return {group: bytes(bits) for group, bits in merged.toLocalIterator()}


_unpacked: dict[int, np.ndarray] = {}


def _bits(sketch: dict[int, bytes], width: int) -> np.ndarray:
    """The sketch's bits, unpacked once in each worker."""
    if id(sketch) not in _unpacked:
        size = (1 << (BLOCK_BITS + GROUP_BITS)) // 8
        out = np.zeros(max(2 * width // 8, size), np.uint8)
        for group, bits in sketch.items():
            out[group * size : (group + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8)
        _unpacked.clear()
        _unpacked[id(sketch)] = out
    return _unpacked[id(sketch)]


def _claims(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Windows of a task, each once per document: the least id with it claims it (_k = 0); others are known to repeat it (_k > 0)."""
    order = np.lexsort((ids, g, h))
    h, g, ids = h[order], g[order], ids[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    first = new | np.concatenate([[True], ids[1:] != ids[:-1]])
    k = np.where(new, 0, 1 + (ids & 0x3FFFFFFF)).astype(np.int32)[first]
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(g[first].view(np.int32)), pa.array(k), pa.array(ids[first])], ["_h", "_g", "_k", "_id"])


def candidates(rows: DataFrame, sketch: dict[int, bytes], k: int = WINDOW, width: int = WIDTH, key: int = 0) -> DataFrame:
    """Windows estimated repeated: _h and _g (96 bits of hash), _k, _id; claims and known repeats of each ``GATHER`` windows."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)
    text, ids = rows.columns.index("_text"), rows.columns.index("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, gathered, n = _bits(sent.value, width), [], 0
        for b in batches:
            data, at = utf8(b.column(text))
            own = b.column(ids).to_numpy()
            for i, j in chunks(at):
                _, h, owner, g = windows(words(data, at[i : j + 1], key=key), k, second=True)
                full = np.arange(len(h))
                for c in _cells(h, g, width):
                    c = c[full]
                    full = full[(bits[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                if len(full):
                    gathered.append((h[full], (g[full] >> np.uint64(32)).astype(np.uint32), own[i:j][owner[full]]))
                    n += len(full)
                if n >= GATHER:
                    yield _claims(*map(np.concatenate, zip(*gathered, strict=True)))
                    gathered, n = [], 0
        if n:
            yield _claims(*map(np.concatenate, zip(*gathered, strict=True)))

    return rows.where("_id is not null").mapInArrow(run, "_h long, _g int, _k int, _id long")


def repeated(found: DataFrame) -> DataFrame:
    """Of each id (_hid) the hashes of its windows that also start in a document of a smaller id (_hits, bounded by its texts).

    A window has one claim from each ``GATHER`` windows at most, so a window's claims are few even
    if every document has it; known repeats are dealt out by their own document.
    """
    least = F.min("_id").over(Window.partitionBy("_h", "_g", "_k"))
    hits = found.withColumn("_least", least).where((F.col("_k") > 0) | (F.col("_id") > F.col("_least")))
    return hits.groupBy(F.col("_id").alias("_hid")).agg(F.collect_set("_h").alias("_hits"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """Per row: the id, n_words, n_removed, and the kept words joined by one space."""
    rows, key = keyed(docs, id_col, text_col).select("_id", "_text"), new_key()
    hits = repeated(candidates(rows, build_sketch(rows, k, width, key), k, width, key))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(data[i:j], 1) for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["_id", "_packed"])

    # texts are shuffled compressed: they are most of what moves
    packed = rows.mapInArrow(pack, "_id long, _packed binary")
    joined = packed.join(hits, packed["_id"] == hits["_hid"], "left").select("_id", "_packed", "_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [zlib.decompress(x.as_buffer()) for x in b.column(1)]
            data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            for i, j in chunks(at):
                w = words(data, at[i : j + 1], key=key)
                place, h, owner = windows(w, k)
                edges = np.searchsorted(owner, np.arange(j - i + 1))
                own = b.column(2).slice(i, j - i)
                starts = [np.zeros(0, np.int64)]
                for d in np.flatnonzero(own.is_valid()):
                    mine = slice(edges[d], edges[d + 1])
                    starts.append(place[mine][np.isin(h[mine], own[int(d)].values.to_numpy().view(np.uint64))])
                gone = covered(len(w.hash), np.concatenate(starts), k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(w.counts, pa.int64()), pa.array(per_document(w.first, gone), pa.int64()), _kept(w, ~gone)], ["_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "_id long, n_words long, n_removed long, kept string").withColumnRenamed("_id", id_col)


def _kept(w: Words, keep: np.ndarray) -> pa.Array:
    """Texts of the kept words, joined by one space."""
    start, size = w.start[keep], (w.end - w.start)[keep]
    per = per_document(w.first, keep)
    last = np.cumsum(per)[per > 0] - 1
    size = size + 1  # with the space that follows
    size[last] -= 1
    total = np.concatenate([[0], np.cumsum(size)])
    data = np.append(w.data, np.uint8(32))[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
    spaced = np.ones(len(size), bool)
    spaced[last] = False
    data[(total[1:] - 1)[spaced]] = 32
    at = total[np.concatenate([[0], np.cumsum(per)])]
    return pa.Array.from_buffers(pa.large_string(), len(per), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
lo AS (SELECT s, min(doc_id) AS least FROM win WHERE doc_id IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN lo ON win.s = lo.s AND win.doc_id > least),
g AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
k AS (SELECT doc_id, w, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS kept FROM t LEFT JOIN g USING (rid))
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - len(kept))::bigint AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
