"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's 5-word shingles are labelled by their occurrence (first, second, ...), so that repetition
counts.  Each of ``SKETCHES`` hash functions picks the ``PICKED`` least of them and keeps those in
text order; two texts share such a key with a probability that falls with edits and with moved
parts.  Texts that share a key are candidates.  A candidate pair is aligned, word by word, in a band
around the diagonal as wide as the threshold allows; its edit similarity is the share of aligned
words among all words of both, ``2 m / (a + b)``, and pairs of at least ``SIMILARITY`` are linked.
Classes are the connected components of the links.

Exact copies (the same words in the same order, by a 128-bit BLAKE2 digest of all of them) are one text
from the start, which has a number of its own.  Texts are aligned by their words, not by hashes.  Three
steps then find the links, each on what the one before leaves in several components.  In each bucket
of the first ``STAR`` hash functions every text is aligned with the bucket's first text (in one of
``LEADS`` orders), so copies are never expanded into all pairs.  In every bucket that holds several components, one text of each is
aligned with one of the least component, by a hash of text and bucket, so that a text meets many.  In
the buckets that are still mixed (those of a passage that many unrelated texts share, or of a family
of texts that are mostly less similar than the threshold) every pair of texts of different components
is compared: by their lengths and by ``CELLS`` counts of hashed words (if these differ by more than a
fifth of the words of both, so do the words), which leaves few; those by the words that they have in
common (one matrix product for a block of texts), and if all allow the threshold by alignment.  Such a
bucket is cut, in the order of its components, into parts that meet in tasks of their own; parts of
one and the same component don't meet.  Nothing is capped: all texts that share a key and are similar
come into one class.  The last step is quadratic in the texts of a mixed bucket.  No step brings a
whole bucket to one task: least and greatest members are aggregates, and parts are numbered by range
partitions.

One changed word spoils five shingles, so short texts have keys of k = 1: those of up to ``SHORT``
words pick ``PICKED_WORDS`` least labelled words, wherever the edits are; those of up to ``TINY``
words also have keys of all their words but up to a third, in every choice, which no pair at the
threshold can miss.  Texts of at least two thirds of ``SHORT`` words have keys of shingles; lengths
of a pair at the threshold are within that ratio, so both of any such pair have keys of one kind.
A pair at similarity s by replaced words, evenly likely everywhere, has the shingle overlap
``q = s**5 / (2 - s**5)`` and shares no key of ``SKETCHES`` with a probability of
``(1 - q**2)**64``: 0.08 at 0.8, 0.005 at 0.85, 1e-5 at 0.9 (more where edits are strewn evenly over
long texts); of short texts at 0.8 0.01 at most, mostly 1e-3.

Defined results: words are runs of anything but ASCII white space; a null text or one without
words is in a class of its own; repeated rows share a class; class ids are the least id in the class (null ids only where all are null, and each row of
those is then a class of its own).  Columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import _mix, by_group, chunks, keyed, pack_texts, packed, parts, plausible, shuffle_joins, utf8, words
from weftgraph.operators.fixpoint import component_labels, cut, forget, release

SHINGLE, SKETCHES, PICKED, PICKED_WORDS = 5, 64, 2, 5
#: Hash functions whose buckets are aligned with one text of each first, and orders in which that is the first:
#: a family's texts meet several of it, as one alone may be unlike most others.
STAR, LEADS = 16, 3
#: Similarity of at least 4 / 5, in integers: 5 m >= 2 (a + b).
SIMILARITY = 0.8
#: Words of a text that has keys of words, and of one that has keys of its words with some left out.
SHORT, TINY = 64, 9
#: Shingles hashed at once by all functions.
BLOCK = 1 << 13
#: Texts and words in a part of a mixed bucket; a task holds two parts at once.
PART, PART_WORDS = 1024, 1 << 21
#: Counts of a text's hashed words, and texts whose counts are compared at once.
CELLS, ROWS = 128, 128
#: Pairs that are aligned without counting common words first, and words counted at once.
FEW, COLUMNS = 32, 4096
_A = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a text with these word hashes."""
    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence numbers."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    occurrence = np.empty(len(s), np.uint64)
    place = np.arange(len(s))
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mix(s + occurrence * np.uint64(0xD1342543DE82EF95))


def _least(v: np.ndarray, picked: int) -> np.ndarray:
    """Places of the least values of each row, in no order; ``v`` is spoilt."""
    rows, out = np.arange(len(v)), []
    for k in range(min(picked, v.shape[1])):
        if k:
            v[rows, out[-1]] = np.iinfo(np.uint64).max
        out.append(v.argmin(1))
    return np.stack(out, 1)


def sketch(s: np.ndarray, picked: int, kind: int) -> np.ndarray:
    """Keys of a text with these shingles (or words), one for each hash function."""
    x = labelled(s)
    best = [i + _least(x[i : i + BLOCK] * _A[:, None], picked) for i in range(0, len(x), BLOCK)]
    own = np.concatenate(best, axis=1)
    if len(best) > 1:  # the least of each block, and of those the least
        own = np.take_along_axis(own, _least(x[own] * _A[:, None], picked), 1)
    own.sort(axis=1)
    key = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(kind * SKETCHES)
    for j in range(own.shape[1]):
        key = _mix(key * np.uint64(0xAF251AF3B0F025B5) + s[own[:, j]])
    return key


@cache
def _choices(n: int) -> list[np.ndarray]:
    """Places of n words with none, one, ... and n / 3 left out: a row for each choice."""
    return [np.array(list(combinations(range(n), n - left)), np.int64) for left in range(n // 3 + 1)]


def text_keys(h: np.ndarray) -> np.ndarray:
    """All keys of a text with these word hashes; of each kind in the order of the hash functions."""
    out = []
    if 3 * len(h) >= 2 * SHORT:
        out.append(sketch(shingles(h), PICKED, 0))
    if 6 <= len(h) <= SHORT:
        out.append(sketch(h, PICKED_WORDS, 1))
    for places in _choices(len(h)) if len(h) <= TINY else []:
        key = np.full(len(places), 2 * SKETCHES, np.uint64)
        for own in h[places].T:
            key = _mix(key * np.uint64(0xAF251AF3B0F025B5) + own)
        out.append(key)
    return np.concatenate(out)


def named(rows: DataFrame) -> DataFrame:
    """Of _id, _th, _text with words: _id, _th, _digest (of the text's words in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(2))
            own = [data[i:j].tobytes().split() for i, j in zip(at, at[1:], strict=False)]
            made = pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in own], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], ["_id", "_th", "_digest"])

    return rows.select("_id", "_th", "_text").mapInArrow(run, "_id long, _th long, _digest binary").where("_digest is not null")


def sketches(texts: DataFrame) -> DataFrame:
    """Of _node, _packed: both, _n (words), _counts (of hashed words, 255 at most each), _keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = pack_texts(b.column(1))
            for i, j in chunks(at):
                w = words(data, at[i : j + 1])
                keys = [text_keys(w.hash[w.first[d] : w.first[d + 1]]) for d in range(j - i)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
                owner = np.repeat(np.arange(j - i), w.counts)
                counts = np.bincount(owner * CELLS + (w.hash >> np.uint64(32)).astype(np.int64) % CELLS, minlength=(j - i) * CELLS)
                counts = np.minimum(counts, 255).astype(np.uint8).reshape(j - i, CELLS)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(w.counts, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary()), lists], ["_node", "_packed", "_n", "_counts", "_keys"])

    return texts.select("_node", "_packed").mapInArrow(run, "_node long, _packed binary, _n int, _counts binary, _keys array<long>")


def numbered(texts: list[bytes]) -> list[np.ndarray]:
    """The words of packed texts as numbers, equal only for equal words."""
    seen: dict[bytes, int] = {}
    return [np.array([seen.setdefault(w, len(seen)) for w in zlib.decompress(t).split()], np.uint32) for t in texts]


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Most words of a and b that can be aligned in order within the band that SIMILARITY allows; 0 if too few."""
    need = -(-2 * (len(a) + len(b)) // 5)
    band = max(len(a), len(b)) - need
    if need > min(len(a), len(b)):
        return 0
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    where = np.searchsorted(values, a)
    of_a = np.bincount(where, minlength=len(values))
    if np.minimum(of_a, counts - of_a).sum() < need:
        return 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    got = head + tail + _banded(where[head : len(a) - tail].tolist(), np.searchsorted(values, b)[head : len(b) - tail].tolist(), band)
    return got if got >= need else 0


def _banded(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of a and b with |i - j| <= band, by bits of one integer that slides along the diagonal."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(a):
        places.setdefault(v, []).append(i)
    base, width, row, settled = 0, 0, 0, 0  # the row's bits stand for a[base : base + width]; a zero is a match counted
    for j, v in enumerate(b):
        top = min(len(a), j + band + 1)
        if top > base + width:
            row |= ((1 << (top - base - width)) - 1) << width
            width = top - base
        if (low := j - band) - base >= 2048:  # places below the band are settled
            drop = min(low - base, width)
            settled += drop - (row & ((1 << drop) - 1)).bit_count()
            row, base, width = row >> drop, base + drop, width - drop
        if v in places:
            own = places[v]
            match = 0
            for p in own[bisect_left(own, max(base, low)) : bisect_left(own, top)]:
                match |= 1 << (p - base)
            if u := row & match:
                row = ((row + u) | (row - u)) & ((1 << width) - 1)
    return settled + width - row.bit_count()


def may_align(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether texts of n and m words whose counts differ by so much can be similar."""
    return (5 * np.minimum(n, m) >= 2 * (n + m)) & (5 * apart <= n + m)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that are linked; texts: _node, _packed."""
    left = texts.select(F.col("_node").alias("a"), F.col("_packed").alias("pa"))
    right = texts.select(F.col("_node").alias("b"), F.col("_packed").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([i for i in range(batch.num_rows) if aligned(*numbered([batch.column(c)[i].as_buffer() for c in (2, 3)]))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with words (_id, _th, _node), and links between different texts (a, b).

    All steps are joins by shuffle, so that no side is collected on the driver.
    """
    with shuffle_joins(rows.sparkSession):
        return _links(rows)


def _links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = cut(named(rows))
    # a text's number means the text and nothing else, however many texts there are
    nodes = cut(found.groupBy("_digest").agg(F.min(F.struct("_id", "_th")).alias("_row")).withColumn("_node", F.monotonically_increasing_id()))
    made = cut(found.join(nodes.select("_digest", "_node"), "_digest").select("_id", "_th", "_node"))
    texts = packed(rows, nodes)
    whole = cut(sketches(texts))
    release(rows.sparkSession)
    keys = whole.select("_node", F.posexplode("_keys").alias("_pos", "_key")).select("_key", "_node", (F.col("_pos") % SKETCHES < STAR).alias("_first"))
    # texts that share a key with another: rows of three numbers
    lead = F.min_by("_node", F.xxhash64("_node", F.pmod("_key", F.lit(LEADS))))
    shared = keys.groupBy("_key").agg(lead.alias("_lead"), F.count("*").alias("_texts")).where("_texts > 1").drop("_texts")
    buckets = cut(keys.join(shared, "_key"))
    texts = cut(whole.join(buckets.select("_node").distinct(), "_node", "left_semi").drop("_keys"))
    for done in (found, nodes, whole):
        forget(done)
    del keys, shared
    release(rows.sparkSession)
    signs = texts.select("_node", "_n", F.col("_counts").alias("_signs"))
    star = buckets.where("_first and _node <> _lead").select(F.least("_lead", "_node").alias("a"), F.greatest("_lead", "_node").alias("b")).distinct()
    found = cut(similar(plausible(star, signs, may_align), texts))
    # one text for each component of a bucket, with that of the least component
    ones = _ones(buckets, _labelled(found, signs))
    least = ones.groupBy("_key").agg(F.min(F.struct("_comp", "_one")).alias("_least"))
    star = ones.join(least, "_key").where("_comp <> _least._comp").select(F.least("_least._one", "_one").alias("a"), F.greatest("_least._one", "_one").alias("b")).distinct()
    found = cut(found.unionByName(similar(plausible(star, signs, may_align), texts)).distinct())
    about = cut(_labelled(found, signs))
    more = _across(_mixed(buckets, ones, about), texts)
    release(rows.sparkSession)
    return made, cut(found.unionByName(more).distinct())


def _labelled(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each text its words (_n) and its component by the links so far (_comp)."""
    labels = component_labels(found, "a", "b").withColumnsRenamed({"id": "_node", "component": "_comp"})
    return nodes.select("_node", "_n").join(labels, "_node", "left").select("_node", "_n", F.coalesce("_comp", "_node").alias("_comp"))


def _several(rows: DataFrame) -> DataFrame:
    """Keys of rows (_key, _comp) of more than one component."""
    return rows.groupBy("_key").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_key")


def _ones(buckets: DataFrame, about: DataFrame) -> DataFrame:
    """Of buckets (_key, _node) in several components a row for each component (_key, _comp), however many texts it has, with one of its texts (_one)."""
    placed = buckets.select("_key", "_node").join(about.select("_node", "_comp"), "_node")
    every = cut(placed.groupBy("_key", "_comp").agg(F.min_by("_node", F.xxhash64("_node", "_key")).alias("_one")))
    ones = cut(every.join(_several(every), "_key", "left_semi"))
    forget(every)
    return ones


def _mixed(buckets: DataFrame, ones: DataFrame, about: DataFrame) -> DataFrame:
    """Of buckets (_key, _node) the rows of those whose components before (ones) are still several, with the component (_comp) and words (_n) of each text."""
    still = _several(ones.select("_key", F.col("_one").alias("_node")).join(about, "_node"))
    return cut(buckets.select("_key", "_node").join(still, "_key", "left_semi").join(about, "_node").select("_key", "_node", "_comp", "_n"))


def _across(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Of buckets (_key, _node, _comp, _n) linked pairs (a, b) of different components, enough to connect all that are similar.

    Two parts of a bucket meet in one group, which a task goes through as its rows arrive, unless
    both hold texts of one component only.  Texts meet by their counts first; the words of those that
    a text of the group may be similar to are sent after them.
    """
    own = cut(parts(buckets, PART, PART_WORDS))
    about = own.groupBy("_key", "_part").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi"))
    i, j = about.toDF("_key", "_i", "_ilo", "_ihi"), about.toDF("_key", "_j", "_jlo", "_jhi")
    meet = i.join(j, "_key").where("_i <= _j and (_ilo < _ihi or _jlo < _jhi or _ilo <> _jlo)").where("_i < _j or _ilo < _ihi").select("_key", "_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_part"))
    group = ["_key", "_i", "_j"]
    sent = own.join(meet, ["_key", "_part"]).join(texts.select("_node", "_n", "_counts"), "_node").select(*group, "_part", "_node", "_comp", "_n", "_counts")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_group(batches, 3):
            part, comp, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (3, 5, 6))
            counts = np.frombuffer(b"".join(x.as_py() for b in held for x in b.column(7)), np.uint8).reshape(-1, CELLS)
            some = pa.array(np.flatnonzero(may_be_similar(part, comp, n, counts)))
            yield pa.Table.from_batches(held).select(range(6)).take(some).combine_chunks().to_batches()[0] if len(some) else held[0].select(range(6)).slice(0, 0)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_group(batches, 3):
            part, node, comp = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (3, 4, 5))
            found = linked_across(part, node, comp, numbered([x.as_buffer() for b in held for x in b.column(6)]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    dealt = lambda rows: rows.repartition(*group).sortWithinPartitions(*group, "_node")
    few = cut(dealt(sent).mapInArrow(likely, "_key long, _i int, _j int, _part int, _node long, _comp long"))
    return dealt(few.join(texts.select("_node", "_packed"), "_node").select(*few.columns, "_packed")).mapInArrow(linked, "a long, b long").distinct()


def may_be_similar(part: np.ndarray, comp: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts of one group have another (of another component and, if there are two parts, part) that lengths and counts allow to be similar."""
    out, two = np.zeros(len(n), bool), part.min() != part.max()
    wide = counts.astype(np.int16)
    for i in range(0, len(n), ROWS):
        rows = slice(i, i + ROWS)
        both = n[rows, None] + n[None, i:]
        good = (comp[rows, None] != comp[None, i:]) & (5 * np.minimum(n[rows, None], n[None, i:]) >= 2 * both)
        if two:
            good &= part[rows, None] != part[None, i:]
        a, b = np.nonzero(good)
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            near = 5 * np.abs(wide[i + x] - wide[i + y]).sum(1, dtype=np.int64) <= both[x, y]
            out[i + x[near]] = out[i + y[near]] = True
    return out


def linked_across(part: np.ndarray, node: np.ndarray, comp: np.ndarray, hashes: list[np.ndarray]) -> list[tuple[int, int]]:
    """Linked pairs of the texts of one group, of different components and, if there are two parts, of different parts.

    Once two components are linked here, their other pairs would add nothing and aren't aligned.
    """
    sizes = np.array([len(h) for h in hashes])
    good = np.triu(comp[:, None] != comp[None], 1) & (5 * np.minimum(sizes[:, None], sizes[None]) >= 2 * (sizes[:, None] + sizes[None]))
    if part.min() != part.max():
        good &= part[:, None] != part[None]
    if not good.any():
        return []
    some = np.flatnonzero(good.any(0) | good.any(1))
    if good.sum() > FEW:
        good[np.ix_(some, some)] &= 5 * _common([labelled(hashes[i].astype(np.uint64)) for i in some]) >= 2 * (sizes[some][:, None] + sizes[some][None])
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    out = []
    for i, j in np.argwhere(good).tolist():
        a, b = top(int(comp[i])), top(int(comp[j]))
        if a != b and aligned(hashes[i], hashes[j]):
            up[max(a, b)] = min(a, b)
            out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = counts > 1
    owner, column = owner[kept[column]], (np.cumsum(kept) - 1)[column[kept[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2**24 words
    for start in range(0, int(kept.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        out += has @ has.T
    return out.astype(np.int64)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, class_id (the least id in its class), class_size (rows), n_verified (the links with its text that were verified on the way; pairs in one class are not all compared)."""
    rows = keyed(docs, id_col, text_col)
    made, found = links(rows)
    labels = component_labels(found, "a", "b").withColumnsRenamed({"id": "_lnode", "component": "_comp"})
    placed = made.join(labels, made["_node"] == F.col("_lnode"), "left").withColumn("_comp", F.coalesce("_comp", "_node"))
    # copies are counted by text first; a table of its own, so that adaptive execution can split a very large class in the join
    texts = placed.groupBy("_comp", "_node").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    ids = cut(texts.groupBy("_comp").agg(F.min("_id").alias("_class"), F.sum("_n").alias("_size")))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("_dnode")).agg(F.count("*").alias("_links"))
    known = placed.join(ids.withColumnRenamed("_comp", "_icomp"), F.col("_comp") == F.col("_icomp")).join(degree, F.col("_node") == F.col("_dnode"), "left")
    known = known.select("_id", "_class", "_size", F.coalesce("_links", F.lit(0)).cast("long").alias("_links"))
    bare = rows.where(~F.col("_text").rlike(r"[^\x20\x09-\x0D]")).select("_id", F.col("_id").alias("_class"), F.lit(1).cast("long").alias("_size"), F.lit(0).cast("long").alias("_links"))
    return known.unionByName(bare).select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"), F.col("_size").alias("class_size"), F.col("_links").alias("n_verified"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents, with all their columns: of each class the one of least id (then of least text hash), and all without words."""
    rows = keyed(docs, id_col, text_col)
    made, found = links(rows)
    labels = component_labels(found, "a", "b").withColumnsRenamed({"id": "_lnode", "component": "_comp"})
    placed = made.join(labels, made["_node"] == F.col("_lnode"), "left").withColumn("_comp", F.coalesce("_comp", "_node"))
    stays = placed.groupBy("_comp").agg(F.min(F.struct("_id", "_th")).alias("_row")).select(F.col("_row._id").alias("_kid"), F.col("_row._th").alias("_kth"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_th"))
    has_words = F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    kept = packed.where(has_words).join(stays, packed["_id"].eqNullSafe(F.col("_kid")) & (packed["_th"] == F.col("_kth"))).dropDuplicates(["_id", "_th"]).select("_row.*")
    return kept.unionByName(packed.where(~has_words).select("_row.*"))
