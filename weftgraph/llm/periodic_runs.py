"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch with smallest period q and a length of at least 2 q that no neighbour extends.  The
text is factorised after Lempel and Ziv: each factor is a new word or the longest stretch that begins
earlier too, found by walking the text's suffix automaton, whose states know where they first end.  A
run that touches the border of two factors is found there by Main's algorithm: for each period, how far
the words agree with those one period away, to the right and to the left of the border, by Z functions
over the factor and a stretch before it of the factor's length and twice that of the one before (a run
that ends in the factor can't begin earlier).  All other runs lie strictly inside a factor, and are
copied from where the factor occurs first.  All of this is linear in the text.

Only runs of ``LEAST`` words and more count.  Such a run repeats stretches of ``LEAST // 2`` words,
which cover all of its words; so a text is first cut to the stretches that repetitions of so many words
cover, by hashes (equal stretches always have equal ones), and a text without any is done.

Each document is handled alone, in the task that reads it; nothing is shuffled.

Defined results: words are runs of anything but ASCII white space; a null or blank text has no words
and no runs; ties of the longest run go to the least start, then period; repeated rows each get the
same result.  In the query a null id plants no period.  Columns other than the id and the text are
never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import _spans, chunks, covered, new_key, utf8, words

LEAST = 12
Run = tuple[int, int, int]  # start, end, period


class SuffixAutomaton:
    """States of a sequence's stretches: transitions, and where each stretch first ends."""

    def __init__(self, w: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.first = [-1]
        link, length, last = [-1], [0], 0
        after, first = self.next, self.first
        for i, c in enumerate(w):
            new = len(after)
            after.append({})
            first.append(i)
            length.append(i + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(after)
                    after.append(after[q].copy())
                    first.append(first[q])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors: start, end, and where the factor begins first (-1 for a new word)."""
    automaton = SuffixAutomaton(w)
    after, first = automaton.next, automaton.first
    out, i, n = [], 0, len(w)
    while i < n:
        state, j, end = 0, i, -1
        while j < n:
            state = after[state][w[j]]  # there is one: all stretches of w are in its automaton
            if first[state] >= j:
                break
            end = first[state]
            j += 1
        out.append((i, j, end - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place of s how many elements agree with its beginning."""
    n = len(s)
    out, lo, hi = [n] + [0] * (n - 1) if n else [], 0, 0
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return out


def agreement(s: list[int], own: list[int], t: list[int], places: int) -> list[int]:
    """For the first places of t how many elements agree with the beginning of s, whose Z function is given."""
    n, m = len(s), len(t)
    out, lo, hi = [0] * places, 0, 0
    for i in range(places if n else 0):
        k = min(hi - i, own[i - lo]) if i < hi and i - lo < n else 0
        while k < n and i + k < m and s[k] == t[i + k]:
            k += 1
        out[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return out


def _at_border(w: list[int], low: int, border: int, high: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs of w that touch the border and end in w[border:high], by period; those that go on beyond touch the next border."""
    left, right, n = w[low:border], w[border:high], len(w)
    back, ahead = left[::-1], right[::-1]
    behind, forth = z_function(back), z_function(right)

    def add(s: int, e: int, q: int) -> None:
        whole = (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n or w[e] != w[e - q])
        if whole and found.get((s, e), q) >= q:
            found[s, e] = q

    # a period to the left of the border: how right and left agree with what is q earlier
    onward = agreement(right, forth, left + right, len(left)) if right else [0] * len(left)
    for q in range(1, len(left) + 1):
        more, less = onward[len(left) - q], behind[q] if q < len(left) else 0
        if more + less >= q and more + less + q >= least:
            add(border - q - less, border + more, q)
    # a period to the right of it
    backward = agreement(back, behind, ahead + back, len(right)) if left else [0] * len(right)
    for q in range(1, len(right) + 1):
        more, less = forth[q] if q < len(right) else 0, backward[len(right) - q]
        if more + less >= q and more + less + q >= least:
            add(border - less, border + q + more, q)


def runs(w: list[int], least: int = 2) -> list[Run]:
    """All runs of at least so many elements, by start, then period."""
    if not w:
        return []
    cut = factors(w)
    found: dict[tuple[int, int], int] = {}
    for (p, i, _), (_, j, _) in zip(cut, [*cut[1:], (len(w), len(w), -1)], strict=True):
        low = max(0, i - 2 * (i - p) - (j - i))
        if j - low >= least:
            _at_border(w, low, i, j, least, found)
    by: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in found.items():
        by.setdefault(s, []).append((e, q))
    for i, j, before in cut:
        if before < 0:
            continue
        end = before + j - i
        for s in range(before + 1, end - least):
            for e, q in by.get(s, ()):
                if e < end:
                    by.setdefault(s + i - before, []).append((e + i - before, q))
    return sorted(((s, e, q) for s, own in by.items() for e, q in own), key=lambda r: (r[0], r[2]))


def _cover(h: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Words in a stretch of k words that is found twice or more in its group; a negative group is left out.  Groups are contiguous."""
    n = len(h)
    if n < k:
        return np.zeros(n, bool)
    made = _spans(h, k)
    at = np.flatnonzero((group[: n - k + 1] == group[k - 1 :]) & (group[: n - k + 1] >= 0))
    order = at[np.lexsort((made[at], group[at]))]
    alike = (made[order][1:] == made[order][:-1]) & (group[order][1:] == group[order][:-1])
    again = np.concatenate([order[1:][alike], order[:-1][alike]])
    return covered(n, again, k)


def stretches(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that hold all runs of 2 k words and more, in documents h[first[i]:first[i + 1]]."""
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for _ in range(2):  # stretches that repeat, and of those the ones that repeat within
        on = _cover(h, group, k)
        new = on.copy()
        new[1:] &= ~on[:-1] | (group[1:] != group[:-1])
        group = np.where(on, np.cumsum(new), -1)
    last = on.copy()
    last[:-1] &= ~on[1:] | (group[1:] != group[:-1])
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    long = end - start >= 2 * k
    return start[long], end[long]


Order = Callable[[object, int], np.ndarray | None]


def _chunk(data: np.ndarray, offsets: np.ndarray, ids: list, least: int, order: Order | None, key: int) -> tuple[list[list[Run]], list[bytes], list[int]]:
    """Runs, collapsed text and number of words of each document of a chunk."""
    w = words(data, offsets, key=key)
    place = np.arange(len(w.hash))
    for d, n in enumerate(w.counts.tolist()):
        if order is not None and n and (mine := order(ids[d], n)) is not None:
            place[w.first[d] : w.first[d + 1]] = w.first[d] + mine
    found: list[list[Run]] = [[] for _ in ids]
    body = w.data.tobytes()
    start, end = w.start.tolist(), w.end.tolist()
    begins, ends = stretches(w.hash[place], w.first, least // 2)
    owner = np.searchsorted(w.first, begins, "right") - 1
    for s, e, d in zip(begins.tolist(), ends.tolist(), owner.tolist(), strict=True):
        number: dict[bytes, int] = {}
        own = [number.setdefault(body[start[i] : end[i]], len(number)) for i in place[s:e].tolist()]
        shift = s - int(w.first[d])
        found[d] += [(a + shift, b + shift, q) for a, b, q in runs(own, least)]
    texts, rel = [], offsets - offsets[0]
    for d in range(len(ids)):
        own = body[rel[d] : rel[d + 1]].split()
        mine = place[w.first[d] : w.first[d + 1]] - w.first[d]
        if found[d]:
            edge = np.zeros(len(own) + 1, np.int64)
            for a, b, q in found[d]:
                edge[a + q] += 1
                edge[b] -= 1
            mine = mine[np.cumsum(edge[:-1]) == 0]
        whole = len(mine) == len(own) and (not len(own) or bool((mine == np.arange(len(own))).all()))
        texts.append(b" ".join(own if whole else [own[i] for i in mine.tolist()]))
    return found, texts, w.counts.tolist()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, order: Order | None = None) -> DataFrame:
    """Per row: the id, n_words, runs (start, length, period; by start, then period), and the text without repetitions.

    A word is left out if a run holds it after the run's first period.  ``order`` gives for an id and a
    number of words the words' places to read them in, or None to read them as they are.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows, key = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), new_key()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in chunks(at):
                found, texts, counts = _chunk(data, at[i : j + 1], ids[i:j], least, order, key)
                flat = np.array([(s, e - s, q) for own in found for s, e, q in own], np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(one))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a document that the query makes periodic from some word on: one in ten, by the crc32 of its id."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    out = find(docs, id_col, text_col, order=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = out.withColumn("_best", best)
    return out.select(
        F.col(f"`{id_col}`"), F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
