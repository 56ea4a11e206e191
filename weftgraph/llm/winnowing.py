"""Benchmark decontamination by winnowing, in DataFrame functions only.

An 8-word window holds five 4-grams, and the least of their hashes is the window's fingerprint:
winnowing with k = 4 and w = 5, which never misses a shared span of w + k - 1 = 8 words.  Distinct
fingerprints of the documents are joined with those of the benchmark; in documents that share one,
the windows with a shared fingerprint are extended to their whole 8 words and joined as text, so
that the result is exact.  Benchmark items of fewer than 8 words are one window of their own
length; each length below 8 that occurs (seven at most) has grams of that length.

No side is broadcast by hand: the planner does so only for a side that is small as measured.

Defined results: a null text has no words; repeated rows each get the same result; an item with a
null id can't be named and is left out; repeated items count once by id; an empty benchmark or an
empty table gives no hits or no rows.  Columns other than the id and the text are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import keyed, same_row

WINDOW, GRAM = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: With windows of this many items a document is reported as contaminated.
MIN_ITEMS = 2


def words_of(text: Column) -> Column:
    """Words of a text: A-Z in lower case, runs of ASCII letters, digits and all other characters beyond ASCII."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _places(n: Column, length: int) -> Column:
    """0 .. n - length, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _fingerprints(words: Column, length: int) -> Column:
    """The fingerprint of each window of the given length, in order."""
    n = F.size(words)
    if length < WINDOW:
        return F.transform(_places(n, length), lambda i: F.xxhash64(F.lit(length), *[F.get(words, i + j) for j in range(length)]))
    return F.transform(_places(n, WINDOW), lambda i: F.array_min(F.slice(F.col("_grams"), i + 1, WINDOW - GRAM + 1)))


def _grams(words: Column) -> Column:
    return F.transform(_places(F.size(words), GRAM), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]))


def _with_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_words", words_of(F.col("_text"))).withColumn("_grams", _grams(F.col("_words")))


def _windows(rows: DataFrame, lengths: list[int], only: Column | None = None) -> DataFrame:
    """Rows _start, _length, _window (its text) of the windows, of all or those whose fingerprint is in ``only``."""
    keep = [c for c in rows.columns if c not in ("_words", "_grams", "_text", "_hits")]

    def part(length: int) -> Column:
        each = F.transform(_fingerprints(F.col("_words"), length), lambda f, i: F.struct(i.alias("_start"), f.alias("_fp")))
        if only is not None:
            each = F.filter(each, lambda x: F.array_contains(only, x["_fp"]))
        return F.transform(each, lambda x: F.struct(x["_start"].alias("_start"), F.lit(length).alias("_length"), x["_fp"].alias("_fp"), F.array_join(F.slice(F.col("_words"), x["_start"] + 1, length), " ").alias("_window")))

    return rows.select(*keep, F.inline(F.concat(*map(part, lengths))))


def benchmark_windows(benchmark: DataFrame, item_id: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """Windows of the items (_item, _length, _fp, _window), and the window lengths that occur.

    An item's windows have 8 words, or all its words if it has fewer; the lengths are eight numbers
    at most, whatever the benchmark's size, and the only thing that is collected.
    """
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("_item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).where("_item is not null")
    rows = _with_words(rows).withColumn("_size", F.least(F.size("_words"), F.lit(WINDOW))).where("_size > 0")
    lengths = sorted((r[0] for r in rows.select("_size").distinct().collect()), reverse=True) or [WINDOW]
    found = _windows(rows, lengths).where("_length = _size").select("_item", "_length", "_fp", "_window").distinct()
    return found, lengths


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (_id, _th, _text) and, for those with occurring windows, _id, _th, starts, items.

    ``starts`` is an array of (start, length) of the occurring windows and ``items`` one of the ids
    of items with them.  Both are bounded by the text and the benchmark of one document.
    """
    rows = keyed(docs, id_col, text_col)
    bench, lengths = benchmark_windows(benchmark, item_id, item_text)
    prints = bench.select("_fp").distinct()
    own = _with_words(rows).select("_id", "_th", F.explode(F.array_distinct(F.concat(*[_fingerprints(F.col("_words"), n) for n in lengths]))).alias("_fp"))
    hits = own.join(prints, "_fp", "left_semi").groupBy("_id", "_th").agg(F.collect_set("_fp").alias("_hits"))
    again = rows.alias("r").join(hits.withColumnsRenamed({"_id": "_hid", "_th": "_hth"}), F.col("r._id").eqNullSafe(F.col("_hid")) & (F.col("r._th") == F.col("_hth"))).select("r._id", "r._th", "r._text", "_hits")
    spans = _windows(_with_words(again), lengths, F.col("_hits"))
    found = spans.join(bench.select("_item", "_window"), "_window").groupBy("_id", "_th").agg(F.collect_set(F.struct("_start", "_length")).alias("starts"), F.collect_set("_item").alias("items"))
    return rows, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_items: int = MIN_ITEMS) -> DataFrame:
    """Per row: the id, n_words, n_hit, n_items, items (sorted array of strings), contaminated."""
    rows, found = find_windows(docs, benchmark, id_col, text_col, item_id, item_text)
    # words inside any window: starts in order, each adds what lies beyond the furthest end so far
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["_start"] + x["_length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["_start"] + x["_length"] - F.greatest(a["end"], x["_start"]))).cast("long").alias("n"))
    found = found.select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), F.aggregate(F.array_sort("starts"), state, step)["n"].alias("n_hit"), F.array_sort("items").alias("items"))
    counted = rows.select("_id", "_th", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    out = counted.join(found, counted["_id"].eqNullSafe(found["_fid"]) & (counted["_th"] == found["_fth"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.size(items) >= min_items).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that hold no window of any item.

    One occurring window is enough to drop a document: a passage of a single item leaks it as well.
    (``contaminated`` of the report asks for ``MIN_ITEMS`` items.)
    """
    _, found = find_windows(docs, benchmark, id_col, text_col, item_id, item_text)
    bad = found.select("_id", "_th")
    key = keyed(docs, id_col, text_col).columns  # names that the join adds and takes away again
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias(key[0]), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias(key[1]))
    return packed.join(bad, same_row(packed, bad), "left_anti").select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS rid FROM documents),
b AS (SELECT item_id::varchar AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, i, dw.k AS k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
