"""Quality rules: figures of each text, and cross-document line frequency.

Lines are normalised (lower case; everything but letters becomes one space), hashed, and the
distinct documents that have a line are counted within each host.  A document is an id with its
text: rows that repeat both count once, copies under other ids count each.  Lines above the limits
are removed, and a document that keeps too few of its words is depleted.

Limits: a line is frequent in a host if at least ``MIN_DOCS`` distinct documents and more than
``MAX_SHARE`` of the host's distinct documents have it; a document is depleted if frequent lines
hold words and what is left has fewer than ``MIN_WORDS`` words or less than ``MIN_LEFT`` of all.

Skew: counts are pre-aggregated by (host, line, document), then by (host, line), so a hot host or
line is a few partial counts; the join back is an ordinary equi-join, which adaptive execution may
broadcast when small or split when skewed.

Defined results: a null text has no words; a null host is a host of its own; repeated rows count
once and each get the same result; a text without lines loses none.  Columns other than the id,
text and host are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD_SQL, Words, chunks, covered, keyed, new_key, per_document, same_words, utf8, windows, words

MIN_DOCS, MAX_SHARE, MIN_WORDS, MIN_LEFT = 10, 0.05, 20, 0.3
REPEAT_WINDOW, BASE_MIN_WORDS, BASE_MAX_REPEAT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
#: A line without letters is no line that could be frequent.
NOT_LETTERS = r"[^\p{L}]+"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_windows(w: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """First words of the windows of k words found twice or more in one document.

    Windows of one hash count as equal only when their words are compared and found the same.
    """
    at, h, owner = windows(w, k)
    order = np.lexsort((h, owner))
    alike = np.flatnonzero((h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
    left, right = at[order[alike]], at[order[alike + 1]]
    # windows one after the other share words: each pair of words is compared once
    pairs = np.unique(np.concatenate([np.stack([left + j, right + j]) for j in range(k)], axis=1), axis=1) if len(left) else np.zeros((2, 0), np.int64)
    if same_words(w, pairs[0], pairs[1]).all():
        return np.unique(np.concatenate([left, right]))
    found: dict[tuple, list[int]] = {}  # two different windows of one hash: by the words themselves
    text = [w.data[i:j].tobytes() for i, j in zip(w.start, w.end, strict=True)]
    for i, d in zip(at.tolist(), owner.tolist(), strict=True):
        found.setdefault((d, *text[i : i + k]), []).append(i)
    return np.array(sorted(i for own in found.values() if len(own) > 1 for i in own), np.int64)


def _figures(data: np.ndarray, offsets: np.ndarray, key: int = 0) -> dict[str, np.ndarray]:
    """Base figures of a chunk of documents."""
    w = words(data, offsets, key=key)
    n_docs, rel = len(offsets) - 1, offsets - offsets[0]
    raw = w.data
    starts_char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = starts_char[w.end] - starts_char[w.start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    repeat = covered(len(w.hash), repeated_windows(w), REPEAT_WINDOW)
    dups = np.zeros(n_docs, np.int64)
    body = raw.tobytes()
    for i in range(n_docs):
        lines = body[rel[i] : rel[i + 1]].split(b"\n")
        if len(lines) > len(set(lines)):
            worded = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            dups[i] = len(worded) - len(set(worded))
    return {"n_words": w.counts, "word_chars": per_document(w.first, chars), "n_symbols": symbols[rel[1:]] - symbols[rel[:-1]], "n_dup_lines": dups, "n_repeat_words": per_document(w.first, repeat)}


def base_figures(rows: DataFrame, text_col: str = "_text") -> DataFrame:
    """All columns but the text, and the base figures of each text (long)."""
    text, keep = rows.columns.index(text_col), [i for i, c in enumerate(rows.columns) if c != text_col]
    names, key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(text))
            parts = [_figures(data, at[i : j + 1], key) for i, j in chunks(at)]
            made = [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *made], [*[b.schema.names[i] for i in keep], *names])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col], *[f"{n} long" for n in names]])
    return rows.mapInArrow(run, schema)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), NOT_LETTERS, " "))


def _line_hash(line: Column) -> Column:
    """A hash of the normalised line, or null if it has no letters."""
    norm = normalised(line)
    return F.when(norm != "", F.xxhash64(norm))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> tuple[DataFrame, DataFrame]:
    """Lines of documents (_id, _th, _host, _at, _line, _n: words), and frequent ones (_host, _line)."""
    each = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("_at"), _line_hash(x).alias("_line"), F.regexp_count(x, F.lit(WORD_SQL)).alias("_n")))
    lines = rows.select("_id", "_th", "_host", F.inline(F.filter(each, lambda x: x["_line"].isNotNull())))
    hosts = rows.groupBy("_host").agg(F.count_distinct(F.struct("_id", "_th")).alias("_docs"))
    counts = lines.groupBy("_host", "_line").agg(F.count_distinct(F.struct("_id", "_th")).alias("_seen")).where(F.col("_seen") >= min_docs)
    frequent = counts.join(hosts, counts["_host"].eqNullSafe(hosts["_host"])).where(F.col("_seen") > max_share * F.col("_docs")).select(counts["_host"], "_line")
    return lines, frequent


def removed_lines(rows: DataFrame, **limits: float) -> DataFrame:
    """Documents with frequent lines: _id, _th, _host, the hashes of those lines, and their words.

    ``_lines`` is bounded by the lines of one document.
    """
    lines, frequent = frequent_lines(rows, **limits)
    f = frequent.withColumnsRenamed({"_host": "_fhost", "_line": "_fline"})
    hit = lines.join(f, (lines["_line"] == f["_fline"]) & lines["_host"].eqNullSafe(f["_fhost"]))
    once = hit.select("_id", "_th", "_host", "_at", "_line", "_n").distinct()  # repeated rows give the same lines again
    return once.groupBy("_id", "_th", "_host").agg(F.collect_set("_line").alias("_lines"), F.sum("_n").alias("_removed"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, **limits: float) -> DataFrame:
    """Per row: the id, base figures, n_line_words (words in frequent lines), base_failed, kept."""
    rows = keyed(docs, id_col, text_col, host_col).withColumnRenamed(f"_{host_col}", "_host")
    base = base_figures(rows)
    gone = removed_lines(rows, **limits).select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth"), F.col("_host").alias("_ghost"), "_removed")
    out = base.join(gone, base["_id"].eqNullSafe(F.col("_gid")) & (base["_th"] == F.col("_gth")) & base["_host"].eqNullSafe(F.col("_ghost")), "left")
    n, removed = F.col("n_words"), F.coalesce("_removed", F.lit(0)).cast("long")
    failed = (n < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT * n)
    depleted = (removed > 0) & ((n - removed < min_words) | (n - removed < min_left * n))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", removed.alias("n_line_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """Per row: the id and the text without frequent lines."""
    rows = keyed(docs, id_col, text_col, host_col).withColumnRenamed(f"_{host_col}", "_host")
    gone = removed_lines(rows, **limits).withColumnsRenamed({"_id": "_gid", "_th": "_gth", "_host": "_ghost"})
    out = rows.join(gone, rows["_id"].eqNullSafe(gone["_gid"]) & (rows["_th"] == gone["_gth"]) & rows["_host"].eqNullSafe(gone["_ghost"]), "left")
    left = F.filter(F.split("_text", "\n"), lambda x: ~F.coalesce(F.array_contains("_lines", _line_hash(x)), F.lit(False)))
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n")).alias(text_col))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
repw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, doc_id, source, text, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, trim(regexp_replace(lower(l), '[^\p{L}]+', ' ', 'g')) AS norm FROM (SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)),
dup AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, l, count(*) AS c FROM ln WHERE n > 0 GROUP BY rid, l) GROUP BY rid),
host AS (SELECT source, count(DISTINCT row(doc_id, text)) AS docs FROM d GROUP BY source),
seen AS (SELECT source, norm, count(DISTINCT row(doc_id, text)) AS c FROM ln WHERE norm <> '' GROUP BY source, norm),
freq AS (SELECT seen.source, norm FROM seen JOIN host ON seen.source IS NOT DISTINCT FROM host.source WHERE c >= 10 AND c > 0.05 * docs),
gone AS (SELECT rid, sum(n) AS n FROM ln JOIN freq ON ln.norm = freq.norm AND ln.source IS NOT DISTINCT FROM freq.source GROUP BY rid),
f AS (SELECT doc_id, len(w)::bigint AS n_words, len(array_to_string(w, ''))::bigint AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(dup.n, 0)::bigint AS n_dup_lines, coalesce(repw.n, 0)::bigint AS n_repeat_words, coalesce(gone.n, 0)::bigint AS n_line_words
  FROM t LEFT JOIN repw USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_line_words > 0 AND (n_words - n_line_words < 20 OR n_words - n_line_words < 0.3 * n_words)) AS kept
FROM f
"""
