"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids, two bytes each (big-endian), every document followed by the
end-of-document id.  Files are read in byte ranges, so that a file of any size is many tasks: Spark's
text reader cuts at the separator's last byte, which also occurs in other ids and at odd places.
Lines of a range are put together again to blocks of bytes; each block is searched for the separator
in one vectorised step, at even and odd places alike; a prefix scan over a file's blocks then gives
each block's place in the file, and so which of its finds are at whole ids, and carries the place of
the last separator and the number of separators so far, so that a document that spans blocks or
ranges is stitched.  A separator's last byte ends a line, so that no separator spans two ranges.

The ids of the documents are written in the same pass and by the same task as their tokens, with the
place of each in the task's file: the input is evaluated once, and may be shuffled or sorted.

Memory is bounded by a batch of lines, and by a line (the bytes between two separators' last bytes).

Defined results: a null or empty text is a document of no tokens; ids after a file's last separator
are a document without an end, counted if there are any; an empty file has no documents; an id that
is null stays so.  Columns other than the id and the text are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import BATCH_BYTES, shared_codec
from weftgraph.llm.common import chunks, delete_folder, ensure_checkpoint_dir, folder_exists, utf8
from weftgraph.operators.fixpoint import cut

#: End of document: 0xC450, so a file's last byte, and that of each row written, is the letter P.
END = 50256
ID_BYTES, ROW_BYTES = 2, BATCH_BYTES
#: Bytes of a block that is searched at once, at least one line.
BLOCK_BYTES = 1 << 20


def _last(end: int) -> str:
    """The character that is the last byte of the end-of-document id."""
    if not 0 <= end < 1 << 16 or end & 0xFF > 127:
        raise ValueError("the end-of-document id has two bytes, and the last is an ASCII character")
    return chr(end & 0xFF)


def write_files(docs: DataFrame, id_col: str, text_col: str, path: str, vocabulary: str, pattern: str) -> None:
    """Token files under ``tokens=1`` and the documents' ids under ``tokens=0``: one of each for a task.

    Spark's text writer writes each row's bytes and then its line separator: rows here end before
    the last byte of an end-of-document id, and that byte is the line separator.  A line of ids is
    the place of the first in the task's token file and each id's characters in hexadecimal.  Both
    files are open at once, so that rows are written in the order in which they are made.
    """
    codec = shared_codec(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            texts = b.column(1)
            for i, j in chunks(utf8(texts)[1], ROW_BYTES):
                ids, at = codec().encode(texts.slice(i, j - i).to_pylist())
                out = np.full(len(ids) + j - i, END, ">u2")
                out[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(at))] = ids
                names = ",".join("-" if x is None else x.encode().hex() for x in b.column(0).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()[:-1], f"{done}:{names}".encode()], pa.binary()), pa.array([1, 0], pa.int32())], ["value", "tokens"])
                done += j - i

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "value binary, tokens int")
    conf, key = docs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    old = conf.get(key)
    conf.set(key, "4")  # two are needed; without this rows would be sorted by the folder
    try:
        rows.select(F.col("value").cast("string"), "tokens").write.partitionBy("tokens").option("lineSep", _last(END)).text(path)
    finally:
        conf.set(key, old)


def _search(batches: Iterator[pa.RecordBatch], end: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of lines (path, start of their range, file size, value) blocks with the byte places of the separator in each."""
    high, low = end >> 8, bytes([end & 0xFF])
    last: tuple = ()
    number = 0
    for b in batches:
        paths, start = b.column(0).dictionary_encode(), b.column(1).to_numpy()
        which = paths.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(start) != 0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            key = (b.column(0)[i].as_py(), int(start[i]))
            number = number if key == last else 0
            last = key
            sizes = np.diff(np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset : b.column(3).offset + b.num_rows + 1])[i:j] + 1
            for s, t in chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), block_bytes):
                data = np.frombuffer(low.join([*b.column(3).slice(i + s, t - s).to_pylist(), b""]), np.uint8)
                found = np.flatnonzero((data[:-1] == high) & (data[1:] == low[0]))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), b.column(2).slice(i, 1), pa.array([found], pa.list_(pa.int64()))], ["path", "range", "block", "size", "file_size", "found"])
                number += 1


def count_tokens(spark: SparkSession, path: str, end: int = END, block_bytes: int = BLOCK_BYTES, stream: Column | None = None) -> DataFrame:
    """Per document of the token files at a path: stream, ordinal (from 0), n_tokens.

    A stream is a file, unless an expression of ``path`` puts several files, in the order of their
    names, together; documents don't span files.
    """
    lines = spark.read.option("lineSep", _last(end)).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))
    found = cut(lines.mapInArrow(lambda it: _search(it, end, block_bytes), "path string, range long, block long, size long, file_size long, found array<long>"))
    # prefix scan over a file's blocks, a few numbers for each: what lies at even and at odd places of the block, the block's place, and then what lies at whole ids
    # (a block's last byte isn't in the file if the file doesn't end with it, so a find there is looked at apart)
    inner = F.filter("found", lambda x: x < F.col("size") - ID_BYTES)
    at = {0: F.filter(inner, lambda x: x % 2 == 0), 1: F.filter(inner, lambda x: x % 2 == 1)}
    small = found.select(F.array_contains("found", F.col("size") - ID_BYTES).alias("edge"), "path", "range", "block", "size", "file_size", *[F.size(at[k]).alias(f"n{k}") for k in at], *[F.try_element_at(at[k], F.lit(-1)).alias(f"last{k}") for k in at])
    order = Window.partitionBy("path").orderBy("range", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = small.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
    even = F.col("begin") % 2 == 0
    edge = F.col("edge") & ((F.col("begin") + F.col("size")) % ID_BYTES == 0) & (F.col("begin") + F.col("size") <= F.col("file_size"))
    scan = scan.withColumn("edge", edge).withColumn("n", F.when(even, F.col("n0")).otherwise(F.col("n1")) + F.col("edge").cast("int"))
    own = F.col("begin") + F.when(F.col("edge"), F.col("size") - ID_BYTES).when(even, F.col("last0")).otherwise(F.col("last1"))
    scan = scan.withColumn("own", (own / ID_BYTES).cast("long")).withColumn("last", F.coalesce(F.max("own").over(before), F.lit(-1)))
    left = F.floor(F.least(F.col("begin") + F.col("size"), F.col("file_size")) / ID_BYTES) - 1 - F.coalesce("own", "last")
    scan = scan.withColumn("open", F.when(F.lead("block").over(order).isNull() & (left > 0), left))
    # of a stream the documents before each file, and of a file those before each block
    scan = scan.withColumn("made", F.col("n") + F.when(F.col("open").isNotNull(), 1).otherwise(0)).withColumn("inside", F.coalesce(F.sum("made").over(before), F.lit(0)))
    files = scan.groupBy("path").agg(F.sum("made").alias("made")).withColumn("stream", (F.col("path") if stream is None else stream).cast("string"))
    ahead = Window.partitionBy("stream").orderBy(F.length("path"), "path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", "stream", F.coalesce(F.sum("made").over(ahead), F.lit(0)).alias("files_before"))
    known = scan.where("made > 0").select("path", "range", "block", "begin", "file_size", "last", "open", "inside").join(files, "path")
    placed = found.select("path", "range", "block", "found").join(known, ["path", "range", "block"])
    ends = F.transform(F.filter("found", lambda x: ((F.col("begin") + x) % 2 == 0) & (F.col("begin") + x + 1 < F.col("file_size"))), lambda x: ((F.col("begin") + x) / ID_BYTES).cast("long"))
    placed = placed.withColumn("ends", ends)
    lengths = F.transform("ends", lambda e, i: e - 1 - F.when(i == 0, F.col("last")).otherwise(F.get("ends", i - 1)))
    lengths = F.when(F.col("open").isNotNull(), F.concat(lengths, F.array("open"))).otherwise(lengths)
    return placed.select("stream", (F.col("files_before") + F.col("inside")).alias("before"), F.posexplode(lengths).alias("i", "n")).select("stream", (F.col("before") + F.col("i")).alias("ordinal"), F.col("n").cast("long").alias("n_tokens"))


def document_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: the id and n_tokens, by way of token files in the shared folder, which are deleted when they are counted.

    An id without a count, or a count without an id, is an error.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    try:
        write_files(docs, id_col, text_col, path, vocabulary, pattern)
        if not folder_exists(spark, f"{path}/tokens=1"):  # an input without rows
            return spark.createDataFrame([], T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType())]))
        part = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int")
        counts = count_tokens(spark, f"{path}/tokens=1", stream=part)
        counts = counts.select(F.col("stream").cast("int").alias("_part"), F.col("ordinal").alias("_ordinal"), "n_tokens")
        lines = spark.read.schema("value string").option("lineSep", _last(END)).text(f"{path}/tokens=0").select(F.col("_metadata.file_path").alias("path"), "value")
        names = F.posexplode(F.split(F.substring_index("value", ":", -1), ",")).alias("_i", "_name")
        ids = lines.select(part.alias("_opart"), F.substring_index("value", ":", 1).cast("long").alias("_first"), names)
        made = F.when(F.col("_name") != "-", F.unhex("_name").cast("string")).cast(docs.schema[id_col].dataType)
        ids = ids.select("_opart", (F.col("_first") + F.col("_i")).alias("_oordinal"), made.alias("_id"))
        out = ids.join(counts, (F.col("_opart") == F.col("_part")) & (F.col("_oordinal") == F.col("_ordinal")), "full")
        checked = F.when(F.col("_opart").isNull() | F.col("_part").isNull(), F.raise_error(F.lit("token files and ids don't match"))).otherwise(F.col("n_tokens"))
        return cut(out.select(F.col("_id").alias(id_col), checked.alias("n_tokens")))
    finally:
        delete_folder(spark, path)
