"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Each byte has a learned
vector; learned filters run over every chunk and are max-pooled there; a small dense layer gives
each chunk a logit, and the mean of a document's logits goes through a sigmoid, so a long document
counts whole and isn't drawn to an extreme by its length.

Learning uses at most ``TRAIN_DOCS`` labelled documents, those of least hash of the id (a documented
bound on rows; the driver holds their chunks, 2.3 bytes for each byte of their texts), and the whole of
each, however long: all of its chunks, which together weigh as much as those of another document.
Only rows whose crc32 of the id as text isn't divisible by ``FOLDS`` are learned from.  Scoring reads
every byte of every text.  Labels, language, source and id are never inputs of a score.

Defined results: a null or empty text is one chunk of padding and has a score; a null id counts as
held out; null labels are ignored and contradictory ones count as the lesser; with no labels, or
labels of one class only, every score is the share of class 1 (one half without labels), moved a
little inwards; a column of the input named like the score gives way to it.  Columns other than the
id and the text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import utf8

TRAIN_DOCS, FOLDS, THRESHOLD = 3000, 5, 0.3
CHUNK, OVERLAP, WIDTH, STRIDE, VECTOR, FILTERS, HIDDEN = 512, 64, 8, 2, 8, 32, 16
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 7
#: Steps that learning takes at least, however few the labels.
MIN_STEPS = 600
PAD = 256


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def chunk_starts(n: int) -> np.ndarray:
    """Places of the chunks of n bytes: steps of CHUNK - OVERLAP until the end is covered."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


@dataclass
class Network:
    bytes_: np.ndarray  # 257 x VECTOR, the last for padding
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    shift: np.ndarray
    dense: np.ndarray
    dense_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    @classmethod
    def start(cls, rng: np.random.Generator) -> Network:
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(normal(257, VECTOR, scale=0.5), normal(WIDTH * VECTOR, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=0.2), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.shift, self.dense, self.dense_shift, self.out, self.out_shift]

    def patches(self, x: np.ndarray) -> np.ndarray:
        """Of chunks of bytes, the vectors of each filter position, as rows."""
        v = self.bytes_[x].reshape(len(x), -1)
        return np.lib.stride_tricks.sliding_window_view(v, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.ascontiguousarray(self.patches(x))
        return p, p.reshape(-1, p.shape[2]) @ self.filters

    def logits(self, x: np.ndarray) -> np.ndarray:
        p, z = self.pooled(x)
        h = np.maximum(z.reshape(len(x), p.shape[1], -1).max(1) + self.shift, 0)
        return np.tanh(h @ self.dense + self.dense_shift) @ self.out + self.out_shift

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> list[np.ndarray]:
        p, z = self.pooled(x)
        z = z.reshape(len(x), p.shape[1], -1)
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.shift
        h = np.maximum(top, 0)
        t = np.tanh(h @ self.dense + self.dense_shift)
        g = (1 / (1 + np.exp(-(t @ self.out + self.out_shift))) - y) * weight / len(x)
        gt = np.outer(g, self.out) * (1 - t * t)
        gh = (gt @ self.dense.T) * (top > 0)
        best = p[np.arange(len(x))[:, None], at]  # chunk, filter, patch
        gp = (gh[:, :, None] * self.filters.T[None]).reshape(len(x), FILTERS, WIDTH, VECTOR)
        which = x[np.arange(len(x))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)].ravel()
        gb = np.stack([np.bincount(which, gp[..., k].ravel(), 257) for k in range(VECTOR)], 1).astype(np.float32)
        return [gb, np.einsum("bf,bfp->pf", gh, best), gh.sum(0), h.T @ gt, gt.sum(0), t.T @ g, g.sum(keepdims=True)]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on chunks (rows of CHUNK byte numbers), their labels, and their weights (1 on average)."""
    rng = np.random.default_rng(SEED)
    net = Network.start(rng)
    share = ((y * weight).sum() + 1) / (len(y) + 2)
    net.out_shift[:] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    epochs = max(epochs, -(-MIN_STEPS // -(-len(y) // BATCH)))
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    total = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            own, step = order[i : i + BATCH], step + 1
            rate = RATE * min(1, 2 * (1 - step / (total + 1)))
            for p, g, m, v in zip(net.parts(), net.gradients(x[own].astype(np.int64), y[own], weight[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut(data: np.ndarray, start: int, end: int, places: np.ndarray) -> np.ndarray:
    """The chunks at some places of the text data[start:end]."""
    out = np.full((len(places), CHUNK), PAD, np.int16)
    for row, at in zip(out, places, strict=True):
        piece = data[start + at : min(end, start + at + CHUNK)]
        row[: len(piece)] = piece
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """Texts to learn from (_id, _y, _text): bounded in number, whole, of each id the one of greatest length (then hash)."""
    labelled = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_id is not null and _y is not null")
    labelled = labelled.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(labelled), "_id")
    return rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.max_by("_text", F.struct(F.octet_length("_text"), F.xxhash64("_text"))).alias("_text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Network:
    """A network learned from a bounded number of labelled documents outside the held-out fold, all of each."""
    x, own = [], []
    for r in sample(docs, labels, id_col, text_col, label_col, most).toLocalIterator():
        data = np.frombuffer(r._text.encode("utf-8", "surrogatepass"), np.uint8)
        x.append(cut(data, 0, len(data), chunk_starts(len(data))))
        own.append((zlib.crc32(str(r._id).encode()), r._id, r._y))
    order = sorted(range(len(own)), key=own.__getitem__)
    x, own = [x[i] for i in order], [own[i] for i in order]
    n = np.array([len(c) for c in x], np.int64)
    y = np.repeat([float(q > 0) for *_, q in own], n).astype(np.float32)
    weight = np.repeat(n.sum() / (max(1, len(n)) * n), n).astype(np.float32)
    return fit(np.concatenate(x) if x else np.zeros((0, CHUNK), np.int16), y, weight)


def score_bytes(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the texts data[at[i]:at[i + 1]]."""
    total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    waiting, owner, held = [], [], 0

    def flush() -> None:
        if waiting:
            made = net.logits(np.concatenate(waiting))
            whose = np.concatenate(owner)
            np.add.at(total, whose, made)
            np.add.at(count, whose, 1)
        waiting.clear()
        owner.clear()

    for i in range(len(at) - 1):
        places = chunk_starts(at[i + 1] - at[i])
        for j in range(0, len(places), BATCH):
            some = places[j : j + BATCH]
            waiting.append(cut(data, at[i], at[i + 1], some))
            owner.append(np.full(len(some), i))
            held += len(some)
            if held >= BATCH:
                flush()
                held = 0
    flush()
    return 1 / (1 + np.exp(-total / np.maximum(count, 1)))


def with_score(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some 10 KB, whatever the input
    text, keep = docs.columns.index(text_col), [i for i, c in enumerate(docs.columns) if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(score_bytes(sent.value, *utf8(b.column(text))))], [*[b.schema.names[i] for i in keep], score_col])

    return docs.mapInArrow(run, T.StructType([*[docs.schema.fields[i] for i in keep], T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: the id, held_out, score, predicted (1 from a score of THRESHOLD)."""
    net = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = with_score(rows, net, "_text", "_score").select("_id", "_score")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that the network doesn't reject."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return with_score(packed, net, "_text", "_score").where(F.col("_score") >= THRESHOLD).select("_row.*")
