"""Personal data: fixed formats, and bootstrapped contextual extraction of further identifiers.

Every text is scanned for the fixed formats (email, ip, card, phone) and for seed entities of known
key formats (kind ``secret``).  Each of these, and every other token with a digit that could be an
identifier, is a mention: a value in a lexical pattern, the two words before it (^ where the text
begins) and the marks around it.  A seed may stand within a token, between other characters than
those of an identifier (letters, digits, _ and -).  Mentions make a bipartite graph of patterns and values.  Spark scores it in rounds: a
pattern's confidence in a kind is the smoothed share of its values that are of that kind, and a
value's score is the noisy-or of the confident patterns it occurs in, seeds staying at 1.  Mentions
in patterns of high confidence are added as spans; those of fixed formats always stay.

Skew: the graph's edges are distinct pairs, so a very frequent value or pattern counts once per
partner; scores are sums, pre-aggregated in each task.

Defined results: a null text is empty and has no spans; repeated rows each get the same result; an
added span that overlaps one of a fixed format is left out.  Columns other than the id and the text
are never read by the search.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import ensure_checkpoint_dir, keyed, utf8

KINDS = ("email", "ip", "card", "phone")
SEEDED = "secret"
#: Rounds of scoring; least confidence and distinct values of a pattern that propagates, and of one that is accepted.
ROUNDS, PROPAGATES, ACCEPTED, SUPPORT, SMOOTHING = 3, 0.5, 0.8, 8, 2.0
#: Least code points of a token with a digit that could be an identifier.
MIN_VALUE = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits that failed at its start; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\s]+")
# within a text, with no character of an identifier on either side; a key has a digit and a letter
_SEED = re.compile(r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9_-])")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_MARKS = "\"'`()[]{}<>,.;:!?*$%&#|=~"
_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[[*range(0x30, 0x3A), 0x40]] = True

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, by start and then kind as listed."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _overlaps(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether a range meets any of the spans, which are sorted by start: of those before its end the furthest end decides."""
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))
    return lambda s, e: bool(k := bisect_left(starts, e)) and ends[k - 1] > s


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, str | None, str, str]]:
    """(start, end, kind if known, pattern, value) of fixed formats, seeds, and other tokens with a digit."""
    out = []
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = np.fromiter((a for a, _ in tokens), np.int64, len(tokens))

    words: dict[int, str] = {}  # whole words, however long, by a digest each, made once
    heads: dict[int, tuple[int, hashlib._Hash]] = {}  # how far a token has been digested

    def word(i: int) -> str:
        if i not in words:
            words[i] = "^" if i < 0 else _digest(text[tokens[i][0] : tokens[i][1]].lower())
        return words[i]

    def before(k: int, start: int) -> str:
        done, own = heads.get(k, (tokens[k][0], hashlib.blake2b(digest_size=8)))
        if start < done:
            done, own = tokens[k][0], hashlib.blake2b(digest_size=8)
        own.update(text[done:start].encode("utf-8", "surrogatepass"))
        heads[k] = start, own
        return own.hexdigest()

    def pattern(start: int, end: int) -> str:
        k = int(np.searchsorted(starts, start, "right")) - 1
        return f"{word(k - 2)} {word(k - 1)} {before(k, start)}_{text[end : end + 1].strip()}"

    seeds = [(m.start(), m.end(), SEEDED) for m in _SEED.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    meets = _overlaps(base)
    seeds = [(s, e, kind) for s, e, kind in seeds if not meets(s, e)]
    known = sorted([*base, *seeds])
    meets = _overlaps(known)
    for s, e, kind in known:
        out.append((s, e, kind, pattern(s, e), text[s:e]))
    for a, b in tokens:
        token = text[a:b]
        if b - a < MIN_VALUE or not any("0" <= c <= "9" for c in token):
            continue
        s, e = a + len(token) - len(token.lstrip(_MARKS)), b - len(token) + len(token.rstrip(_MARKS))
        if e - s < MIN_VALUE or meets(s, e) or not any("0" <= c <= "9" for c in text[s:e]):
            continue
        out.append((s, e, None, pattern(s, e), text[s:e]))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_MENTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pattern", pa.int64()), ("value", pa.int64())]))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def scan(rows: DataFrame) -> DataFrame:
    """Of _id, _th, _text: the spans of fixed formats, joined and counted, and the mentions, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("_text")
            data, at = utf8(column)
            total = np.concatenate([[0], np.cumsum(_DIGIT_OR_AT[data[at[0] : at[-1]]])])
            some = (total[at[1:] - at[0]] - total[at[:-1] - at[0]]) > 0
            texts, counts, found = [], [], []
            for i in range(b.num_rows):
                base: list[Span] = []
                each = []
                if some[i]:  # no format and no mention is without a digit or an at sign
                    text = column[i].as_py() or ""
                    base = base_spans(text)
                    each = [{"start": s, "end": e, "kind": k, "pattern": _number(p), "value": _number(v)} for s, e, k, p, v in mentions(text, base)]
                texts.append(_joined(base))
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                found.append(each)
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), *[pa.array(numbers[:, k]) for k in range(len(KINDS))], pa.array(texts, pa.string()), pa.array(found, _MENTION)], ["_id", "_th", *[f"n_{k}" for k in KINDS], "_base", "_mentions"])

    return rows.mapInArrow(run, f"_id long, _th long, {', '.join(f'n_{k} long' for k in KINDS)}, _base string, _mentions array<struct<start:long,end:long,kind:string,pattern:long,value:long>>")


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns accepted for a kind (pattern, kind), from distinct edges (pattern, value, kind or null)."""
    size = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    links = edges.select("pattern", "value").distinct().join(size, "pattern").checkpoint()
    seeds = edges.where("kind is not null").select("value", "kind").distinct()
    scores = seeds.withColumn("score", F.lit(1.0))
    for last in (*[False] * (rounds - 1), True):
        confidence = links.join(scores, "value").groupBy("pattern", "kind").agg((F.sum("score") / (F.first("n") + SMOOTHING)).alias("confidence"))
        if last:
            return confidence.where(F.col("confidence") >= ACCEPTED).groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        lent = links.join(confidence.where(F.col("confidence") >= PROPAGATES), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = seeds.withColumn("score", F.lit(1.0)).unionByName(lent).groupBy("value", "kind").agg(F.max("score").alias("score")).checkpoint()
    raise ValueError("at least one round is needed")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Distinct rows by content: _id, _th, counts and spans of the fixed formats, and ``_all``: all spans (start, end, kind)."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = scan(keyed(docs, id_col, text_col)).checkpoint()
    each = found.select("_id", "_th", F.inline("_mentions"))
    accepted = confident_patterns(each.select("pattern", "value", "kind").distinct(), rounds)
    known = "kind is null or kind = 'secret'"
    added = each.where(known).withColumnRenamed("kind", "_seed").join(accepted, "pattern").select("_id", "_th", "start", "end", F.coalesce("_seed", "kind").alias("kind"))
    seeded = each.where(f"kind = '{SEEDED}'").select("_id", "_th", "start", "end", "kind")
    more = added.unionByName(seeded).groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "end", "kind")).alias("_more")).withColumnsRenamed({"_id": "_mid", "_th": "_mth"})
    out = found.join(more, found["_id"].eqNullSafe(F.col("_mid")) & (found["_th"] == F.col("_mth")), "left")
    # one span for each place: a seed's own kind goes before that of a pattern
    base = F.when(F.col("_base") == "", F.array().cast("array<struct<start:long,end:long,kind:string>>")).otherwise(F.transform(F.split("_base", ","), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), F.split(x, ":")[2].cast("long").alias("end"), F.split(x, ":")[0].alias("kind"))))
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, [*KINDS, SEEDED])), x["kind"]), F.lit(0)), F.lit(99))
    everything = F.transform(F.array_sort(F.transform(F.concat(base, F.coalesce("_more", F.array().cast("array<struct<start:long,end:long,kind:string>>"))), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return out.select("_id", "_th", *[f"n_{k}" for k in KINDS], "_base", everything.alias("_all"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of the fixed formats, base (their spans), spans (all; kind:start:end, comma-joined)."""
    spans = F.array_join(F.transform("_all", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return find(docs, id_col, text_col).select(F.col("_id").alias(id_col), *[f"n_{k}" for k in KINDS], F.col("_base").alias("base"), spans.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of documents, with all their columns; each span's text gives way to <KIND>.

    Overlapping spans give way together, to the first's kind.  A column of lengths, if there is
    one, follows the text where it changes.
    """
    spans = find(docs, id_col, text_col).where(F.size("_all") > 0).select("_id", "_th", "_all").distinct().withColumnsRenamed({"_id": "_sid", "_th": "_sth"})
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_th"))
    joined = packed.join(spans, packed["_id"].eqNullSafe(F.col("_sid")) & (packed["_th"] == F.col("_sth")), "left")
    text = F.col("_row").getField(text_col)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), F.when(x["start"] < a["end"], a["text"]).otherwise(F.concat(a["text"], F.substring(text, (a["end"] + 1).cast("int"), (x["start"] - a["end"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).alias("text"))
    done = F.aggregate("_all", start, step, lambda a: F.concat(a["text"], F.substring(text, (a["end"] + 1).cast("int"), F.lit(2**31 - 1))))
    new = F.when(F.col("_all").isNull(), text).otherwise(done)
    out = joined.withColumn("_new", new)
    columns = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        columns.append((F.col("_new") if c == text_col else F.when(F.col("_all").isNull(), old).otherwise(F.char_length("_new").cast(docs.schema[c].dataType)) if c == length_col else old).alias(c))
    return out.select(*columns)
