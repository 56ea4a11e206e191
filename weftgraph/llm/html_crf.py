"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed to its leaf blocks: runs of text between block-level tags, each with the tags and
class names of its ancestors.  Scripts, styles, comments and the head are no blocks.  The field has
two labels (article or not), features of ancestors and of the text's shape, and transitions from
block to block; it is trained by penalised likelihood on labelled pages (forward-backward, in numpy,
a fraction of a second to a few seconds on the driver) and decoded by Viterbi's algorithm.

Defined results: a null or empty page has an empty text; tags left open are closed where HTML closes
them; ``br`` and white space of any kind, character references included, become one space; a quote that
is never closed ends no tag, so that the page's later tags end at the next ``>``; repeated rows and
null ids stay as they are.  Columns other than the id, the URL and the HTML are never read.

Parsing is linear in the page, however deep or broken: open elements are found by their tag's last
place on the stack, ancestors are shared by the leaves below them, and nothing is searched twice.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.labelled_pages import labelled_pages

TRAIN_PAGES, STEPS, RATE, PENALTY = 600, 150, 0.15, 1e-4

#: Tags of HTML that delimit blocks.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template head title svg iframe textarea object math canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Landmarks: the innermost one is a feature of its own.
LANDMARK = frozenset("article main nav header footer aside form section ul ol table figure".split())
#: A start tag closes these if they are open and no landmark lies between.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_MARKUP = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.IGNORECASE)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in SKIPPED}


class Element:
    """An open element: what its leaves take from it and its ancestors.

    ``features`` names each block-level tag and each word of a class name, id or role around a leaf
    once; elements that add none share the tuple of the element around them.
    """

    __slots__ = ("features", "inner", "land", "landmark", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], depth: int, outer: Element | None, known: Container[str] | None):
        self.tag = tag
        self.inner = tag if tag in BLOCK or outer is None else outer.inner
        self.land, self.landmark = (tag, depth) if tag in LANDMARK else (outer.land, outer.landmark) if outer else ("none", -1)
        own = outer.features if outer else ()
        new = [f"in={tag}"] * (tag in BLOCK) + [f"name={w}" for w in names]
        new = [f for f in dict.fromkeys(new) if (known is None or f in known) and f not in own]
        self.features = (*own, *new) if new else own


_ROOT = Element("none", (), -1, None, None)


@dataclass
class Leaf:
    text: str
    around: Element
    linked: int  # code points inside links


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def leaves(page: str, known: Container[str] | None = None) -> list[Leaf]:
    """Leaf blocks of a page, in order, with their text white space-normalised; blocks without text are left out.

    With ``known``, only those of the ancestors' features that are in it are kept, which bounds what
    an element can add.
    """
    out: list[Leaf] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is on the stack
    now, at, end, last = _Open(), 0, len(page), page.rfind(">")
    loose, headless = False, False

    def flush() -> None:
        nonlocal now
        if now.parts:
            text = " ".join("".join(now.parts).split())
            if text:
                out.append(Leaf(text, stack[-1] if stack else _ROOT, now.linked))
            now = _Open()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            now.parts.append(text)
            if places["a"]:
                now.linked += len(text)

    def pop(depth: int) -> None:
        for e in reversed(stack[depth:]):
            places[e.tag].pop()
        del stack[depth:]

    while at < end:
        start = page.find("<", at)
        if start < 0 or start > last:  # no more tags
            add(page[at:])
            break
        add(page[at:start])
        m = _MARKUP.match(page, start)
        if m is None:
            add("<")
            at = start + 1
            continue
        if m[3] is None:
            to = page.find("-->", m.end() - 2) if m[1] else page.find(">", m.end())
            at = end if to < 0 else to + (3 if m[1] else 1)
            continue
        rest = None if loose else _REST.match(page, m.end())
        if rest is None:
            loose = True
            to = page.find(">", m.end())
            attrs, at = page[m.end() : to], to + 1
        else:
            attrs, at = rest[1], rest.end()
        tag = m[3].lower()
        if m[2]:
            if tag in BLOCK:
                flush()
            if places[tag]:
                pop(places[tag][-1])
            continue
        if tag in SKIPPED:
            if attrs.endswith("/"):
                continue
            if tag != "head":
                over = _ENDS[tag].search(page, at, last + 1)
                at = over.end() if over else end
            elif not headless:  # ends at its end tag or where the body begins
                over = _HEAD_END.search(page, at)
                at, headless = (over.end(), False) if over else (at, True)
            continue
        if tag == "br":
            now.parts.append(" ")
        if tag in BLOCK:
            flush()
            while places["p"] and (stack[-1].tag == "p" or tag not in ("button", "label", "option")):
                pop(places["p"][-1])
            if tag in CLOSES:
                nearest = max((places[t][-1] for t in CLOSES[tag] if places[t]), default=-1)
                if nearest > (stack[-1].landmark if stack else -1):
                    pop(nearest)
        if tag in VOID or attrs.endswith("/"):
            continue
        names = tuple(w for a, b, c in _NAMES.findall(attrs) for w in _WORD.findall((a or b or c).lower())) if "=" in attrs else ()
        places[tag].append(len(stack))
        stack.append(Element(tag, names, len(stack), stack[-1] if stack else _ROOT, known))
    flush()
    return out


def features(block: Leaf) -> list[str]:
    n, share, around = block.text.count(" ") + 1, block.linked / len(block.text), block.around
    out = ["bias", f"tag={around.inner}", f"land={around.land}", f"words={min(4, n.bit_length() // 2)}", f"link={int(share > 0.05) + int(share > 0.5) + int(share > 0.9)}", f"end={block.text[-1] in '.!?…'}"]
    out += around.features
    if "©" in block.text:
        out.append("copyright")
    return out


def marginals(score: np.ndarray, mask: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded pages (pages, blocks, labels): log-partition, and probabilities of labels and of pairs of them."""
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    lse = lambda x, axis: np.log(np.exp(x - (top := x.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    alpha[:, 0] = first + score[:, 0]
    for t in range(1, score.shape[1]):
        new = lse(alpha[:, t - 1, :, None] + moves, 1) + score[:, t]
        alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
    for t in range(score.shape[1] - 2, -1, -1):
        new = lse(moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
    z = lse(alpha[:, -1], 1)
    unary = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + moves + (score + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return z, unary, pair


@dataclass
class Field:
    """Weights of features (rows) for the two labels, of transitions, and of the first label."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        w = self.weights
        score = np.array([w[[self.index[f] for f in features(b) if f in self.index]].sum(0) for b in blocks])
        (m00, m01), (m10, m11) = self.moves.tolist()
        (a, b), back = (self.first + score[0]).tolist(), []
        for x, y in score[1:].tolist():
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def train(pages: list[tuple[list[Leaf], list[int]]]) -> Field:
    """Penalised maximum likelihood by Adam; pages are padded to one length and handled at once."""
    index: dict[str, int] = {}
    rows = [[[index.setdefault(f, len(index)) for f in features(b)] for b in blocks] for blocks, _ in pages]
    P, T, K = len(pages), max(len(b) for b, _ in pages), len(index)
    mask, y = np.zeros((P, T)), np.zeros((P, T), int)
    which, feature = [], []
    for p, (own, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        mask[p, : len(labels)], y[p, : len(labels)] = 1, labels
        for t, fs in enumerate(own):
            which += [p * T + t] * len(fs)
            feature += fs
    which, feature = np.array(which), np.array(feature)
    theta = [np.zeros((K, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    gold = np.eye(2)[y] * mask[..., None]
    gold_moves = np.einsum("pti,ptj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, STEPS + 1):
        w, moves, first = theta
        score = np.stack([np.bincount(which, w[feature, k], P * T) for k in (0, 1)], 1).reshape(P, T, 2)
        _, unary, pair = marginals(score, mask, moves, first)
        off = (unary - gold).reshape(P * T, 2)
        grads = [np.stack([np.bincount(feature, off[which, k], K) for k in (0, 1)], 1) / P + PENALTY * w, (pair.sum((0, 1)) - gold_moves) / P, (unary[:, 0] - gold[:, 0]).sum(0) / P]
        for x, g, a, b in zip(theta, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(index, *theta)


def examples(n: int, seed: int = 0) -> list[tuple[list[Leaf], list[int]]]:
    """Labelled pages, parsed; the parser finds the very blocks that were labelled."""
    out = []
    for page, blocks in labelled_pages(n, seed):
        found = leaves(page)
        if [b.text for b in found] != [" ".join(html.unescape(t).split()) for t, _ in blocks]:
            raise ValueError("a labelled page isn't parsed to its blocks")
        out.append((found, [y for _, y in blocks]))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(examples(TRAIN_PAGES))


def main_text(page: str | None, model: Field) -> str:
    blocks = leaves(page or "", model.index)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the URL, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred weights
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{html_col}`").alias("_html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                own = b.slice(i, 256)
                texts = [main_text(x.as_py(), sent.value) for x in own.column(2)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    return rows.mapInArrow(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})
