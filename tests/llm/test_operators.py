"""Every corpus operator against a plain version, and on awkward rows and empty tables."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests_prose import AWKWARD, drifting, prose, size_bits
from weftgraph.llm import bpe, byte_cnn, common, html_crf, license_dice, line_frequency, order_minhash, pii_bootstrap, substring_dedup, token_scan, winnowing

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, n=40):
    """Prose with copies, shared passages and shared lines."""
    passage, line = prose(30, 99), "This line is on very many pages of the site"
    texts = []
    for i in range(n):
        t = prose(40 + 3 * i, i)
        if i % 4 == 1:
            t = texts[-1]
        if i % 4 == 2:
            t = t + " " + passage
        if i % 2:
            t = t + "\n" + line
        texts.append(t)
    return spark.createDataFrame([(i, t, f"h{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string"), texts


# ---- op1


def base(text):
    w = WORD.findall(text)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_line_frequency(spark, awkward, empty):
    got = line_frequency.assess(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 4}
    for i, t in enumerate(AWKWARD):
        if i != 4:
            r = by[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t or ""), i
    assert line_frequency.assess(empty).count() == 0


def test_frequent_lines_go(spark):
    df, texts = corpus(spark)
    cleaned = {r.doc_id: r.text for r in line_frequency.clean(df, min_docs=5, max_share=0.1).collect()}
    norm = lambda x: re.sub(r"[^\W\d_]*", lambda m: m[0], " ".join(re.findall(r"[^\W\d_]+", x.lower())))
    seen = Counter((i % 2, x) for i, t in enumerate(texts) for x in {norm(x) for x in t.split("\n")} if x)
    for i, t in enumerate(texts):
        assert cleaned[i] == "\n".join(x for x in t.split("\n") if not (norm(x) and seen[i % 2, norm(x)] >= 5 and seen[i % 2, norm(x)] > 2)), i
    assert "many pages" not in "".join(cleaned.values())
    copies = spark.createDataFrame([(i, prose(30, 5), "h") for i in range(12)] + [(100, prose(30, 6), "h")] * 12, "doc_id long, text string, source string")
    assert {r.doc_id: r.kept for r in line_frequency.assess(copies).collect()} == {**dict.fromkeys(range(12), False), 100: True}  # ids are counted, not rows
    depleted = spark.createDataFrame([(i, f"{prose(3, i)}\n" + "shared words " * 30, "h") for i in range(20)], "doc_id long, text string, source string")
    assert not any(r.kept for r in line_frequency.assess(depleted).collect())


# ---- op2


def without_repeats(rows, k=13):
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            least[tuple(w[j : j + k])] = min(i, least.get(tuple(w[j : j + k]), i))
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p for j in range(len(w) - k + 1) if least[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)
    return out


@pytest.mark.parametrize("width", [1 << 22, 1 << 10])  # with the small one nothing is pruned
def test_substring_dedup(spark, awkward, empty, width):
    df, texts = corpus(spark)
    want = without_repeats(list(enumerate(texts)))
    for r in substring_dedup.remove(df.repartition(3), width=width).collect():
        assert (r.kept, r.n_words, r.n_removed) == want[r.doc_id]
    got = substring_dedup.remove(awkward, width=width).collect()
    assert len(got) == awkward.count() and sum(r.n_removed for r in got if r.doc_id == 5) == 60
    assert all(r.n_removed == 0 for r in got if r.doc_id in (None, 4))
    assert substring_dedup.remove(empty, width=width).count() == 0


def test_sketch_merges_to_counts():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 20, 3000).astype(np.uint32) for _ in range(4)]
    made = [substring_dedup._partial([p]) for p in parts]
    bits = np.zeros(1 << 22, bool)
    for b in substring_dedup._merge(iter(made)):
        import zlib

        bits[:] = np.unpackbits(np.frombuffer(zlib.decompress(b.column("bits")[0].as_py()), np.uint8), bitorder="little").astype(bool)
    cells, n = np.unique(np.concatenate(parts), return_counts=True)
    assert set(np.flatnonzero(bits)) == set(cells[n > 1].tolist())


# ---- op3


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    f = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    f += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    f += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii_bootstrap.luhn(digits(m[0]))]
    f += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(s, e, pii_bootstrap.KINDS[k]) for s, k, e in sorted(f)]


def test_fixed_formats_are_the_patterns():
    r = random.Random(0)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b.", "@", "c", "-", "+1", " ", "4", "12", "(", ")", ".", "7", "255.", "4111 1111 1111 1111", "é"]) for _ in range(r.randint(0, 25)))
        assert pii_bootstrap.base_spans(t) == plain_spans(t), t


def test_contexts_find_unseen_identifiers(spark, awkward, empty):
    r = random.Random(1)
    known = [(i, f'{prose(5, i)} token = "{r.getrandbits(160):040x}" {prose(5, i + 500)}') for i in range(30)]
    unseen = [(100 + i, f'{prose(5, i)} token = "Q7-{i}-zz99" {prose(5, i)}') for i in range(3)]
    other = [(200 + i, f"{prose(5, i)} room number B{i}0012 {prose(5, i)}") for i in range(10)]
    df = spark.createDataFrame([*known, *unseen, *other], "doc_id long, text string")
    got = {x.doc_id: x for x in pii_bootstrap.report(df).collect()}
    assert all(got[i].spans.startswith("secret:") for i in range(30))
    for i, t in unseen:
        (kind, s, e) = got[i].spans.split(":")
        assert kind == "secret" and t[int(s) : int(e)] == f"Q7-{i - 100}-zz99"
    assert all(got[i].spans == "" for i, _ in other)
    rows = pii_bootstrap.report(awkward).collect()
    assert len(rows) == awkward.count() and all(x.spans == "" for x in rows)
    assert pii_bootstrap.report(empty).count() == 0


def test_seeds_within_tokens_and_at_the_start(spark):
    aws, sk, digest = "AKIA" + "Q7" * 8, "sk-" + "a1B2" * 6, "0123456789abcdef" * 2 + "01234567"
    texts = [(f"{aws} is the key", [aws]), (f"{sk}", [sk]), (f"use key={aws}", [aws]), (f'token="{digest}"', [digest]), (f'say {{"key":"{sk}","id":"{aws}"}}', [sk, aws]), (f"see https://x.org/p?key={aws}&v=2 there", [aws]), (f"not x{aws} or {aws}9", [])]
    for x in pii_bootstrap.report(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect():
        t, want = texts[x.doc_id]
        spans = [s.split(":") for s in x.spans.split(",") if s]
        assert [(k, t[int(s) : int(e)]) for k, s, e in spans] == [("secret", w) for w in want], t
    out = {x.doc_id: x.text for x in pii_bootstrap.redact(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string"), length_col=None).collect()}
    assert out[0] == "<SECRET> is the key" and out[2] == "use key=<SECRET>"


def test_redaction(spark, awkward, empty):
    df = spark.createDataFrame([(1, "é mail me.x@y.org, or 10.0.0.1 now", 33, "k"), (2, "nothing", 7, "k"), (None, None, None, "k")], "doc_id long, text string, n_chars long, _all string")
    got = {x.doc_id: x for x in pii_bootstrap.redact(df).collect()}
    assert got[1].text == "é mail <EMAIL>, or <IP> now" and got[1].n_chars == len(got[1].text) and got[2].text == "nothing" and got[None].text is None
    assert sorted(map(str, pii_bootstrap.redact(awkward).collect())) == sorted(map(str, awkward.collect()))
    assert pii_bootstrap.redact(empty).count() == 0


def plain_scores(edges, rounds=pii_bootstrap.ROUNDS):
    """Accepted patterns by the scoring rounds, in dictionaries."""
    values, seeds = {}, {(v, k) for _, v, k in edges if k}
    for p, v, _ in edges:
        values.setdefault(p, set()).add(v)
    values = {p: vs for p, vs in values.items() if len(vs) >= pii_bootstrap.SUPPORT}
    scores = dict.fromkeys(seeds, 1.0)
    kinds = sorted({k for _, k in seeds})
    for last in [False] * (rounds - 1) + [True]:
        confidence = {(p, k): s / (len(vs) + pii_bootstrap.SMOOTHING) for p, vs in values.items() for k in kinds if (s := sum(scores.get((v, k), 0.0) for v in vs)) > 0}
        if last:
            best = {}
            for (p, k), c in confidence.items():
                if c >= pii_bootstrap.ACCEPTED:
                    best[p] = max(best.get(p, (0.0, "")), (c, k))
            return {p: k for p, (_, k) in best.items()}
        lost = {}
        for (p, k), c in confidence.items():
            if c >= pii_bootstrap.PROPAGATES:
                for v in values[p]:
                    lost[v, k] = lost.get((v, k), 1.0) * (1 - c)
        scores = {**dict.fromkeys(seeds, 1.0), **{x: 1 - n for x, n in lost.items() if x not in seeds}}


@pytest.mark.parametrize("seed", [0, 1])
def test_scoring_rounds_are_the_plain_ones(spark, seed):
    r, edges = random.Random(seed), set()
    known = {v: r.choice(["secret", "phone"]) for v in range(0, 4000, 2)}
    for p in range(60):
        purity, main = 1 - r.random() ** 2, r.choice(["secret", "phone"])
        of_kind = [v for v in known if known[v] == main]
        for _ in range(r.randint(3, 60)):
            v = r.choice(of_kind) if r.random() < purity else r.randrange(1, 4000, 2)
            edges.add((p, v, known.get(v) if r.random() < 0.9 else None))
    for k in range(20):  # patterns joined to others by values that only these know
        edges |= {(100 + k, v, None) for p, v, _ in list(edges) if p == k}
    df = spark.createDataFrame(sorted(edges, key=str), "pattern long, value long, kind string").repartition(3)
    common.ensure_checkpoint_dir(spark)
    got = {x.pattern: x.kind for x in pii_bootstrap.confident_patterns(df).collect()}
    want = plain_scores(edges)
    assert got == want and len(want) > 3 and len({k for k in want.values()}) == 2


def test_long_words_are_patterns_of_their_own(spark):
    """Words that agree in their last 32 characters but not before make two patterns."""
    tail, r = "t" * 40, random.Random(2)
    rows = [(i, f"see a{tail} {r.getrandbits(160):040x} end") for i in range(20)] + [(50, f"see a{tail} Q7-zz-9911 end"), (60, f"see b{tail} Q7-zz-9922 end")]
    got = {x.doc_id: x.spans for x in pii_bootstrap.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].startswith("secret:") and got[60] == ""


def test_many_spans_in_one_text_are_linear():
    text = " ".join(f"u{i}@x.org v{i}77777 {i:08d}aa" for i in range(30_000))
    assert len(pii_bootstrap.mentions(text, pii_bootstrap.base_spans(text))) >= 60_000


# ---- op4


def lcs(a, b):
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + (a[i] == b[j]))
    return m[-1, -1]


def test_near_duplicates(spark, awkward, empty):
    r, texts = random.Random(0), []
    for g in range(6):
        origin = prose(80, g).split(" ")
        for c in range(4):
            w = origin[:]
            for _ in range(c * 2):
                w[r.randrange(len(w))] = f"new{r.random()}"
            texts.append(" ".join(w))
    texts.append(texts[0])
    sh = [WORD.findall(t) for t in texts]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            if 5 * lcs(sh[i], sh[j]) >= 2 * (len(sh[i]) + len(sh[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in order_minhash.classes(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert sorted(x.doc_id for x in order_minhash.keep_one(df).collect()) == sorted(set(got.values()))
    rows = order_minhash.classes(awkward).collect()
    assert len(rows) == awkward.count()
    assert {x.class_id for x in rows if x.doc_id == 5} == {4} and all(x.class_size == 1 for x in rows if x.doc_id in (0, 1, 2))
    assert order_minhash.classes(empty).count() == 0 and order_minhash.keep_one(empty).count() == 0
    assert order_minhash.keep_one(awkward).columns == awkward.columns


def test_size_estimates_stay_short(spark):
    """The driver plans each step by an estimate of sizes; carried through the rounds, its digits would fill the driver."""
    made, found = order_minhash.links(common.keyed(spark.createDataFrame(drifting(), "doc_id long, text string"), "doc_id", "text"))
    rows = order_minhash.classes(spark.createDataFrame(drifting(), "doc_id long, text string"))
    assert max(size_bits(x) for x in (made, found, rows)) < 2000
    assert {(r.doc_id, r.class_id, r.class_size) for r in rows.collect()} == {(i, 0, 60) for i in range(60)}


def test_links_inside_a_family_below_the_threshold(spark):
    r, origin = random.Random(0), prose(300, 7).split(" ")

    def edit(w, k, tag):
        places = set(r.sample(range(len(w)), k))
        return [f"{tag}x{p}" if p in places else x for p, x in enumerate(w)]

    texts = []
    for i in range(300):  # pairs of about 0.92 among texts that are less like all others
        texts.append(edit(origin, 90, f"u{i}"))
        texts.append(edit(texts[-1], 24, f"v{i}"))
    got = {x.doc_id: x.class_id for x in order_minhash.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    h = [np.array([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in w], np.uint32) for w in texts]
    linked = [(i, i + 1) for i in range(0, len(texts), 2) if order_minhash.aligned(h[i], h[i + 1])]
    assert len(linked) == 300 and [p for p in linked if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) == 300


def test_mixed_buckets_lose_no_link():
    """One bucket of texts of many components, all pairs against plain alignment; in one part and in two."""
    r, hashes = random.Random(5), []
    for g in range(40):
        own = [r.randrange(1 << 32) for _ in range(60)]
        for _ in range(3):
            hashes.append(np.array([r.randrange(1 << 32) if r.random() < 0.15 else x for x in own], np.uint32))
    n = len(hashes)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if 5 * lcs(hashes[i], hashes[j]) >= 2 * (len(hashes[i]) + len(hashes[j])) and i // 3 == j // 3}
    ids = np.arange(n)
    for parts in ([ids * 0], [(ids % 2)], [(ids % 3 > 0) * 1]):
        found = order_minhash.linked_across(parts[0], ids, ids, hashes)
        assert set(found) <= want
        roots = list(range(n))

        def top(x):
            while roots[x] != x:
                x = roots[x]
            return x

        for a, b in found:
            roots[max(top(a), top(b))] = min(top(a), top(b))
        across = [(a, b) for a, b in want if parts[0][a] != parts[0][b] or parts[0].min() == parts[0].max()]
        assert across and all(top(a) == top(b) for a, b in across)


def test_counts_lose_no_similar_pair():
    r, hashes = random.Random(6), []
    for g in range(30):
        own = [r.randrange(1 << 32) for _ in range(r.randint(3, 400))]
        for share in (0.0, 0.05, 0.15, 0.2, 0.3):
            w = [r.randrange(1 << 32) if r.random() < share else x for x in own]
            hashes.append(np.array(w[: max(1, int(len(w) * r.choice([1, 1, 0.8, 0.67])))], np.uint32))
    n = np.array([len(h) for h in hashes])
    counts = np.stack([np.minimum(np.bincount(h % order_minhash.CELLS, minlength=order_minhash.CELLS), 255) for h in hashes]).astype(np.uint8)
    ids = np.arange(len(n))
    got = order_minhash.may_be_similar(ids * 0, ids, n, counts)
    want = {i for i in ids for j in range(i // 5 * 5, i // 5 * 5 + 5) if i != j and 5 * bits_lcs(hashes[i], hashes[j]) >= 2 * (n[i] + n[j])}
    assert want <= set(np.flatnonzero(got).tolist()) and len(want) > 60
    alone = order_minhash.may_be_similar(ids[::5] * 0, ids[::5], n[::5], counts[::5])
    assert alone.sum() < 0.3 * len(alone)  # unrelated texts are mostly told apart


@pytest.mark.parametrize("most", [6, 14, 42])
def test_short_texts_are_candidates(spark, most):
    r, pairs = random.Random(0), []
    for i in range(400):
        a = [f"w{i}x{j}" for j in range(r.randint(1, most))]
        b = a[:]
        for k in range(len(a) // 2):  # as many words more as the threshold allows
            b.insert(r.randint(0, len(b)), f"more{i}x{k}")
        c = [f"new{i}" if k % 5 == 4 else x for k, x in enumerate(a)]  # every fifth word is another
        pairs += [(a, b), ([f"q{x}" for x in a], [f"q{x}" for x in c])]
    got = {x.doc_id: x.class_id for x in order_minhash.classes(spark.createDataFrame([(2 * i + k, " ".join(w)) for i, p in enumerate(pairs) for k, w in enumerate(p)], "doc_id long, text string")).collect()}
    similar = [i for i, (a, b) in enumerate(pairs) if 5 * lcs(a, b) >= 2 * (len(a) + len(b))]
    lost = [tuple(map(len, pairs[i])) for i in similar if got[2 * i + 1] != 2 * i]
    assert len(similar) > 600 and len(lost) <= (0 if most <= 6 else 0.01 * len(similar)), lost


def bits_lcs(a, b):
    """Longest common subsequence without any band."""
    at = {}
    for i, v in enumerate(a):
        at[v] = at.get(v, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for v in b:
        u = row & at.get(v, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_of_similar_pairs(spark, size):
    """All pairs of the table at a word similarity of 0.8 and more by brute force: lengths and word counts bound it, alignment decides."""
    path = f"/root/testdata/sf{size}"
    if not Path(path).is_dir():
        pytest.skip("needs the tables")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    by: dict = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = tuple(WORD.findall(r.text or ""))
        if w:
            by.setdefault(w, r.doc_id)
    own = sorted(by, key=len)
    n, number = np.array([len(w) for w in own]), {x: k for k, x in enumerate(sorted({x for w in own for x in w}))}
    counts, fine = (np.stack([np.bincount([number[x] % size for x in w], minlength=size) for w in own]).astype(np.float32) for size in (64, 2048))
    pairs = []
    for i in range(len(own)):
        top = np.searchsorted(2 * n, 3 * n[i], "right")
        near = i + 1 + np.flatnonzero(5 * np.abs(counts[i + 1 : top] - counts[i]).sum(1) <= n[i] + n[i + 1 : top])
        for j in near[5 * np.abs(fine[near] - fine[i]).sum(1) <= n[i] + n[near]].tolist():
            x, y = own[i], own[j]
            if 5 * sum((Counter(x) & Counter(y)).values()) >= 2 * (len(x) + len(y)) and 5 * bits_lcs(x, y) >= 2 * (len(x) + len(y)):
                pairs.append((by[x], by[y]))
    by = {i: w for w, i in by.items()}
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    print(size, len(pairs), found)
    assert len(pairs) > (50 if size == "0.01" else 500) and found >= 0.99 * len(pairs)
    linked = {c for p in pairs for c in (got[p[0]], got[p[1]])}  # texts that are like no other stay alone
    alone = Counter(got[i] for i in by)
    assert sum(n > 1 and c not in linked for c, n in alone.items()) <= 0.02 * max(1, len(linked))


def test_verified_links_are_named_so(empty):
    assert order_minhash.classes(empty).columns == ["doc_id", "class_id", "class_size", "n_verified"]


def test_banded_alignment():
    r = random.Random(3)
    for _ in range(150):
        a = [r.randint(0, 6) for _ in range(r.randint(0, 20))]
        b = [r.randint(0, 6) if r.random() < 0.2 else x for x in a if r.random() < 0.9]
        assert order_minhash._banded(a, b, 40) == lcs(a, b)


# ---- op5


def test_bpe_is_tiktoken(spark, awkward, empty):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    for r in bpe.decode(bpe.encode(awkward, "text", VOCABULARY, PATTERN, "ids", "same"), "ids", VOCABULARY, PATTERN).collect():
        assert r.ids == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.same
    assert bpe.digests(empty, "doc_id", "text", VOCABULARY, PATTERN).count() == 0
    t = bpe.digests(awkward.where("doc_id = 9"), "doc_id", "text", VOCABULARY, PATTERN).first()
    assert t.ids_sha256 == hashlib.sha256(" ".join(map(str, own.encode_ordinary(AWKWARD[9]))).encode()).hexdigest()


def test_columns_named_like_made_ones_give_way(spark):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    df = spark.createDataFrame([("some text", "old", "older", 1)], "text string, ids string, decoded string, same int")
    made = bpe.encode(df, "text", VOCABULARY, PATTERN, "ids", "same")
    assert made.columns == ["text", "decoded", "ids", "same"]
    r = bpe.decode(made, "ids", VOCABULARY, PATTERN).select("ids", "decoded", "same").first()
    assert r.ids == own.encode_ordinary("some text") and bytes(r.decoded) == b"some text" and r.same is True
    over = bpe.encode(df, "text", VOCABULARY, PATTERN, "text").first()
    assert over.text == r.ids


def test_bpe_is_tiktoken_on_random_text():
    codec = bpe.Codec(bpe.read_ranks(VOCABULARY), PATTERN, bpe.PerfectHash.build(bpe.read_ranks(VOCABULARY)))
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "e", "th", "ing", " ", "\n", "  ", "1", "'s", "é", "漢", "!?", "ZZ", "\t", "x" * 9]) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    flat, at = codec.encode(texts)
    assert [flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == own.encode_ordinary_batch(texts)


def test_perfect_hash_is_minimal_and_exact():
    entries = {f"w{i}".encode(): i for i in range(2000)}
    h = bpe.PerfectHash.build(entries)
    keys = [*entries, b"w", b"zz", b"", b"w20000", b"x" * 500]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    assert h.find(np.frombuffer(b"".join(keys), np.uint8), at).tolist() == [*range(2000), -1, -1, -1, -1, -1]
    assert len(h.value) == 2000


# ---- op6


def test_extraction_on_unseen_layouts():
    model = html_crf.trained()
    pages = html_crf.examples(150, 7)
    wrong = sum(a != b for blocks, y in pages for a, b in zip(model.decode(blocks), y, strict=True))
    assert wrong <= 0.01 * sum(len(y) for _, y in pages)


def test_extraction(spark):
    from weftgraph.session import prepare

    prepare(spark)
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A &amp; B</h1><p>First  text\n here.<br>Then more of it, as a sentence goes.<p>Second one, also long enough to be text.</article><script>var x='<p>no</p>'</script><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p" * 2000), (5, "u", "<div>" * 500 + "x"), (6, "u", "<!-- open")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_crf.extract(df).collect()}
    assert got[1].text == "A & B\nFirst text here. Then more of it, as a sentence goes.\nSecond one, also long enough to be text."
    assert got[2].text == got[3].text == "" and len(got) == 6 and got[1].n_chars == len(got[1].text)
    assert html_crf.extract(df.limit(0)).count() == 0


def test_viterbi_is_the_best_of_all():
    from itertools import product

    rng, r = np.random.default_rng(1), random.Random(1)
    blocks = html_crf.examples(20, 3)
    names = sorted({f for page, _ in blocks for b in page for f in html_crf.features(b)})
    for page, _ in blocks:
        some = page[: r.randint(1, 9)]
        model = html_crf.Field({f: i for i, f in enumerate(names)}, rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        score = np.array([model.weights[[model.index[f] for f in html_crf.features(b)]].sum(0) for b in some])
        value = lambda y: model.first[y[0]] + sum(score[t, k] for t, k in enumerate(y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert tuple(model.decode(some)) == max(product((0, 1), repeat=len(some)), key=value)


def test_forward_backward_is_the_sum_over_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    score, moves, first = rng.normal(size=(3, 5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths, mask = (5, 3, 1), np.zeros((3, 5))
    for p, n in enumerate(lengths):
        mask[p, :n] = 1
    z, unary, pair = html_crf.marginals(score, mask, moves, first)
    for p, n in enumerate(lengths):
        paths = list(product((0, 1), repeat=n))
        w = np.array([np.exp(first[y[0]] + sum(score[p, t, k] for t, k in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))) for y in paths])
        assert np.isclose(z[p], np.log(w.sum()))
        for t in range(n):
            assert np.allclose(unary[p, t], [sum(w[i] for i, y in enumerate(paths) if y[t] == k) / w.sum() for k in (0, 1)])
        for t in range(n - 1):
            assert np.allclose(pair[p, t], [[sum(w[i] for i, y in enumerate(paths) if y[t : t + 2] == (a, b)) / w.sum() for b in (0, 1)] for a in (0, 1)])
        assert not unary[p, n:].any()


@pytest.mark.parametrize("page", ["<div>x" * 170_000, "<div>" * 60_000 + "<li></li>" * 60_000, "<p" * 500_000 + ">", "<a b='x>" * 100_001, "<head>" * 150_000, "".join(f'<div class="n{i}">' for i in range(40_000)) + "text", "<ul><li>" + "<div>" * 50_000 + "<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000, "&" * 1_000_000])
def test_parsing_is_linear(page):
    import time

    model, began = html_crf.trained(), time.time()
    html_crf.main_text(page, model)
    assert time.time() - began < 30


def test_broken_markup():
    texts = lambda page: [b.text for b in html_crf.leaves(page)]
    assert texts("<p title=it's>one</p><p>two") == ["one", "two"]
    assert texts('<p title="a>b">one<p class="open>two</p>three') == ["one", "two", "three"]
    assert texts("a < b<p>c <3 d") == ["a < b", "c <3 d"]
    assert texts("x<!-- <p>y") == ["x"] and texts("x<p") == ["x<p"] and texts("<title>t</title><body>b") == ["b"]
    assert texts("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    nested = html_crf.leaves("<ul><li>a<ul><li>b</ul><li>c</ul>")
    assert [b.around.features for b in nested] == [("in=ul", "in=li")] * 3


def test_extraction_of_repeated_rows_and_clashing_columns(spark):
    page = "<article><p>First text here. Then more of it, as a sentence goes.</p></article>"
    rows = [(1, "u", page, "a", 5, "h"), (1, "u", page, "a", 5, "h"), (None, "u", page, "b", 6, "h"), (2, "v", "<nav><a href='/'>Home</a></nav>", None, None, None)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, _html string")).collect()
    assert sorted((str(r.page_id), r.url, r.n_chars) for r in got) == sorted([("1", "u", 53), ("1", "u", 53), ("None", "u", 53), ("2", "v", 0)])
    assert set(got[0].asDict()) == {"page_id", "url", "text", "n_chars"}


# ---- op7


def plain_score(net, data):
    """The score of one text by loops over its chunks, filters and positions."""
    logits = []
    for start in range(0, max(1, len(data) - byte_cnn.OVERLAP), byte_cnn.CHUNK - byte_cnn.OVERLAP):
        piece = list(data[start : start + byte_cnn.CHUNK])
        piece += [byte_cnn.PAD] * (byte_cnn.CHUNK - len(piece))
        vectors = [net.bytes_[b].astype(float) for b in piece]
        best = [-np.inf] * byte_cnn.FILTERS
        for at in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
            window = np.concatenate(vectors[at : at + byte_cnn.WIDTH])
            for f in range(byte_cnn.FILTERS):
                best[f] = max(best[f], float(window @ net.filters[:, f]))
        h = [max(b + float(s), 0.0) for b, s in zip(best, net.shift, strict=True)]
        hidden = [np.tanh(sum(x * float(net.dense[i, j]) for i, x in enumerate(h)) + float(net.dense_shift[j])) for j in range(byte_cnn.HIDDEN)]
        logits.append(sum(x * float(net.out[j]) for j, x in enumerate(hidden)) + float(net.out_shift[0]))
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_are_the_plain_convolution():
    net = byte_cnn.Network.start(np.random.default_rng(4))
    texts = ["", "short", prose(60, 1), prose(300, 2), "é" * 700]
    data, at = common.utf8(pa.array(texts))
    got = byte_cnn.score_bytes(net, data, at)
    assert np.allclose(got, [plain_score(net, t.encode()) for t in texts], atol=1e-5)


def test_the_sample_is_bounded_and_holds_whole_texts(spark, awkward):
    docs = spark.createDataFrame([(i, prose(50 + 40 * (i % 7), i)) for i in range(100)] + [(3, "another text of this id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(7, 0, 0), (7, 1, 0), (9, None, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    texts = {i: prose(50 + 40 * (i % 7), i) for i in range(100)}
    rows = byte_cnn.sample(docs, labels, "doc_id", "text", "quality", 1000).collect()
    learned = {r._id: r for r in rows}
    assert len(rows) == len(learned) == sum(not byte_cnn.is_held_out(i) for i in range(100)) and all(r._text == texts[r._id] for r in rows)
    assert learned[7]._y == 0 if 7 in learned else True  # contradictory labels count as the lesser
    few = byte_cnn.sample(docs, labels, "doc_id", "text", "quality", 30).collect()
    assert len(few) == 30 and all(r._text == texts[r._id] for r in few)
    long = docs.where("doc_id <> 1").union(spark.createDataFrame([(1, "long " * 2_000_000)], docs.schema))
    assert len(byte_cnn.sample(long, labels, "doc_id", "text", "quality", 1000).collect()) == len(rows)  # however long one of them is
    out = byte_cnn.with_score(awkward.withColumn("score", F.lit("old")), byte_cnn.Network.start(np.random.default_rng(0)))
    assert out.columns == [*awkward.columns, "score"] and out.schema["score"].dataType.simpleString() == "double" and out.count() == awkward.count()



def test_classifier(spark, awkward, empty):
    rows = [(i, prose(60, i) if i % 4 else "$$$ " * 20 + prose(10, i) + " ### " * 20, int(i % 4 > 0)) for i in range(160)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in byte_cnn.classify(docs, labels).collect()}
    assert all(got[i].held_out == byte_cnn.is_held_out(i) for i in got)
    held = [i for i in got if got[i].held_out]
    good, bad = [got[i].score for i in held if i % 4], [got[i].score for i in held if not i % 4]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and all(0 <= got[i].score <= 1 for i in got)
    out = byte_cnn.classify(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert {round(r.score, 6) for r in byte_cnn.classify(docs, none).collect()} == {0.5}
    assert byte_cnn.classify(empty, none).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        seen = np.zeros(n, bool)
        for at in byte_cnn.chunk_starts(n):
            seen[at : at + byte_cnn.CHUNK] = True
        assert seen.all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = byte_cnn.Network.start(rng)
    for p in net.parts():
        p[...] = p * 1.0
    x, y = rng.integers(0, 257, (3, byte_cnn.CHUNK)), np.array([1.0, 0.0, 1.0], np.float32)
    loss = lambda: float(np.mean(np.log1p(np.exp(net.logits(x))) - y * net.logits(x)))
    for p, g in zip(net.parts(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.1 * abs(g[at]) + 1e-3


# ---- op8


def test_token_counts(spark, awkward, empty):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_scan.document_counts(awkward, "doc_id", "text", VOCABULARY, PATTERN).collect())
    assert got == sorted((str(r.doc_id), len(own.encode_ordinary(r.text or ""))) for r in awkward.collect())
    assert token_scan.document_counts(empty, "doc_id", "text", VOCABULARY, PATTERN).count() == 0


@pytest.mark.parametrize("shuffled", [lambda d: d.repartition(9), lambda d: d.repartition(5, "source"), lambda d: d.orderBy("n_chars"), lambda d: d.coalesce(1)])
def test_counts_of_a_shuffled_input(spark, shuffled):
    path = "/root/testdata/sf0.01"
    if not Path(path).is_dir():
        pytest.skip("needs the tables")
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = {r.doc_id: len(own.encode_ordinary(r.text or "")) for r in docs.collect()}
    got = token_scan.document_counts(shuffled(docs), "doc_id", "text", VOCABULARY, PATTERN).collect()
    assert len(got) == len(want) and {r.doc_id: r.n_tokens for r in got} == want
    assert not list(Path(common.ensure_checkpoint_dir(spark).removeprefix("file:")).glob("tokens-*"))


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("P,:", "one two"), (None, "x"), ("", None), ("é", "")], "name string, text string")
    got = {r.name: r.n_tokens for r in token_scan.document_counts(docs, "name", "text", VOCABULARY, PATTERN).collect()}
    assert set(got) == {"P,:", None, "", "é"} and got[""] == got["é"] == 0 and got["P,:"] > 0


@pytest.mark.parametrize("block", [1, 6, 1 << 20])
def test_boundaries_are_stitched(spark, tmp_path, block):
    r = random.Random(block)
    sizes = [3, 0, 7, 1, 0, 12]
    flat = [x for n in sizes for x in [5] * n + [token_scan.END]] + [5, 5]
    (tmp_path / "a.bin").write_bytes(np.array(flat, ">u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    # ids whose bytes are those of the separator at odd places, in ranges of a few bytes
    many = [r.randint(0, 9) for _ in range(300)]
    odd = [x for n in many for x in [r.choice([0x50C4, 0x5050, 0xC4C4, 0x00C4, 0x5000, 7]) for _ in range(n)] + [token_scan.END]]
    (tmp_path / "c.bin").write_bytes(np.array(odd, ">u2").tobytes() + b"\xc4")  # half an id is none
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = token_scan.count_tokens(spark, str(tmp_path), block_bytes=block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    by = lambda name: [(x.ordinal, x.n_tokens) for x in sorted(rows, key=lambda x: x.ordinal) if x.stream.endswith(name)]
    assert by("a.bin") == list(enumerate([*sizes, 2])) and by("b.bin") == []
    assert by("c.bin") == list(enumerate(many))
    both = token_scan.count_tokens(spark, str(tmp_path), block_bytes=block, stream=F.lit("all")).collect()
    assert [x.n_tokens for x in sorted(both, key=lambda x: x.ordinal)] == [*sizes, 2, *many] and {x.stream for x in both} == {"all"}


# ---- op9


def test_winnowing(spark, awkward, empty):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    items = [(1, prose(20, 50)), (2, "just four short words"), (3, None), (4, ""), (5, prose(20, 50)), (None, prose(9, 1)), (6, "ONE")]
    texts = [prose(30, 60) + " " + prose(20, 50).upper().replace("É", "é").replace("Ü", "ü") + " x", "a just FOUR, short words b one", prose(50, 61), prose(20, 50)[:60], *AWKWARD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in winnowing.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(8, len(v))
            wins = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k and item is not None else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(w), len(hit), sorted(found)), i
    assert len(winnowing.decontaminate(awkward, bench).collect()) == awkward.count()
    assert winnowing.decontaminate(empty, bench).count() == 0 and not any(r.contaminated for r in winnowing.decontaminate(docs, bench.limit(0)).collect())
    assert winnowing.drop_contaminated(awkward, bench).columns == awkward.columns


# ---- op10


def test_license_scan(spark, awkward, empty):
    mit = next(t for n, t in license_dice.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [(1, "Some words\nReleased under the MIT License.\nmore"), (2, mit), (3, mit.replace("Software", "Program", 2)), (4, prose(80, 1)), (5, None), (6, "All rights reserved"), (7, "\n\n")]
    got = {r.doc_id: r for r in license_dice.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "MIT" in got[1].licenses and got[1].best == 1.0 and "MIT" in got[2].licenses and "MIT" in got[3].licenses
    assert got[4].licenses == "" and got[5].best is None and got[6].licenses == "Proprietary" and got[7].n_passages == 0
    assert len(license_dice.scan(awkward).collect()) == awkward.count() and license_dice.scan(empty).count() == 0


def plain_licenses(text, made):
    """Names and best coefficient of a text by comparing every passage with every template."""
    norm = re.sub(r"[^\W_\n]+|\n|[^\n]", lambda m: m[0] if re.match(r"[^\W_]|\n", m[0]) else " ", text.lower())
    passages = [x.split() for x in norm.split("\n")]
    pars = re.split(r"\n *\n[ \n]*", re.sub(r" +", " ", norm))
    passages += [p.split() for p in pars if "\n" in p] + ([norm.split()] if len(pars) > 1 else [])
    names, best = set(), None
    for w in passages:
        own = Counter(zip(w, w[1:], strict=False))
        scores = [(2 * sum((own & Counter(tuple(g.split(" ")) for g in b)).values()) / max(1, sum(own.values()) + len(b)), name) for name, b in made]
        top = max(scores)[0]
        if sum(own.values()) and top >= 0.8:
            names |= {n for c, n in scores if c == top}
            best = max(best or 0, top)
    return ",".join(sorted(names)), best


def test_relatives_and_ties_of_licences(spark, tmp_path):
    r, made = random.Random(4), license_dice.template_passages()
    texts = [t for _, t in license_dice.TEMPLATES]
    for _, t in license_dice.TEMPLATES * 2:
        w = t.split(" ")
        for _ in range(r.randint(0, max(1, len(w) // 8))):
            w[r.randrange(len(w))] = r.choice(["other", "words", "License", "the"])
        texts.append(f"{prose(5, 1)}\n\n{' '.join(w)}\n{prose(4, 2)}")
    got = {x.doc_id: (x.licenses, x.best) for x in license_dice.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i, t in enumerate(texts) if got[i] != plain_licenses(t, made)] == []
    for i, (name, t) in enumerate(license_dice.TEMPLATES):
        if "\n" not in t:
            assert got[i] == (name, 1.0)  # a notice is itself, not its relatives
    # two templates that are equally near are both named; templates may come from a folder
    for name in ("One", "Two"):
        (tmp_path / f"{name}.txt").write_text(f"You may use {name} of these works for any purpose you like at all")
    own = license_dice.read_templates(spark, str(tmp_path))
    assert [n for n, _ in own] == ["One", "Two"]
    tie = license_dice.scan(spark.createDataFrame([(1, "you may use three of these works for any purpose you like at all")], "doc_id long, text string"), templates=own).first()
    assert tie.licenses == "One,Two" and tie.best == 22 / 26


# ---- shared kernels


def twins():
    """Two words of one hash under any polynomial modulo a power of two: a Thue-Morse string and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_crafted_words_stay_apart(spark):
    a, b = twins()
    tail = " ".join(f"w{i}" for i in range(12))
    texts = [f"{a} {tail}", f"{b} {tail}", f"{a} {tail} zz {b} {tail}", a, b, " ".join(a), " ".join(b)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_repeat_words for r in line_frequency.assess(docs).collect()} == {i: base(t)[4] for i, t in enumerate(texts)}
    want = without_repeats(list(enumerate(texts)))
    assert {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring_dedup.remove(docs, width=1 << 20).collect()} == want
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert got[3] == 3 and got[4] == 4 and got[1] == 0  # of the same 12 words of 13
    assert got[6] == (5 if order_minhash.aligned(*[np.array([ord(c) for c in x], np.uint32) for x in (a, b)]) else 6)


def test_repeats_are_of_words_even_where_hashes_collide(monkeypatch):
    texts = [prose(60, 1), prose(30, 2) + " " + prose(30, 2), " ".join("xy"[i % 2] for i in range(40)), "", "one"]
    data, at = common.utf8(pa.array(texts))
    monkeypatch.setattr(common, "_mix", lambda x: x * np.uint64(0))
    got = line_frequency._figures(data, at)["n_repeat_words"].tolist()
    assert got == [base(t)[4] for t in texts] and got[1] == 60


def test_long_words_are_hashed_whole():
    texts = ["".join("abcdefgh"[(i * k) % 8] for i in range(n)) for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 200) for k in (1, 3)]
    texts += [t[:-1] + "z" for t in texts] + [t + "\0" for t in texts]
    data, at = common.utf8(pa.array([" ".join(texts)]))
    for key in (0, 12345):
        w = common.words(data, at, key=key)
        assert len(w.hash) == len(texts) == len(set(w.hash.tolist())) == len(set(w.lane(1).tolist())) and not set(w.hash.tolist()) & set(w.lane(1).tolist())
    assert set(w.hash.tolist()).isdisjoint(common.words(data, at).hash.tolist())



def test_word_hashes_are_of_the_words():
    texts = ["a b a", "", None, "é\tb", "a"]
    data, at = common.utf8(pa.array(texts))
    w = common.words(data, at)
    assert w.counts.tolist() == [3, 0, 0, 2, 1] and w.hash[0] == w.hash[2] == w.hash[5] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 3
    place, h, owner = common.windows(w, 2)
    assert place.tolist() == [0, 1, 3] and owner.tolist() == [0, 0, 3] and len(set(h.tolist())) == 3


def test_buckets_are_told_by_one_row_for_each_component(spark):
    """op4: a bucket of many texts of few components is few rows, until its texts meet; one that links have joined doesn't come back."""
    buckets = spark.createDataFrame([(k, n) for k in (1, 2, 3) for n in range(40 * k)], "_key long, _node long")
    signs = spark.createDataFrame([(n, 7) for n in range(120)], "_node long, _n int")
    star = lambda lo, hi: [(lo, n) for n in range(lo + 1, hi)]
    found = spark.createDataFrame(star(0, 40) + star(40, 80) + star(80, 120), "a long, b long")
    ones = order_minhash._ones(buckets, order_minhash._labelled(found, signs))
    assert sorted((r._key, r._comp) for r in ones.collect()) == [(2, 0), (2, 40), (3, 0), (3, 40), (3, 80)]
    assert all(r._comp <= r._one < r._comp + 40 for r in ones.collect())
    found = found.unionByName(spark.createDataFrame([(3, 50)], "a long, b long"))
    got = order_minhash._mixed(buckets, ones, order_minhash._labelled(found, signs)).collect()
    assert sorted((r._key, r._node, r._comp, r._n) for r in got) == [(3, n, 0 if n < 80 else 80, 7) for n in range(120)]
