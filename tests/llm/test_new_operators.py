"""Whitening, periodic runs and the n-gram join against plain versions, and on awkward rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_prose import AWKWARD, drifting, prose
from weftgraph.llm import periodic_runs, token_groups, whitening
from weftgraph.llm.common import apart

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- op11


def plain_whitening(vectors, k):
    """By Python's integers and one symmetric solver over all vectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values, kind="stable")[:k]
    return n, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_is_the_plain_one(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10))
    rows = [(i, [float(c) for c in np.float32(x)]) for i, x in enumerate(v)]
    bad = [(900, None), (901, [None] * 10), (902, [float("nan")] * 10), (903, [1.0] * 9 + [float("inf")]), (904, [0.0] * 9 + [None])]
    df = spark.createDataFrame(rows + bad + [rows[0], (None, rows[1][1])], "vec_id long, embedding array<float>")
    n, deviation, white, explained = plain_whitening([r[1] for r in [*rows, rows[0], rows[1]]], 4)
    got = whitening.whiten(df.repartition(5), components=4).collect()
    assert len(got) == 302 * 4 and {r.n for r in got} == {302 == n and n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == {*range(300), None} and len(by[0][1]) == 2
    sign = [np.sign(by[0][c + 1][0].whitened) * np.sign(white[0, c]) for c in range(4)]
    for i in range(300):
        for c in range(4):
            r = by[i][c + 1][0]
            assert int(r.deviation) == deviation[i] and abs(r.whitened - sign[c] * white[i, c]) < 1e-8 and abs(r.explained / explained[c] - 1) < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None, "x", 1)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(make([(1, [1.0, 2.0], "x", 1)])).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(make([(i, [float(i), 3.0], "x", 1) for i in range(10)])).collect()  # the second dimension doesn't vary
    assert {r.component for r in flat if r.whitened is None} == {2} and flat[0].identity_error < 1e-9
    with pytest.raises(Exception, match="several lengths"):
        whitening.whiten(make([(1, [1.0], "x", 1), (2, [1.0, 2.0], "x", 1)]).repartition(2)).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(make([(1, [1e200], "x", 1)])).collect()
    far = whitening.whiten(make([(i, [float(i) * 1e11, -float(i)], "x", 1) for i in range(8)])).collect()  # beyond 64 bits: Python's integers
    x = [64 * i * 10**11 + 10**6 for i in range(8)]
    y = [-64 * i + 10**6 for i in range(8)]
    assert {r.vec_id: int(r.deviation) for r in far} == {i: (8 * x[i] - sum(x)) ** 2 + (8 * y[i] - sum(y)) ** 2 for i in range(8)}
    assert whitening.whiten(make([(1, [], "x", 1)])).count() == 0


# ---- op12


def plain_runs(w, least):
    """Every period by itself: stretches of words that agree with those one period on."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_the_plain_ones(least):
    r = random.Random(least)
    for _ in range(1500):
        k, own = r.choice([1, 2, 2, 3, 4]), []
        for _ in range(r.randint(0, 5)):
            own += [r.randrange(k) for _ in range(r.randint(1, 9))] * r.choice([1, 1, 2, 3, 5])
        assert periodic_runs.runs(own, least) == plain_runs(own, least), own
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    assert periodic_runs.runs(b, least) == plain_runs(b, least)


def test_factors_are_the_longest_that_begin_earlier():
    r = random.Random(4)
    for _ in range(300):
        w = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 30))]
        at = 0
        for i, j, before in periodic_runs.factors(w):
            assert i == at
            most = max((k for s in range(i) for k in [next((k for k in range(len(w) - i) if w[s + k] != w[i + k]), len(w) - i)]), default=0)
            assert (j - i == most and before < i and w[before : before + most] == w[i:j]) if most else (j == i + 1 and before == -1)
            at = j
        assert at == len(w)


def plain_report(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    own = plain_runs(w, 12)
    gone = {i for s, e, q in own for i in range(s + q, e)}
    best = min(own, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(own), *head, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in own)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_periodic_runs(spark, awkward, empty):
    r, texts = random.Random(9), []
    for i in range(120):
        t = prose(r.randint(0, 120), i).split()
        for _ in range(r.randint(0, 3)):
            at, b = r.randint(0, len(t)), prose(r.randint(1, 12), 1000 + i).split()
            t[at:at] = b * r.randint(2, 9) + b[: r.randint(0, len(b))]
        texts.append("  ".join(t))
    texts += ["a b " * 3000, "x " * 11, "x " * 12, "a b c d e f " * 2, "A a " * 10]
    want = {i: plain_report(i, t) for i, t in enumerate(texts)}
    assert sum(v[0] > 1 for v in want.values()) > 40
    got = periodic_runs.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == want
    rows = periodic_runs.report(awkward).collect()
    assert len(rows) == awkward.count() and periodic_runs.report(empty).count() == 0
    by = {x.doc_id: tuple(x)[1:] for x in rows if x.doc_id not in (None, 4)}
    assert by == {i: plain_report(i, t) for i, t in enumerate(AWKWARD) if i != 4}
    assert len({tuple(x) for x in rows if x.doc_id is None}) == 1


def test_real_outputs_of_runs(spark):
    out = periodic_runs.find(spark.createDataFrame([("a", "p q r s p q r s p q r s p q z")], "doc_id string, text string")).first()
    assert out.n_words == 15 and [tuple(r) for r in out.runs] == [(0, 14, 4)] and out.collapsed == "p q r s z"


def test_stretches_hold_all_runs():
    """With hashes that all collide nothing is cut off, and the result stays the same."""
    w = np.array([zlib.crc32(x.encode()) for x in (prose(40, 1) + " " + "a b c " * 6 + prose(40, 2)).split()], np.uint64)
    first = np.array([0, len(w)])
    (s,), (e,) = periodic_runs.stretches(w, first, 6)
    assert w[s] == w[s + 3] and e - s >= 18
    assert [x.tolist() for x in periodic_runs.stretches(w * np.uint64(0), first, 6)] == [[0], [len(w)]]


# ---- op13


def plain_sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    sets, up = [plain_sets(t) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def family(r, words, n, edits, tag):
    out = []
    for i in range(n):
        w = words[:]
        for p in r.sample(range(len(w)), r.randint(0, edits)):
            w[p] = f"{tag}{i}x{p}"
        out.append(" ".join(w))
    return out


def check(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    want = plain_components(texts)
    assert got == want
    return want


def test_join_is_the_plain_one(spark, monkeypatch):
    r = random.Random(2)
    passage = prose(80, 77)
    texts = [t for g in range(5) for t in family(r, prose(90, g).split(), 9, 6, f"f{g}")]  # about the threshold
    texts += family(r, prose(300, 50).split(), 60, 30, "u") + [t for _, t in drifting()]  # families that drift
    texts += [prose(15, 100 + i) + " " + passage for i in range(40)]  # mostly one passage, not alike enough
    texts += [passage + f" tail{i}" for i in range(10)] + [prose(k, k) for k in range(12)] + [prose(3, 3).upper(), "One two", "one TWO", "", " ", "é É"]
    r.shuffle(texts)
    want = check(spark, texts)
    assert 20 < len({c for _, c in want.values()}) < len(texts) - 100
    monkeypatch.setattr(token_groups, "GROUP", 3)  # many small groups, many blocks
    monkeypatch.setattr(token_groups, "QUERIES", 2)
    assert check(spark, texts) == want


def test_join_of_awkward_rows(spark, awkward, empty):
    out = token_groups.components(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and token_groups.components(empty).count() == 0
    want = plain_components(AWKWARD)
    by = {x.doc_id: (x.n_shingles, x.component_id) for x in rows if x.doc_id not in (None, 4)}
    assert by == {i: c for i, c in want.items() if i != 4}
    assert all(x.component_id is None for x in rows if x.doc_id is None) and out.columns == ["doc_id", "n_shingles", "component_id", "n_copies", "n_verified"]


def test_no_link_hides_behind_the_bound():
    r = random.Random(8)
    for _ in range(200):
        base = [r.randrange(1 << 60) for _ in range(r.randint(1, 40))]
        sets = [np.unique(np.array([r.randrange(1 << 60) if r.random() < 0.1 else x for x in base], np.uint64)) for _ in range(8)]
        comp = np.array([r.randrange(4) for _ in sets])
        queries = [(-1, 10 + i, np.unique(np.array([r.randrange(1 << 60) if r.random() < 0.1 else x for x in base], np.uint64))) for i in range(4)]
        found, opened = token_groups.open_group(sets, comp, queries)
        up = {}

        def top(c):
            while c in up:
                c = up[c]
            return c

        for k, m in found:
            assert token_groups.linked(len(queries[k][2]), len(sets[m]), len(np.intersect1d(queries[k][2], sets[m])))
            a, b = sorted((top(queries[k][1]), top(int(comp[m]))))
            up[b] = a
        for _, c, s in queries:
            for m, own in enumerate(sets):
                if token_groups.linked(len(s), len(own), len(np.intersect1d(s, own))):
                    assert top(c) == top(int(comp[m]))


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 60):
        assert token_groups.prefix_size(n) == n - -(-8 * n // 10) + 1
    r = random.Random(1)
    for _ in range(2000):
        a = set(r.sample(range(100), r.randint(1, 60)))
        b = (a - set(r.sample(sorted(a), min(len(a) - 1, r.randint(0, 8))))) | set(r.sample(range(100), r.randint(0, 5)))
        if token_groups.linked(len(a), len(b), len(a & b)):
            assert set(sorted(a)[: token_groups.prefix_size(len(a))]) & set(sorted(b)[: token_groups.prefix_size(len(b))])


def test_signatures_lose_no_link():
    r = random.Random(6)
    for _ in range(400):
        a = np.unique(np.array([r.randrange(1 << 63) for _ in range(r.choice([1, 5, 60, 700, 50_000 if r.random() < 0.02 else 90]))], np.uint64))
        b = np.unique(np.concatenate([a[[r.random() < 0.92 for _ in a]], np.array([r.randrange(1 << 63) for _ in range(len(a) // 12)], np.uint64)]))
        both = len(np.intersect1d(a, b))
        apart = np.abs(token_groups.signature(a).astype(int) - token_groups.signature(b).astype(int)).sum()
        if len(b) and token_groups.linked(len(a), len(b), both):
            assert token_groups.may_link(len(a), len(b), apart)


def test_unrelated_long_sets_are_told_apart():
    """with a fixed number of cells sets of many shingles look alike, and their texts were all sent."""
    rng = np.random.default_rng(2)
    for n in (300, 1100, 4000, 20_000):
        sets = [np.unique(rng.integers(0, 1 << 63, m).astype(np.uint64)) for m in (n, n, n - n // 10)]
        near = np.unique(np.concatenate([sets[0][n // 20 :], sets[1][: n // 25]]))
        assert token_groups.linked(len(near), len(sets[0]), len(np.intersect1d(near, sets[0])))
        signs = [token_groups.signature(s) for s in [*sets, near]]
        size = np.array([*map(len, sets), len(near)])
        i, j = np.array([0, 0, 1, 0]), np.array([1, 2, 2, 3])
        assert token_groups.may_link(size[i], size[j], apart(signs, signs, i, j)).tolist() == [False, False, False, True]


def test_folded_signatures_lose_no_link():
    """Sets on both sides of a doubling of the cells; counts that reach 255."""
    rng = np.random.default_rng(3)
    for n in (1020, 2045, 4090):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.concatenate([a, np.unique(rng.integers(0, 1 << 63, n // 9).astype(np.uint64))])
        x, y = token_groups.signature(a), token_groups.signature(b)
        assert len(y) == 2 * len(x) and token_groups.linked(len(a), len(b), len(a))
        assert apart([x], [y], np.array([0]), np.array([0])).tolist() == [len(b) - len(a)]
    full, twice = np.full(128, 255, np.uint8), np.full(256, 250, np.uint8)
    assert apart([full], [twice], np.array([0]), np.array([0])).tolist() == [0]


def test_a_family_is_not_joined_by_all_pairs(spark):
    """Near copies of one text meet in groups: rows made grow with the family, not with its square."""
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate(family(r, prose(200, 5).split(), 400, 3, "n"))]
    made, found = token_groups.links(token_groups.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    assert found.count() < 4 * made.select("_node").distinct().count()
    assert made.agg(F.count_distinct("_node")).first()[0] > 200
