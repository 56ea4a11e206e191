"""Texts for the corpus tests."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ten", "ru", "vas", "élo", "Ünt") for b in ("sti", "nor", "pe", "dal", "x1", "gro", "bin")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def drifting() -> list[tuple[int, str]]:
    """Ids and texts of 100 words, each with four more words changed than the one before: one class, whose ends are unlike."""
    w, out = prose(100, 5).split(), []
    for i in range(60):
        out.append((i, " ".join(w)))
        for k in range(4):
            w[(i * 4 + k) % len(w)] = f"new{i}x{k}"
    return out


def size_bits(df) -> int:
    """Bits of the size that Spark's planner expects."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


#: Texts of every awkward kind: null, empty, blank, one word, very long, repeated, odd characters.
AWKWARD = [None, "", " \n\t ", "one", prose(60, 1), prose(60, 1), prose(9000, 2), "a" * 60_000, "x " * 500, "\x00\x1c\x85  é😀 漢字\n\n|||", "!!! ### $$$"]
