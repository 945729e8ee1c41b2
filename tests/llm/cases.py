"""Documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, bucket int, score double, block string, _id int"


def documents(seed: int = 3) -> list[tuple]:
    """Rows with nulls, empty and very long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = text(60), text(20)
    rows = [text(rng.randint(1, 80)) for _ in range(60)]
    rows += [base] * 12
    for _ in range(25):  # near copies, some closer than the threshold and some not
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [f"{text(rng.randint(3, 30))} {passage} {text(rng.randint(3, 30))}" for _ in range(15)]
    rows += ["a b c d e", "A b C d e", "a b c d e f", "a b", "a b", "x", "", "   \t\n ", None, None, "é ñ", "1234 5678", "\x00 \x01"]
    rows += [text(6000), "y" * 3000, " ".join(["same"] * 500), "z z   w"]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t) if t else None, "p", 1, 0.5, "q", 7) for i, t in enumerate(rows)]
    rng.shuffle(out)
    out += [out[3], out[3], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


def words_of(text: str | None, fold: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.translate(LOWER) if fold else raw).split()


def trimmed(rows: list[tuple], window: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    tokens = [(r[0], words_of(r[1])) for r in rows]
    for i, w in tokens:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words_of(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows: list[tuple], percent: int = 80) -> dict:
    """(doc_id, shingles) to smallest doc_id reachable, over the different sets."""
    sets: dict[frozenset, int] = {}
    for r in rows:
        s = shingles(r[1])
        if s and r[0] is not None:
            sets[s] = min(r[0], sets.get(s, r[0]))
    keys = list(sets)
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            n = len(keys[i] & keys[j])
            if n and 100 * n >= percent * (len(keys[i]) + len(keys[j]) - n):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, s in enumerate(keys):
        least[find(i)] = min(sets[s], least.get(find(i), sets[s]))
    return {s: least[find(i)] for i, s in enumerate(keys)}


def unigram_counts(rows: list[tuple], train) -> Counter:
    c: Counter = Counter()
    for r in rows:
        if train(r[0]):
            c.update([*words_of(r[1], True), b"\0end"])
    return c
