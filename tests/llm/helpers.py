"""Small documents and plain versions of the operators."""

from __future__ import annotations

import random
import re
import string
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, extra: str = ""):
    """A table of texts, or of (doc_id, text) pairs, with the columns of documents."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(pool) for _ in range(n))


def components(rows: list[tuple[int, str]], width: int, percent: int) -> dict[int, int]:
    """Smallest doc_id that a document reaches over links, by brute force over all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def deduplicated(rows: list[tuple[int, str]], chars: int = 20, least: int = 3) -> dict[int, tuple[int, str]]:
    """(dropped lines, kept text) of each document."""
    blank = "\t\n\x0b\x0c\r "
    key = lambda line: line.strip(blank).translate(LOWER)
    held: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= least}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out[i] = (len(lines) - len(kept), "\n".join(kept))
    return out


def leaked(text: str, item: str, width: int = 5) -> float:
    """Best weighted shingle similarity of any window as long as the item."""
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    w, b = norm(text), norm(item)
    k = min(width, len(b))
    grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    best, target = 0.0, grams(b)
    for s in range(len(w) - len(b) + 1):
        own = grams(w[s : s + len(b)])
        best = max(best, sum((own & target).values()) / sum((own | target).values()))
    return best
